"""The CUBE estimator: published figures of two point sets, and its parts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadline.grid import create_grid
from leadline.operators.cube import Nodes, Raster, choose, hypotheses


def ramp(width, height):
    x, y = (a.ravel() for a in np.meshgrid(403744 + np.linspace(0, width, 50), 4122687 + np.linspace(0, height, 50)))
    return x, y, np.linspace(10, 20, 2500), np.linspace(0.3, 0.7, 2500), np.linspace(0.3, 0.7, 2500)


def test_kernel():
    x, y, z, tvu, thu = ramp(2, 3)
    inside = y > y.min()  # the lower border belongs to the raster below
    raster = Raster(403744, 4122687, 3, 3, 1.0)
    for part in np.array_split(np.flatnonzero(inside), 4):
        raster.add(*(a[part] for a in (x, y, z, tvu, thu)))
    found = choose(hypotheses(raster.finish()).assign(row=lambda d: d["node"] // 3, col=lambda d: d["node"] % 3))
    assert np.allclose(found["depth"], [11.824, 11.928, 12.148, 15.116, 15.192, 15.379, 17.912, 17.972, 18.353], atol=1e-3)
    assert np.allclose(found["total_uncertainty"], [0.109, 0.109, 0.663, 0.116, 0.116, 0.349, 0.135, 0.136, 0.313], atol=1e-3)
    assert (found["hypothesis_count"] == 1).all() and (found["hypothesis_ratio"] == 0).all()


def test_grid(spark):
    x, y, z, tvu, thu = ramp(3, 3)
    g = create_grid(spark)
    g.add_points({"x": x, "y": y, "z": z, "tvu": tvu, "thu": thu}, "test1", None, 26917, "waterline")
    assert g.grid("cube", resolution=2.0, grid_parameters={"variance_selection": "cube", "method": "local", "iho_order": "order1a"}) == [2.0]
    got = g.get_layers_by_name(["depth", "density", "total_uncertainty", "hypothesis_count", "hypothesis_ratio"])
    assert {a.size for a in got} == {262_144} and np.count_nonzero(~np.isnan(got[0])) == np.count_nonzero(got[3]) == 4 and np.count_nonzero(got[1]) == 6
    assert [float(a[31, 144]) for a in got] == [pytest.approx(10.784, abs=1e-3), 561, pytest.approx(0.125, abs=1e-3), 1, 0.0]
    with pytest.raises(ValueError):
        g.grid("cube", resolution=2.0, grid_parameters={"method": "guess"})


def test_two_surfaces_make_two_hypotheses():
    nodes = Nodes(2)
    rng = np.random.default_rng(1)
    z = np.where(np.arange(90) % 3 == 0, 30.0, 10.0) + 0.05 * rng.standard_normal(90)
    nodes.feed(np.zeros(90, np.int64), z, np.full(90, 0.01))
    nodes.feed(np.ones(40, np.int64), 30.0 + 0.05 * rng.standard_normal(40), np.full(40, 0.01))
    nodes.flush()
    hyp = hypotheses(nodes).assign(row=0, col=lambda d: d["node"])
    assert (hyp["node"] == 1).sum() == 1
    if (hyp["node"] == 0).sum() > 1:
        prior, local = (choose(hyp, m).set_index("col")["depth"] for m in ("prior", "local"))
        assert prior[0] == pytest.approx(10, abs=0.2) and local[0] == pytest.approx(30, abs=0.5)


def test_few_soundings_and_blocks(spark):
    nodes = Nodes(1)
    nodes.feed(np.zeros(3, np.int64), np.array([5.0, 7.0, 6.0]), np.ones(3))
    assert nodes.count[0] == 0
    nodes.flush()
    assert nodes.size.sum() == 3 and nodes.mean[0, 0] == pytest.approx(6.0)
    rng = np.random.default_rng(2)
    n = 4000
    pdf = pd.DataFrame({"x": rng.random(n) * 256, "y": rng.random(n) * 256, "z": 40 + rng.standard_normal(n) * 0.1, "tvu": 0.04, "thu": 0.04})
    pdf.loc[:5, "tvu"] = None
    from leadline.operators import cells as C

    got = C.variable_resolution(spark.createDataFrame(pdf).withColumn("container", F.lit("a")), "cube", resolution=4.0, leaf=128.0)
    r = got.agg(F.sum("density"), F.min("depth"), F.max("depth"), F.count("depth")).first()
    assert r[0] == n and 39.5 < r[1] <= r[2] < 40.5 and r[3] > 2000


def test_query_goes_by_depth(spark, data):
    from leadline.plans import survey

    keys = ["tile_x", "tile_y", "resolution"]
    cells = survey.cube_grid(spark, data).cache()
    tiles = lambda df: {tuple(r) for r in df.select(*keys).distinct().collect()}
    assert tiles(cells) == tiles(survey.vr_mean_auto_depth(spark, data))
    # Every sounding is counted, at the same cells as those of the mean.
    own = lambda df: {tuple(r) for r in df.where("density > 0").select(*keys, "row", "col", "density").collect()}
    assert own(cells) == own(survey.vr_mean_auto_depth(spark, data))
    cells.unpersist()


def test_parts_of_a_tile_choose_as_the_whole(spark, monkeypatch):
    import leadline.operators.cube as cube

    rng = np.random.default_rng(8)
    n = 3000
    pdf = pd.DataFrame({"x": rng.random(n) * 64, "y": rng.random(n) * 64, "z": rng.choice([20.0, 26.0], n) + rng.standard_normal(n) * 0.05, "tvu": 0.01, "thu": 0.01})
    points = spark.createDataFrame(pdf)
    from leadline.operators import cells as C

    got = []
    for part in (128, 16):
        monkeypatch.setattr(cube, "PART", part)
        found = C.single_resolution(points, "cube", 2.0, tile_size=64.0)
        got.append(sorted(map(tuple, found.select("row", "col", "depth", "hypothesis_count", "density").collect())))
    assert got[0] == got[1] and len(got[0]) > 900 and any(r[3] > 1 for r in got[0])
