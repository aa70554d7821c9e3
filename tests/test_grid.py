"""The grid object, end to end, on point sets made from formulas."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadline.functions.names import family, utc_seconds, utc_text
from leadline.functions.rounding import is_power_of_two, power_of_two, to_mm
from leadline.grid import create_grid, is_grid, load_grid
from leadline.operators import cells as C
from leadline.operators import chunks, layers, neighbors, stats
from leadline.operators import resolution as R
from leadline.operators.keys import with_tiles
from leadline.operators.slopes import plane_slopes
from leadline.sources.shared import new_path
from leadline.streaming.ingest import ingest, running_cells, windowed_cells


def lattice(xs, ys, z, tvu=(1, 2), thu=(0.5, 1)):
    x, y = (a.ravel() for a in np.meshgrid(np.asarray(xs, float), np.asarray(ys, float)))
    out = {"x": x, "y": y, "z": np.linspace(*z, x.size).astype(np.float32)}
    if tvu:
        out |= {"tvu": np.linspace(*tvu, x.size).astype(np.float32), "thu": np.linspace(*thu, x.size).astype(np.float32)}
    return out


SMALL = lattice(range(0, 1000, 100), range(0, 1000, 100), (20, 30))
SMALL2 = lattice(range(0, 5000, 100), range(50000, 55000, 100), (20, 30))
SMALL3 = lattice(range(3000, 8000, 100), range(52000, 57000, 100), (20, 30))
DEEP = lattice(range(3000, 8000, 10), range(52000, 57000, 10), (500, 5000))
CLOSE = lattice(range(800, 1200, 100), range(800, 1200, 100), (5, 30))
ONLYZ = lattice(range(800, 1200, 100), range(800, 1200, 100), (5, 30), None)
FACE = {"x": np.array([200, 250, 300, 350, 400, 450, 500, 550, 600, 650, 700, 750, 800, 400, 600.0]), "y": np.array([600, 550, 500, 470, 440, 410, 400, 410, 440, 470, 500, 550, 600, 800, 800.0]), "z": np.linspace(5, 30, 15), "tvu": np.linspace(1, 2, 15), "thu": np.linspace(0.5, 1, 15)}


def structured(d):
    out = np.empty(len(d["x"]), [(n, "f8" if n in "xy" else "f4") for n in d])
    for n in d:
        out[n] = d[n]
    return out


def frame(spark, d, **more):
    return spark.createDataFrame(pd.DataFrame({n: np.asarray(v, float) for n, v in d.items()}).assign(**more))


@pytest.fixture
def vr(spark):
    return create_grid(spark, grid_type="variable_resolution_tile")


@pytest.fixture
def sr(spark):
    return create_grid(spark)


def test_single_resolution(sr):
    assert sr.is_empty and sr.no_grid and not sr.has_tiles
    sr.add_points(structured(SMALL2), "test1", ["line1", "line2"], 26917, "waterline")
    assert sr.return_extents() == [[0.0, 49152.0], [5120.0, 55296.0]] and sr.mean_depth == 25.0 and sr.number_of_tiles == 30 and sr.point_count_changed
    assert sr.containers == {"test1": ["line1", "line2"]} and sr.epsg == 26917 and sr.has_vertical_uncertainty
    assert sr.grid() == [1.0] and not sr.point_count_changed and not sr.no_grid
    got = sr.get_layers_by_name(["depth", "density", "horizontal_uncertainty", "vertical_uncertainty"])
    assert {a.size for a in got} == {31_457_280} and np.count_nonzero(~np.isnan(got[0])) == np.count_nonzero(got[1]) == 2500
    assert [float(a[848, 0]) for a in got] == [20.0, 1, 0.5, 1.0]


def test_coarser_trimmed_and_sign(sr):
    sr.add_points(SMALL2, "test1")
    assert sr.grid() == [1.0] and sr.grid(resolution=128, clear_existing=True) == [128.0]
    depth, density = sr.get_layers_by_name(["depth", "density"])
    assert depth.shape == (48, 40) and np.count_nonzero(~np.isnan(depth)) == 1521 and depth[6, 0] == pytest.approx(20.002, abs=1e-3) and density[6, 0] == 2
    up = sr.get_layers_by_name("depth", nodatavalue=1e6, z_positive_up=True)[0]
    assert np.count_nonzero(up != 1e6) == 1521 and up[6, 0] == pytest.approx(-20.002, abs=1e-3)
    (trimmed,), mins, maxs = sr.get_layers_trimmed("depth")
    assert trimmed.shape == (39, 39) and mins == [6, 0] and maxs == [45, 39]
    x, y, _, _, _ = sr.return_surf_xyz("depth")
    assert len(x) == len(y) == 40 and (x[0], y[0]) == (0.0, 49920.0)
    assert sr.return_surf_xyz("depth", cell_boundaries=False)[0][0] == 64.0
    tiles = list(sr.get_tiles_by_resolution(128.0, ["depth", "density"]))
    assert len(tiles) == 30 and sum(int(np.count_nonzero(t[4]["density"])) for t in tiles) == 1521 and tiles[0][0] == [0.0, 128.0, 0, 50176.0, 0, -128.0]


def test_variable_resolution(vr):
    vr.add_points(DEEP, "test1")
    assert vr.grid() == [32.0, 64.0, 128.0] and vr.cell_count == {32.0: 471, 64.0: 948, 128.0: 1320}
    with pytest.raises(ValueError):
        vr.get_layers_by_name("depth")
    cell = vr.cells().where("tile_x = 3968 and tile_y = 53120").collect()
    assert len(cell) >= 1
    deep = vr.cells().where("resolution = 128 and tile_x = 6784 and tile_y = 55168").first()
    assert deep is None or deep.density == 169


def test_areas_and_stale_resolutions(vr):
    vr.add_points(CLOSE, "close")
    assert vr.grid() == [0.25, 0.5, 1.0] and vr.cell_count == {0.25: 3, 0.5: 7, 1.0: 6} and vr.coverage_area_square_meters == 7.937
    vr.clear_grid()
    assert vr.no_grid
    vr.add_points(SMALL, "small")
    vr.grid()
    assert vr.cell_count == {1.0: 106, 0.5: 6}
    vr.remove_points("small")
    assert vr.point_count_changed
    vr.grid()
    assert vr.cell_count == {0.25: 3, 0.5: 10, 1.0: 10} and vr.points_count == 16


def test_single_resolution_areas(sr):
    sr.add_points(CLOSE, "close")
    assert sr.grid() == [0.5] and sr.cell_count == {0.5: 16} and sr.coverage_area_square_meters == 4.0 and sr.coverage_area_square_nm == pytest.approx(4 / 3434290.012)


def test_update_only_what_changed(sr):
    sr.add_points(SMALL2, "test1")
    sr.grid(resolution=64.0)
    sr.add_points(SMALL3, "test2")
    assert sr.point_count_changed and sr.grid(resolution=64.0, regrid_option="update") == [64.0] and not sr.point_count_changed
    updated = sr.cells().orderBy(*layers.KEYS).collect()
    sr.grid(resolution=64.0, clear_existing=True)
    assert sr.cells().orderBy(*layers.KEYS).collect() == updated


def test_replaced_repeats_are_seen(sr):
    two = lambda z: {"x": [10.0, 10.0], "y": [10.0, 10.0], "z": [z, z]}
    sr.add_points(two(20.0), "a")
    sr.grid(resolution=64.0)
    assert sr.layer_values_at_xy(10.0, 10.0) == 20.0
    sr.remove_points("a")
    sr.add_points(two(55.0), "a")
    assert sr.point_count_changed
    sr.grid(resolution=64.0, regrid_option="update")
    assert sr.layer_values_at_xy(10.0, 10.0) == 55.0 and not sr.point_count_changed
    sr.replace_points(two(60.0), "a")
    assert sr.points_count == 2 and sr.point_count_changed
    sr.grid(resolution=64.0, regrid_option="update")
    assert sr.layer_values_at_xy(10.0, 10.0) == 60.0


def test_update_reads_and_writes_touched_blocks_only(spark):
    g = create_grid(spark, tile_size=64.0)
    far = lattice(range(0, 8000, 100), range(0, 8000, 100), (20, 30))
    g.add_points(far, "all")
    g.grid(resolution=8.0)
    (first,) = g._m["cells"]
    every = set(g._m["cells"][first])
    assert len(every) == 64
    g.add_points({"x": [5.0], "y": [5.0], "z": [50.0]}, "one")
    g.grid(resolution=8.0, regrid_option="update")
    (second,) = set(g._m["cells"]) - {first}
    assert set(g._m["cells"][second]) == {"0_0"} and set(g._m["cells"][first]) == every - {"0_0"}
    assert g.cell_count == {8.0: 6400} and g.layer_values_at_xy(5.0, 5.0) == 35.0
    plan = g._tiled({"0_0"})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "block" in plan.split("PartitionFilters")[1][:120]
    assert len(g._tiled({"0_0"}).inputFiles()) >= 1 and g._tiled({"0_0"}).count() == 122
    g.remove_points("all")  # the cells of tiles without points go at once
    assert g.cell_count == {8.0: 1}


def test_a_failed_write_leaves_the_grid(spark, sr, monkeypatch):
    sr.add_points(CLOSE, "a")
    sr.grid(resolution=64.0)
    before = sr.cells().count()
    other = load_grid(spark, sr.output_folder)
    other.add_points(SMALL, "b")
    with pytest.raises(OSError):  # someone else's manifest is not replaced
        sr.add_points(SMALL, "c")
    assert list(sr.containers) == ["a"] and sr.points_count == 16  # what failed is not believed to be there
    again = load_grid(spark, sr.output_folder)
    assert list(again.containers) == ["a", "b"] and again.cells().count() == before


def test_many_containers_are_one_scan(spark, sr):
    import time

    sr.add_points({"x": [1.0], "y": [1.0], "z": [1.0]}, "c0")
    first = sr._m["containers"]["c0"]["batch"]
    fs = f"{sr._store.root}/points".removeprefix("file:")
    import shutil

    for i in range(1, 2000):
        shutil.copytree(f"{fs}/batch={first}", f"{fs}/batch={i:032d}")
        sr._m["containers"][f"c{i}"] = {**sr._m["containers"]["c0"], "batch": f"{i:032d}", "seq": i}
    sr._frames = {}
    sr.points()  # classes are loaded
    sr._frames = {}
    began = time.time()
    plan = sr.points()._jdf.queryExecution().executedPlan().toString()
    took = time.time() - began
    assert plan.count("FileScan") == 1 and sr.points_count == 2000 and took < 6  # 0.9 s here, when nothing else runs


def test_batches_without_depths_or_places(sr, vr):
    for g in (sr, vr):
        spark = g.spark
        rows = spark.createDataFrame([(None, 5.0, None), (5.0, 5.0, None)], "x double, y double, z float")
        g.add_points(rows, "nulls")
        assert g.points_count == 2 and g.number_of_tiles == 1 and g.mean_depth == 0.0
        g.add_points(rows.limit(0), "empty")
        assert g.points_count == 2 and g.containers.keys() == {"nulls", "empty"}
        assert g.grid(resolution=64.0) == [64.0] and g.cell_count == {} and g.cells().first().density == 1
        g.grid(resolution=64.0, regrid_option="update")
        assert g.points().count() == 2
        copy = g.save(new_path(spark, "copy"))
        assert load_grid(spark, copy.output_folder).points().count() == 2 and copy.cells().count() == 1
        g.remove_points("nulls")
        assert g.cells().count() == 0 and g.points_count == 0


def test_places_that_are_none(sr):
    bad = [np.nan, np.inf, -np.inf, 5.0]
    sr.add_points({"x": bad, "y": [5.0] * 4, "z": [1.0, 2.0, 3.0, 4.0]}, "a", vertical_reference="waterline")
    assert sr.points_count == 4 and sr.number_of_tiles == 1 and sr.return_extents() == [[0.0, 0.0], [1024.0, 1024.0]]
    assert sr.grid(resolution=64.0) == [64.0] and sr.cells().count() == 1 and sr.layer_values_at_xy(5.0, 5.0) == 4.0


class Dataset(dict):
    """Like a dataset of arrays: iterates over its data, has its coordinates among the variables, computes to itself."""

    def __init__(self, data, coords):
        super().__init__(data)
        self.coords, self.variables = coords, {**data, **coords}

    def __getitem__(self, name):
        return self.variables[name]

    def compute(self):
        return self


def test_datasets_with_coordinates(sr):
    sr.add_points(Dataset({"z": CLOSE["z"], "beam": np.arange(16)}, {"x": CLOSE["x"], "y": CLOSE["y"]}), "d")
    assert sr.points().columns == ["x", "y", "z", "container"] and sr.points().agg(F.sum("x")).first()[0] == CLOSE["x"].sum()


def test_coordinate_systems(sr):
    sr.add_points(CLOSE, "a", crs="EPSG:26917")
    assert sr.epsg == 26917
    sr.add_points(CLOSE, "b", crs="26917")
    with pytest.raises(ValueError):
        sr.add_points(CLOSE, "c", crs="+proj=utm +zone=17")


def test_container_layers(sr):
    sr.add_points(SMALL2, "a")
    sr.add_points(SMALL3, "b")
    sr.grid(resolution=128.0)
    both, a, b = sr.get_layers_by_name(["density", "a_density", "b_density"], 128.0)
    assert both.sum() == 5000 and a.sum() == b.sum() == 2500 and (a + b == both).all()
    assert sr.layer_names == ["depth", "density", "vertical_uncertainty", "horizontal_uncertainty"]
    slopes = sr.layer_cells(["x_slope", "y_slope"], 128.0).where("x_slope is not null").count()
    assert slopes > 0


def test_backscatter(spark):
    g = create_grid(spark, grid_backend="zarr", is_backscatter=True)
    g.add_points(ONLYZ, "test1", None, 26917, "waterline")
    assert g.grid(resolution=8.0) == [8.0] and g.layer_names == ["intensity", "density"] and g.cell_count == {8.0: 16} and g.coverage_area_square_meters == 1024.0
    with pytest.raises(ValueError):
        g.export("/tmp/never", "bag")


def test_extents_grow_by_a_tile_a_batch(sr):
    for i in range(6):
        sr.add_points(FACE, f"em_{i}" if i else "survey__line", ["l"], 26917, "waterline", 1625235801.123 + i, 1625235901.5 + i)
    e = sr.return_extents()
    assert e[1][0] - e[0][0] == 6144.0 == e[1][1] - e[0][1] and sr.number_of_tiles == 1
    assert sr.min_time == "2021-07-02T14:23:21" and sr.max_time == "2021-07-02T14:25:06"
    assert sr.return_unique_containers() == ["survey", "em_1", "em_2", "em_3", "em_4", "em_5"]
    told = sr.return_attribution()
    assert told["height"] == 6144.0 and told["source_survey"]["multibeam_lines"] == ["l"] and "containers" in repr(sr)


def test_lookups(sr, vr):
    sr.add_points(CLOSE, "c")
    sr.grid(resolution=64.0)
    assert sr.layer_values_at_xy(801.0, 801.0) == 5.0 and np.isnan(sr.layer_values_at_xy(0.0, 0.0))
    got = sr.layer_values_at_xy(np.array([[800.0, 900.0], [-5.0, 1e9]]), np.array([[800.0, 800.0], [0.0, 0.0]]), nodatavalue=-1.0)
    assert got.tolist() == [[5.0, pytest.approx(6.667)], [-1.0, -1.0]]
    with pytest.raises(ValueError):
        sr.layer_values_at_xy(np.zeros(2), np.zeros(3))
    vr.add_points(CLOSE, "c")
    vr.grid()
    assert vr.layer_values_at_xy(np.array([800.1, 1100.1]), np.array([800.1, 1100.1])).tolist() == [5.0, 30.0]


def test_chunks_of_tiles(sr):
    sr.add_points(SMALL2, "test1")
    sr.grid(resolution=64.0)
    one = list(sr.get_chunks_of_tiles(64.0, ["depth", "density"]))
    assert len(one) == 1 and one[0][2]["depth"].shape == (96, 80) and one[0][0] == [0.0, 64.0, 0, 55296.0, 0, -64.0] and one[0][1] == 6144.0
    four = list(sr.get_chunks_of_tiles(64.0, ["density"], override_maximum_chunk_dimension=2048))
    assert four[0][2]["density"].shape == (32, 32) and four[0][0][3] == 51200.0 and sum(int((c[2]["density"] > 0).sum()) for c in four) == int((one[0][2]["density"] > 0).sum())


def test_guards(spark, sr):
    with pytest.raises(ValueError):
        sr.grid()
    with pytest.raises(ValueError):
        sr.cells() or sr.get_layers_by_name("depth")
    for bad in ({"x": [1.0], "y": [1.0]}, np.zeros(3), np.zeros((2, 2)), "points"):
        with pytest.raises(ValueError):
            sr.add_points(bad, "bad")
    sr.add_points(CLOSE, "c", crs=26917, vertical_reference="waterline")
    with pytest.raises(ValueError):
        sr.add_points(CLOSE, "c", crs=26917, vertical_reference="waterline")
    with pytest.raises(ValueError):
        sr.add_points(CLOSE, "d", crs=1, vertical_reference="waterline")
    with pytest.raises(ValueError):
        sr.add_points(CLOSE, "d", crs=26917, vertical_reference="ellipse")
    for bad in ({"algorithm": "median"}, {"resolution": 3.0}, {"auto_resolution_mode": "x"}, {"regrid_option": "x"}):
        with pytest.raises(ValueError):
            sr.grid(**bad)
    sr.grid(resolution=64.0)
    with pytest.raises(ValueError):
        sr.grid("shoalest", resolution=64.0)
    assert sr.grid("shoalest", resolution=64.0, clear_existing=True) == [64.0]
    sr.remove_points("never added")
    with pytest.raises(ValueError):
        create_grid(spark, tile_size=1000)
    with pytest.raises(ValueError):
        create_grid(spark, grid_type="quad")


def test_save_load_and_csv(spark, vr, tmp_path):
    vr.add_points(CLOSE, "c", ["f"], 26917, "waterline", 1.0, 2.0)
    vr.grid()
    copy = vr.save(str(tmp_path / "saved"))
    back = load_grid(spark, str(tmp_path / "saved"))
    assert is_grid(spark, copy.output_folder) and not is_grid(spark, str(tmp_path))
    order = list(layers.KEYS)
    assert back.cells().orderBy(*order).collect() == vr.cells().select(*back.cells().columns).orderBy(*order).collect()
    assert back.points().orderBy("x", "y").collect() == vr.points().orderBy("x", "y").collect() and back.resolutions == vr.resolutions and back.containers == {"c": ["f"]}
    back.remove_points("c")
    assert back.is_empty and not vr.is_empty
    vr.grid(resolution=64.0, clear_existing=True)
    (path,) = vr.export(str(tmp_path / "out.csv"))
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "x y elevation density vertical_uncertainty horizontal_uncertainty" and len(lines) == 37 and lines[1].startswith("800.000 800.000 -5.000 1 ") and "nan 0 nan nan" in "\n".join(lines)
    assert vr.export(str(tmp_path / "out.csv"))[0] != path
    (folder,) = vr.export(str(tmp_path / "parts.csv"), single_file=False)
    assert os.path.isfile(path) and os.path.isdir(folder) and sorted(set(r.value for r in spark.read.text(folder).collect())) == sorted(set(lines))
    with pytest.raises(ValueError):
        vr.export("x", "xyz")


def test_statistics(sr):
    sr.add_points(SMALL2, "a")
    sr.grid(resolution=128.0)
    d = sr.densities().agg(F.sum("density"), F.sum("density_m2")).first()
    assert d[0] == 2500 and d[1] == pytest.approx(2500 / 128**2)
    h = sr.histogram("density", 5).orderBy("bin").collect()
    assert sum(r.n for r in h) == 1521 and h[0].low == 1.0 and h[-1].high == 4.0
    depth = sr.return_layer_values("depth").toPandas()["value"].to_numpy()
    want, edges = np.histogram(depth.astype(float), 50)
    got = sr.histogram("depth").orderBy("bin").collect()
    assert [r.n for r in got] == want.tolist() and np.allclose([r.low for r in got], edges[:-1])
    assert sr.density_vs_depth(10).count() == 10 and sr.tile_summary().count() == 30
    assert stats.histogram(sr.cells().where("density > 3").select(F.lit(2.0).alias("value")), 4).agg(F.sum("n")).first()[0] > 0


def test_mean_and_shoalest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.random(500) * 8, "y": rng.random(500) * 8, "z": rng.integers(1, 6, 500) * 1.5, "tvu": rng.random(500), "thu": rng.random(500)})
    pdf.loc[5, ["tvu", "thu"]] = None
    points = spark.createDataFrame(pdf)
    cell = [np.floor(pdf["y"]).astype(int), np.floor(pdf["x"]).astype(int)]
    mean = {(r.row, r.col): r for r in C.single_resolution(points, "mean", 1.0, tile_size=8.0).collect()}
    shoal = {(r.row, r.col): r for r in C.single_resolution(points, "shoalest", 1.0, tile_size=8.0).collect()}
    for key, g in pdf.groupby(cell):
        assert mean[key].density == len(g) == shoal[key].density and mean[key].depth == pytest.approx(g["z"].mean(), abs=6e-4)
        top = g.assign(t=g["tvu"].fillna(-1)).sort_values(["z", "t", "thu"]).iloc[0]
        assert shoal[key].depth == top["z"] and (np.isnan(top["tvu"]) or shoal[key].vertical_uncertainty == pytest.approx(top["tvu"], abs=6e-4))


def test_slopes(spark):
    rng = np.random.default_rng(2)
    x, y = 403_744 + rng.random(200) * 8, 4_122_664 + rng.random(200) * 8
    cloud = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": 0.25 * x - 0.5 * y + 7}))
    line = spark.createDataFrame(pd.DataFrame({"x": [1.0, 2.0, 3.0], "y": [1.0, 2.0, 3.0], "z": [2.0, 4.0, 6.0]}))
    lone = spark.createDataFrame(pd.DataFrame({"x": [9.0], "y": [1.0], "z": [5.0]}))
    keyed = lambda d: with_tiles(d, 8.0).withColumn("resolution", F.lit(8.0))
    for r in plane_slopes(keyed(cloud)).collect():
        assert r.x_slope == pytest.approx(0.25, abs=1e-6) and r.y_slope == pytest.approx(-0.5, abs=1e-6)
    r = plane_slopes(keyed(line)).first()
    want = np.linalg.lstsq(np.array([[1, 1, 1], [2, 2, 1], [3, 3, 1.0]]), np.array([2, 4, 6.0]), rcond=None)[0]
    assert (r.x_slope, r.y_slope) == (pytest.approx(want[0]), pytest.approx(want[1]))
    assert plane_slopes(keyed(lone), fill_singular=False).first().x_slope is None and plane_slopes(keyed(lone)).first().x_slope is not None


def test_slopes_of_all_cells(spark, tmp_path):
    from leadline.plans import survey

    # One sounding; two; four on a line, one place twice; one place three times; five in a plane.  x within a cell of 4 m each.
    cells = [[(1, 0)], [(4, 1), (6, 3)], [(8, 0), (9, 1), (10, 2), (11, 3), (9, 1)], [(13, 2)] * 3, [(16, 0), (17, 3), (18, 1), (19, 2), (16, 2)]]
    flat = [(x, y, 8 * i) for c in cells for i, (x, y) in enumerate(c)]
    rows = [(x, 1, 0, y, float(q), 0.0, 0.0, "A", "F") for x, y, q in flat]
    spark.createDataFrame(rows, "l_partkey long, l_linenumber int, l_suppkey long, l_orderkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.col: (r.x_slope, r.y_slope) for r in survey.plane_slopes_all(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for col, c in enumerate(cells):
        a = np.array([[x + 0.125, y + 0.5, 1.0] for x, y in c])
        want = np.linalg.lstsq(a, np.array([i + 0.25 * x for i, (x, _) in enumerate(c)]), rcond=None)[0]
        assert got[col] == (pytest.approx(want[0], abs=2e-6), pytest.approx(want[1], abs=2e-6))
    assert survey.plane_slopes_query(spark, str(tmp_path)).count() == 1


def test_resolutions(spark):
    depths = [0.5, 9.99, 10.0, 20.0, 39.0, 20479.0, 20480.0, -5.0]
    df = spark.createDataFrame([(d,) for d in depths], "d double")
    assert [r.r for r in df.select(R.by_depth(F.col("d"), 128.0).alias("r")).collect()] == [0.25, 0.25, 0.5, 1.0, 1.0, 128.0, 0.25, 0.25]
    assert R.resolution_for_depth(25.0, 1024) == 1.0
    for bad in (0.0, None):
        with pytest.raises(ValueError):
            R.resolution_for_depth(bad, 1024)
    with pytest.raises(ValueError):
        R.by_density(df, 128.0, start=666.0)


def test_powers_and_rounding(spark):
    good, bad = [2.0**k for k in range(-10, 51, 6)] + [1.0, 0.5], [1.99**50, 2.01**5, 4.104, 1.00001, 0.5124, 0.0, -2.0, 2.01**-3]
    assert all(map(is_power_of_two, good)) and not any(map(is_power_of_two, bad))
    df = spark.createDataFrame([(v,) for v in good + bad], "v double")
    assert [r.p for r in df.select(power_of_two(F.col("v")).alias("p")).collect()] == [True] * len(good) + [False] * len(bad)
    v = np.random.default_rng(3).random(300).astype(np.float32) * 100
    got = spark.createDataFrame(pd.DataFrame({"v": v})).select(to_mm(F.col("v"), True).alias("r")).toPandas()["r"].to_numpy()
    assert (got == np.round(v, 3)).all()


def test_names_and_times(spark):
    df = spark.createDataFrame([("a__b", 1625235801), ("a__b__c", 0), ("plain", None)], "c string, t bigint")
    got = df.select(family(F.col("c")).alias("f"), utc_text(F.col("t")).alias("u"), utc_seconds(utc_text(F.col("t"))).alias("s")).collect()
    assert [tuple(r) for r in got] == [("a", "2021-07-02T14:23:21", 1625235801), ("a__b__c", "1970-01-01T00:00:00", 0), ("plain", None, None)]


def test_neighbors_and_halo(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": rng.random(400) * 48, "y": rng.random(400) * 48, "z": 1.0})
    tiled = with_tiles(spark.createDataFrame(pdf), 16.0)
    got = {(r.tile_x, r.tile_y, r.side): (r.neighbor_x, r.neighbor_y) for r in neighbors.tile_neighbors(tiled, 16.0).collect()}
    assert len(got) == 24 and got[16.0, 16.0, "south"] == (16.0, 0.0) and got[16.0, 16.0, "east"] == (32.0, 16.0) and (0.0, 0.0, "west") not in got
    middle = neighbors.halo_points(tiled, 16.0, 2.0).where("for_x = 16 and for_y = 16").count()
    x, y = pdf["x"], pdf["y"]
    ring = ((x >= 14) & (x < 16) & (y >= 16) & (y < 32)) | ((x >= 32) & (x <= 34) & (y >= 16) & (y < 32)) | ((y >= 14) & (y < 16) & (x >= 16) & (x < 32)) | ((y >= 32) & (y <= 34) & (x >= 16) & (x < 32))
    assert middle == ring.sum()


@pytest.mark.parametrize(("n", "longest"), [(1, 1), (5, 2), (10, 3), (7, 7), (9, 4), (12, 5)])
def test_sections_like_array_split(spark, n, longest):
    tiles = spark.createDataFrame([(float(i), 0.0) for i in range(n)], "tile_x double, tile_y double")
    got = [r.chunk for r in chunks.chunk_tiles(tiles, 1.0, longest).orderBy("tile_x").collect()]
    want = [i for i, part in enumerate(np.array_split(np.arange(n), -(-n // longest))) for _ in part]
    assert got == want


def test_methods_can_be_added(spark):
    C.register("deepest", lambda points, single: [F.max("z").alias("depth"), F.count("*").alias("density")])
    assert C.single_resolution(frame(spark, CLOSE), "deepest", 1024.0).agg(F.max("depth")).first()[0] == 30.0 and "deepest" in C.methods()


def test_streams(spark, sr, tmp_path):
    source = tmp_path / "in"
    frame(spark, SMALL).write.parquet(str(source / "1"))
    schema = "x double, y double, z double, tvu double, thu double"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
    for i in (1, 2):
        q = ingest(stream, sr, "live", str(tmp_path / "cp"), resolution=64.0)
        q.processAllAvailable()
        q.stop()
        assert sr.points_count == 100 * i and len(sr.containers) == i and not sr.point_count_changed
        frame(spark, SMALL3).limit(100).write.mode("append").parquet(str(source / "2"))
    q = running_cells(stream, 64.0).writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("running").agg(F.sum("density")).first()[0] == 300
    timed = stream.withColumn("t", F.timestamp_seconds(F.col("x").cast("bigint")))
    q = windowed_cells(timed, "t", 64.0, "10 minutes", "5 minutes").writeStream.format("memory").queryName("windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").count() > 0
