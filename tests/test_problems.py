"""The general data problems: brute force on small fixtures, and the odd cases."""

import math
import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.operators.heavy import heavy_keys, per_key, salted, skew_join
from leadline.operators.near import Quadtree, RTree, near_counts, near_pairs, near_pairs_in_regions, points_in_regions
from leadline.operators.smallfiles import archive_files, consolidate, files_adding_nothing
from leadline.operators.spikes import flag_implausible, forward_backward
from leadline.sources.archive import decode_ids, encode_ids, pack

START = datetime(2015, 1, 1, tzinfo=UTC)
READINGS = T.StructType([T.StructField("point_id", T.LongType()), T.StructField("z", T.FloatType()), T.StructField("tvu", T.FloatType()), T.StructField("container", T.StringType()), T.StructField("ping_time", T.TimestampType()), T.StructField("_source", T.StringType())])


def readings(spark, zs, container="a", tvu=None, first=0):
    rows = [(first + i, None if z is None else float(z), None if tvu is None else tvu[i], container, START + timedelta(seconds=i), "clash") for i, z in enumerate(zs)]
    return spark.createDataFrame(rows, READINGS)


def noise(n, base=20.0, scale=0.1, seed=1):
    return base + scale * np.random.default_rng(seed).standard_normal(n)


def flagged(df, **kw):
    return {(r.point_id, r.channel): r.state for r in flag_implausible(df, **kw).collect()}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    emit, move, prior = rng.random((7, 3)), rng.random((3, 3)), np.array([0.5, 0.3, 0.2])
    move /= move.sum(axis=1, keepdims=True)
    want = np.zeros((7, 3))
    for path in np.ndindex(*[3] * 7):
        p = prior[path[0]] * emit[0, path[0]]
        for t in range(1, 7):
            p *= move[path[t - 1], path[t]] * emit[t, path[t]]
        for t in range(7):
            want[t, path[t]] += p
    first = np.zeros(7, bool)
    first[0] = True
    got = forward_backward(emit, move, prior, first, block=3)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_spikes_stuck_and_bounds(spark):
    z = noise(400)
    z[50:53] += 8
    z[100:130] = 20.123
    z[200], z[210], z[220] = float("nan"), 1e6, float("inf")
    z[300:] += 5  # a change of place
    got = flagged(readings(spark, z))
    want = {(i, "z"): "spike" for i in range(50, 53)} | {(i, "z"): "stuck" for i in range(100, 130)} | {(i, "z"): "out_of_range" for i in (200, 210, 220)}
    assert got == want


def test_slopes_rough_noise_and_constant_uncertainty_are_no_cases(spark):
    z = np.concatenate([noise(150), np.linspace(20, 60, 150) + noise(150, 0), noise(60, 60, 0.25, 5), noise(150, 60)])
    assert flagged(readings(spark, z, tvu=[0.25] * len(z))) == {}


def test_uncertainties(spark):
    tvu = [float(t) for t in noise(200, 0.3, 0.03, 2)]
    tvu[20], tvu[40], tvu[60], tvu[80] = -1.0, 0.0, 5.0, None
    assert flagged(readings(spark, noise(200), tvu=tvu)) == {(20, "tvu"): "out_of_range", (40, "tvu"): "out_of_range", (60, "tvu"): "spike"}


def test_drying_heights(spark):
    shallow, deep = noise(200, 0.2, 0.1), noise(200, 40.0, 0.1)
    deep[70] = -2.0
    both = readings(spark, shallow).unionByName(readings(spark, deep, "b", first=1000))
    assert flagged(both) == {(1070, "z"): "out_of_range"}


def test_slices_give_the_same(spark):
    z = noise(3000)
    z[500:502] -= 6
    z[1400:1460] = 19.9
    both = readings(spark, z).unionByName(readings(spark, noise(300, 5, 0.1, 4), "b", first=10_000))
    assert flagged(both, slice_rows=400) == flagged(both) != {}


def test_readings_with_nulls_repeats_and_empty(spark):
    z = list(noise(120))
    z[10] = z[11] = None
    z[60] += 9
    df = readings(spark, z)
    odd = spark.createDataFrame([(None, 1.0, None, "a", START, "x"), (5000, 1.0, None, None, START, "x"), (5001, 1.0, None, "a", None, "x")], READINGS)
    assert flagged(df.unionByName(df).unionByName(odd)) == {(60, "z"): "spike"}
    assert flagged(df.limit(0)) == {}
    assert flagged(readings(spark, [None] * 5)) == {} == flagged(readings(spark, [3.0]))


def test_heavy_keys(spark):
    keys = ["big"] * 400 + [f"k{i}" for i in range(500)] + [None] * 100
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, v int").repartition(7)
    assert [tuple(r) for r in heavy_keys(df, {"key": F.col("key")}, 0.4).collect()] == [("key", "big", 400)]
    assert heavy_keys(df, {"key": F.col("key")}, 0.41).collect() == []
    assert heavy_keys(df.limit(0), {"key": F.col("key")}, 0.1).collect() == []
    got = {r.key_name: (r.n, r.is_heavy) for r in per_key(df.withColumnRenamed("v", "is_heavy").withColumn("n", F.lit(1)), {"key": F.col("key")}, [F.count("*").alias("n")], 0.1).collect()}
    assert got["big"] == (400, True) and got["k7"] == (1, False) and len(got) == 501
    with pytest.raises(ValueError):
        heavy_keys(df, {"key": F.col("key")}, 0)


def test_per_key_counts_null_keys_in_the_base(spark):
    df = spark.createDataFrame([("big",)] * 400 + [(f"k{i}",) for i in range(500)] + [(None,)] * 100, "key string").repartition(3)
    flag = lambda share: {r.key_name: r.is_heavy for r in per_key(df, {"key": F.col("key")}, [F.count("*").alias("n")], share).collect()}
    got = flag(0.42)  # 44 % of the rows with a key, 40 % of all
    assert not any(got.values()) and len(got) == 501 and flag(0.4)["big"]


def test_heavy_keys_of_a_tiny_share(spark):
    df = spark.range(300_000).select(F.when(F.col("id") < 12, F.lit("some")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"))
    assert [tuple(r) for r in heavy_keys(df, {"key": F.col("key")}, 4e-5).collect()] == [("key", "some", 12)]
    assert heavy_keys(df, {"key": F.col("key")}, 4.1e-5).collect() == []


def skewed(spark, n=40_000):
    return spark.range(n).select(F.when(F.col("id") % 10 < 9, F.lit("big")).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("key"), F.col("id").alias("v")).repartition(8)


def test_per_key_of_lists_is_salted_or_refused(spark):
    df, lists = skewed(spark), [F.collect_list("v").alias("v"), F.countDistinct("v").alias("n")]
    for refused in (lists, [F.percentile("v", 0.5).alias("p")], [F.collect_set("v").alias("s")]):
        with pytest.raises(ValueError):
            per_key(df, {"key": F.col("key")}, refused, 0.1)
    lists = [F.collect_list("v").alias("v")]
    got = {r.key_name: (sorted(r.v), r.is_heavy) for r in per_key(df, {"key": F.col("key")}, lists, 0.1, merge=[F.flatten(F.collect_list("v")).alias("v")]).collect()}
    want = {}
    for r in df.collect():
        want.setdefault(r.key, []).append(r.v)
    assert {k: v for k, (v, _) in got.items()} == {k: sorted(v) for k, v in want.items()} and [k for k, (_, h) in got.items() if h] == ["big"]
    # No part of the heavy key is more than twice the middle one.
    parts = [r["count"] for r in df.where("key = 'big'").withColumn("_part", salted(df, 64)).groupBy("_part").count().collect()]
    assert len(parts) == 64 and max(parts) <= 2 * sorted(parts)[32]


def test_skew_join_against_brute_force(spark):
    left = skewed(spark, 3000).unionByName(spark.createDataFrame([(None, 1), ("lonely", 2)], "key string, v long"))
    right = spark.createDataFrame([("big", 1.0), ("big", 2.0), ("k1", 3.0), ("k9", 4.0), (None, 5.0), ("unused", 6.0)], "key string, w double")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "key", how).select("key", "v", "w").collect()))
        for most in (100, 1):  # by broadcast, and salted
            assert sorted(map(str, skew_join(left, right, "key", 0.2, how, salt=5, broadcast_rows=most).select("key", "v", "w").collect())) == want
    assert skew_join(left.limit(0), right, "key", 0.2).count() == 0 == skew_join(left, right.limit(0), "key", 0.2).count()
    for bad in ({"how": "outer"}, {"right": right.withColumn("v", F.lit(1))}):
        with pytest.raises(ValueError):
            skew_join(left, bad.get("right", right), "key", 0.2, bad.get("how", "inner"))


FILES = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("grid_name", T.StringType()), T.StructField("tile_name", T.StringType()), T.StructField("layer", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("record_ids", T.ArrayType(T.LongType())), T.StructField("bucket", T.StringType())])


def files(spark, *lists, group=("g", "t", "l")):
    return spark.createDataFrame([(i + 1, *group, f"p/{group[0]}/{i + 1}", ids, "clash") for i, ids in enumerate(lists)], FILES)


def nothing_added(df):
    return sorted(r.key for r in files_adding_nothing(archive_files(df)).collect())


def test_files_adding_nothing_against_brute_force(spark):
    rng = random.Random(4)
    lists = [rng.choices(range(30), k=rng.randrange(0, 9)) for _ in range(150)]
    want = [i + 1 for i, a in enumerate(lists) if a and any(j != i and set(a) <= set(b) and (len(set(b)), -j) > (len(set(a)), -i) for j, b in enumerate(lists))]
    assert nothing_added(files(spark, *lists)) == want


def test_files_with_nulls_repeats_and_other_groups(spark):
    df = files(spark, [1, 2, 2], [2, 1], [1, None], None, [], [9]).unionByName(files(spark, [1], group=("other", "t", "l")).withColumn("file_id", F.lit(50)).withColumn("file_path", F.lit("q")))
    odd = files(spark, [1], group=(None, "t", "l")).withColumn("file_id", F.lit(60)).withColumn("file_path", F.lit(None).cast("string"))
    assert nothing_added(df.unionByName(df).unionByName(odd)) == [2, 3]
    assert nothing_added(df.limit(0)) == []


def test_files_of_one_path_are_all_kept(spark):
    df = files(spark, [1, 2], [3, 4], [3]).withColumn("file_path", F.lit("same"))
    got = [r.id for r in consolidate(df).contents().select(F.explode(decode_ids(F.col("content"))).alias("id")).collect()]
    assert sorted(got) == [1, 2, 3, 4] and nothing_added(df) == [3]


@pytest.mark.parametrize("block_bytes", [1 << 20, 512])  # a group in one block, and in many
def test_nested_and_popular_files(spark, block_bytes):
    rng = random.Random(9)
    chain = [list(range(k)) for k in range(1, 60)]
    popular = [[900, 901, *rng.sample(range(1000, 1040), 6)] for _ in range(80)]
    lists = chain + popular + [[1, 2, 3], [900, 901], [], [77, 900]]
    want = [i + 1 for i, a in enumerate(lists) if a and any(j != i and set(a) <= set(b) and (len(set(b)), -j) > (len(set(a)), -i) for j, b in enumerate(lists))]
    a = archive_files(files(spark, *lists), block_bytes=block_bytes)
    assert sorted(r.key for r in files_adding_nothing(a).collect()) == want and (a.blocks().count() > 1) == (block_bytes == 512)
    c = consolidate(files(spark, *lists), block_bytes=block_bytes)
    got = [r.id for r in c.contents().select(F.explode(decode_ids(F.col("content"))).alias("id")).collect()]
    assert sorted(got) == sorted({x for ids in lists for x in ids})


def test_consolidated_records_once(spark):
    a = consolidate(files(spark, [1, 2, 3], [3, 4], [2], [5, 5]))
    got = [r.id for r in a.contents().select(F.explode(decode_ids(F.col("content"))).alias("id")).collect()]
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert a.verify().isEmpty()


def test_archive_round_trip(spark):
    rng = random.Random(7)
    given = {f"f{i}": rng.randbytes(rng.choice([0, 1, 50, 3000])) for i in range(60)}
    df = spark.createDataFrame([(p, bytearray(b), "g" if len(b) % 2 else None, 3) for p, b in given.items()], "path string, content binary, g string, length int")
    a = pack(df.unionByName(df), "path", "content", ["g"], block_bytes=5000)
    assert {r.path: bytes(r.content) for r in a.contents().collect()} == given
    assert a.verify().isEmpty() and 1 < a.blocks().count() < 40
    assert [r.path for r in a.lookup(spark.createDataFrame([("f3",), ("none",)], "path string")).collect()] == ["f3"]
    assert pack(df.limit(0), "path", "content", ["g"]).index().count() == 0
    twice = spark.createDataFrame([("p", bytearray(b"one"), "g"), ("p", bytearray(b"two"), "g")], "path string, content binary, g string")
    assert sorted(bytes(r.content) for r in pack(twice, "path", "content", ["g"]).contents().collect()) == [b"one", b"two"]


def test_ids_as_bytes(spark):
    ids = [0, 1, -1, 2**62, -(2**63), 255]
    df = spark.createDataFrame([(ids,), ([],), (None,), ([None, 7],)], "ids array<bigint>")
    assert [r.d for r in df.select(decode_ids(encode_ids(F.col("ids"))).alias("d")).collect()] == [ids, [], [], [7]]
    assert bytes(df.select(encode_ids(F.col("ids")).alias("c")).first().c[:16]) == bytes(15) + b"\x01"


POINTS = T.StructType([T.StructField("point_id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("container", T.StringType()), T.StructField("_leaf", T.StringType())])
AREAS = T.StructType([T.StructField("area_id", T.LongType()), T.StructField("ring", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))])


def area(spark, *rings):
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(rings)], AREAS)


def crowd(spark, n=600, seed=2, spot=0.2):
    rng = random.Random(seed)
    rows = [(i, rng.random() * 10, rng.random() * 10, rng.choice("abc"), "clash") for i in range(n)]
    rows += [(n + i, 5 + rng.random() * spot, 5 + rng.random() * spot, rng.choice("ab"), "clash") for i in range(80)]
    return rows, spark.createDataFrame(rows, POINTS)


def test_near_pairs_against_brute_force(spark):
    rows, df = crowd(spark)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] != b[3] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.25**2}
    for leaf_rows in (100_000, 50, 7):  # one leaf, many, and parts of a crowded one
        got = [tuple(r) for r in near_pairs(df.unionByName(df), 0.25, leaf_rows=leaf_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_counts_against_brute_force(spark):
    rows, df = crowd(spark)
    for distance, leaf_rows in ((2.0, 100_000), (0.25, 50), (0.25, 20)):  # one leaf, many, and parts of a crowded one
        want = {(a[0], sum(a[3] != b[3] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= distance**2 for b in rows)) for a in rows}
        assert sorted(tuple(r) for r in near_counts(df.unionByName(df), distance, leaf_rows=leaf_rows).collect()) == sorted(want)
    assert near_counts(df.limit(0), 1.0).count() == 0


def test_regions(spark):
    rows, df = crowd(spark)
    notch = [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (5.1, 2.0), (1.0, 9.0)]
    square = [(4.0, 4.0), (8.0, 4.0), (8.0, 8.0), (4.0, 8.0)]

    def inside(p, ring):
        hit = False
        for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]):
            if (ya > p[2]) != (yb > p[2]) and p[1] < (xb - xa) * (p[2] - ya) / (yb - ya) + xa:
                hit = not hit
        return hit

    regions = area(spark, notch, square, [(0.0, 0.0), (1.0, 1.0)], None)
    want = {(p[0], i + 1) for p in rows for i, r in enumerate((notch, square)) if inside(p, r)}
    pairs = {(a[0], b[0], i) for a in rows for b in rows if a[0] < b[0] and a[3] != b[3] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.09 for i in (1, 2) if (a[0], i) in want and (b[0], i) in want}
    for leaf_rows in (100_000, 20):
        assert sorted(tuple(r) for r in points_in_regions(df.unionByName(df), regions, leaf_rows=leaf_rows).collect()) == sorted(want)
        assert sorted(tuple(r) for r in near_pairs_in_regions(df, regions, 0.3, leaf_rows=leaf_rows).collect()) == sorted(pairs)


def test_near_with_nulls_and_empty(spark):
    odd = spark.createDataFrame([(1, 1.0, 1.0, "a", ""), (2, 1.1, 1.0, "b", ""), (3, None, 1.0, "b", ""), (4, 1.0, float("nan"), "b", ""), (5, 1.0, 1.0, None, ""), (None, 1.0, 1.0, "b", ""), (6, float("inf"), 1.0, "b", "")], POINTS)
    assert [tuple(r) for r in near_pairs(odd, 0.2).collect()] == [(1, 2)]
    square = area(spark, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])
    assert sorted(r.point_id for r in points_in_regions(odd, square).collect()) == [1, 2, 5]
    assert near_pairs(odd.limit(0), 1.0).count() == 0 == near_pairs_in_regions(odd, square.limit(0), 1.0).count()


def test_trees():
    rng = np.random.default_rng(1)
    x, y = rng.random(500), rng.random(500)
    tree = Quadtree.build(x, y, (x.min(), y.min(), x.max(), y.max()), 20, 1e-3)
    leaf = tree.leaf(x, y)
    assert np.bincount(leaf).max() <= 20
    for box in ((0.1, 0.2, 0.4, 0.3), (0.0, 0.0, 1.0, 1.0)):
        inside = (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])
        assert set(leaf[inside]) <= set(tree.leaves_in(*box))
    q, p = RTree(x, y).in_boxes(x, y, np.array([[0.1, 0.2, 0.4, 0.3]]))
    assert set(p) == set(np.flatnonzero((x >= 0.1) & (x <= 0.4) & (y >= 0.2) & (y <= 0.3))) and not q.any()
    assert math.isclose(tree.unit * 2**26, max(np.ptp(x), np.ptp(y)) * 1.0001)


def test_no_temporary_folder_on_a_cluster():
    from unittest.mock import MagicMock

    from leadline.sources.shared import shared_root

    session = MagicMock()
    sc = session.sparkContext
    sc.getConf.return_value.get.return_value = None
    sc.getCheckpointDir.return_value = None
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        sc.master = master
        with pytest.raises(RuntimeError):
            shared_root(session)
    sc.getConf.return_value.get.return_value = "hdfs:///shared"
    assert shared_root(session) == "hdfs:///shared"
