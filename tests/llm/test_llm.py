"""The training-data problems: brute force, exact properties, and the odd cases."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadline.llm import queries
from leadline.llm.mixing import mix
from leadline.llm.packing import difference, fill, pack
from leadline.llm.quality import divergence, prose, text_quality
from leadline.llm.quantiles import HIGH, LOW, Sketch, merge, quantiles, rank_error, sketch
from leadline.llm.tokens import TOKENIZER, n_tokens
from leadline.llm.topn import cluster, row_groups, skipped, to_read, top_n

needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


# The best of every group.


def best(rows, n):
    groups = defaultdict(set)
    for g, h, z, k, *_ in rows:
        if None not in (g, h, z, k) and not math.isnan(z):
            groups[g, h].add((z, k))
    return sorted((g, h, z, k) for (g, h), items in groups.items() for z, k in sorted(items)[:n])


def test_top_n_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(40), rng.choice([1.5, 2.5, float(rng.randrange(9)), math.inf, -math.inf, math.nan, None]), rng.randrange(900), "clash") for _ in range(3000)]
    rows += [("hot", 1, rng.random(), i, "clash") for i in range(4000)] + [("tied", 1, 7.0, i, "clash") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, h int, z float, k bigint, rank string")
    as_stored = [tuple(r) for r in df.collect()]
    for file_rows in (100_000, 700):
        table = cluster(df.unionByName(df), ["g", "h"], "z", "k", file_rows)
        assert sorted(tuple(r)[:4] for r in top_n(table, 3).collect()) == best(as_stored, 3)


def test_top_n_skips_row_groups(spark):
    df = spark.range(400_000).select(F.substring(F.concat(F.lit("one"), F.col("id")), 1, 3).alias("g"), F.col("id").cast("float").alias("z"), F.col("id").alias("k"))
    table = cluster(df, ["g"], "z", "k", 100_000)
    assert row_groups(table).count() >= 4 and to_read(table, 3).count() == 1
    assert [r.k for r in top_n(table, 3).orderBy("rank").collect()] == [0, 1, 2]
    told = skipped(table, 3).first()
    assert told.n_rows == 400_000 and told.n_single == told.n_row_groups == told.n_ruled_out + 1 and told.n_rows_ruled_out > 290_000


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "g string, z float, k bigint")
    assert top_n(cluster(df, ["g"], "z", "k"), 3).count() == 0


# Percentiles.


def test_sketch_error_within_bound():
    rng = np.random.default_rng(2)
    for low in (True, False):
        n, s = 120_000, Sketch(low=low)
        for part in np.array_split(rng.permutation(n).astype(float), 23):
            t = Sketch(low=low).add(part)
            s.merge_levels(t.levels, t.states, t.n)
        values = np.concatenate(s.levels)
        weights = np.repeat([1 << h for h in range(len(s.levels))], [len(x) for x in s.levels])
        assert weights.sum() == n == s.n and len(values) < 6000
        order = np.argsort(values)
        ranks = np.cumsum(weights[order])
        for p in (0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999):
            got = values[order][np.searchsorted(ranks, p * n)]
            far = p if low else 1 - p
            assert abs(got - p * n) <= rank_error() * far * n + 2


def test_bound_holds_for_many_merges_of_equal_sketches():
    """200 sketches of one size, merged; several hundred trials: the bound is three standard deviations."""
    rng = np.random.default_rng(12)
    trials, parts, size = 320, 200, 250
    n = parts * size
    for low, probs in ((True, (0.01, 0.02, 0.05, 0.25, 0.5)), (False, (0.75, 0.95, 0.98, 0.99))):
        off = []
        for _ in range(trials):
            s = Sketch(low=low)
            for part in np.split(rng.permutation(n).astype(float), parts):
                t = Sketch(low=low).add(part)
                s.merge_levels(t.levels, t.states, t.n)
            values = np.concatenate(s.levels)
            weights = np.repeat([1 << h for h in range(len(s.levels))], [len(x) for x in s.levels])
            order = np.argsort(values)
            ranks = np.cumsum(weights[order])
            # The estimated number of values below the one that has p n below it, in standard deviations of the stated bound.
            at = np.searchsorted(values[order], np.array(probs) * n, side="left") - 1
            far = np.array(probs) if low else 1 - np.array(probs)
            off.append((np.where(at >= 0, ranks[at], 0) - np.array(probs) * n) / (rank_error() / 3 * far * n))
        off = np.array(off)
        assert (np.abs(off) > 3).mean(axis=0).max() <= 0.01
        assert np.abs(off.mean(axis=0)).max() < 0.35 and off.std(axis=0).max() < 1.2


def test_percentiles_by_key(spark):
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1), i % 7) for i in range(20_000)] + [(f"k{i % 500}", float(i), i % 3) for i in range(3000)]
    rows += [("odd", v, 0) for v in (None, math.nan, math.inf, -math.inf, 1.0)] + [(None, 1.0, 0)]
    df = spark.createDataFrame(rows, "key string, z double, day int").repartition(6)
    q = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    direct = sketch(df, {"key": F.col("key")}, F.col("z"))
    by_day = merge(sketch(df, {"key": F.col("key"), "day": F.col("day")}, F.col("z")), ["key"])
    for s in (direct, by_day):
        got = {r.key: r for r in quantiles(s, ["key"], q).collect()}
        assert len(got) == 502 and got["odd"].n == 3 and got["odd"].p50 == 1.0 and got["odd"].p99 == math.inf
        for key, r in got.items():
            v = sorted(z for k, z, _ in rows if k == key and z is not None and not math.isnan(z))
            assert r.n == len(v) and (r.rank_error > 0) == (key == "hot")
            for name, p in q.items():
                want = max(1, math.ceil(p * len(v) - 1e-9))
                rank = np.searchsorted(v, r[name], side="right")
                assert abs(rank - want) <= r[f"{name}_error"] <= r.rank_error * min(p, 1 - p) * len(v) + 1e-6
    for tail, p in ((LOW, 0.01), (HIGH, 0.99)):
        one = quantiles(sketch(df, {"key": F.col("key")}, F.col("z"), tails=(tail,)), ["key"], {"p": p}).where("key = 'hot'").first()
        v = sorted(z for k, z, _ in rows if k == "hot")
        assert one.n == 20_000 and abs(np.searchsorted(v, one.p, side="right") - p * 20_000) <= one.p_error + 1
    assert quantiles(sketch(df.limit(0), {"key": F.col("key")}, F.col("z")), ["key"], q).count() == 0


# Packing.


def test_differencing_is_a_partition():
    rng = np.random.default_rng(4)
    for n, k in ((1, 3), (5, 5), (40, 7), (300, 90)):
        sizes = rng.integers(1, 100, n)
        w = difference(sizes, k)
        assert len(w) == n and w.min() >= 0 and w.max() < k
        if n >= 4 * k:
            sums = np.bincount(w, weights=sizes, minlength=k)
            assert sums.max() - sums.min() < 100
    assert difference(np.array([8, 7, 6, 5, 4]), 2).tolist() in ([0, 1, 1, 0, 0], [1, 0, 0, 1, 1], [0, 1, 1, 1, 0], [0, 1, 0, 1, 1], [1, 0, 1, 0, 0], [1, 0, 0, 0, 1], [0, 0, 1, 1, 1], [1, 1, 0, 0, 0])


def test_fill_keeps_to_the_capacity():
    rng = np.random.default_rng(6)
    sizes = np.minimum(rng.lognormal(6, 0.8, 800).astype(int), 2048)
    w = fill(sizes, 2048)
    sums = np.bincount(w, weights=sizes)
    assert sums.max() <= 2048 and sizes.sum() / (len(sums) * 2048) > 0.96
    assert fill(np.zeros(3, int), 10).tolist() == [0, 0, 0] and len(fill(np.zeros(0, int), 10)) == 0


def test_fill_of_awkward_sizes_is_quick():
    import time

    for sizes, windows in ((np.full(600, 1025), 600), (np.full(600, 2048), 600), (np.full(600, 700), 300), (np.r_[np.full(300, 1100), np.full(300, 948)], 300), (np.ones(600, int), 1)):
        began = time.thread_time()
        w = fill(sizes, 2048)
        sums = np.bincount(w, weights=sizes)
        assert sums.max() <= 2048 and len(np.unique(w)) <= windows * 1.02 + 1 and time.thread_time() - began < 1.5


def test_pack_every_item_once(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, None, 5, 64, 65, 200, 640]) if i % 4 == 0 else rng.randrange(1, 64), "clash") for i in range(900)] + [(None, 5, "x")]
    df = spark.createDataFrame(rows, "id int, n int, window string")
    got = pack(df.unionByName(df), "id", "n", 64, batch_items=200).collect()
    sums, pieces = Counter(), defaultdict(list)
    for r in got:
        sums[r.window] += r.n
        pieces[r.id].append((r.start, r.n))
    assert max(sums.values()) <= 64 and set(pieces) == set(range(900))
    for i, n, _ in rows[:900]:
        at = 0
        for start, size in sorted(pieces[i]):
            assert start == at
            at += size
        assert at == (n or 0) and len(pieces[i]) == max(1, -(-(n or 0) // 64))
    assert pack(df.limit(0), "id", "n", 64).count() == 0
    with pytest.raises(ValueError):
        pack(df, "id", "n", 0)


@needs_tokenizer
def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("a" * 20_000,), ("😀 naïve",)], "text string")
    got = [r.n for r in df.select(n_tokens(F.col("text")).alias("n")).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 100 and got[4] > 2


# Mixing.


def test_mix_reaches_the_shares(spark):
    rng = random.Random(9)
    docs = [(f"{s}{i}", s, rng.randrange(1, 100), "clash") for s, n in (("big", 4000), ("mid", 900), ("small", 120), ("other", 50)) for i in range(n)]
    docs += [("n1", None, 5, ""), (None, "big", 5, ""), ("z", "big", 0, ""), ("y", "big", None, "")]
    df = spark.createDataFrame(docs, "id string, src string, n int, copies string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    selection, report = mix(df.unionByName(df), targets, "id", F.col("src"), F.col("n"))
    limit = {"big": 1, "mid": 2, "small": 4}
    size = {d[0]: d[2] for d in docs}
    got, total = Counter(), 0
    for r in selection.collect():
        assert 1 <= r.copies <= limit[r.source] and r.size == size[r.id] > 0
        got[r.source] += r.copies * r.size
        total += r.copies * r.size
    rows = {r.source: r for r in report.collect()}
    assert {s: rows[s].selected for s in limit} == got and rows["none"].selected == 0 and not rows["none"].reached
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        assert abs(got[s] / total - share / 0.9) < 0.01
    again, _ = mix(df, targets, "id", F.col("src"), F.col("n"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, selection.collect()))


def test_mix_of_a_given_total_and_weights(spark):
    df = spark.range(2000).select(F.col("id"), F.lit("a").alias("src"), F.lit(10).alias("n"), F.when(F.col("id") < 1000, 3.0).otherwise(1.0).alias("w"))
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    selection, report = mix(df, targets, "id", F.col("src"), F.col("n"), F.col("w"), total=8000.0)
    heavy = selection.where("id < 1000").agg(F.sum("copies")).first()[0]
    assert report.first().selected == 8000 and 540 <= heavy <= 660
    selection, report = mix(df, targets, "id", F.col("src"), F.col("n"), total=1e6)
    assert report.first().selected == 40_000 and report.first().most_copies == 2
    assert mix(df.limit(0), targets, "id", F.col("src"), F.col("n"))[0].count() == 0


def test_mix_chances_are_those_intended(spark):
    """Four weights, sizes apart from them, a limit that binds the heaviest: the share taken of each class is its chance."""
    n = 24_000
    df = spark.range(n).select(F.col("id"), F.lit("a").alias("src"), (F.col("id") % 37 + 1).alias("n"), F.element_at(F.array(*map(F.lit, (0.5, 1.0, 2.0, 20.0))), (F.col("id") % 4 + 1).cast("int")).alias("w"))
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    rows = df.toPandas()
    for total, seed in ((0.3, 1), (0.5, 2)):
        quota = total * rows["n"].sum()
        selection, report = mix(df, targets, "id", F.col("src"), F.col("n"), F.col("w"), total=float(quota), seed=seed)
        took = rows["id"].isin({r.id for r in selection.collect()})
        scale = 1.0
        for _ in range(60):  # copies are w * scale, at most one
            scale *= quota / (np.minimum(rows["w"] * scale, 1) * rows["n"]).sum()
        for w, mine in rows.groupby("w"):
            p = min(w * scale, 1)
            got, size = took[mine.index].mean(), len(mine)
            assert abs(got - p) <= 3.5 * math.sqrt(p * (1 - p) / size) + 1e-3
            # Long texts are as likely as short ones.
            long = took[mine.index[mine["n"] > 19]].mean()
            assert abs(long - got) <= 3.5 * math.sqrt(p * (1 - p) / size * 2) + 1e-3
        assert abs(report.first().selected - quota) <= 19


def test_mix_tells_the_source_that_binds(spark):
    df = spark.createDataFrame([(i, "rich", 10) for i in range(1000)] + [(5000, "poor", 7)], "id int, src string, n int")
    targets = spark.createDataFrame([("rich", 0.7, 1), ("poor", 0.2, 3), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    binds = lambda **more: {r.source for r in mix(df, targets, "id", F.col("src"), F.col("n"), **more)[1].collect() if r.binds}
    assert binds() == {"poor"} and binds(total=50.0) == set() and binds(total=1e6) == {"rich", "poor"}


# Quality.

WORDS = [("en", w) for w in "the of and a to in is that it was for on as with be by at this not are but from or have which we if when there so can no now one all more".split()] + [("de", w) for w in "der die das und ist nicht in den zu ein eine mit auf aber denn so ich es im am vor nach".split()]
PROSE = "The loader reads the order of the lines, but it was not clear to me that this is the only place. We saw that the file was closed and that there is no more memory than we have. If it reads the name, then the job can go on with the rest of the work."


def test_divergence():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert np.allclose(divergence(p, np.array([0.0, 1.0])), [1.0, 0.3112781]) and np.allclose(divergence(p, np.array([0.5, 0.5])), [0.3112781, 0.0])


def test_quality(spark):
    wrapped = "\n".join("+" + PROSE[i : i + 60] for i in range(0, len(PROSE), 60))
    texts = {
        "prose": PROSE, "wrapped": "@@ -1 +1,9 @@\r\n" + wrapped.replace("\n", "\r\n"), "capitals": PROSE.upper(), "quoted": "> " + PROSE.replace(". ", ".\n> "), "german": "Das ist nicht so, denn der Lauf ist im Plan und die Zeit ist nicht da. Ich habe es so vor den Tagen und nach den Tagen gesehen, aber das ist nicht die Regel.",
        "list": "\n".join(f"- {p}" for p in ("the order of the lines", "not the rest of it", "all of the work", "a list of names")), "code": "int f(int a_b) {\n  return a_b->c[3] + 7;\n}\n" * 5,
        "words": "the of and a to in is that it was for on as with be by at this not are but from " * 5, "table": "12.5 13.7 9\n1.0 2.5 3\n" * 9, "blank": "  \n\t ", "empty": "", "null": None, "long": (PROSE + "\n") * 3000, "broken": "�Ã¤�" * 50,
    }
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id string, text string, n_words int")
    common = spark.createDataFrame(WORDS + [("en", None), ("xx", "foo")], "lang string, word string")
    q = text_quality(df, common)
    assert {r.doc_id for r in prose(q).collect()} == {"prose", "wrapped", "capitals", "quoted", "german", "long"}
    got = {r.doc_id: r for r in q.collect()}
    assert len(got) == len(texts)
    words = PROSE.replace(",", "").replace(".", "").split()
    r = got["prose"]
    assert r.n_words == len(words) and math.isclose(r.mean_word_length, sum(map(len, words)) / len(words)) and r.symbol_ratio == 0 and r.punctuated_lines == 1.0
    assert math.isclose(r.common_words, sum(w.lower() in {w for lang, w in WORDS if lang == "en"} for w in words) / len(words))
    assert r.structure.startswith("prose") and got["code"].structure == "code" and got["table"].structure == "table" and got["list"].structure == "list"
    for k in ("blank", "empty", "null"):
        assert got[k].n_words == 0 and got[k].structure is None and got[k].prose_share == 0
    assert text_quality(df.limit(0), common).count() == 0 and text_quality(df, common.limit(0)).count() == len(texts)
    assert text_quality(df.unionByName(df), common).count() == 2 * len(texts)


def test_words_of_any_language_and_length(spark):
    long = [("de", w) for w in ("selbstverständlich", "und", "außerordentlichkeit", "außerordentlichkeix")]
    many = [(f"l{i}", w) for i in range(70) for w in (f"w{'x' * (i % 30)}q", "und")]
    common = spark.createDataFrame([*long, ("it", "che"), ("it", "CHE"), *many, (None, "x"), ("it", None)], "lang string, word string")
    df = spark.createDataFrame([("a", "Selbstverständlich und AUSSERORDENTLICHKEIT"), ("b", "che che no"), ("c", "außerordentlichkeit außerordentlichkeiy selbstverständlicx"), ("d", f"w{'x' * 29}q und nein")], "doc_id string, text string")
    got = {r.doc_id: r for r in text_quality(df, common).collect()}
    assert [round(got[k].common_words, 4) for k in "abcd"] == [0.6667, 0.6667, 0.3333, 0.6667]
    with pytest.raises(ValueError):
        text_quality(df, common, most_words=10)


def test_words_that_share_a_key():
    from leadline.llm.quality import Words

    w = Words({"en": [f"abcdefghijklmnop{i:02d}" for i in range(20)] + ["ab", "abc"]})
    raw = [f"abcdefghijklmnop{i:02d}".encode() for i in range(25)] + [b"ab", b"abd", b"abc"]
    length = np.array([len(x) for x in raw])
    row = w.find(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length, length)
    assert [i < len(w.words) for i in row] == [True] * 20 + [False] * 5 + [True, False, True]
    assert all(w.words[r] == x for r, x in zip(row, raw, strict=True) if r < len(w.words))


@needs_tokenizer
@pytest.mark.parametrize("name", ["p4_percentiles", "p4_daily", "p5_row_groups", "p7_packed", "p7_windows", "p8_selection", "p8_shares", "p9_found", "p9_stats"])
def test_queries_run(name, spark, data):
    assert queries.QUERIES[name](spark, data).count() > 0
