"""Per-key results and joins where a few keys hold most rows.

A Misra-Gries sketch, one pass and mergeable, names every key that can reach
the share asked for; one more pass counts those few exactly.  Heavy keys are
told apart by a broadcast join with that short list.  Their rows stay where
they are, to be combined before the shuffle, joined with broadcast rows or
salted; the rest goes through an ordinary shuffle; the two are united.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

#: The sketch takes no smaller support than this; below it keys are counted one by one.
_LEAST_SUPPORT = 1e-4
#: Right rows of heavy keys that are sent to all executors; beyond it they are dealt out with a salt.
BROADCAST_ROWS = 100_000
#: Parts a heavy key is dealt out to.
SALT = 64
#: Aggregates that hold all values of a group until the end.
_WHOLE_GROUP = ("collect_list", "collect_set", "array_agg", "percentile", "median", "mode", "listagg", "string_agg", "histogram_numeric", "percentile_cont", "percentile_disc")


def _each(rows: DataFrame, n: int) -> DataFrame:
    """A row ``(i, k)`` for every kind of key of every row."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_k{i}").alias("k")) for i in range(n)])).alias("c")).select("c.*").where("k is not null")


def heavy_keys(df: DataFrame, keys: dict[str, Column], share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows: ``(key_kind, key_name, n_rows)``.

    ``keys`` names each kind of key and its expression, cast to string; a row
    whose expression is null has no key of that kind but counts in the base.
    The sketch keeps ``4 / share`` counters a kind, so it cannot miss a key,
    and the list is at most that long whatever the data.  For a share so small
    that the sketch would need more than 10,000 counters, every key is counted
    instead.  An empty table gives an empty result.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be over 0 and at most 1")
    kinds = list(keys)
    rows = df.select(*[e.cast("string").alias(f"_k{i}") for i, e in enumerate(keys.values())])
    n = F.count("*")
    each = _each(rows, len(kinds))
    if share / 4 > _LEAST_SUPPORT:
        found = rows.stat.freqItems([f"_k{i}" for i in range(len(kinds))], share / 4).first()  # at most 4 / share for each kind
        short = df.sparkSession.createDataFrame([(i, k) for i in range(len(kinds)) for k in found[i] if k is not None], "i int, k string")
        each = each.join(F.broadcast(short), ["i", "k"])
    counted = each.groupBy("i", "k").agg(n.alias("n_rows"))
    total = rows.agg(n.alias("total"))
    kind_name = F.element_at(F.array(*[F.lit(x) for x in kinds]), F.col("i") + 1)
    return counted.join(F.broadcast(total), F.col("n_rows") >= F.col("total") * F.lit(share) - F.lit(1e-6)).select(kind_name.alias("key_kind"), F.col("k").alias("key_name"), "n_rows")


def salted(df: DataFrame, salt: int) -> Column:
    """A part, 0 to ``salt - 1``, of each row: by its values and the partition it is in, so that a task that runs again deals rows out as before."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")]) + F.spark_partition_id(), F.lit(salt))


def _combines(df: DataFrame, aggregates: list[Column]) -> bool:
    """Whether Spark can combine the aggregates before the shuffle, to a few numbers a key."""
    plan = df.agg(*aggregates)._jdf.queryExecution().analyzed().toString().lower()
    return not re.search(r"\b(" + "|".join(_WHOLE_GROUP) + r")\(|\(distinct ", plan)


def per_key(df: DataFrame, keys: dict[str, Column], aggregates: list[Column], share: float, merge: list[Column] | None = None, salt: int = SALT) -> DataFrame:
    """``aggregates`` for every key of every kind, without a few tasks doing most of the work: ``(key_kind, key_name, ..., is_heavy)``.

    ``aggregates`` are aliased.  Those that Spark combines (counts, sums,
    means, extremes, sketches) are computed in one pass: rows of heavy keys,
    marked by a broadcast join, leave each task as one combined row, the rest
    goes through the shuffle.  Aggregates that hold a whole group (lists,
    sets, exact percentiles, distinct counts) would put a heavy key in one
    task: they need ``merge``, which makes the result of a heavy key from the
    results of its ``salt`` parts, named as in ``aggregates``; without it they
    are refused.  Rows of the other keys are aggregated as they are.  What
    ``merge`` makes is a row, and must fit one.

    A null key is no key, but its rows count in the base of ``share``, as in
    :func:`heavy_keys`.  Columns of ``df`` named like those of the result don't
    matter.  An empty table gives an empty result.
    """
    kinds = list(keys)
    rows = df.withColumns({f"_k{i}": e.cast("string") for i, e in enumerate(keys.values())})
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_k{i}").alias("k")) for i in range(len(kinds))]))
    each = rows.select(*df.columns, pairs.alias("_key")).where("_key.k is not null")
    kind_of = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    found = cut(heavy_keys(df, keys, share).select(F.struct(kind_of[F.col("key_kind")].alias("i"), F.col("key_name").alias("k")).alias("_heavy")))  # at most 1 / share keys a kind
    same = (F.col("_key.i") == F.col("_heavy.i")) & (F.col("_key.k") == F.col("_heavy.k"))
    marked = each.join(F.broadcast(found), same, "left")
    plain = [F.element_at(F.array(*[F.lit(x) for x in kinds]), F.col("_key.i") + 1).alias("key_kind"), F.col("_key.k").alias("key_name")]
    out = lambda d, results: d.select(*plain, *results, "_is_heavy").withColumnRenamed("_is_heavy", "is_heavy")
    marked = marked.withColumn("_is_heavy", F.col("_heavy").isNotNull())
    results = df.agg(*aggregates).columns
    if _combines(df, aggregates):
        return out(marked.groupBy("_key", "_is_heavy").agg(*aggregates), results)
    if merge is None:
        raise ValueError("these aggregates hold a whole group in one task: give merge, or aggregates that combine")
    light = marked.where("not _is_heavy").groupBy("_key", "_is_heavy").agg(*aggregates)
    parts = marked.where("_is_heavy").withColumn("_part", salted(marked, salt)).groupBy("_key", "_is_heavy", "_part").agg(*aggregates)
    return out(light, results).unionByName(out(parts.groupBy("_key", "_is_heavy").agg(*merge), results))


def skew_join(left: DataFrame, right: DataFrame, on: str, share: float, how: str = "inner", salt: int = SALT, broadcast_rows: int = BROADCAST_ROWS, heavy: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on the column ``on``, where a few keys hold most rows of ``left``.

    Rows of heavy keys of ``left`` meet the few rows of ``right`` that have
    such a key by broadcast; those are counted first, and beyond
    ``broadcast_rows`` heavy rows of ``left`` are dealt out to ``salt`` parts
    instead, each of which gets a copy.  All other rows meet by an ordinary
    shuffle, and the two results are united.  ``how`` is ``inner`` or
    ``left``.  Null keys find nothing.  Apart from ``on``, the two must not
    share names of columns.  ``heavy`` gives the heavy keys where they are
    known, in a column ``on``; else they are looked for.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    clash = (set(left.columns) & set(right.columns)) - {on}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    kind = dict(left.dtypes)[on]
    if heavy is None:
        heavy = heavy_keys(left, {"key": F.col(on)}, share).select(F.col("key_name").cast(kind).alias(on))
    heavy = cut(heavy)  # at most 1 / share keys
    heavy_left, rest_left = left.join(F.broadcast(heavy), on, "left_semi"), left.join(F.broadcast(heavy), on, "left_anti")
    heavy_right, rest_right = right.join(F.broadcast(heavy), on, "left_semi"), right.join(F.broadcast(heavy), on, "left_anti")
    if heavy_right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = heavy_left.join(F.broadcast(heavy_right), on, how)
    else:
        dealt = heavy_left.withColumn("_salt", salted(heavy_left, salt))
        copies = heavy_right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))))
        met = dealt.join(copies.hint("shuffle_hash"), [on, "_salt"], how).drop("_salt")
    return met.unionByName(rest_left.join(rest_right, on, how))
