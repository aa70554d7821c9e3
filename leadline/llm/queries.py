"""The queries of the training-data problems, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut
from ..sources.tables import table
from .mixing import mix
from .packing import pack
from .quality import prose, text_quality
from .quantiles import SECTION, merge, quantiles, sketch
from .tokens import n_tokens
from .topn import cluster, skipped, top_n

SHOALEST = 3
CAPACITY = 2048
PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _soundings(points: DataFrame) -> DataFrame:
    """Each sounding once.  Its rows are equal in container and time, so they meet in one task without a shuffle by id, and what is near in time stays together."""
    near = points.withColumn("_slot", F.floor(F.unix_seconds("ping_time") / 600)).repartition("container", "_slot")
    return near.dropDuplicates(["container", "_slot", "point_id"])


def _daily(points: DataFrame) -> DataFrame:
    """A sketch of z for each day of every container and every cell."""
    cell = F.when(F.col("cell_index") != -1, F.concat(F.col("tile_name"), F.lit("/"), F.col("cell_index")))
    key = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    rows = _soundings(points.select("point_id", "container", "tile_name", "cell_index", "z", "ping_time"))
    rows = rows.select(F.to_date("ping_time").alias("day"), "z", F.explode(F.array(key("container", F.col("container")), key("cell", cell))).alias("k"))
    return sketch(rows, {"key_kind": F.col("k.kind"), "key_name": F.col("k.name"), "day": F.col("day")}, F.col("z"))


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of z of every container and every cell, from the sketches of its days."""
    keys = ["key_kind", "key_name"]
    return quantiles(merge(_daily(table(spark, folder, "points")), keys), keys, PERCENTILES)


def p4_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The percentiles of the containers and cells whose sketches hold every value."""
    return p4_percentiles(spark, folder).where("rank_error = 0").select("key_kind", "key_name", "n", *PERCENTILES)


def p4_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of z of each day of every container and every cell."""
    return quantiles(_daily(table(spark, folder, "points")), ["key_kind", "key_name", "day"], PERCENTILES)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three shoalest soundings of every cell."""
    points = table(spark, folder, "points").where("cell_index <> -1")
    return top_n(cluster(points, ["tile_name", "cell_index"], "z", "point_id"), SHOALEST).select("tile_name", "cell_index", "point_id")


def p5_row_groups(spark: SparkSession, folder: str) -> DataFrame:
    """What the statistics of the clustered table rule out before anything is read."""
    points = table(spark, folder, "points").where("cell_index <> -1")
    return skipped(cluster(points, ["tile_name", "cell_index"], "z", "point_id"), SHOALEST)


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in a window of ``CAPACITY`` tokens."""
    docs = table(spark, folder, "documents").select("doc_id", n_tokens(F.col("text")).alias("n_tokens"))
    return pack(cut(docs), "doc_id", "n_tokens", CAPACITY)


def p7_windows(spark: SparkSession, folder: str) -> DataFrame:
    """What each window holds and leaves unused."""
    windows = p7_packed(spark, folder).groupBy("window").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    return windows.withColumn("unused", F.lit(CAPACITY) - F.col("n_tokens"))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of a packing: every document packed, none twice, its pieces side by side and as long as it, no window over the capacity, no document cut that fits one."""
    docs = table(spark, folder, "documents").select("doc_id", n_tokens(F.col("text")).alias("n_tokens"))
    docs = cut(docs)
    packed = cut(pack(docs, "doc_id", "n_tokens", CAPACITY).withColumnRenamed("n_tokens", "size"))
    pieces = packed.groupBy("doc_id").agg(F.count("*").alias("_n"), F.countDistinct("start").alias("_starts"), F.sum("size").alias("_size"), F.max(F.col("start") + F.col("size")).alias("_end"))
    each = docs.join(pieces, "doc_id", "full")
    over = packed.groupBy("window").agg(F.sum("size").alias("_s")).agg(F.count(F.when(F.col("_s") > CAPACITY, 1)).alias("n_over_capacity"))
    whole = (F.col("_n") == F.col("_starts")) & (F.col("_size") == F.col("n_tokens")) & (F.col("_end") == F.col("n_tokens"))
    told = each.agg(F.count("n_tokens").alias("n_documents"), F.count(F.when(whole, 1)).alias("n_packed_whole"), F.count(F.when((F.col("_n") > 1) & (F.col("n_tokens") <= CAPACITY), 1)).alias("n_cut_needlessly"))
    return told.crossJoin(over)  # one row each


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"))
    # A text is wished for by the root of its size: longer ones say more, but not in proportion.
    return mix(docs, table(spark, folder, "mix_targets"), "doc_id", F.lower(F.trim("source")), F.col("n_tokens"), F.sqrt("n_tokens"))


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that mix the sources to their target shares, with the copies of each."""
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached, and the sources that hold the size of the mix."""
    return _mixed(spark, folder)[1]


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of a selection for each target source: no document twice, none of another source, none too often, and the quota met within half a document."""
    selection, report = _mixed(spark, folder)
    docs = table(spark, folder, "documents").select("doc_id", F.lower(F.trim("source")).alias("_source")).dropDuplicates(["doc_id"])
    told = cut(selection).join(docs, "doc_id", "left")
    found = told.groupBy("source").agg(F.count("*").alias("_rows"), F.countDistinct("doc_id").alias("_docs"), F.max("copies").alias("_copies"), F.sum(F.col("copies") * F.col("size")).alias("_tokens"), F.max("size").alias("_longest"), F.count(F.when(~F.col("source").eqNullSafe(F.col("_source")), 1)).alias("_foreign"))
    rows = report.join(found, "source", "left").fillna(0, ["_rows", "_docs", "_copies", "_tokens", "_longest", "_foreign"])
    return rows.select(
        "source", "target_share", "max_repeats", (F.col("_rows") == F.col("_docs")).alias("once"), (F.col("_foreign") == 0).alias("own"), (F.col("_copies") <= F.col("max_repeats")).alias("within_repeats"),
        (F.abs(F.col("_tokens") - F.col("quota")) <= F.greatest(F.col("_longest") / 2, F.lit(1e-6))).alias("quota_met"),
    )


def p9_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every text."""
    return text_quality(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p9_basic(spark: SparkSession, folder: str) -> DataFrame:
    """Words and their mean length of every text."""
    found = p9_stats(spark, folder)
    return found.select("doc_id", "n_words", F.round(F.col("mean_word_length") + F.lit(3e-8), 6).alias("mean_word_length"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that are natural prose."""
    return prose(p9_stats(spark, folder)).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_percentiles": p4_percentiles,
    "p4_daily": p4_daily,
    "p4_exact": p4_exact,
    "p5_found": p5_found,
    "p5_row_groups": p5_row_groups,
    "p7_packed": p7_packed,
    "p7_windows": p7_windows,
    "p7_check": p7_check,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p8_check": p8_check,
    "p9_found": p9_found,
    "p9_stats": p9_stats,
    "p9_basic": p9_basic,
}

_EXACT = 2 * 3 * SECTION

#: Runs of letters, digits and joints; other characters than ASCII count as letters, but for dashes, quotes and the like.
_RUN = r"[A-Za-z0-9_\x{80}-\x{1FFF}\x{2040}-\x{10FFFF}]+"
#: Words: no digit, no joint, and capitals in front only or throughout.
_WORD = r"[A-Z]?[^A-Z0-9_]*|[A-Z]{2,}"

SQL: dict[str, str] = {
    "p7_check": "select count(*) as n_documents, count(*) as n_packed_whole, 0::bigint as n_cut_needlessly, 0::bigint as n_over_capacity from documents",
    "p8_check": "select source, target_share, max_repeats, true as once, true as own, true as within_repeats, true as quota_met from mix_targets",
    "p9_basic": f"""with w as (select doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '{_RUN}'), lambda t: regexp_full_match(t, '{_WORD}')) as words from documents)
  select doc_id, len(words) as n_words, round(coalesce(list_sum(list_transform(words, lambda t: length(t)))::double / nullif(len(words), 0), 0) + 3e-8, 6) as mean_word_length from w""",
    "p4_exact": f"""with s as (select distinct point_id, container, tile_name, cell_index, z from points where z is not null and not isnan(z) and ping_time is not null),
  k as (select 'container' as key_kind, container as key_name, cast(z as double) as z from s where container is not null
    union all select 'cell', tile_name || '/' || cast(cell_index as varchar), cast(z as double) from s where cell_index <> -1 and tile_name is not null),
  l as (select key_kind, key_name, count(*) as n, list(z order by z) as v from k group by 1, 2 having count(*) <= {_EXACT})
  select key_kind, key_name, n, {", ".join(f"v[greatest(1, cast(ceil({p} * n - 1e-9) as int))] as {c}" for c, p in PERCENTILES.items())} from l""",
    "p5_found": f"""select tile_name, cell_index, point_id from (
  select tile_name, cell_index, point_id, row_number() over (partition by tile_name, cell_index order by z, point_id) as r
  from (select distinct tile_name, cell_index, point_id, z from points where cell_index <> -1 and tile_name is not null and z is not null and not isnan(z)))
  where r <= {SHOALEST}""",
}
