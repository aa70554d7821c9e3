"""The queries of the general data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.heavy import heavy_keys, per_key, skew_join
from ..operators.near import near_counts, near_pairs, near_pairs_in_regions, points_in_regions
from ..operators.smallfiles import archive_files, consolidate, files_adding_nothing
from ..operators.spikes import DEPTH, UNCERTAINTY, flag_implausible
from ..sources.archive import decode_ids
from ..sources.shared import cut
from ..sources.tables import table

HEAVY_SHARE = 0.02
NEAR_METERS = 0.3503
#: Areas are close if the middles of their boxes are.
AREA_METERS = 1_500.0


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Soundings with an implausible z or tvu."""
    return flag_implausible(table(spark, folder, "points")).select("point_id").distinct()


def p1_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every flag with its state and probability."""
    return flag_implausible(table(spark, folder, "points"))


def p1_impossible(spark: SparkSession, folder: str) -> DataFrame:
    """Of the flags, those of values that no instrument means, whatever the container: not a number, infinite, beyond the hard bounds."""
    points = table(spark, folder, "points")
    beyond = lambda c, low, high: F.isnan(c) | (F.abs(c) == F.lit(float("inf"))) | low | (F.col(c) > high)
    values = points.select("point_id", F.explode(F.array(
        F.struct(F.lit("z").alias("channel"), beyond("z", F.col("z") < DEPTH.low, DEPTH.high).alias("beyond")),
        F.struct(F.lit("tvu").alias("channel"), beyond("tvu", F.col("tvu") <= UNCERTAINTY.low, UNCERTAINTY.high).alias("beyond")),
    )).alias("v")).where("v.beyond").select("point_id", "v.channel").distinct()
    return flag_implausible(points).where("state = 'out_of_range'").join(values, ["point_id", "channel"], "left_semi").select("point_id", "channel")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose every distinct record one other file of the same grid, tile and layer holds too."""
    return files_adding_nothing(archive_files(table(spark, folder, "tile_files"))).select(F.col("key").alias("file_id"))


def p2_consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of a grid, tile and layer once, read back from the blocks."""
    contents = consolidate(table(spark, folder, "tile_files")).contents()
    return contents.select("grid_name", "tile_name", "layer", F.explode(decode_ids(F.col("content"))).alias("record_id"))


def p2_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of the archive of all files: members, records and bytes of each grid, tile and layer."""
    index = archive_files(table(spark, folder, "tile_files")).index()
    return index.groupBy("grid_name", "tile_name", "layer").agg(F.count("*").alias("n_files"), F.sum(F.col("length") / 8).cast("bigint").alias("n_records"), F.countDistinct("bucket").alias("n_blocks"))


def p2_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Single files looked up in the archive by path, whose bytes and checksum must be those they came with: every file whose id is divisible by 50."""
    files = table(spark, folder, "tile_files")
    asked = files.where(F.col("file_id") % 50 == 0).select(F.col("file_path").alias("path"))
    found = archive_files(files).lookup(asked)
    return found.select("path", F.array_join(decode_ids(F.col("content")).cast("array<string>"), ",").alias("records"), (F.sha2("content", 256) == F.col("checksum")).alias("sound"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Soundings of different containers at most ``NEAR_METERS`` apart, with each area both lie in."""
    return near_pairs_in_regions(table(spark, folder, "points"), table(spark, folder, "areas"), NEAR_METERS)


def p3_areas(spark: SparkSession, folder: str) -> DataFrame:
    """Every sounding with each area it lies in."""
    return points_in_regions(table(spark, folder, "points"), table(spark, folder, "areas"))


def p3_near_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every sounding, inside areas or not, with the number of soundings of other containers at most ``NEAR_METERS`` away."""
    return near_counts(table(spark, folder, "points"), NEAR_METERS)


def p3_near_areas(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of areas the middles of whose boxes are at most ``AREA_METERS`` apart; the boxes are those of the rings."""
    middle = lambda c: ((F.array_min(F.col(f"ring.{c}")) + F.array_max(F.col(f"ring.{c}"))) / 2).alias(c)
    places = table(spark, folder, "areas").select("area_id", middle("x"), middle("y"), F.col("area_id").cast("string").alias("own"))
    return near_pairs(places, AREA_METERS, key="area_id", group="own")


def _point_keys() -> dict:
    cell = F.when(F.col("cell_index") != -1, F.concat(F.col("tile_name"), F.lit("/"), F.col("cell_index")))
    return {"container": F.col("container"), "cell": cell}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and cells that hold at least 2 in 100 of all rows."""
    return heavy_keys(table(spark, folder, "points"), _point_keys(), HEAVY_SHARE).select("key_kind", "key_name")


def p6_key_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean and least z of every container and every cell; the mean is over finite z."""
    points = table(spark, folder, "points").select("container", "tile_name", "cell_index", "z")
    z = F.col("z").cast("double")
    finite = ~F.isnan(z) & (F.abs(z) < F.lit(float("inf")))
    aggregates = [F.count("*").alias("n_rows"), F.round(F.avg(F.when(finite, z)), 3).alias("mean_z"), F.min(F.when(~F.isnan(z), z)).alias("least_z")]
    return per_key(points, _point_keys(), aggregates, HEAVY_SHARE)


def p6_key_shoals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every container and every cell that are shoaler than its mean: each row meets its key's mean by a skew join."""
    z = F.col("z").cast("double")
    points = table(spark, folder, "points").where(~F.isnan(z) & (F.abs(z) < F.lit(float("inf"))))
    found = None
    for kind, key in _point_keys().items():
        rows = points.select(key.cast("string").alias("key_name"), z.alias("z")).where("key_name is not null")
        means = cut(per_key(rows, {kind: F.col("key_name")}, [F.round(F.avg("z"), 3).alias("mean_z")], HEAVY_SHARE))
        met = skew_join(rows, means.select("key_name", "mean_z"), "key_name", HEAVY_SHARE, heavy=means.where("is_heavy").select("key_name"))
        one = met.groupBy("key_name").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("z") < F.col("mean_z"), 1)).alias("n_shoaler")).select(F.lit(kind).alias("key_kind"), "key_name", "n_rows", "n_shoaler")
        found = one if found is None else found.unionByName(one)
    return found


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_flags": p1_flags,
    "p1_impossible": p1_impossible,
    "p2_found": p2_found,
    "p2_consolidated": p2_consolidated,
    "p2_blocks": p2_blocks,
    "p2_lookup": p2_lookup,
    "p3_found": p3_found,
    "p3_areas": p3_areas,
    "p3_near_counts": p3_near_counts,
    "p3_near_areas": p3_near_areas,
    "p6_found": p6_found,
    "p6_key_stats": p6_key_stats,
    "p6_key_shoals": p6_key_shoals,
}

_KEYS = """(select 'container' as key_kind, container as key_name, z from points
  union all select 'cell', case when cell_index <> -1 then tile_name || '/' || cast(cell_index as varchar) end, z from points)"""

#: Soundings with the areas they lie in: boxes from the rings, then crossings of a ray.
_INSIDE = """edges as (select area_id, unnest([{'a': ring[i], 'b': ring[i % len(ring) + 1]} for i in range(1, len(ring) + 1)]) as e from areas),
  boxes as (select area_id, min(e.a.x) as x0, max(e.a.x) as x1, min(e.a.y) as y0, max(e.a.y) as y1 from edges group by 1),
  pts as (select distinct point_id, x, y, container from points where x is not null and y is not null),
  near as (select p.*, b.area_id from pts p join boxes b on p.x between b.x0 and b.x1 and p.y between b.y0 and b.y1),
  inside as (select n.point_id, any_value(n.x) as x, any_value(n.y) as y, any_value(n.container) as container, n.area_id
    from near n join edges using (area_id)
    where (e.a.y > n.y) <> (e.b.y > n.y) and n.x < (e.b.x - e.a.x) * (n.y - e.a.y) / (e.b.y - e.a.y) + e.a.x
    group by n.point_id, n.area_id having count(*) % 2 = 1)"""

SQL: dict[str, str] = {
    "p1_impossible": f"""with s as (select * from points where container is not null and ping_time is not null)
  select distinct point_id, 'z' as channel from s where isnan(z) or isinf(z) or z < {DEPTH.low} or z > {DEPTH.high}
  union select distinct point_id, 'tvu' from s where isnan(tvu) or isinf(tvu) or tvu <= {UNCERTAINTY.low} or tvu > {UNCERTAINTY.high}""",
    "p2_found": """with f as (select file_id, grid_name, tile_name, layer, list_distinct(record_ids) as ids from tile_files),
  e as (select file_id, grid_name, tile_name, layer, len(ids) as n, unnest(ids) as id from f)
  select distinct file_id from (select a.file_id, b.file_id as other from e a join e b using (grid_name, tile_name, layer, id)
  where a.file_id <> b.file_id and (b.n > a.n or (b.n = a.n and b.file_id < a.file_id)) group by 1, 2, a.n having count(*) = a.n)""",
    "p2_consolidated": "select distinct grid_name, tile_name, layer, unnest(record_ids) as record_id from tile_files",
    "p2_lookup": "select file_path as path, coalesce(array_to_string(record_ids, ','), '') as records, true as sound from tile_files where file_id % 50 = 0",
    "p2_blocks": """select grid_name, tile_name, layer, count(*) as n_files, cast(sum(len(record_ids)) as bigint) as n_records,
  greatest(1, cast(ceil(sum(len(record_ids)) * 8 / 33554432.0) as bigint)) as n_blocks from tile_files group by 1, 2, 3""",
    "p3_areas": f"with {_INSIDE} select point_id, area_id from inside",
    "p3_found": f"""with {_INSIDE},
  binned as (select *, floor(x / {NEAR_METERS}) as bx, floor(y / {NEAR_METERS}) as by_ from inside where container is not null),
  around as (select b.*, bx + dx as nx, by_ + dy as ny from binned b, (values (-1), (0), (1)) s(dx), (values (-1), (0), (1)) t(dy))
  select a.point_id as point_id_a, b.point_id as point_id_b, a.area_id from around a
  join binned b on a.nx = b.bx and a.ny = b.by_ and a.area_id = b.area_id
  where a.point_id < b.point_id and a.container <> b.container
  and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {NEAR_METERS} * {NEAR_METERS}""",
    "p3_near_counts": f"""with pts as (select distinct point_id, x, y, container from points where x is not null and y is not null and container is not null),
  binned as (select *, floor(x / {NEAR_METERS}) as bx, floor(y / {NEAR_METERS}) as by_ from pts),
  around as (select b.*, bx + dx as nx, by_ + dy as ny from binned b, (values (-1), (0), (1)) s(dx), (values (-1), (0), (1)) t(dy)),
  counted as (select a.point_id, count(*) as n from around a join binned b on a.nx = b.bx and a.ny = b.by_
  where a.container <> b.container and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {NEAR_METERS} * {NEAR_METERS} group by 1)
  select point_id, coalesce(n, 0) as n_near from pts left join counted using (point_id)""",
    "p3_near_areas": f"""with m as (select area_id, (list_min([p.x for p in ring]) + list_max([p.x for p in ring])) / 2 as x, (list_min([p.y for p in ring]) + list_max([p.y for p in ring])) / 2 as y from areas)
  select a.area_id as area_id_a, b.area_id as area_id_b from m a join m b on a.area_id < b.area_id
  where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {AREA_METERS} * {AREA_METERS}""",
    "p6_found": f"""select key_kind, key_name from {_KEYS} where key_name is not null group by 1, 2
  having count(*) >= 0.02 * (select count(*) from points)""",
    "p6_key_shoals": f"""with k as (select key_kind, key_name, cast(z as double) as z from {_KEYS} where key_name is not null and isfinite(z)),
  m as (select key_kind, key_name, round(avg(z), 3) as mean_z from k group by 1, 2)
  select key_kind, key_name, count(*) as n_rows, count(*) filter (where z < mean_z) as n_shoaler from k join m using (key_kind, key_name) group by 1, 2""",
    "p6_key_stats": f"""select key_kind, key_name, count(*) as n_rows,
  round(avg(cast(z as double)) filter (where isfinite(z)), 3) as mean_z,
  min(cast(z as double)) filter (where not isnan(z)) as least_z,
  count(*) >= 0.02 * (select count(*) from points) as is_heavy
  from {_KEYS} where key_name is not null group by 1, 2""",
}
