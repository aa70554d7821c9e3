"""Layer values at given places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def values_at(places: DataFrame, cells: DataFrame, layer: str, key: str = "query_id", nodata: float | None = None, resolutions: list[float] | None = None) -> DataFrame:
    """``(key, x, y, resolution, value)``: the value of the finest cell that has one, at each place; none gives ``nodata``.

    A place has one cell index at each resolution, so this is an equality join
    on (resolution, index), with the handful of resolutions there are.  Places
    with null coordinates find nothing.  Repeated keys are answered once a row.
    ``resolutions`` names those that ``cells`` may have, where they are known,
    as those of a grid are; else they are looked for first.
    """
    if resolutions is None:
        resolutions = [r.resolution for r in cells.select("resolution").distinct().orderBy("resolution").limit(65).collect()]
    if len(resolutions) > 64:
        raise ValueError("more resolutions than powers of two make sense")
    if not resolutions:
        return places.select(key, "x", "y", F.lit(None).cast("double").alias("resolution"), F.lit(nodata).cast("double").alias("value"))
    index = lambda c, r: F.floor(c / r).cast("bigint")
    asked = places.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), "x", "y")
    each = asked.select("*", F.explode(F.array(*[F.lit(r) for r in resolutions])).alias("resolution"))
    each = each.withColumns({"_gx": index(F.col("x"), F.col("resolution")), "_gy": index(F.col("y"), F.col("resolution"))})
    # Tiles start at multiples of every resolution in use, so an index within the tile gives one within the plane.
    have = cells.where(F.col(layer).isNotNull()).select("resolution", (index(F.col("tile_x"), F.col("resolution")) + F.col("col")).alias("_gx"), (index(F.col("tile_y"), F.col("resolution")) + F.col("row")).alias("_gy"), F.col(layer).cast("double").alias("_v"))
    # The places pass through once: their row numbers need not be the same on a second reading.
    found = F.min(F.when(F.col("_v").isNotNull(), F.struct("resolution", "_v")))
    best = each.join(have, ["resolution", "_gx", "_gy"], "left").groupBy("_row").agg(F.first("_key").alias(key), F.first("x").alias("x"), F.first("y").alias("y"), found.alias("_b"))
    return best.select(key, "x", "y", F.col("_b.resolution").alias("resolution"), F.coalesce(F.col("_b._v"), F.lit(nodata).cast("double")).alias("value"))
