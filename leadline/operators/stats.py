"""Statistics over cells: counts, coverage, densities, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import origin

#: Fixed value: square meters in a square nautical mile.
SQUARE_NM = 3434290.012


def cell_counts(cells: DataFrame, layer: str = "depth") -> DataFrame:
    """``(resolution, n_cells)`` of cells with the layer."""
    return cells.where(F.col(layer).isNotNull()).groupBy("resolution").agg(F.count("*").alias("n_cells"))


def coverage(cells: DataFrame, layer: str = "depth") -> DataFrame:
    """``(square_meters, square_nm)``; each tile and resolution is rounded half-even before they are added."""
    parts = cells.where(F.col(layer).isNotNull()).groupBy("tile_x", "tile_y", "resolution").agg(F.bround(F.count("*") * F.col("resolution") * F.col("resolution"), 3).alias("_a"))
    total = F.coalesce(F.sum("_a"), F.lit(0.0))
    return parts.agg(total.alias("square_meters"), (total / F.lit(SQUARE_NM)).alias("square_nm"))


def densities(cells: DataFrame, depth: str = "depth") -> DataFrame:
    """``(density, density_m2, depth)`` of every filled cell."""
    return cells.where("density > 0").select("density", (F.col("density") / (F.col("resolution") * F.col("resolution"))).alias("density_m2"), F.col(depth).alias("depth"))


def histogram(values: DataFrame, bins: int = 50) -> DataFrame:
    """``(bin, low, high, n)`` of the column ``value`` in equal bins from its least to its greatest; the last is closed, empty ones are listed.

    If all values are equal, the range is one wide about them.
    """
    if bins < 1:
        raise ValueError("bins must be at least 1")
    v = F.col("value").cast("double")
    some = values.where(F.col("value").isNotNull())
    ends = some.agg(F.min(v).alias("_a"), F.max(v).alias("_b")).where("_a is not null")
    flat = F.col("_a") == F.col("_b")
    ends = ends.select(F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"), F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"))
    place = F.least(F.floor((v - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)).cast("int")
    counted = some.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    every = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", width.alias("_w"))
    return every.join(counted, "bin", "left").select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def mean_by_depth(pairs: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """``(bin, depth, mean_value)``: the mean of ``value`` in bins of ``depth``; the depth is the bin's upper edge, bins count from 1.

    The bins reach a millimeter beyond the least and greatest depth.
    """
    d = F.col("depth").cast("double")
    some = pairs.where(F.col("depth").isNotNull()).select(d.alias("depth"), value.cast("double").alias("_v"))
    ends = some.agg((F.min("depth") - 0.001).alias("_lo"), (F.max("depth") + 0.001).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    place = (F.floor((F.col("depth") - F.col("_lo")) / step) + 1).cast("int")
    rows = some.crossJoin(F.broadcast(ends)).withColumns({"bin": place, "_step": step})  # one row
    return rows.groupBy("bin", "_lo", "_step").agg(F.avg("_v").alias("mean_value")).select("bin", (F.col("_lo") + F.col("bin") * F.col("_step")).alias("depth"), "mean_value")


def trial_counts(tiled: DataFrame, resolution: float, prefix: str = "tile") -> DataFrame:
    """``(tile, cell_x, cell_y, n)``: points in the cells of a resolution under trial."""
    return tiled.groupBy(f"{prefix}_x", f"{prefix}_y", origin(F.col("x"), resolution).alias("cell_x"), origin(F.col("y"), resolution).alias("cell_y")).agg(F.count("*").alias("n"))


def layer_range(cells: DataFrame, layers: list[str]) -> DataFrame:
    """``(layer, least, greatest)``, as raster headers want it."""
    one = cells.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in layers for n, f in (("least", F.min), ("greatest", F.max))])
    each = F.array(*[F.struct(F.lit(c).alias("layer"), F.col(f"least_{c}").alias("least"), F.col(f"greatest_{c}").alias("greatest")) for c in layers])
    return one.select(F.explode(each).alias("r")).select("r.*")
