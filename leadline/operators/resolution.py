"""Choosing a cell size from depth or from density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import origin

#: The resolution in meters that goes with a greatest depth.
DEPTH_RESOLUTION = {10: 0.25, 20: 0.5, 40: 1.0, 60: 2.0, 80: 4.0, 160: 8.0, 320: 16.0, 640: 32.0, 1280: 64.0, 2560: 128.0, 5120: 256.0, 10240: 512.0, 20480: 1024.0}
#: Fixed values of the density method.
POINTS_PER_CELL, START, NOISE, FULL_ENOUGH = 5, 16.0, 0.75, 0.75
RESOLUTIONS = sorted(DEPTH_RESOLUTION.values())


def by_depth(mean: Column, tile_size: float) -> Column:
    """The resolution of the first depth over ``mean``, at most the tile's size.

    A mean of 20,480 or more finds none and gets the finest resolution.  A null
    mean gives null.
    """
    res = F.lit(RESOLUTIONS[0])
    for depth in sorted(DEPTH_RESOLUTION, reverse=True):
        res = F.when(mean < depth, F.lit(DEPTH_RESOLUTION[depth])).otherwise(res)
    return F.when(mean.isNotNull(), F.least(res, F.lit(float(tile_size))))


def resolution_for_depth(mean: float, tile_size: float) -> float:
    """The same for a plain number; 0 and ``None`` have no resolution."""
    if not mean:
        raise ValueError("no resolution for a mean depth of zero or none")
    res = next((r for d, r in sorted(DEPTH_RESOLUTION.items()) if d > mean), RESOLUTIONS[0])
    return float(min(res, tile_size))


def _by_depth_at_least(mean: Column) -> Column:
    """Of the density method: the first depth at or over ``mean``; the coarsest if none."""
    res = F.lit(RESOLUTIONS[-1])
    for depth in sorted(DEPTH_RESOLUTION, reverse=True):
        res = F.when(mean <= depth, F.lit(DEPTH_RESOLUTION[depth])).otherwise(res)
    return res


def _at_least(value: Column) -> Column:
    res = F.lit(RESOLUTIONS[-1])
    for r in reversed(RESOLUTIONS):
        res = F.when(value <= F.lit(r), F.lit(r)).otherwise(res)
    return res


def by_density(tiled: DataFrame, tile_size: float, prefix: str = "tile", start: float | None = None, noise: float | None = None, single: bool = False) -> DataFrame:
    """``({prefix}_x, {prefix}_y, resolution, full, estimate)`` of each tile.

    Points are counted in coarse cells.  Where too few of these are filled, the
    depth decides; else each cell's density calls for a resolution, and their
    mean, weighted by points, is raised to the next one there is.  Two
    aggregations: cells first, then tiles, the second over one short row a cell.
    """
    if start is not None and start not in RESOLUTIONS:
        raise ValueError(f"start must be one of {RESOLUTIONS}")
    s = min(float(tile_size), start or START)
    noise = NOISE if noise is None else noise
    keys = [f"{prefix}_x", f"{prefix}_y"]
    cell = [origin(F.col(c), s).alias(f"_c{c}") for c in ("x", "y")]
    cells = tiled.groupBy(*keys, *cell).agg(F.count("*").alias("_n"), F.sum(F.col("z").cast("double")).alias("_z"), F.count("z").alias("_nz"))
    estimate = F.sqrt(F.lit(2.0 * POINTS_PER_CELL * (1 + noise)) / (F.col("_n") / F.lit(s * s)))
    tiles = cells.groupBy(*keys).agg(F.count("*").alias("_cells"), (F.sum(estimate * F.col("_n")) / F.sum("_n")).alias("estimate"), F.try_divide(F.sum("_z"), F.sum("_nz")).alias("_mean"))
    mean = F.col("_mean").cast("float").cast("double") if single else F.col("_mean")
    full = F.col("_cells") / F.lit(float(int((tile_size / s) ** 2)))
    res = F.when(full <= FULL_ENOUGH, _by_depth_at_least(mean)).otherwise(_at_least(F.col("estimate")))
    return tiles.select(*keys, F.least(res, F.lit(float(tile_size))).alias("resolution"), full.alias("full"), "estimate")


def by_hill_climb(tiled: DataFrame, tile_size: float, prefix: str = "tile", start: float | None = None) -> DataFrame:
    """The older density method: ``({prefix}_x, {prefix}_y, resolution)``.

    From ``start`` on, a step coarser while any cell has fewer points than
    asked for, a step finer while all have more than four times as many; going
    back and forth ends at the coarser of the two.  Counts at all resolutions
    come from one pass, each from the finer one.
    """
    if start is not None and start not in RESOLUTIONS:
        raise ValueError(f"start must be one of {RESOLUTIONS}")
    keys = [f"{prefix}_x", f"{prefix}_y"]
    options = RESOLUTIONS
    fine = tiled.groupBy(*keys, origin(F.col("x"), options[0]).alias("_x"), origin(F.col("y"), options[0]).alias("_y")).agg(F.count("*").alias("_n"))
    # Beyond the tile's size a tile is one cell.
    at = lambda c, k, r: F.greatest(F.floor(F.col(c) / r) * r, F.col(k))
    each = fine.select(*keys, "_n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), at("_x", keys[0], r).alias("cx"), at("_y", keys[1], r).alias("cy")) for i, r in enumerate(options)])).alias("c"))
    cells = each.groupBy(*keys, "c").agg(F.sum("_n").alias("_n"))
    judged = cells.groupBy(*keys, "c.i").agg(F.when(F.min("_n") < POINTS_PER_CELL, 1).when(F.min("_n") > 4 * POINTS_PER_CELL, -1).otherwise(0).alias("_step"))
    steps = judged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "_step"))).alias("_s"))
    first = options.index(start or START)
    go = F.sequence(F.lit(0), F.lit(len(options)))
    # State: place, the place before, done.  A step back means that it would go back and forth.
    begin = F.struct(F.lit(first).alias("at"), F.lit(-1).alias("last"), F.lit(False).alias("done"))

    def walk(s, _):
        step = F.element_at("_s", s["at"] + 1)["_step"]
        to = s["at"] + step
        stop = (step == 0) | (to < 0) | (to >= len(options))
        back = ~stop & (to == s["last"])
        return F.when(s["done"], s).otherwise(F.struct(F.when(stop, s["at"]).when(back, F.greatest(to, s["at"])).otherwise(to).alias("at"), s["at"].alias("last"), (stop | back).alias("done")))

    return steps.withColumn("_w", F.aggregate(go, begin, walk)).select(*keys, F.element_at(F.array(*[F.lit(r) for r in options]), F.col("_w.at") + 1).alias("resolution"))

