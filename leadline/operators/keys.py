"""Tile and cell keys: arithmetic on coordinates, no lattice is ever built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import is_power_of_two


def origin(c: Column, size: float) -> Column:
    """The lower edge of the half-open bin ``[k * size, (k + 1) * size)``."""
    return F.floor(c / F.lit(float(size))).cast("double") * F.lit(float(size))


def placed(*coordinates: str) -> Column:
    """Whether all of these columns are there and finite."""
    ok = F.lit(True)
    for c in coordinates:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok


def check_size(size: float, name: str) -> float:
    """``size`` as a float, if it is a power of two."""
    if not is_power_of_two(size):
        raise ValueError(f"{name} must be a power of two, got {size}")
    return float(size)


def with_tiles(points: DataFrame, size: float, prefix: str = "tile") -> DataFrame:
    """Add ``{prefix}_x`` and ``{prefix}_y``, the south-west corner of each point's tile; points without finite coordinates are left out."""
    size = check_size(size, "tile size")
    some = points.where(placed("x", "y"))
    return some.withColumns({f"{prefix}_x": origin(F.col("x"), size), f"{prefix}_y": origin(F.col("y"), size)})


def with_cells(tiled: DataFrame, prefix: str = "tile") -> DataFrame:
    """Add ``row`` and ``col`` of each point in its tile at ``resolution``; row 0 is in the south."""
    index = lambda v, o: F.floor((F.col(v) - F.col(o)) / F.col("resolution")).cast("int")
    return tiled.withColumns({"row": index("y", f"{prefix}_y"), "col": index("x", f"{prefix}_x")})


def flat_index(row: Column, col: Column, size: float, resolution: Column) -> Column:
    """``row * ncols + col``."""
    return (row * F.ceil(F.lit(float(size)) / resolution) + col).cast("int")


def row_col(index: Column, n_cols: Column) -> Column:
    """Row and column of a flat index."""
    return F.struct(F.floor(index / n_cols).cast("int").alias("row"), F.pmod(index, n_cols).cast("int").alias("col"))


def node(tile: str, index: str) -> Column:
    """The coordinate of a cell's center."""
    return F.col(tile) + (F.col(index) + F.lit(0.5)) * F.col("resolution")


def aligned_extents(points: DataFrame, size: float) -> DataFrame:
    """One row ``min_x, min_y, max_x, max_y``: the box of all points on tile borders, one tile more where a point lies on the upper border."""
    size = F.lit(float(size))
    box = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)])
    low = lambda c: F.floor(F.col(c) / size) * size
    high = lambda c: F.when(F.ceil(F.col(c) / size) * size == F.col(c), F.col(c) + size).otherwise(F.ceil(F.col(c) / size) * size)
    return box.select(low("min_x").alias("min_x"), low("min_y").alias("min_y"), high("max_x").alias("max_x"), high("max_y").alias("max_y"))
