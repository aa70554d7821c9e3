"""Square blocks of tiles that a raster writer can hold at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the greatest side of a block in meters.
GREATEST = 32768.0


def _section(i: Column, n: Column, longest: int) -> Column:
    """The section of place ``i`` where ``n`` places are split as evenly as can be into sections of at most ``longest``; the first ones are longer by one."""
    k = F.ceil(n / F.lit(longest))
    q, r = F.floor(n / k), n % k
    early = r * (q + 1)
    return F.when(i < early, F.floor(i / (q + 1))).otherwise(r + F.floor((i - early) / q)).cast("int")


def chunk_tiles(tiles: DataFrame, tile_size: float, greatest: float = GREATEST) -> DataFrame:
    """``(tile_x, tile_y, chunk, chunk_row, chunk_col)`` of each tile; chunks are numbered row by row, those without tiles don't occur."""
    longest = max(int(greatest // tile_size), 1)
    each = tiles.select("tile_x", "tile_y").distinct()
    ends = each.agg(*[f(c).alias(f"{n}_{c}") for c in ("tile_x", "tile_y") for n, f in (("lo", F.min), ("hi", F.max))])
    place = lambda c: ((F.col(c) - F.col(f"lo_{c}")) / F.lit(float(tile_size))).cast("bigint")
    n = lambda c: ((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / F.lit(float(tile_size)) + 1).cast("bigint")
    rows = each.crossJoin(F.broadcast(ends))  # one row
    across = F.ceil(n("tile_x") / F.lit(longest)).cast("int")
    rows = rows.select("tile_x", "tile_y", _section(place("tile_y"), n("tile_y"), longest).alias("chunk_row"), _section(place("tile_x"), n("tile_x"), longest).alias("chunk_col"), across.alias("_k"))
    return rows.select("tile_x", "tile_y", (F.col("chunk_row") * F.col("_k") + F.col("chunk_col")).alias("chunk"), "chunk_row", "chunk_col")


def chunk_geotransforms(chunked: DataFrame, resolution: float, tile_size: float) -> DataFrame:
    """``(chunk, origin_x, origin_y, n_cols, n_rows, longest)``: the block's north-west corner, its raster's shape, and its longer side in meters, 0 for a single tile."""
    size, res = F.lit(float(tile_size)), F.lit(float(resolution))
    side = lambda c: F.max(c) - F.min(c) + size
    return chunked.groupBy("chunk").agg(
        F.min("tile_x").cast("float").cast("double").alias("origin_x"), (F.max("tile_y") + size).cast("float").cast("double").alias("origin_y"),
        (side("tile_x") / res).cast("bigint").alias("n_cols"), (side("tile_y") / res).cast("bigint").alias("n_rows"),
        F.when(F.count("*") > 1, F.greatest(side("tile_x"), side("tile_y"))).otherwise(F.lit(0.0)).alias("longest"),
    )
