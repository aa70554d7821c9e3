"""Tiles next to each other, and the points near their shared borders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a tile, and the step in x and y to the neighbor there, in the order neighbors are given.
SIDES = (("south", 0, -1), ("east", 1, 0), ("north", 0, 1), ("west", -1, 0))


def tile_neighbors(tiles: DataFrame, size: float) -> DataFrame:
    """``(tile_x, tile_y, side, position, neighbor_x, neighbor_y)``: the up to four tiles beside each tile that there are."""
    each = tiles.select("tile_x", "tile_y").distinct()
    steps = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("side"), (F.col("tile_x") + dx * size).alias("x"), (F.col("tile_y") + dy * size).alias("y")) for i, (s, dx, dy) in enumerate(SIDES)])
    wanted = each.select("tile_x", "tile_y", F.explode(steps).alias("s")).select("tile_x", "tile_y", "s.side", "s.position", F.col("s.x").alias("neighbor_x"), F.col("s.y").alias("neighbor_y"))
    there = each.select(F.col("tile_x").alias("neighbor_x"), F.col("tile_y").alias("neighbor_y"))
    return wanted.join(there, ["neighbor_x", "neighbor_y"]).select("tile_x", "tile_y", "side", "position", "neighbor_x", "neighbor_y")


def halo_points(tiled: DataFrame, size: float, buffer: float) -> DataFrame:
    """Each point once for every neighboring tile from whose border it is at most ``buffer`` away: the point's columns, and ``for_x``, ``for_y``.

    Only the sides count, not the corners, and only tiles that have points.
    Every point makes at most four copies, in place; no range join.
    """
    if not 0 <= buffer <= size:
        raise ValueError("buffer must be between 0 and the tile's size")
    to = lambda dx, dy: F.struct((F.col("tile_x") + dx * size).alias("x"), (F.col("tile_y") + dy * size).alias("y"))
    near = F.array(
        F.when(F.col("y") >= F.col("tile_y") + size - buffer, to(0, 1)),
        F.when(F.col("y") <= F.col("tile_y") + buffer, to(0, -1)),
        F.when(F.col("x") >= F.col("tile_x") + size - buffer, to(1, 0)),
        F.when(F.col("x") <= F.col("tile_x") + buffer, to(-1, 0)),
    )
    copies = tiled.withColumn("_for", F.explode(F.filter(near, lambda t: t.isNotNull()))).withColumns({"for_x": F.col("_for.x"), "for_y": F.col("_for.y")}).drop("_for")
    there = tiled.select(F.col("tile_x").alias("for_x"), F.col("tile_y").alias("for_y")).distinct()
    return copies.join(there, ["for_x", "for_y"], "left_semi")


def tile_outlines(tiles: DataFrame, size: float) -> DataFrame:
    """``(tile_x, tile_y, corner, x, y)``: the five corners of each tile's closed outline."""
    corners = ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))
    each = F.array(*[F.struct(F.lit(i).alias("corner"), (F.col("tile_x") + dx * size).alias("x"), (F.col("tile_y") + dy * size).alias("y")) for i, (dx, dy) in enumerate(corners)])
    return tiles.select("tile_x", "tile_y").distinct().select("tile_x", "tile_y", F.explode(each).alias("c")).select("tile_x", "tile_y", "c.*")


def geotransforms(cells: DataFrame, size: float) -> DataFrame:
    """``(tile_x, tile_y, resolution, origin_x, pixel_width, skew_x, origin_y, skew_y, pixel_height)`` of each tile and resolution with cells."""
    single = lambda c: c.cast("float").cast("double")
    return cells.select("tile_x", "tile_y", "resolution").distinct().select(
        "tile_x", "tile_y", "resolution", single(F.col("tile_x")).alias("origin_x"), F.col("resolution").alias("pixel_width"), F.lit(0.0).alias("skew_x"),
        single(F.col("tile_y") + size).alias("origin_y"), F.lit(0.0).alias("skew_y"), (-F.col("resolution")).alias("pixel_height"),
    )
