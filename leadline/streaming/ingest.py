"""Streams of points: batches into a grid, or running cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.keys import check_size, with_cells, with_tiles


def ingest(points: DataFrame, grid, prefix: str, checkpoint: str, regrid: bool = True, **gridding) -> StreamingQuery:
    """Add every micro-batch of a stream to ``grid`` as container ``{prefix}__{batch}`` and grid the tiles it touches.

    The batch's number is in the container's name: a batch that is replayed
    after a failure replaces itself.  What arrives late is just another
    container.
    """

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        grid.replace_points(batch, f"{prefix}__{number}", vertical_reference=grid.vertical_reference)
        if regrid:
            grid.grid(regrid_option="update" if not grid.no_grid else "full", **gridding)

    return points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def running_cells(points: DataFrame, resolution: float, tile_size: float = 1024.0) -> DataFrame:
    """Cells of a stream at one resolution, kept up to date: sums, counts and the shoalest point, which all add up.

    Use it with ``outputMode("update")``; the state is one short row a cell.
    """
    tiled = with_tiles(points, tile_size).withColumn("resolution", F.lit(check_size(resolution, "resolution")))
    keys = ["tile_x", "tile_y", "resolution", "row", "col"]
    return with_cells(tiled).groupBy(*keys).agg(F.avg(F.col("z").cast("double")).alias("depth"), F.min("z").alias("shoalest"), F.count("*").alias("density"))


def windowed_cells(points: DataFrame, time: str, resolution: float, window: str, late: str, slide: str | None = None, tile_size: float = 1024.0) -> DataFrame:
    """The same by windows of time; points later than ``late`` are left out and closed windows leave the state."""
    tiled = with_tiles(points.withWatermark(time, late), tile_size).withColumn("resolution", F.lit(check_size(resolution, "resolution")))
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return with_cells(tiled).groupBy(span.alias("window"), "tile_x", "tile_y", "resolution", "row", "col").agg(F.avg(F.col("z").cast("double")).alias("depth"), F.min("z").alias("shoalest"), F.count("*").alias("density"))
