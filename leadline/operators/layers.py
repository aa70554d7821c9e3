"""Layers: chosen columns of the cells, as sparse rows or as a filled raster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole-number layers, whose empty value is 0.
COUNTS = ("density", "hypothesis_count")
KEYS = ("tile_x", "tile_y", "resolution", "row", "col")


def layer_names(cells: DataFrame) -> list[str]:
    """The layers of a cell table, in its order."""
    return [c for c in cells.columns if c not in (*KEYS, "x", "y", "container")]


def pick(cells: DataFrame, layers: list[str], resolution: float | None = None, nodata: float | None = None, positive_up: bool = False) -> DataFrame:
    """Keys and ``layers`` of the cells at ``resolution``.

    Null becomes ``nodata``, for counts its whole part or else 0; ``positive_up``
    turns the sign of ``depth``.
    """
    unknown = [n for n in layers if n not in layer_names(cells)]
    if unknown:
        raise ValueError(f"no layer {unknown}; there are {layer_names(cells)}")
    at = cells if resolution is None else cells.where(F.col("resolution") == F.lit(float(resolution)))
    out = []
    for n in layers:
        c = -F.col(n) if n == "depth" and positive_up else F.col(n)
        if n in COUNTS:
            c = F.coalesce(c, F.lit(int(nodata) if nodata is not None and nodata == nodata else 0))
        elif nodata is not None:
            c = F.coalesce(c, F.lit(float(nodata)).cast(dict(cells.dtypes)[n]))
        out.append(c.alias(n))
    return at.select(*KEYS, *out)


def values(cells: DataFrame, layer: str) -> DataFrame:
    """``(value)``: all values of a layer that are there, at all resolutions."""
    some = F.col(layer) != 0 if layer in COUNTS else F.col(layer).isNotNull()
    return cells.where(some).select(F.col(layer).alias("value"))


def with_grid_index(cells: DataFrame, min_x: float, min_y: float) -> DataFrame:
    """Add ``grid_row`` and ``grid_col``, counted from the grid's south-west corner."""
    index = lambda t, i, o: (F.floor((F.col(t) - F.lit(float(o))) / F.col("resolution")) + F.col(i)).cast("bigint")
    return cells.withColumns({"grid_row": index("tile_y", "row", min_y), "grid_col": index("tile_x", "col", min_x)})


def trim_bounds(indexed: DataFrame, layer: str) -> DataFrame:
    """``(resolution, min_row, min_col, max_row, max_col)`` of the cells that have the layer; the greater ones are one past the last."""
    return indexed.where(F.col(layer).isNotNull()).groupBy("resolution").agg(F.min("grid_row").alias("min_row"), F.min("grid_col").alias("min_col"), (F.max("grid_row") + 1).alias("max_row"), (F.max("grid_col") + 1).alias("max_col"))


def filled(indexed: DataFrame, layers: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """Every cell of the box, filled or not: ``(resolution, grid_row, grid_col, layers...)``.

    The box is that of the first layer, or the one row for each resolution in
    ``bounds``.  Rows are made in the executors from a range of row numbers;
    use it where a full raster is what is asked for.
    """
    box = bounds if bounds is not None else trim_bounds(indexed, layers[0])
    rows = box.select("resolution", "min_col", "max_col", F.explode(F.sequence("min_row", F.col("max_row") - 1)).alias("grid_row"))
    cells = rows.select("resolution", "grid_row", F.explode(F.sequence("min_col", F.col("max_col") - 1)).alias("grid_col"))
    have = indexed.select("resolution", "grid_row", "grid_col", *layers)
    out = cells.join(have, ["resolution", "grid_row", "grid_col"], "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in layers if n in COUNTS})


def surface(indexed: DataFrame, layers: list[str], min_x: float, min_y: float) -> DataFrame:
    """The filled box with the center of each cell: ``(resolution, x, y, layers...)``."""
    at = lambda i, o: F.lit(float(o)) + (F.col(i) + F.lit(0.5)) * F.col("resolution")
    return filled(indexed, layers).select("resolution", at("grid_col", min_x).alias("x"), at("grid_row", min_y).alias("y"), *layers)


def csv_rows(indexed: DataFrame, layers: list[str], min_x: float, min_y: float, positive_up: bool = True) -> DataFrame:
    """Rows of the CSV export, as text: all cells of the box with three decimals, ``nan`` where empty; ``depth`` becomes ``elevation`` if ``positive_up``, its sign turned if depths are positive."""
    rows = surface(indexed, layers, min_x, min_y)
    name = lambda n: "elevation" if n == "depth" and positive_up else n
    three = lambda c: F.coalesce(F.format_string("%.3f", c.cast("double")), F.lit("nan"))
    out = []
    for n in layers:
        c = -F.col(n) if n == "depth" and positive_up else F.col(n)
        out.append((c.cast("bigint").cast("string") if n in COUNTS else F.when(c.isNull(), F.lit("nan")).otherwise(three(c))).alias(name(n)))
    return rows.select("resolution", F.format_string("%.3f", F.col("x")).alias("x"), F.format_string("%.3f", F.col("y")).alias("y"), *out)


def container_layer(cells_of: DataFrame, name: str, layer: str = "depth") -> DataFrame:
    """The layers of one container's points under its name: ``{name}`` and ``{name}_density``."""
    return cells_of.select(*KEYS, F.col(layer).alias(name), F.col("density").alias(f"{name}_density"))

