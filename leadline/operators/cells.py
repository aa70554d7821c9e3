"""Gridding: points to cells as one lazy plan.

A method is a name with a list of aggregates, or with a function over the
points of a tile.  Cells are rows; an empty cell is no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import to_mm
from .keys import check_size, node, with_cells, with_tiles
from .resolution import by_density, by_depth

Aggregates = Callable[[DataFrame, bool], list[Column]]

_methods: dict[str, Aggregates] = {}
_tile_methods: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, aggregates: Aggregates) -> None:
    """Add a method of built-in aggregates: ``(points, single) -> aliased columns``."""
    _methods[name] = aggregates


def register_tile_method(name: str, function: Callable[..., DataFrame]) -> None:
    """Add a method over whole tiles: ``(points with keys and resolution, leaf size, parameters) -> cells``."""
    _tile_methods[name] = function


def methods() -> list[str]:
    """Names of all methods."""
    return sorted([*_methods, *_tile_methods])


def check_method(name: str) -> str:
    """``name``, if there is such a method."""
    if name not in methods():
        raise ValueError(f"unknown method {name!r}; there are {methods()}")
    return name


def _has(points: DataFrame, column: str) -> bool:
    return column in points.columns


def _mean(points: DataFrame, single: bool) -> list[Column]:
    mean = lambda c: to_mm(F.avg(F.col(c).cast("double")), single)
    out = [mean("z").alias("depth"), F.count("*").alias("density")]
    out += [mean(c).alias(n) for c, n in (("tvu", "vertical_uncertainty"), ("thu", "horizontal_uncertainty")) if _has(points, c)]
    return out


def _shoalest(points: DataFrame, single: bool) -> list[Column]:
    # Ties in z go to the least tvu, then the least thu, so that every run agrees.
    extra = [c for c in ("tvu", "thu") if _has(points, c)]
    best = F.min(F.when(F.col("z").isNotNull(), F.struct("z", *extra)))
    names = {"tvu": "vertical_uncertainty", "thu": "horizontal_uncertainty"}
    return [to_mm(best["z"], single).alias("depth"), F.count("*").alias("density"), *[to_mm(best[c], single).alias(names[c]) for c in extra]]


register("mean", _mean)
register("shoalest", _shoalest)


def aggregate_cells(keyed: DataFrame, method: str, leaf: float, prefix: str = "tile", single: bool = False, extra: tuple[str, ...] = (), parameters: dict | None = None) -> DataFrame:
    """Cells of points that have tile keys and ``resolution``: ``({prefix}_x, {prefix}_y, resolution, row, col, layers...)``.

    One shuffle, on the cell's key, of rows combined beforehand.  ``extra``
    columns become part of the key.
    """
    check_method(method)
    if method in _tile_methods:
        return _tile_methods[method](keyed, leaf, prefix, parameters or {})
    keys = [f"{prefix}_x", f"{prefix}_y", "resolution", "row", "col", *extra]
    return with_cells(keyed, prefix).groupBy(*keys).agg(*_methods[method](keyed, single))


def with_nodes(cells: DataFrame, prefix: str = "tile") -> DataFrame:
    """Add ``x`` and ``y``, the center of each cell."""
    return cells.withColumns({"x": node(f"{prefix}_x", "col"), "y": node(f"{prefix}_y", "row")})


def tile_means(tiled: DataFrame, prefix: str = "tile") -> DataFrame:
    """``({prefix}_x, {prefix}_y, n, mean_z)``; the mean as a 32-bit float, which decides the resolution at a border."""
    return tiled.groupBy(f"{prefix}_x", f"{prefix}_y").agg(F.count("*").alias("n"), F.avg(F.col("z").cast("double")).cast("float").alias("mean_z"))


def with_resolution(tiled: DataFrame, resolutions: DataFrame, prefix: str = "tile") -> DataFrame:
    """Each point with its tile's resolution.

    Whether the tiles are sent to all executors or shuffled is left to Spark,
    which knows their size.  Tiles without any depth have none and are left out.
    """
    keys = [f"{prefix}_x", f"{prefix}_y"]
    return tiled.join(resolutions.select(*keys, "resolution").where("resolution is not null"), keys)


def single_resolution(points: DataFrame, method: str = "mean", resolution: float | None = None, mode: str = "depth", tile_size: float = 1024.0, single: bool = False, parameters: dict | None = None) -> DataFrame:
    """Cells of one resolution: given, by the mean depth of all points, or the coarsest that the tiles' density asks for."""
    tiled = with_tiles(points, tile_size)
    if resolution is not None:
        keyed = tiled.withColumn("resolution", F.lit(min(check_size(resolution, "resolution"), float(tile_size))))
    else:
        if mode == "depth":
            mean = to_mm(F.avg(F.col("z").cast("double")), single).cast("double")
            one = points.agg(by_depth(mean, tile_size).alias("resolution"))
        elif mode == "density":
            one = by_density(tiled, tile_size, single=single).agg(F.max("resolution").alias("resolution"))
        else:
            raise ValueError("mode must be 'depth' or 'density'")
        keyed = tiled.crossJoin(F.broadcast(one))  # one row
    return aggregate_cells(keyed, method, tile_size, single=single, parameters=parameters)


def leaf_resolutions(tiled: DataFrame, leaf: float, mode: str, single: bool = False) -> DataFrame:
    """``(tile_x, tile_y, resolution)`` of every leaf tile."""
    if mode == "depth":
        return tile_means(tiled).select("tile_x", "tile_y", by_depth(F.col("mean_z").cast("double"), leaf).alias("resolution"))
    if mode == "density":
        return by_density(tiled, leaf, single=single).select("tile_x", "tile_y", "resolution")
    raise ValueError("mode must be 'depth' or 'density'")


def variable_resolution(points: DataFrame, method: str = "mean", resolution: float | None = None, mode: str = "depth", leaf: float = 128.0, single: bool = False, parameters: dict | None = None) -> DataFrame:
    """Cells whose resolution is chosen leaf tile by leaf tile."""
    tiled = with_tiles(points, leaf)
    if resolution is not None:
        keyed = tiled.withColumn("resolution", F.lit(min(check_size(resolution, "resolution"), float(leaf))))
    else:
        keyed = with_resolution(tiled, leaf_resolutions(tiled, leaf, mode, single))
    return aggregate_cells(keyed, method, leaf, single=single, parameters=parameters)


def kept_cells(old: DataFrame, live: DataFrame, regridded: DataFrame | None, new: DataFrame, clear: bool, prefix: str = "tile") -> DataFrame:
    """Of the cells there were, those that stay after a run.

    An old cell goes if its tile has no points left, or if its tile was gridded
    again at the same resolution, or at any if ``clear``.  ``regridded`` are
    the tiles of an update, ``live`` then only needs their points; ``None``
    means all tiles, and ``live`` all points.
    """
    tile = [f"{prefix}_x", f"{prefix}_y"]
    there = live.select(*tile).distinct()
    if regridded is None:
        stay = old.join(there, tile, "left_semi")
        return stay.where("false") if clear else stay.join(new.select(*tile, "resolution").distinct(), [*tile, "resolution"], "left_anti")
    done = regridded.select(*tile).distinct()
    if clear:
        return old.join(done, tile, "left_anti")
    gone = done.join(there, tile, "left_anti")
    return old.join(gone, tile, "left_anti").join(new.select(*tile, "resolution").distinct(), [*tile, "resolution"], "left_anti")


def merge_cells(old: DataFrame, new: DataFrame, live: DataFrame, regridded: DataFrame | None, clear: bool, prefix: str = "tile") -> DataFrame:
    """Cells after a run: the new ones, and of the old ones those of :func:`kept_cells`."""
    return new.unionByName(kept_cells(old, live, regridded, new, clear, prefix), allowMissingColumns=True)
