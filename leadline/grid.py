"""The grid object: batches of points in, gridded surfaces out.

It holds a manifest and the names of tables in its folder, no data; every
answer is a plan over those tables.  Without a folder of its own it lives in
the shared folder of the session.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import charts as P
from .functions.names import family, tile_name
from .functions.rounding import to_mm
from .operators import cells as C
from .operators import chunks, layers, lookup, neighbors, stats
from .operators import resolution as R
from .operators.cube import CUBE
from .operators.keys import check_size, origin, placed
from .operators.slopes import plane_slopes
from .sources import export as X
from .sources.batch import COLUMNS, schema_of, to_frame
from .sources.shared import new_path
from .sources.store import BLOCK_TILES, ROOTS, Store, block_of, exists, find_root, has_content, named_blocks

_TIME = "%Y-%m-%dT%H:%M:%S"
TYPES, BACKENDS = tuple(ROOTS), ("parquet", "numpy", "zarr")


def create_grid(spark: SparkSession, folder_path: str = "", grid_type: str = "single_resolution", grid_backend: str = "parquet", tile_size: float = 1024.0, subtile_size: float = 128.0, is_backscatter: bool = False) -> Grid:
    """A new grid.  The backend's name is kept for reference; tables are always Parquet."""
    if grid_type not in TYPES:
        raise ValueError(f"grid_type must be one of {TYPES}")
    if grid_backend not in BACKENDS:
        raise ValueError(f"grid_backend must be one of {BACKENDS}")
    check_size(tile_size, "tile_size")
    if grid_type != "single_resolution":
        check_size(subtile_size, "subtile_size")
        if subtile_size > tile_size:
            raise ValueError("subtile_size can't exceed tile_size")
    folder = folder_path or new_path(spark, "grid")
    if folder_path and has_content(spark, folder):
        folder = f"{folder}_{datetime.now(UTC):%Y%m%d_%H%M%S}"
    manifest = {
        "grid_type": grid_type, "storage_type": grid_backend, "tile_size": float(tile_size), "subtile_size": float(subtile_size) if grid_type != "single_resolution" else None,
        "is_backscatter": bool(is_backscatter), "epsg": None, "crs": None, "vertical_reference": None, "min_time": None, "max_time": None, "mean_depth": 0.0, "containers": {}, "seq": 0,
        "extents": None, "grid_algorithm": None, "grid_resolution": None, "grid_parameters": None, "resolutions": [], "cells": None, "cell_schema": None, "touched": [],
    }
    grid = Grid(spark, Store(spark, f"{folder}/{ROOTS[grid_type]}"), manifest)
    grid._save()
    return grid


def load_grid(spark: SparkSession, folder_path: str) -> Grid:
    """The grid saved in a folder."""
    _, root = find_root(spark, folder_path)
    store = Store(spark, root)
    return Grid(spark, store, store.load_manifest())


def is_grid(spark: SparkSession, folder_path: str) -> bool:
    """Whether a folder holds one grid."""
    try:
        find_root(spark, folder_path)
    except ValueError:
        return False
    return True


class Grid:
    """Use :func:`create_grid` or :func:`load_grid`."""

    def __init__(self, spark: SparkSession, store: Store, manifest: dict):
        self.spark, self._store, self._m = spark, store, manifest
        self._saved = copy.deepcopy(manifest)
        self._frames: dict[str, DataFrame] = {}  # scans of what the manifest names, listed once

    def _save(self) -> None:
        self._frames = {}
        try:
            self._store.save_manifest(self._m)
        except Exception:
            self._m = copy.deepcopy(self._saved)  # what was meant to change has not
            raise
        self._saved = copy.deepcopy(self._m)

    def _kept(self, kind: str, make: Callable[[], DataFrame]) -> DataFrame:
        if kind not in self._frames:
            self._frames[kind] = make()
        return self._frames[kind]

    # What there is.

    @property
    def output_folder(self) -> str:
        return self._store.root.rsplit("/", 1)[0]

    @property
    def name(self) -> str:
        return self._store.root.rsplit("/", 1)[1]

    @property
    def is_variable(self) -> bool:
        return self._m["grid_type"] != "single_resolution"

    @property
    def tile_size(self) -> float:
        return self._m["tile_size"]

    @property
    def subtile_size(self) -> float | None:
        return self._m["subtile_size"]

    @property
    def leaf_size(self) -> float:
        """Side of the smallest tiles."""
        return self.subtile_size or self.tile_size

    @property
    def is_backscatter(self) -> bool:
        return self._m["is_backscatter"]

    @property
    def depth_key(self) -> str:
        return "intensity" if self.is_backscatter else "depth"

    @property
    def epsg(self) -> int | None:
        return self._m["epsg"]

    @property
    def vertical_reference(self) -> str | None:
        return self._m["vertical_reference"]

    @property
    def min_time(self) -> str | None:
        return self._m["min_time"]

    @property
    def max_time(self) -> str | None:
        return self._m["max_time"]

    @property
    def mean_depth(self) -> float:
        """Mean of the batch added last."""
        return self._m["mean_depth"]

    @property
    def resolutions(self) -> list[float]:
        return self._m["resolutions"]

    @property
    def grid_algorithm(self) -> str | None:
        return self._m["grid_algorithm"]

    @property
    def grid_resolution(self):
        return self._m["grid_resolution"]

    @property
    def containers(self) -> dict[str, list[str]]:
        """Source files of each container, in the order added."""
        return {n: c["files"] for n, c in self._m["containers"].items()}

    @property
    def container_timestamp(self) -> dict[str, str]:
        return {n: c["added_at"] for n, c in self._m["containers"].items()}

    @property
    def _columns(self) -> list[str]:
        """Columns that any batch has."""
        return [c for c in COLUMNS if any(c in k["columns"] for k in self._m["containers"].values())]

    @property
    def _block_side(self) -> float:
        return BLOCK_TILES * self.tile_size

    def _point_schema(self) -> T.StructType:
        return schema_of(self._columns)

    def _stored(self, blocks: set[str] | None = None, containers: list[str] | None = None, box: list[float] | None = None) -> DataFrame:
        """Stored points with their leaf tile, of some blocks or containers only, and of tiles with corners in a box.

        Folders of other blocks and batches are not opened, and row groups of
        tiles outside the box are skipped by their statistics.
        """
        every = self._kept("points", lambda: self._store.points([c["batch"] for c in self._m["containers"].values()], self._point_schema()))
        if containers is not None:
            every = every.where(F.col("batch").isin([self._m["containers"][c]["batch"] for c in containers]))
        if blocks is not None:
            every = every.where(F.col("block").isin(sorted(blocks)))
        if box is not None:
            every = every.where(F.col("tile_x").between(box[0], box[2]) & F.col("tile_y").between(box[1], box[3]))
        return every.drop("batch", "block")

    def points(self, containers: list[str] | None = None) -> DataFrame | None:
        """All points with their container, or those of some containers."""
        return None if self.is_empty else self._stored(containers=containers).drop("tile_x", "tile_y")

    def cells(self) -> DataFrame | None:
        """All cells; one row a cell, a column a layer."""
        return None if self.no_grid else self._kept("cells", lambda: self._store.cells(self._m["cells"], self._cell_schema()).drop("block"))

    def _cell_schema(self) -> T.StructType:
        return T.StructType.fromJson(self._m["cell_schema"])

    def _tiled(self, blocks: set[str] | None = None, box: list[float] | None = None) -> DataFrame:
        return self._stored(blocks, box=box).where("tile_x is not null")

    def _tiles(self, size: float, batches: list[str] | None = None) -> DataFrame:
        """Distinct tiles of a size, from what is kept of each batch; no point is read."""
        found = self._store.tiles([c["batch"] for c in self._m["containers"].values()] if batches is None else batches)
        return found.where("tile_x is not null").select(origin(F.col("tile_x"), size).alias("tile_x"), origin(F.col("tile_y"), size).alias("tile_y")).distinct()

    def _need_cells(self) -> DataFrame:
        if self.no_grid:
            raise ValueError("there is no grid yet")
        return self.cells()

    @property
    def is_empty(self) -> bool:
        return not self._m["containers"]

    @property
    def no_grid(self) -> bool:
        return self._m["cells"] is None

    @property
    def has_tiles(self) -> bool:
        return not self.is_empty

    @property
    def has_vertical_uncertainty(self) -> bool:
        return "tvu" in self._columns

    @property
    def has_horizontal_uncertainty(self) -> bool:
        return "thu" in self._columns

    @property
    def positive_up(self) -> bool:
        """Whether the vertical reference counts heights upward."""
        return 'height (h)",up' in (self.vertical_reference or "")

    @property
    def points_count(self) -> int:
        return sum(c["n"] for c in self._m["containers"].values())

    @property
    def number_of_tiles(self) -> int:
        return 0 if self.is_empty else self._tiles(self.tile_size).count()

    @property
    def point_count_changed(self) -> bool:
        """Whether points were added or removed since the tiles were last gridded."""
        return not self.is_empty and (self.no_grid or bool(self._m["touched"]))

    # Adding and removing points.

    def _check_crs(self, crs) -> tuple[int | None, str | None]:
        """The EPSG number, if there is one, and the text of a coordinate system; it must be that of the grid."""
        if crs is None:
            return self.epsg, self._m["crs"]
        text = str(crs).strip()
        number = text.upper().removeprefix("EPSG:")
        epsg, text = (int(number), None) if number.isdigit() else (None, text)
        if (self.epsg is not None or self._m["crs"]) and (epsg, text) != (self.epsg, self._m["crs"]):
            raise ValueError(f"coordinate system {crs} differs from {self.epsg or self._m['crs']}")
        return epsg, text

    def add_points(self, data, container_name: str, file_list: list[str] | None = None, crs=None, vertical_reference: str | None = None, min_time: float | None = None, max_time: float | None = None) -> None:
        """Add a batch under a name of its own.  ``crs`` is an EPSG number, or a system's text."""
        if container_name in self._m["containers"]:
            raise ValueError(f"container {container_name!r} is there already; remove it first")
        self._add(data, container_name, file_list, crs, vertical_reference, min_time, max_time)

    def replace_points(self, data, container_name: str, file_list: list[str] | None = None, crs=None, vertical_reference: str | None = None, min_time: float | None = None, max_time: float | None = None) -> None:
        """Put a batch in the place of the one that has its name, if there is one, in one step."""
        self._add(data, container_name, file_list, crs, vertical_reference, min_time, max_time)

    def _add(self, data, name: str, file_list, crs, vertical_reference, min_time, max_time) -> None:
        m, old = self._m, self.vertical_reference
        epsg, text = self._check_crs(crs)
        if old and old != vertical_reference and not ("MLLW" in old and "MLLW" in (vertical_reference or "")):
            raise ValueError(f"vertical reference {vertical_reference!r} differs from {old!r}")
        batch, rows = uuid.uuid4().hex, to_frame(self.spark, data)
        corner = lambda c: F.when(placed("x", "y"), origin(F.col(c), self.leaf_size))
        rows = rows.withColumns({"container": F.lit(name), "tile_x": corner("x"), "tile_y": corner("y")})
        self._store.write_points(rows.withColumn("block", block_of(F.col("tile_x"), F.col("tile_y"), self._block_side)), batch)
        stored = self._store.points([batch], schema_of(rows.columns))
        z = F.col("z").cast("double")
        ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")]
        per_tile = stored.groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"), F.count("z").alias("n_z"), F.sum(z).alias("sum_z"), F.max(z != 0).alias("nonzero"), *ends)
        # Points without a place make a row without a tile, whose ends don't count.
        per_tile = per_tile.withColumns({e: F.when(F.col("tile_x").isNotNull(), F.col(e)) for e in ("min_x", "min_y", "max_x", "max_y")})
        tiles = self._store.write_tiles(per_tile, batch)
        s = tiles.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), to_mm(F.try_divide(F.sum("sum_z"), F.sum("n_z")), True).alias("mean"), F.max("nonzero").alias("nonzero"), *[f(c).alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))]).first()
        if s.min_x is not None and s.min_y is not None:
            m["extents"] = self._grown([s.min_x, s.min_y, s.max_x, s.max_y])
        m["mean_depth"] = float(np.float32(s["mean"])) if s.nonzero and s["mean"] is not None else 0.0
        m["epsg"], m["crs"], m["vertical_reference"] = epsg, text, vertical_reference
        for key, value, pick in (("min_time", min_time, min), ("max_time", max_time, max)):
            if value is not None:
                seconds = int(value)
                if m[key]:
                    seconds = pick(seconds, int(datetime.strptime(m[key], _TIME).replace(tzinfo=UTC).timestamp()))
                m[key] = datetime.fromtimestamp(seconds, UTC).strftime(_TIME)
        before = m["containers"].pop(name, None)
        m["containers"][name] = {"files": list(file_list) if file_list else ["Unknown"], "added_at": f"{datetime.now(UTC):%Y%m%d_%H%M%S}", "batch": batch, "n": int(s.n), "columns": [c for c in COLUMNS if c in rows.columns], "seq": m["seq"]}
        m["seq"] += 1
        m["touched"] = [*m["touched"], batch, *([before["batch"]] if before else [])]
        gone = self._drop_empty_tiles(before["batch"]) if before else []
        self._save()
        self._store.drop([*gone, *([f"points/batch={before['batch']}"] if before else [])])

    def _grown(self, box: list[float]) -> list[float]:
        """Extents after another batch; a border that is aligned already moves out by a tile."""
        size, old = self.tile_size, self._m["extents"]
        low, high = box[:2], box[2:]
        if old:
            low, high = [min(a, b) for a, b in zip(low, old[:2], strict=True)], [max(a, b) for a, b in zip(high, old[2:], strict=True)]
        up = lambda v: v + size if np.ceil(v / size) * size == v else float(np.ceil(v / size) * size)
        return [*(float(np.floor(v / size) * size) for v in low), *(up(v) for v in high)]

    def remove_points(self, container_name: str | None = None) -> None:
        """Remove a container, and the cells of tiles that are left without points.

        A name that isn't there changes nothing; extents and mean depth stay.
        """
        found = self._m["containers"].pop(container_name, None)
        if found:
            self._frames = {}
            self._m["touched"] = [*self._m["touched"], found["batch"]]
            gone = self._drop_empty_tiles(found["batch"])
            self._save()
            self._store.drop([*gone, f"points/batch={found['batch']}"])

    def _drop_empty_tiles(self, batch: str) -> list[str]:
        """Take the cells of tiles that only a removed batch had points in out of the manifest; the folders that may go."""
        self._frames = {}
        if self.no_grid:
            return []
        tiles = self._tiles(self.leaf_size, [batch])
        empty = tiles.join(self._tiles(self.leaf_size), ["tile_x", "tile_y"], "left_anti")
        blocks, _ = named_blocks(empty, self._block_side)
        if blocks is not None and not blocks:
            return []
        version = uuid.uuid4().hex
        stay = self._store.cells(self._m["cells"], self._cell_schema(), blocks).join(empty, ["tile_x", "tile_y"], "left_anti")
        self._store.write_cells(stay, version)
        return self._put_version(version, blocks)

    def _put_version(self, version: str, blocks: set[str] | None) -> list[str]:
        """Let a version's blocks stand for these blocks, or for all; the folders that may go."""
        m, gone, left = self._m, [], {}
        for v, have in (m["cells"] or {}).items():
            stay = {b: r for b, r in have.items() if blocks is not None and b not in blocks}
            if stay:
                left[v] = stay
            gone += [f"cells/version={v}"] if not stay else [f"cells/version={v}/block={b}" for b in have if b not in stay]
        m["cells"] = left | {version: self._store.blocks_of(version)}
        m["resolutions"] = sorted({r for have in m["cells"].values() for rs in have.values() for r in rs})
        return gone

    def return_extents(self) -> list[list[float]]:
        e = self._m["extents"]
        return [e[:2], e[2:]] if e else None

    # Gridding.

    def _mean_resolution(self) -> float:
        return R.resolution_for_depth(self.mean_depth, self.tile_size)

    def resolution_by_density(self, starting_resolution: float | None = None) -> float:
        """The coarsest resolution that the leaf tiles' density asks for; 0 without tiles."""
        if self.is_empty:
            return 0.0
        return float(R.by_density(self._tiled(), self.leaf_size, start=starting_resolution, single=True).agg(F.max("resolution")).first()[0] or 0.0)

    def grid(self, algorithm: str = "mean", resolution: float | None = None, clear_existing: bool = False, auto_resolution_mode: str = "depth", regrid_option: str = "full", grid_parameters: dict | None = None) -> list[float]:
        """Grid all tiles, or only those whose points have changed (``regrid_option='update'``); the resolutions in use.

        Cells at other resolutions stay, unless ``clear_existing``.
        """
        C.check_method(algorithm)
        if self.is_empty:
            raise ValueError("there are no points to grid")
        if auto_resolution_mode not in ("depth", "density"):
            raise ValueError("auto_resolution_mode must be 'depth' or 'density'")
        if regrid_option not in ("full", "update"):
            raise ValueError("regrid_option must be 'full' or 'update'")
        if self.grid_algorithm and self.grid_algorithm != algorithm and not clear_existing and not self.no_grid:
            raise ValueError(f"the grid was made with {self.grid_algorithm!r}; clear_existing to change that")
        if algorithm == CUBE and not {"tvu", "thu"} <= set(self._columns):
            raise ValueError("this method needs tvu and thu")
        m, leaf, keys, side = self._m, self.leaf_size, ["tile_x", "tile_y"], self._block_side
        todo, blocks, box = None, None, None
        if regrid_option == "update" and not self.no_grid:
            # The tiles of the batches that came or went; only their blocks are read and written.
            todo = self._tiles(leaf, m["touched"])
            blocks, box = named_blocks(todo, side)
            if blocks is not None and not blocks:
                m["touched"] = []
                self._save()
                return self.resolutions
        some = self._tiled(blocks, box)
        if todo is not None:
            some = some.join(todo, keys, "left_semi")
        if resolution is not None:
            rez = some.withColumn("resolution", F.lit(min(check_size(resolution, "resolution"), leaf)))
        elif self.is_variable:
            rez = C.with_resolution(some, C.leaf_resolutions(some, leaf, auto_resolution_mode, single=True))
        else:
            one = self._mean_resolution() if auto_resolution_mode == "depth" else self.resolution_by_density()
            rez = some.withColumn("resolution", F.lit(one))
        parameters = dict(grid_parameters or {})
        if algorithm == CUBE and todo is not None:
            # The points about a tile's border count as well, whether or not their own tile is gridded now.
            steps = F.array(*[F.struct((F.col("tile_x") + dx * leaf).alias("tile_x"), (F.col("tile_y") + dy * leaf).alias("tile_y")) for dx, dy in ((0, 0), *[(x, y) for _, x, y in neighbors.SIDES])])
            around = named_blocks(todo.select(F.explode(steps).alias("t")).select("t.*"), side)
            parameters["halo"] = neighbors.halo_points(self._tiled(*around), leaf, leaf / 10).join(todo.toDF("for_x", "for_y"), ["for_x", "for_y"], "left_semi")
        new = C.aggregate_cells(rez, algorithm, leaf, single=True, parameters=parameters)
        if self.is_backscatter:
            new = new.withColumnRenamed("depth", "intensity")
        old_schema = self._cell_schema() if not self.no_grid else T.StructType([])
        version, with_block = uuid.uuid4().hex, lambda c: c.withColumn("block", block_of(F.col("tile_x"), F.col("tile_y"), side))
        self._store.write_cells(with_block(new), version)
        replaces_all = clear_existing and todo is None
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*new.schema.fields, *([] if replaces_all else [f for f in old_schema.fields if f.name not in new.columns])]])
        if not self.no_grid and not replaces_all:
            old = self._store.cells(m["cells"], old_schema, blocks)
            fresh = self._store.cells({version: self._store.blocks_of(version)}, schema).select(*keys, "resolution").distinct()
            self._store.write_cells(C.kept_cells(old, some, todo, fresh, clear_existing), version)
        gone = self._put_version(version, blocks)
        m["cell_schema"], m["touched"] = schema.jsonValue(), []
        m["grid_algorithm"], m["grid_parameters"] = algorithm, grid_parameters
        m["grid_resolution"] = resolution if resolution is not None else f"AUTO_{auto_resolution_mode.upper()}"
        self._save()
        self._store.drop([*gone, *self._stale_tiles()])
        return self.resolutions

    def _stale_tiles(self) -> list[str]:
        """Folders of tiles of batches that are gone and told for."""
        live = {c["batch"] for c in self._m["containers"].values()} | set(self._m["touched"])
        return [f"tiles/{n}" for n in self._store.names("tiles") if n.removeprefix("batch=") not in live]

    def clear_grid(self) -> None:
        """Drop the cells, keep the points."""
        self._m.update(cells=None, cell_schema=None, touched=[], resolutions=[], grid_algorithm=None, grid_resolution=None)
        self._save()
        self._store.drop(["cells"])

    # Layers.

    @property
    def layer_names(self) -> list[str]:
        return layers.layer_names(self.cells()) if not self.no_grid else []

    return_layer_names = layer_names

    def _one_resolution(self, resolution: float | None) -> float:
        if resolution is None:
            if len(self.resolutions) > 1:
                raise ValueError(f"name one of the resolutions {self.resolutions}")
            resolution = self.resolutions[0]
        return float(resolution)

    def _indexed(self, cells: DataFrame | None = None) -> DataFrame:
        return layers.with_grid_index(self._need_cells() if cells is None else cells, *self._m["extents"][:2])

    def _with_extra(self, names: list[str], resolution: float) -> DataFrame:
        """Cells at a resolution, with slopes and layers of single containers where they are asked for."""
        cells = self._need_cells().where(F.col("resolution") == F.lit(resolution))
        have, keys = layers.layer_names(cells), list(layers.KEYS)
        rez = lambda pts: pts.where("tile_x is not null").join(cells.select("tile_x", "tile_y").distinct(), ["tile_x", "tile_y"], "left_semi").withColumn("resolution", F.lit(resolution))
        if any(n in ("x_slope", "y_slope") for n in names):
            cells = cells.join(plane_slopes(rez(self._stored())), keys, "left")
        for n in names:
            bare = n.removesuffix("_density")
            if n not in have and n not in cells.columns and bare in self._m["containers"]:
                alone = C.aggregate_cells(rez(self._stored(containers=[bare])), self.grid_algorithm, self.leaf_size, single=True)
                cells = cells.join(layers.container_layer(alone, bare), keys, "left")
        return cells

    def layer_cells(self, layer: str | list[str] = "depth", resolution: float | None = None, nodatavalue: float | None = None, z_positive_up: bool = False) -> DataFrame:
        """The layers as sparse rows: keys and one column a layer.  A container's name gives the grid of its points alone."""
        names = [layer] if isinstance(layer, str) else list(layer)
        up = z_positive_up != self.positive_up
        return layers.pick(self._with_extra(names, self._one_resolution(resolution)), names, None, nodatavalue, up)

    def _raster(self, rows: DataFrame, names: list[str], resolution: float, box: tuple[int, int, int, int], nodata: float) -> list[np.ndarray]:
        """Filled arrays of a box of rows and columns; what is collected is the sparse cells in it."""
        r0, c0, r1, c1 = box
        at = rows.where(f"grid_row >= {r0} and grid_row < {r1} and grid_col >= {c0} and grid_col < {c1}").select("grid_row", "grid_col", *names).toPandas()
        out = []
        for n in names:
            whole = n in layers.COUNTS or n.endswith("_density")
            a = np.full((r1 - r0, c1 - c0), int(nodata) if whole and nodata == nodata else 0 if whole else nodata, dtype=np.int64 if whole else np.float32)
            v = at[n].to_numpy()
            ok = ~np.isnan(v.astype(float))
            a[at["grid_row"].to_numpy()[ok] - r0, at["grid_col"].to_numpy()[ok] - c0] = v[ok]
            out.append(a)
        return out

    def get_layers_by_name(self, layer: str | list[str] = "depth", resolution: float | None = None, nodatavalue: float = np.nan, z_positive_up: bool = False) -> list[np.ndarray] | None:
        """Filled arrays over the whole extents, row 0 in the south; ``None`` if there are no cells at the resolution."""
        self._need_cells()
        names, res = [layer] if isinstance(layer, str) else list(layer), self._one_resolution(resolution)
        rows = self._indexed(self.layer_cells(names, res, None, z_positive_up))
        if rows.where(F.col(names[0]).isNotNull()).isEmpty():
            return None
        x0, y0, x1, y1 = self._m["extents"]
        return self._raster(rows, names, res, (0, 0, int((y1 - y0) / res), int((x1 - x0) / res)), nodatavalue)

    def get_layers_trimmed(self, layer: str | list[str] = "depth", resolution: float | None = None, nodatavalue: float = np.nan, z_positive_up: bool = False):
        """Arrays of the box that the first layer fills, and its first and past-the-last row and column."""
        names, res = [layer] if isinstance(layer, str) else list(layer), self._one_resolution(resolution)
        rows = self._indexed(self.layer_cells(names, res, None, z_positive_up))
        b = layers.trim_bounds(rows, names[0]).first()
        if b is None:
            return None, None, None
        box = (b.min_row, b.min_col, b.max_row, b.max_col)
        return self._raster(rows, names, res, box, nodatavalue), [b.min_row, b.min_col], [b.max_row, b.max_col]

    def return_surf_xyz(self, layer: str | list[str] = "depth", resolution: float | None = None, cell_boundaries: bool = True, nodatavalue: float = np.nan):
        """x and y of the trimmed box, borders or centers of its cells, with its arrays and first and last indices."""
        res = self._one_resolution(resolution)
        data, mins, maxs = self.get_layers_trimmed(layer, res, nodatavalue)
        if data is None:
            return None, None, None, None, None
        axis = lambda o, a, b: o + res * (np.arange(a, b + 1) if cell_boundaries else np.arange(a, b) + 0.5)
        x0, y0 = self._m["extents"][:2]
        return axis(x0, mins[1], maxs[1]), axis(y0, mins[0], maxs[0]), data, mins, maxs

    def _packed(self, rows: DataFrame, names: list[str], by: list[str]) -> DataFrame:
        """A row for each leaf tile: where its cells lie in its raster, and the layers, as bytes of arrays."""
        side = {n: ("<i8" if self._is_whole(n) else "<f4") for n in names}
        leaf, keys = self.leaf_size, [*by, "tile_x", "tile_y"]

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            width = int(np.ceil(leaf / pdf["resolution"].iloc[0]))
            out = {k: [pdf[k].iloc[0]] for k in keys} | {"at": [(pdf["row"].to_numpy(np.int64) * width + pdf["col"].to_numpy(np.int64)).tobytes()]}
            for n, kind in side.items():
                v = pdf[n].to_numpy(float)
                out[n] = [(np.nan_to_num(v) if kind == "<i8" else v).astype(kind).tobytes()]
            return pd.DataFrame(out)

        kinds = dict(rows.dtypes)
        fields = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "at binary", *[f"`{n}` binary" for n in names]])
        return rows.select(*keys, "resolution", "row", "col", *names).groupBy(*keys).applyInPandas(pack, fields)

    @staticmethod
    def _is_whole(name: str) -> bool:
        return name in layers.COUNTS or name.endswith("_density")

    def _empty(self, names: list[str], rows: int, cols: int, nodata: float) -> dict[str, np.ndarray]:
        whole = int(nodata) if nodata == nodata else 0
        return {n: np.full((rows, cols), whole, np.int64) if self._is_whole(n) else np.full((rows, cols), nodata, np.float32) for n in names}

    @staticmethod
    def _put(data: dict[str, np.ndarray], tile, width: int, row: int, col: int) -> None:
        """Write a packed tile's cells into arrays in which its corner is at (row, col)."""
        at = np.frombuffer(tile["at"], np.int64)
        for n, a in data.items():
            v = np.frombuffer(tile[n], "<i8" if a.dtype == np.int64 else "<f4")
            ok = np.ones(len(v), bool) if a.dtype == np.int64 else ~np.isnan(v)
            a[row + at[ok] // width, col + at[ok] % width] = v[ok]

    def get_tiles_by_resolution(self, resolution: float | None = None, layer: str | list[str] = "depth", nodatavalue: float = np.nan, z_positive_up: bool = False) -> Iterator:
        """Yield for each leaf tile its geotransform, first row and column in the grid, number of cells a side, and arrays; a tile at a time is in memory."""
        names, res = [layer] if isinstance(layer, str) else list(layer), self._one_resolution(resolution)
        side = int(self.leaf_size / res)
        x0, y0 = self._m["extents"][:2]
        for t in self._packed(self.layer_cells(names, res, None, z_positive_up), names, []).orderBy("tile_y", "tile_x").toLocalIterator():
            data = self._empty(names, side, side, nodatavalue)
            self._put(data, t, side, 0, 0)
            geo = [float(np.float32(t.tile_x)), res, 0, float(np.float32(t.tile_y + self.leaf_size)), 0, -res]
            yield geo, int((t.tile_y - y0) / res), int((t.tile_x - x0) / res), side, data

    def get_geotransform(self, resolution: float) -> list[float]:
        x0, _, _, y1 = self._m["extents"]
        return [float(np.float32(x0)), float(resolution), 0, float(np.float32(y1)), 0, -float(resolution)]

    def get_tile_boundaries(self) -> DataFrame:
        return neighbors.tile_outlines(self._tiles(self.tile_size), self.tile_size)

    def get_tile_neighbors(self) -> DataFrame:
        return neighbors.tile_neighbors(self._tiles(self.tile_size), self.tile_size)

    def get_tile_neighbor_points(self, buffer_value: float) -> DataFrame:
        """The points within ``buffer_value`` of the borders that leaf tiles share."""
        return neighbors.halo_points(self._tiled(), self.leaf_size, buffer_value)

    def _chunked(self, res: float, names: list[str], positive_up: bool, greatest: float | None) -> DataFrame:
        """The cells at a resolution with their block of tiles, ``chunk``, its box and its number of tiles."""
        size = self.tile_size
        blocks = chunks.chunk_tiles(self._tiles(size), size, greatest or chunks.GREATEST).select("tile_x", "tile_y", "chunk")
        box = blocks.groupBy("chunk").agg(F.min("tile_x").alias("x0"), F.min("tile_y").alias("y0"), (F.max("tile_x") + size).alias("x1"), (F.max("tile_y") + size).alias("y1"), F.count("*").alias("n_tiles"))
        at = blocks.join(box, "chunk").withColumnsRenamed({"tile_x": "_tx", "tile_y": "_ty"})
        rows = self.layer_cells(names, res, None, positive_up).withColumns({"_tx": origin(F.col("tile_x"), size), "_ty": origin(F.col("tile_y"), size)})
        return rows.join(at, ["_tx", "_ty"]).drop("_tx", "_ty")

    def get_chunks_of_tiles(self, resolution: float | None = None, layer: str | list[str] = "depth", nodatavalue: float = np.nan, z_positive_up: bool = False, override_maximum_chunk_dimension: float | None = None, for_gdal: bool = True) -> Iterator:
        """Yield for each block of tiles its geotransform, longer side, and arrays, north up if ``for_gdal``.

        One job for all blocks: tiles arrive in the order of their blocks, so
        that the arrays of one block at a time are in memory.
        """
        names, res = [layer] if isinstance(layer, str) else list(layer), self._one_resolution(resolution)
        box, width = ["chunk", "x0", "y0", "x1", "y1", "n_tiles"], int(np.ceil(self.leaf_size / res))
        last, data = None, {}

        def done():
            out = {n: np.flipud(a) for n, a in data.items()} if for_gdal else data
            longest = max(last.x1 - last.x0, last.y1 - last.y0) if last.n_tiles > 1 else 0
            return [float(np.float32(last.x0)), res, 0, float(np.float32(last.y1)), 0, -res], longest, out

        for t in self._packed(self._chunked(res, names, z_positive_up, override_maximum_chunk_dimension), names, box).orderBy("chunk", "tile_y", "tile_x").toLocalIterator():
            if last is None or t.chunk != last.chunk:
                if last is not None:
                    yield done()
                last, data = t, self._empty(names, int((t.y1 - t.y0) / res), int((t.x1 - t.x0) / res), nodatavalue)
            self._put(data, t, width, int((t.tile_y - t.y0) / res), int((t.tile_x - t.x0) / res))
        if last is not None:
            yield done()

    # Questions.

    def layer_values_at_xy(self, x_loc, y_loc, layer: str = "depth", resolution: float | None = None, nodatavalue: float = np.nan):
        """Values at places, the finest cell first; a number for numbers, an array for arrays."""
        x, y = np.atleast_1d(np.asarray(x_loc, float)), np.atleast_1d(np.asarray(y_loc, float))
        if x.shape != y.shape:
            raise ValueError("x_loc and y_loc must be alike in shape")
        places = self.spark.createDataFrame(pd.DataFrame({"query_id": np.arange(x.size), "x": x.ravel(), "y": y.ravel()}))
        found = self.values_at(places, layer, resolution).toPandas().sort_values("query_id")["value"].to_numpy(float)
        found = np.where(np.isnan(found), nodatavalue, found).reshape(x.shape)
        return float(found[0]) if np.isscalar(x_loc) else found

    def values_at(self, places: DataFrame, layer: str = "depth", resolution: float | None = None, nodatavalue: float | None = None) -> DataFrame:
        """The same for a table of places: ``(query_id, x, y, resolution, value)``."""
        cells = self._need_cells()
        if resolution is not None:
            cells = cells.where(F.col("resolution") == F.lit(float(resolution)))
        return lookup.values_at(places, cells, layer, nodata=nodatavalue, resolutions=self.resolutions if resolution is None else [float(resolution)])

    @property
    def cell_count(self) -> dict[float, int]:
        return {float(r.resolution): r.n_cells for r in stats.cell_counts(self._need_cells(), self.depth_key).collect()} if not self.no_grid else {}

    @property
    def coverage_area_square_meters(self) -> float:
        return stats.coverage(self._need_cells(), self.depth_key).first().square_meters

    @property
    def coverage_area_square_nm(self) -> float:
        return stats.coverage(self._need_cells(), self.depth_key).first().square_nm

    def densities(self) -> DataFrame:
        """``(density, density_m2, depth)`` of every filled cell."""
        return stats.densities(self._need_cells(), self.depth_key)

    def return_layer_values(self, layer: str) -> DataFrame:
        return layers.values(self._need_cells(), layer)

    def histogram(self, layer: str, number_of_bins: int = 50) -> DataFrame:
        """Of a layer, or of ``density_m2``."""
        found = self.densities().select(F.col("density_m2").alias("value")) if layer == "density_m2" else self.return_layer_values(layer)
        return stats.histogram(found, number_of_bins)

    def density_vs_depth(self, number_of_bins: int = 50, per_square_meter: bool = False) -> DataFrame:
        return stats.mean_by_depth(self.densities(), F.col("density_m2" if per_square_meter else "density"), number_of_bins)

    def tile_summary(self) -> DataFrame:
        """``(tile_x, tile_y, tile_name, n, mean_z)`` of the leaf tiles."""
        return C.tile_means(self._tiled()).withColumn("tile_name", tile_name(F.col("tile_x"), F.col("tile_y")))

    def return_unique_containers(self) -> list[str]:
        """Families of containers in the order added."""
        if self.is_empty:
            return []
        rows = self.spark.createDataFrame([(n, c["seq"]) for n, c in self._m["containers"].items()], "container string, seq int")
        return [r.f for r in rows.groupBy(family(F.col("container")).alias("f")).agg(F.min("seq").alias("s")).orderBy("s").collect()]

    def return_attribution(self) -> dict:
        """What a viewer shows of the grid."""
        e = self._m["extents"] or [None] * 4
        out = {
            "grid_folder": self.output_folder, "name": self.name, "type": self._m["grid_type"], "grid_resolution": self.grid_resolution, "grid_algorithm": self.grid_algorithm, "grid_parameters": self._m["grid_parameters"],
            "epsg": self.epsg or self._m["crs"], "vertical_reference": self.vertical_reference, "height": e[3] - e[1] if e[0] is not None else 0.0, "width": e[2] - e[0] if e[0] is not None else 0.0,
            "minimum_x": e[0], "maximum_x": e[2], "minimum_y": e[1], "maximum_y": e[3], "minimum_time_utc": self.min_time, "maximum_time_utc": self.max_time,
            "tile_size": self.tile_size, "subtile_size": self.subtile_size, "tile_count": self.number_of_tiles, "resolutions": self.resolutions, "storage_type": self._m["storage_type"],
        }
        for f in self.return_unique_containers():
            mine = [n for n in self._m["containers"] if n == f or n.startswith(f"{f}__")]
            c = self._m["containers"][mine[0]]
            out[f"source_{f}"] = {"time": c["added_at"], "multibeam_lines": c["files"]}
        return out

    def __repr__(self) -> str:
        return f"Grid({self._m['grid_type']}, {len(self.containers)} containers, resolutions {self.resolutions}, extents {self._m['extents']})"

    # Files.

    def save(self, folder_path: str) -> Grid:
        """Copy the grid to another folder; the copy."""
        if has_content(self.spark, folder_path):
            folder_path = f"{folder_path}_{datetime.now(UTC):%Y%m%d_%H%M%S}"
        to, m = Store(self.spark, f"{folder_path}/{self.name}"), {**self._m}
        batches = [c["batch"] for c in m["containers"].values()]
        if batches:
            to.write_points(self._store.points(batches, self._point_schema()), None)
            to.keep_folders(batches)
        for b in {*batches, *m["touched"]}:
            to.write_tiles(self._store.tiles([b]), b)
        if not self.no_grid:
            version = uuid.uuid4().hex
            to.write_cells(self._store.cells(m["cells"], self._cell_schema()), version)
            m["cells"] = {version: to.blocks_of(version)}
        to.save_manifest(m)
        return Grid(self.spark, to, m)

    def export(self, output_path: str, export_format: str = "csv", z_positive_up: bool = True, resolution: float | None = None, override_maximum_chunk_dimension: float | None = None, single_file: bool = True, writer: Callable = X.write_raster, **metadata) -> list[str]:
        """Write ``csv``, ``geotiff`` or ``bag`` files, one a resolution and block; their paths.

        Rasters are written by the executors, a block a task, to a path that
        all of them see; ``writer`` has the signature of ``write_raster``.  A
        CSV is one file, or with ``single_file=False`` a folder of sorted parts.
        """
        kind = export_format.lower()
        if kind not in ("csv", "geotiff", "bag"):
            raise ValueError("export_format must be csv, geotiff or bag")
        if kind == "bag" and self.is_backscatter:
            raise ValueError("a BAG holds depths, not backscatter")
        self._need_cells()
        wanted = [float(resolution)] if resolution is not None else self.resolutions
        base = output_path.rsplit(".", 1)[0] if "." in output_path.rsplit("/", 1)[-1] else output_path
        if kind == "csv":
            base = X.free_name(base, any(exists(self.spark, f"{base}_{r}.csv") for r in wanted))
            rows = layers.csv_rows(self._indexed(), self.layer_names, *self._m["extents"][:2], positive_up=z_positive_up and self.mean_depth > 0 and not self.is_backscatter)
            if z_positive_up and not self.mean_depth > 0 and "depth" in rows.columns:
                rows = rows.withColumnRenamed("depth", "elevation")
            return X.write_csv(rows, base, wanted, single_file)
        names = [n for n in (self.depth_key, "vertical_uncertainty", "total_uncertainty") if n in self.layer_names]
        up = True if kind == "bag" else z_positive_up
        title = lambda n: "Elevation" if n == "depth" and up else (X.BAG_BANDS if kind == "bag" else X.BANDS)[n]
        ext, driver, options = ("tif", "GTiff", ()) if kind == "geotiff" else ("bag", "BAG", X.bag_options(**metadata))
        if writer is X.write_raster:
            X.check_gdal()
        out = []
        for r in wanted:
            rows = self._chunked(r, names, up, override_maximum_chunk_dimension)
            used = sorted(c.chunk for c in rows.select("chunk").distinct().collect())  # a few: blocks are tens of kilometers wide
            paths = {c: f"{base}_{r}_{i}.{ext}" for i, c in enumerate(used, 1)}
            X.write_blocks(rows, r, {n: title(n) for n in names}, paths, self.epsg or self._m["crs"], driver, options, (self.min_time, self.max_time) if kind == "bag" else None, writer)
            out += [paths[c] for c in used]
        return out

    # Charts: the reduced frame is drawn where matplotlib is installed, and returned.

    def plot(self, layer: str = "depth", resolution: float | None = None) -> list:
        """Draw a layer at a resolution, or at each in turn; the trimmed surfaces."""
        found = [self.return_surf_xyz(layer, r)[:3] for r in ([float(resolution)] if resolution is not None else self.resolutions)]
        P.surface([f for f in found if f[0] is not None], layer)
        return found

    def _plot_histogram(self, layer: str, name: str, bins: int) -> pd.DataFrame | None:
        if layer != "density_m2" and layer not in self.layer_names:
            return None
        return P.bars(self.histogram(layer, bins).orderBy("bin").toPandas(), name, "cells")

    def plot_density_histogram(self, number_of_bins: int = 50):
        return self._plot_histogram("density", "points in a cell", number_of_bins)

    def plot_density_per_square_meter_histogram(self, number_of_bins: int = 50):
        return self._plot_histogram("density_m2", "points a square meter", number_of_bins)

    def plot_z_histogram(self, number_of_bins: int = 50):
        return self._plot_histogram(self.depth_key, "intensity (dB)" if self.is_backscatter else "depth (m)", number_of_bins)

    def plot_vertical_uncertainty_histogram(self, number_of_bins: int = 50):
        return self._plot_histogram("vertical_uncertainty", "vertical uncertainty (m)", number_of_bins)

    def plot_total_uncertainty_histogram(self, number_of_bins: int = 50):
        return self._plot_histogram("total_uncertainty", "total uncertainty (m)", number_of_bins)

    def plot_horizontal_uncertainty_histogram(self, number_of_bins: int = 50):
        return self._plot_histogram("horizontal_uncertainty", "horizontal uncertainty (m)", number_of_bins)

    def plot_density_vs_depth(self, number_of_bins: int = 50):
        return P.line(self.density_vs_depth(number_of_bins).orderBy("bin").toPandas(), "depth (m)", "points in a cell")

    def plot_density_per_square_meter_vs_depth(self, number_of_bins: int = 50):
        return P.line(self.density_vs_depth(number_of_bins, True).orderBy("bin").toPandas(), "depth (m)", "points a square meter")
