"""Queries that go through the grid object: add, grid, update, replace, remove, save, load, stream, export.

Batches are the containers of the point view.  The grid rounds in 32-bit
floats, as its cells are stored; the SQL does the same.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, create_grid, load_grid
from ..operators import layers
from ..sources.shared import new_path
from ..sources.tables import table
from ..streaming.ingest import ingest, running_cells, windowed_cells
from .survey import _CELL, _ONE, _P, FIXED, LEAF, NODATA, TILE, Query, _lookup_sql, _tiled, points

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CONTAINERS = tuple(f"survey_{flag}__line_{status}" for flag in "ANR" for status in "FO")
_SHIFT = 40.0
_DAY = 86_400


def _add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _single(value: str) -> str:
    """Three decimals, half-even, in 32-bit floats; told as a double."""
    return f"cast(cast(round_even(cast(cast({value} as float) * cast(1000 as float) as double), 0) / 1000.0 as float) as double)"


_MEAN = f"{_single('avg(z)')} as depth, count(*) as density, {_single('avg(tvu)')} as vertical_uncertainty, {_single('avg(thu)')} as horizontal_uncertainty"
_BEST = "min({'z': z, 'tvu': tvu, 'thu': thu})"
_SHOALEST = f"{_single(_BEST + '.z')} as depth, count(*) as density, {_single(_BEST + '.tvu')} as vertical_uncertainty, {_single(_BEST + '.thu')} as horizontal_uncertainty"


def _vr_sql(source: str, cells: str, tag: str = "", kind: str = _MEAN) -> str:
    """CTEs for the variable-resolution cells of ``source`` under the name ``cells``."""
    t, leaf, r = f"t{tag}", f"l{tag}", f"r{tag}"
    return (
        f"{t} as (select *, floor(x / {LEAF}) * {LEAF} as tile_x, floor(y / {LEAF}) * {LEAF} as tile_y from {source}), "
        f"{leaf} as (select tile_x, tile_y, {_lookup_sql('cast(avg(z) as float)', LEAF)} as resolution from {t} group by 1, 2), "
        f"{r} as (select {t}.*, resolution from {t} join {leaf} using (tile_x, tile_y)), "
        f"{cells} as (select {_CELL}, {kind} from {r} group by all)"
    )


def _told(cells: DataFrame) -> DataFrame:
    """Cells with all layers as doubles and whole numbers, as the SQL tells them."""
    whole = {c: F.col(c).cast("double") for c, k in cells.dtypes if k == "float"}
    return cells.withColumns(whole) if whole else cells


def _new(spark: SparkSession, kind: str = "variable_resolution_tile", folder: str = "") -> Grid:
    return create_grid(spark, folder, kind, tile_size=TILE, subtile_size=LEAF)


def _filled(spark: SparkSession, folder: str, names: tuple[str, ...] = CONTAINERS, kind: str = "variable_resolution_tile", times: bool = False) -> Grid:
    """A grid to which the containers were added one after the other."""
    grid, every = _new(spark, kind), points(spark, folder)
    for i, name in enumerate(names):
        grid.add_points(every.where(F.col("container") == name), name, [f"{i}.raw"], 26917, "waterline", *((i * _DAY, (i + 2) * _DAY + 0.75) if times else ()))
    return grid


@_add("grid_add_grid", f"with {_P}, {_vr_sql('p', 'c')} select * from c")
def grid_add_grid(spark, folder):
    """Four batches added to a grid, then gridded."""
    grid = _filled(spark, folder)
    grid.grid()
    return _told(grid.cells())


@_add("grid_shoalest", f"with {_P}, {_vr_sql('p', 'c', kind=_SHOALEST)} select * from c")
def grid_shoalest(spark, folder):
    """The same with the shoalest points."""
    grid = _filled(spark, folder)
    grid.grid("shoalest")
    return _told(grid.cells())


_MERGED = "select * from cn union all select * from ca anti join (select distinct tile_x, tile_y, resolution from cn) using (tile_x, tile_y, resolution)"


@_add("grid_update_after_add", f"""with {_P}, a as (select * from p where container <> '{_ONE}'), d as (select * from p where container = '{_ONE}' and x < 300), k as (select * from a union all select * from d),
  dirty as (select distinct floor(x / {LEAF}) * {LEAF} as tile_x, floor(y / {LEAF}) * {LEAF} as tile_y from d),
  kd as (select k.* from k semi join dirty on dirty.tile_x = floor(k.x / {LEAF}) * {LEAF} and dirty.tile_y = floor(k.y / {LEAF}) * {LEAF}),
  {_vr_sql('a', 'ca', 'a')}, {_vr_sql('kd', 'cn', 'n')} {_MERGED}""")  # fmt: skip
def grid_update_after_add(spark, folder):
    """A batch arrives at a grid: an update grids the tiles it touches and keeps the rest."""
    grid = _filled(spark, folder, tuple(c for c in CONTAINERS if c != _ONE))
    grid.grid()
    grid.add_points(points(spark, folder).where((F.col("container") == _ONE) & (F.col("x") < 300)), _ONE, crs=26917, vertical_reference="waterline")
    grid.grid(regrid_option="update")
    return _told(grid.cells())


@_add("grid_update_after_replace", f"""with {_P}, a as (select * from p union all select * from p where container = '{_ONE}'),
  k as (select * replace (case when container = '{_ONE}' then z + {_SHIFT} else z end as z) from a),
  dirty as (select distinct floor(x / {LEAF}) * {LEAF} as tile_x, floor(y / {LEAF}) * {LEAF} as tile_y from p where container = '{_ONE}'),
  kd as (select k.* from k semi join dirty on dirty.tile_x = floor(k.x / {LEAF}) * {LEAF} and dirty.tile_y = floor(k.y / {LEAF}) * {LEAF}),
  {_vr_sql('a', 'ca', 'a')}, {_vr_sql('kd', 'cn', 'n')} {_MERGED}""")  # fmt: skip
def grid_update_after_replace(spark, folder):
    """A container whose every row occurs twice is taken out and comes back deeper: an update must see it."""
    every = points(spark, folder)
    one = every.where(F.col("container") == _ONE)
    grid = _filled(spark, folder, tuple(c for c in CONTAINERS if c != _ONE))
    grid.add_points(one.unionByName(one), _ONE, crs=26917, vertical_reference="waterline")
    grid.grid()
    deeper = one.withColumn("z", F.col("z") + F.lit(_SHIFT))
    grid.remove_points(_ONE)
    grid.add_points(deeper.unionByName(deeper), _ONE, crs=26917, vertical_reference="waterline")
    grid.grid(regrid_option="update")
    return _told(grid.cells())


@_add("grid_remove_container", f"""with {_P}, k as (select * from p where container <> '{_ONE}'),
  {_vr_sql('p', 'ca0', 'a')}, {_vr_sql('k', 'cn', 'n')},
  ca as (select ca0.* from ca0 semi join (select distinct tile_x, tile_y from tn) using (tile_x, tile_y)) {_MERGED}""")
def grid_remove_container(spark, folder):
    """A container is taken out of a grid, and what it touched gridded again; cells of other resolutions stay."""
    grid = _filled(spark, folder)
    grid.grid()
    grid.remove_points(_ONE)
    grid.grid(regrid_option="update")
    return _told(grid.cells())


@_add("grid_save_load", f"with {_P}, {_vr_sql('p', 'c')} select * from c")
def grid_save_load(spark, folder):
    """A grid saved to another folder, and loaded from there."""
    grid = _filled(spark, folder)
    grid.grid()
    grid.save(to := new_path(spark, "saved"))
    return _told(load_grid(spark, to).cells())


@_add("grid_points_loaded", f"with {_P} select x, y, z, tvu, thu, container from p")
def grid_points_loaded(spark, folder):
    """The points of a grid, as they come back from its folder."""
    grid = _filled(spark, folder)
    return _told(load_grid(spark, grid.output_folder).points())


@_add("stream_ingest_cells", f"with {_P}, {_vr_sql('p', 'c')} select * from c")
def stream_ingest_cells(spark, folder):
    """The points arrive as a stream of three micro-batches, each a container of a grid that is updated."""
    source, grid = new_path(spark, "arrivals"), _new(spark)
    every = points(spark, folder)
    every.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = ingest(stream, grid, "live", new_path(spark, "stream"), regrid=False)
    query.processAllAvailable()
    query.stop()
    grid.grid(regrid_option="update")
    return _told(grid.cells())


@_add("grid_single_resolution", f"""with {_P}, {_tiled(TILE)}, m as (select {_single('avg(z)')} as mean from p where container = '{CONTAINERS[-1]}'),
  r as (select t.*, {_lookup_sql('mean', TILE)} as resolution from t, m), c as (select {_CELL}, {_MEAN} from r group by all) select * from c""")  # fmt: skip
def grid_single_resolution(spark, folder):
    """One cell size by the mean depth of the batch added last, as the grid object keeps it."""
    grid = _filled(spark, folder, kind="single_resolution")
    grid.grid()
    return _told(grid.cells())


@_add("grid_state", f"""with {_P}, {_vr_sql('p', 'c')}, last as (select {_single('avg(z)')} as mean from p where container = '{CONTAINERS[-1]}'),
  e as (select floor(min(x) / {TILE}) * {TILE} as min_x, floor(min(y) / {TILE}) * {TILE} as min_y, (floor(max(x) / {TILE}) + {len(CONTAINERS)}) * {TILE} as max_x, (floor(max(y) / {TILE}) + {len(CONTAINERS)}) * {TILE} as max_y from p)
  select count(*) as points_count, count(distinct (floor(x / {TILE}), floor(y / {TILE}))) as n_tiles, {len(CONTAINERS)}::bigint as n_containers,
  any_value(mean) as mean_depth, any_value(min_x) as min_x, any_value(min_y) as min_y, any_value(max_x) as max_x, any_value(max_y) as max_y,
  '1970-01-01T00:00:00' as min_time, strftime(make_timestamp({(len(CONTAINERS) + 1) * _DAY} * 1000000::bigint), '%Y-%m-%dT%H:%M:%S') as max_time,
  (select count(*) from c) as n_cells, (select string_agg(cast(resolution as varchar), ' ' order by resolution) from (select distinct resolution from c)) as resolutions,
  'depth density vertical_uncertainty horizontal_uncertainty' as layer_names, 'survey_A survey_N survey_R' as families, true as has_tvu, true as has_thu, false as changed from p, last, e""")  # fmt: skip
def grid_state(spark, folder):
    """What a grid tells of itself: counts, extents that grow by a tile a batch, mean depth of the last batch, times, resolutions, names."""
    grid = _filled(spark, folder, times=True)
    grid.grid()
    (x0, y0), (x1, y1) = grid.return_extents()
    told = grid.return_attribution()
    row = (grid.points_count, told["tile_count"], len(grid.containers), grid.mean_depth, x0, y0, x1, y1, grid.min_time, grid.max_time, sum(grid.cell_count.values()), " ".join(map(str, grid.resolutions)), " ".join(grid.layer_names), " ".join(grid.return_unique_containers()), grid.has_vertical_uncertainty, grid.has_horizontal_uncertainty, grid.point_count_changed)
    return spark.createDataFrame([row], "points_count bigint, n_tiles bigint, n_containers bigint, mean_depth double, min_x double, min_y double, max_x double, max_y double, min_time string, max_time string, n_cells bigint, resolutions string, layer_names string, families string, has_tvu boolean, has_thu boolean, changed boolean")


_FIXED_CELLS = f"{_tiled(TILE)}, r as (select *, cast({FIXED} as double) as resolution from t), c as (select {_CELL}, {_MEAN} from r group by all)"


def _fixed(spark: SparkSession, folder: str) -> Grid:
    grid = _filled(spark, folder, kind="single_resolution")
    grid.grid(resolution=FIXED)
    return grid


@_add("grid_container_layer", f"""with {_P}, {_FIXED_CELLS}, o as (select {_CELL}, {_single('avg(z)')} as "{_ONE}", count(*) as "{_ONE}_density" from r where container = '{_ONE}' group by all)
  select tile_x, tile_y, resolution, row, col, density, "{_ONE}", "{_ONE}_density" from c left join o using (tile_x, tile_y, resolution, row, col)""")  # fmt: skip
def grid_container_layer(spark, folder):
    """Layers of the points of one container beside the layers of all."""
    return _told(_fixed(spark, folder).layer_cells(["density", _ONE, f"{_ONE}_density"], FIXED))


_SUMS = "count(*) as n_cells, sum(density) as n_points, round(sum(depth), 3) as sum_depth"


def _raster_row(data: dict[str, np.ndarray]) -> tuple[int, int, float]:
    filled = ~np.isnan(data["depth"])
    return int(filled.sum()), int(data["density"].sum()), round(float(data["depth"][filled].astype(np.float64).sum()), 3)


@_add("grid_tile_rasters", f"with {_P}, {_vr_sql('p', 'c')} select tile_x as origin_x, tile_y + {LEAF} as origin_y, cast({LEAF} / 8 as int) as side, {_SUMS} from c where resolution = 8.0 group by 1, 2")
def grid_tile_rasters(spark, folder):
    """The rasters of the leaf tiles at one resolution, one after the other."""
    grid = _filled(spark, folder)
    grid.grid()
    rows = [(geo[0], geo[3], side, *_raster_row(data)) for geo, _, _, side, data in grid.get_tiles_by_resolution(8.0, ["depth", "density"])]
    return spark.createDataFrame(rows, "origin_x double, origin_y double, side int, n_cells bigint, n_points bigint, sum_depth double")


@_add("grid_chunk_rasters", f"with {_P}, {_FIXED_CELLS} select tile_x as origin_x, tile_y + {TILE} as origin_y, {_SUMS} from c group by 1, 2")
def grid_chunk_rasters(spark, folder):
    """The rasters of blocks of one tile each, north up."""
    blocks = _fixed(spark, folder).get_chunks_of_tiles(FIXED, ["depth", "density"], override_maximum_chunk_dimension=TILE)
    return spark.createDataFrame([(geo[0], geo[3], *_raster_row(data)) for geo, _, data in blocks], "origin_x double, origin_y double, n_cells bigint, n_points bigint, sum_depth double")


@_add("grid_csv_file", f"""with {_P}, {_FIXED_CELLS}, i as (select *, cast(floor(tile_y / resolution) + row as bigint) as gr, cast(floor(tile_x / resolution) + col as bigint) as gc from c),
  b as (select min(gr) as r0, max(gr) as r1, min(gc) as c0, max(gc) as c1 from i),
  m as (select gr, gc from (select unnest(range(r0, r1 + 1)) as gr from b), (select unnest(range(c0, c1 + 1)) as gc from b))
  select printf('%.3f %.3f %s %d %s %s', (gc + 0.5::double) * {FIXED}, (gr + 0.5::double) * {FIXED}, case when depth is null then 'nan' else printf('%.3f', -depth) end, coalesce(density, 0),
  case when vertical_uncertainty is null then 'nan' else printf('%.3f', vertical_uncertainty) end, case when horizontal_uncertainty is null then 'nan' else printf('%.3f', horizontal_uncertainty) end) as line from m left join i using (gr, gc)
  union all select 'x y elevation density vertical_uncertainty horizontal_uncertainty'""")  # fmt: skip
def grid_csv_file(spark, folder):
    """The lines of the CSV file that a grid exports."""
    (path,) = _fixed(spark, folder).export(f"{new_path(spark, 'csv')}/out.csv", "csv")
    return spark.read.text(path).withColumnRenamed("value", "line")


_Q = "q as (select o_orderkey as query_id, cast(o_orderkey * 3 % 1100 as double) as x, cast(o_custkey * 11 % 1100 as double) as y from orders)"


@_add("grid_lookup", f"""with {_P}, {_vr_sql('p', 'c')}, {_Q}, g as (select resolution, floor(tile_x / resolution) + col as gx, floor(tile_y / resolution) + row as gy, depth from c),
  a as (select query_id, x, y, res, floor(x / res) as gx, floor(y / res) as gy from q, (select distinct resolution as res from c) s)
  select query_id, x, y, min(g.resolution) as resolution, coalesce(min_by(g.depth, g.resolution), {NODATA}) as value
  from a left join g on g.resolution = a.res and g.gx = a.gx and g.gy = a.gy group by query_id, x, y""")  # fmt: skip
def grid_lookup(spark, folder):
    """Depths at places, from the cells of a grid."""
    grid = _filled(spark, folder)
    grid.grid()
    places = table(spark, folder, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") * 3 % 1100).cast("double").alias("x"), (F.col("o_custkey") * 11 % 1100).cast("double").alias("y"))
    return grid.values_at(places, "depth", nodatavalue=NODATA)


@_add("grid_array_batches", "select tile_x as x, tile_y as y, resolution as z, source from tiles, (values ('array'), ('mapping'), ('frame'), ('lazy'), ('dataset')) s(source)")
def grid_array_batches(spark, folder):
    """Batches given as structured array, mapping, pandas frame, lazy array and dataset of variables."""
    pdf = table(spark, folder, "tiles").select(F.col("tile_x").alias("x"), F.col("tile_y").alias("y"), F.col("resolution").alias("z")).toPandas()
    array = pdf.to_records(index=False).view(np.ndarray)
    array = np.array([tuple(r) for r in array.tolist()], [("x", "f8"), ("y", "f8"), ("z", "f4")])
    lazy = type("Lazy", (), {"compute": lambda self: array})()
    dataset = type("Dataset", (), {"variables": ("x", "y", "z", "beam"), "__getitem__": lambda self, n: pdf[n].to_numpy()})()
    grid = _new(spark)
    for name, data in (("array", array), ("mapping", dict(pdf.items())), ("frame", pdf), ("lazy", lazy), ("dataset", dataset)):
        grid.add_points(data, name)
    return _told(grid.points()).withColumnRenamed("container", "source")


@_add("grid_slopes", f"""with {_P}, {_tiled(TILE)}, r as (select *, cast({FIXED} as double) as resolution from t), k as (select {_CELL}, count(*) as density from r group by all)
  select tile_x, tile_y, resolution, row, col, density, true as has_slopes from k""")
def grid_slopes(spark, folder):
    """Every cell of a grid has slopes."""
    found = _fixed(spark, folder).layer_cells(["density", "x_slope", "y_slope"], FIXED)
    return found.select(*layers.KEYS, "density", (F.col("x_slope").isNotNull() & F.col("y_slope").isNotNull()).alias("has_slopes"))


@_add("grid_halo", f"""with {_P}, {_tiled(LEAF)}, d as (select distinct tile_x, tile_y from t), o as (
  select *, tile_x as for_x, tile_y + {LEAF} as for_y from t where y >= tile_y + {LEAF} - 8 union all select *, tile_x, tile_y - {LEAF} from t where y <= tile_y + 8 union all
  select *, tile_x + {LEAF}, tile_y from t where x >= tile_x + {LEAF} - 8 union all select *, tile_x - {LEAF}, tile_y from t where x <= tile_x + 8)
  select for_x, for_y, count(*) as n, sum(z) as sum_z from o where (for_x, for_y) in (select (tile_x, tile_y) from d) group by 1, 2""")  # fmt: skip
def grid_halo(spark, folder):
    """What the leaf tiles of a grid see of their neighbors."""
    halo = _filled(spark, folder).get_tile_neighbor_points(8.0)
    return halo.groupBy("for_x", "for_y").agg(F.count("*").alias("n"), F.sum(F.col("z").cast("double")).alias("sum_z"))


_COARSE = 64.0


def _streamed(spark: SparkSession, folder: str, more: dict | None = None) -> DataFrame:
    """The points as a stream of three files."""
    source = new_path(spark, "arrivals")
    every = points(spark, folder).withColumns(more or {})
    every.repartition(3).write.parquet(source)
    return spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(source)


def _complete(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """The state of a stream after all its files: a row a cell, here a few hundred."""
    name = f"state_{uuid.uuid4().hex}"
    query = cells.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", new_path(spark, "stream")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


_STATE = "avg(z) as depth, min(z) as shoalest, count(*) as density"


@_add("stream_running_cells", f"with {_P}, {_tiled(TILE)}, r as (select *, cast({_COARSE} as double) as resolution from t) select {_CELL}, {_STATE} from r group by all")
def stream_running_cells(spark, folder):
    """Cells kept up to date by a stream."""
    return _complete(spark, running_cells(_streamed(spark, folder), _COARSE))


@_add("stream_windowed_cells", f"""with {_P}, {_tiled(TILE)}, r as (select *, cast({_COARSE} as double) as resolution from t)
  select cast(floor(x * 60 / 7200) * 7200 as bigint) as window_start, {_CELL}, {_STATE} from r group by all""")  # fmt: skip
def stream_windowed_cells(spark, folder):
    """The same by windows of two hours; here a meter in x takes a minute."""
    timed = _streamed(spark, folder, {"at": F.timestamp_micros((F.col("x") * F.lit(60_000_000)).cast("bigint"))})
    cells = _complete(spark, windowed_cells(timed, "at", _COARSE, "2 hours", "1 hour"))
    return cells.select(F.unix_seconds("window.start").alias("window_start"), *layers.KEYS, "depth", "shoalest", "density")
