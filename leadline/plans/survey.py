"""The gridding engine's queries on one view of points, each with its SQL.

All values of the view are dyadic rationals, so sums don't depend on the order
in which they are made and both engines agree to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import family, tile_name, utc_seconds, utc_text
from ..functions.rounding import power_of_two, to_mm
from ..operators import cells as C
from ..operators import chunks, layers, lookup, neighbors, stats
from ..operators import resolution as R
from ..operators.cube import CUBE
from ..operators.keys import aligned_extents, flat_index, row_col, with_cells, with_tiles
from ..operators.slopes import plane_slopes
from ..sources.tables import table

TILE, LEAF, FIXED = 1024.0, 128.0, 8.0
NODATA = 1_000_000.0
BUFFER = 16.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def points(spark: SparkSession, folder: str) -> DataFrame:
    """The view of points over ``lineitem``."""
    d = lambda v: F.lit(float(v))
    hundredths = lambda c: F.round(F.col(c) * 100).cast("int").cast("double")
    part = (F.col("l_partkey") % 1024).cast("double")
    return table(spark, folder, "lineitem").select(
        (part + F.col("l_linenumber") * d(0.125)).alias("x"),
        (((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 1024).cast("double") + d(0.5)).alias("y"),
        (F.col("l_quantity") * d(0.125) + part * d(0.25)).alias("z"),
        (hundredths("l_discount") / d(64) + d(0.25)).alias("tvu"),
        (hundredths("l_tax") / d(64) + d(0.125)).alias("thu"),
        F.concat(F.lit("survey_"), "l_returnflag", F.lit("__line_"), "l_linestatus").alias("container"),
    )


_P = """p as (select cast(l_partkey % 1024 as double) + l_linenumber * cast(0.125 as double) as x,
  cast((l_suppkey * 7 + l_orderkey) % 1024 as double) + cast(0.5 as double) as y,
  l_quantity * cast(0.125 as double) + cast(l_partkey % 1024 as double) * cast(0.25 as double) as z,
  cast(cast(round(l_discount * 100) as int) as double) / cast(64 as double) + cast(0.25 as double) as tvu,
  cast(cast(round(l_tax * 100) as int) as double) / cast(64 as double) + cast(0.125 as double) as thu,
  concat('survey_', l_returnflag, '__line_', l_linestatus) as container from lineitem)"""


def _tiled(size: float, source: str = "p") -> str:
    return f"t as (select *, floor(x / {size}) * {size} as tile_x, floor(y / {size}) * {size} as tile_y from {source})"


def _lookup_sql(mean: str, size: float) -> str:
    cases = " ".join(f"when {mean} < {d} then {r}" for d, r in R.DEPTH_RESOLUTION.items())
    return f"least(case {cases} else 0.25 end, {size})::double"


_MEAN = "round_even(avg(z), 3) as depth, count(*) as density, round_even(avg(tvu), 3) as vertical_uncertainty, round_even(avg(thu), 3) as horizontal_uncertainty"
_SHOALEST = "round_even(min({'z': z, 'tvu': tvu, 'thu': thu}).z, 3) as depth, count(*) as density, round_even(min({'z': z, 'tvu': tvu, 'thu': thu}).tvu, 3) as vertical_uncertainty, round_even(min({'z': z, 'tvu': tvu, 'thu': thu}).thu, 3) as horizontal_uncertainty"
_CELL = "tile_x, tile_y, resolution, cast(floor((y - tile_y) / resolution) as int) as row, cast(floor((x - tile_x) / resolution) as int) as col"


def _cells(source: str, layers_sql: str = _MEAN, extra: str = "", name: str = "c") -> str:
    return f"{name} as (select {_CELL}{extra}, {layers_sql} from {source} group by all)"


_FIXED = f"r as (select *, cast({FIXED} as double) as resolution from t)"
_BY_LEAF = f"l as (select tile_x, tile_y, {_lookup_sql('cast(avg(z) as float)', LEAF)} as resolution from t group by 1, 2), r as (select t.*, resolution from t join l using (tile_x, tile_y))"
_SR = f"with {_P}, {_tiled(TILE)}, {_FIXED}, {_cells('r')}"
_VR = f"with {_P}, {_tiled(LEAF)}, {_BY_LEAF}, {_cells('r')}"


def _density_sql(size: float) -> str:
    s = min(size, R.START)
    at_least = lambda v: "case " + " ".join(f"when {v} <= {r} then {r}" for r in R.RESOLUTIONS) + f" else {R.RESOLUTIONS[-1]} end"
    depth = "case " + " ".join(f"when mean <= {d} then {r}" for d, r in R.DEPTH_RESOLUTION.items()) + f" else {R.RESOLUTIONS[-1]} end"
    est = f"sqrt(cast({2.0 * R.POINTS_PER_CELL * (1 + R.NOISE)} as double) / (n / cast({s * s} as double)))"
    return f"""dc as (select tile_x, tile_y, floor(x / {s}) as cx, floor(y / {s}) as cy, count(*) as n, sum(z) as sz from t group by 1, 2, 3, 4),
  dt as (select tile_x, tile_y, count(*) / cast({float(int((size / s) ** 2))} as double) as "full", sum({est} * n) / sum(n) as estimate, sum(sz) / sum(n) as mean from dc group by 1, 2),
  l as (select tile_x, tile_y, cast(least(case when "full" <= {R.FULL_ENOUGH} then {depth} else {at_least('estimate')} end, {size}) as double) as resolution, "full" as filled, estimate from dt)"""


def _add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _sr(spark: SparkSession, folder: str, method: str = "mean") -> DataFrame:
    return C.single_resolution(points(spark, folder), method, FIXED, tile_size=TILE)


def _vr(spark: SparkSession, folder: str, method: str = "mean", mode: str = "depth") -> DataFrame:
    return C.variable_resolution(points(spark, folder), method, mode=mode, leaf=LEAF)


@_add("vr_mean_auto_depth", f"{_VR} select * from c")
def vr_mean_auto_depth(spark, folder):
    """The flagship: mean depth in cells whose size follows the depth of each leaf tile."""
    return _vr(spark, folder)


@_add("sr_mean_fixed", f"{_SR} select * from c")
def sr_mean_fixed(spark, folder):
    """Mean depth, density and uncertainties in cells of one given size."""
    return _sr(spark, folder)


@_add("sr_shoalest_fixed", f"with {_P}, {_tiled(TILE)}, {_FIXED}, {_cells('r', _SHOALEST)} select * from c")
def sr_shoalest_fixed(spark, folder):
    """The shoalest point of each cell, with its own uncertainties."""
    return _sr(spark, folder, "shoalest")


@_add("sr_mean_depth_only", f"{_SR} select * exclude (vertical_uncertainty, horizontal_uncertainty) from c")
def sr_mean_depth_only(spark, folder):
    """Points without uncertainties give no uncertainty layers."""
    return C.single_resolution(points(spark, folder).select("x", "y", "z"), "mean", FIXED, tile_size=TILE)


@_add("sr_mean_auto_depth", f"with {_P}, {_tiled(TILE)}, r as (select t.*, (select {_lookup_sql('round_even(avg(z), 3)', TILE)} from p) as resolution from t), {_cells('r')} select * from c")
def sr_mean_auto_depth(spark, folder):
    """One size for all cells, by the mean depth of all points."""
    return C.single_resolution(points(spark, folder), tile_size=TILE)


@_add("vr_shoalest_auto_depth", f"with {_P}, {_tiled(LEAF)}, {_BY_LEAF}, {_cells('r', _SHOALEST)} select * from c")
def vr_shoalest_auto_depth(spark, folder):
    """Shoalest points in cells whose size follows the depth."""
    return _vr(spark, folder, "shoalest")


@_add("tile_density_resolution", f"with {_P}, {_tiled(LEAF)}, {_density_sql(LEAF)} select tile_x, tile_y, resolution, filled, round(estimate, 6) as estimate from l")
def tile_density_resolution(spark, folder):
    """The resolution each leaf tile calls for by its density."""
    found = R.by_density(with_tiles(points(spark, folder), LEAF), LEAF)
    return found.select("tile_x", "tile_y", "resolution", F.col("full").alias("filled"), F.round("estimate", 6).alias("estimate"))


@_add("sr_mean_auto_density", f"with {_P}, {_tiled(TILE)}, {_density_sql(TILE)}, r as (select t.*, (select max(resolution) from l) as resolution from t), {_cells('r')} select * from c")
def sr_mean_auto_density(spark, folder):
    """One size for all cells: the coarsest that any tile calls for by density."""
    return C.single_resolution(points(spark, folder), mode="density", tile_size=TILE)


@_add("vr_mean_auto_density", f"with {_P}, {_tiled(LEAF)}, {_density_sql(LEAF)}, r as (select t.*, resolution from t join l using (tile_x, tile_y)), {_cells('r')} select * from c")
def vr_mean_auto_density(spark, folder):
    """Cells whose size follows the density of each leaf tile."""
    return _vr(spark, folder, mode="density")


def _hill_sql() -> str:
    opts = R.RESOLUTIONS
    union = " union all ".join(f"select {i} as i, tile_x, tile_y, greatest(floor(x / {r}) * {r}, tile_x) as cx, greatest(floor(y / {r}) * {r}, tile_y) as cy from t" for i, r in enumerate(opts))
    values = ", ".join(f"({i}, {r}::double)" for i, r in enumerate(opts))
    return f"""with recursive {_P}, {_tiled(LEAF)}, e as ({union}),
  n as (select i, tile_x, tile_y, cx, cy, count(*) as n from e group by all),
  j as (select i, tile_x, tile_y, case when min(n) < {R.POINTS_PER_CELL} then 1 when min(n) > {4 * R.POINTS_PER_CELL} then -1 else 0 end as step from n group by 1, 2, 3),
  w as (select tile_x, tile_y, {opts.index(R.START)} as pos, -1 as last, false as done from (select distinct tile_x, tile_y from t)
    union all
    select w.tile_x, w.tile_y,
      case when step = 0 or pos + step < 0 or pos + step >= {len(opts)} then pos when pos + step = last then greatest(pos, pos + step) else pos + step end, pos,
      step = 0 or pos + step < 0 or pos + step >= {len(opts)} or pos + step = last
    from w join j on j.i = w.pos and j.tile_x = w.tile_x and j.tile_y = w.tile_y where not done)
  select tile_x, tile_y, res as resolution from w join (values {values}) o(i, res) on o.i = w.pos where done"""


@_add("tile_resolution_hillclimb", _hill_sql())
def tile_resolution_hillclimb(spark, folder):
    """The older density method, step by step."""
    return R.by_hill_climb(with_tiles(points(spark, folder), LEAF), LEAF)


@_add("tile_summary", f"with {_P}, {_tiled(LEAF)} select tile_x, tile_y, printf('%.1f_%.1f', tile_x, tile_y) as tile_name, count(*) as n, cast(avg(z) as float) as mean_z from t group by 1, 2")
def tile_summary(spark, folder):
    """Name, number of points and mean depth of each leaf tile."""
    means = C.tile_means(with_tiles(points(spark, folder), LEAF))
    return means.select("tile_x", "tile_y", tile_name(F.col("tile_x"), F.col("tile_y")).alias("tile_name"), "n", "mean_z")


@_add("cell_count_by_resolution", f"{_VR} select resolution, count(*) as n_cells from c group by 1")
def cell_count_by_resolution(spark, folder):
    """Filled cells at each resolution."""
    return stats.cell_counts(_vr(spark, folder))


_AREA = f"{_VR}, a as (select tile_x, tile_y, resolution, round_even(count(*) * resolution * resolution, 3) as a from c group by 1, 2, 3) select"


@_add("coverage_area", f"{_AREA} sum(a) as square_meters from a")
def coverage_area(spark, folder):
    """Area of the filled cells in square meters."""
    return stats.coverage(_vr(spark, folder)).select("square_meters")


@_add("coverage_area_nm", f"{_AREA} sum(a) / {stats.SQUARE_NM} as square_nm from a")
def coverage_area_nm(spark, folder):
    """The same in square nautical miles."""
    return stats.coverage(_vr(spark, folder)).select("square_nm")


@_add("density_values", f"{_VR} select density, density / (resolution * resolution) as density_m2, depth from c")
def density_values(spark, folder):
    """Points in each filled cell, and per square meter, beside its depth."""
    return stats.densities(_vr(spark, folder))


def _binned_sql(value: str) -> str:
    return f"""{_VR}, d as (select depth, cast({value} as double) as v from c), e as (select min(depth) - 0.001::double as lo, max(depth) + 0.001::double as hi from d),
  b as (select v, lo, (hi - lo) / 50 as step, cast(floor((depth - lo) / ((hi - lo) / 50)) + 1 as int) as bin from d, e)
  select bin, lo + bin * step as depth, round(avg(v), 6) as mean_value from b group by bin, lo, step"""


@_add("density_vs_depth", _binned_sql("density"))
def density_vs_depth(spark, folder):
    """Mean density in 50 bins of depth."""
    return stats.mean_by_depth(stats.densities(_vr(spark, folder)), F.col("density")).withColumn("mean_value", F.round("mean_value", 6))


@_add("density_per_m2_vs_depth", _binned_sql("density / (resolution * resolution)"))
def density_per_m2_vs_depth(spark, folder):
    """The same per square meter."""
    return stats.mean_by_depth(stats.densities(_vr(spark, folder)), F.col("density_m2")).withColumn("mean_value", F.round("mean_value", 6))


def _histogram_sql(value: str) -> str:
    return f"""{_VR}, v as (select cast({value} as double) as v from c), e as (select min(v) as lo, max(v) as hi from v),
  k as (select cast(least(floor((v - lo) / ((hi - lo) / 50)), 49) as int) as bin, count(*) as n from v, e group by 1)
  select cast(b.bin as int) as bin, lo + b.bin * ((hi - lo) / 50) as low, lo + (b.bin + 1) * ((hi - lo) / 50) as high, coalesce(n, 0) as n
  from range(50) b(bin) cross join e left join k on k.bin = b.bin"""


def _histogram(name: str, column: str, sql: str) -> None:
    def query(spark, folder):
        found = stats.densities(_vr(spark, folder)) if column.startswith("density") else _vr(spark, folder)
        return stats.histogram(found.select(F.col(column).alias("value")))

    query.__doc__ = f"Histogram of {column}."
    _add(name, _histogram_sql(sql))(query)


_histogram("density_histogram", "density", "density")
_histogram("density_per_m2_histogram", "density_m2", "density / (resolution * resolution)")
_histogram("depth_histogram", "depth", "depth")
_histogram("tvu_histogram", "vertical_uncertainty", "vertical_uncertainty")
_histogram("thu_histogram", "horizontal_uncertainty", "horizontal_uncertainty")


def _places(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") * 3 % 1100).cast("double").alias("x"), (F.col("o_custkey") * 11 % 1100).cast("double").alias("y"))


_RES = ", ".join(f"({r}::double)" for r in R.RESOLUTIONS)
_Q = "q as (select o_orderkey as query_id, cast(o_orderkey * 3 % 1100 as double) as x, cast(o_custkey * 11 % 1100 as double) as y from orders)"
_AT = f"""g as (select resolution, floor(tile_x / resolution) + col as gx, floor(tile_y / resolution) + row as gy, depth from c),
  a as (select query_id, x, y, res, floor(x / res) as gx, floor(y / res) as gy from q, (values {_RES}) s(res))
  select query_id, x, y, min(g.resolution) as resolution, coalesce(min_by(g.depth, g.resolution), 1000000.0) as value
  from a left join g on g.resolution = a.res and g.gx = a.gx and g.gy = a.gy group by query_id, x, y"""


@_add("lookup_xy_single_res", f"{_SR}, {_Q}, {_AT}")
def lookup_xy_single_res(spark, folder):
    """Depth at places, from cells of one size."""
    return lookup.values_at(_places(spark, folder), _sr(spark, folder), "depth", nodata=NODATA, resolutions=[FIXED])


@_add("lookup_xy_multi_res", f"{_VR}, {_Q}, {_AT}")
def lookup_xy_multi_res(spark, folder):
    """Depth at places, from the finest cell that has one."""
    return lookup.values_at(_places(spark, folder), _vr(spark, folder), "depth", nodata=NODATA, resolutions=[r for r in R.RESOLUTIONS if r <= LEAF])


@_add("layer_nodata", f"""{_SR}, k as (select tile_x, tile_y, row, col, vertical_uncertainty as v from c where density > 1)
  select c.tile_x, c.tile_y, c.resolution, c.row, c.col, coalesce(v, {NODATA}) as vertical_uncertainty, case when v is null then {int(NODATA)} else density end as density
  from c left join k using (tile_x, tile_y, row, col)""")  # fmt: skip
def layer_nodata(spark, folder):
    """Layers with cells of one point emptied, empty values replaced."""
    cells = _sr(spark, folder)
    some = cells.withColumns({n: F.when(F.col("density") > 1, F.col(n)) for n in ("vertical_uncertainty", "density")})
    return layers.pick(some, ["vertical_uncertainty", "density"], FIXED, NODATA)


@_add("layer_positive_up", f"{_VR} select tile_x, tile_y, resolution, row, col, -depth as depth from c where resolution = 8.0")
def layer_positive_up(spark, folder):
    """Depths at one resolution, counted upward."""
    return layers.pick(_vr(spark, folder), ["depth"], 8.0, positive_up=True)


@_add("layer_values", f"{_VR} select vertical_uncertainty as value from c")
def layer_values(spark, folder):
    """All values of a layer."""
    return layers.values(_vr(spark, folder), "vertical_uncertainty")


_INDEXED = "i as (select *, cast(floor(tile_y / resolution) + row as bigint) as grid_row, cast(floor(tile_x / resolution) + col as bigint) as grid_col from c)"


@_add("trim_bounds", f"{_VR}, {_INDEXED} select resolution, min(grid_row) as min_row, min(grid_col) as min_col, max(grid_row) + 1 as max_row, max(grid_col) + 1 as max_col from i group by 1")
def trim_bounds(spark, folder):
    """First and past-the-last row and column filled at each resolution."""
    return layers.trim_bounds(layers.with_grid_index(_vr(spark, folder), 0.0, 0.0), "depth")


_DENSE = f"""{_SR}, {_INDEXED}, b as (select min(grid_row) as r0, max(grid_row) as r1, min(grid_col) as c0, max(grid_col) as c1 from i),
  m as (select grid_row, grid_col from (select unnest(range(r0, r1 + 1)) as grid_row from b), (select unnest(range(c0, c1 + 1)) as grid_col from b)),
  s as (select cast({FIXED} as double) as resolution, m.grid_row, m.grid_col, depth, coalesce(density, 0) as density from m left join i using (grid_row, grid_col))"""


@_add("dense_layer", f"{_DENSE} select * from s")
def dense_layer(spark, folder):
    """Every cell of the filled box, empty ones too."""
    return layers.filled(layers.with_grid_index(_sr(spark, folder), 0.0, 0.0), ["depth", "density"])


@_add("surface_xyz", f"{_DENSE} select resolution, (grid_col + 0.5::double) * resolution as x, (grid_row + 0.5::double) * resolution as y, depth, density from s")
def surface_xyz(spark, folder):
    """The same with the centers of the cells."""
    return layers.surface(layers.with_grid_index(_sr(spark, folder), 0.0, 0.0), ["depth", "density"], 0.0, 0.0)


@_add("csv_export_rows", f"""{_DENSE} select resolution, printf('%.3f', (grid_col + 0.5::double) * resolution) as x, printf('%.3f', (grid_row + 0.5::double) * resolution) as y,
  case when depth is null then 'nan' else printf('%.3f', -depth) end as elevation, cast(density as varchar) as density from s""")  # fmt: skip
def csv_export_rows(spark, folder):
    """The text rows of the CSV export."""
    return layers.csv_rows(layers.with_grid_index(_sr(spark, folder), 0.0, 0.0), ["depth", "density"], 0.0, 0.0)


_ONE = "survey_R__line_F"


@_add("container_grid", f"with {_P}, {_tiled(TILE)}, {_FIXED}, {_cells('r', extra=', container')} select tile_x, tile_y, resolution, row, col, container, depth, density from c")
def container_grid(spark, folder):
    """Depth and density of the points of each container by itself."""
    tiled = with_tiles(points(spark, folder), TILE).withColumn("resolution", F.lit(FIXED))
    cells = C.aggregate_cells(tiled, "mean", TILE, extra=("container",))
    return cells.select(*layers.KEYS, "container", "depth", "density")


@_add("container_families", "with f as (select case when len(string_split(container, '__')) = 2 then string_split(container, '__')[1] else container end as family, seq from containers) select family, min(seq) as first_seq, count(*) as n_containers from f group by 1")
def container_families(spark, folder):
    """Containers by what stands before the double underscore."""
    named = table(spark, folder, "containers").select(family(F.col("container")).alias("family"), "seq")
    return named.groupBy("family").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n_containers"))


@_add("remove_container_grid", f"with {_P}, k as (select * from p where container <> '{_ONE}'), {_tiled(LEAF, 'k')}, {_BY_LEAF}, {_cells('r')} select * from c")
def remove_container_grid(spark, folder):
    """The grid without one container."""
    return C.variable_resolution(points(spark, folder).where(F.col("container") != _ONE), leaf=LEAF)


@_add("two_batch_union_grid", f"with {_P}, k as (select * from p where container = '{_ONE}' union all select * from p where container like 'survey_N%'), {_tiled(LEAF, 'k')}, {_BY_LEAF}, {_cells('r')} select * from c")
def two_batch_union_grid(spark, folder):
    """The grid of two batches added one after the other."""
    every = points(spark, folder)
    return C.variable_resolution(every.where(F.col("container") == _ONE).unionByName(every.where(F.col("container").like("survey_N%"))), leaf=LEAF)


@_add("dirty_tile_update", f"""with {_P}, a as (select * from p where container <> '{_ONE}'), d as (select * from p where container = '{_ONE}' and x < 300),
  k as (select * from a union all select * from d),
  ta as (select *, floor(x / {LEAF}) * {LEAF} as tile_x, floor(y / {LEAF}) * {LEAF} as tile_y from a),
  la as (select tile_x, tile_y, {_lookup_sql('cast(avg(z) as float)', LEAF)} as resolution from ta group by 1, 2), ra as (select ta.*, resolution from ta join la using (tile_x, tile_y)),
  {_cells('ra', name='ca')}, {_tiled(LEAF, 'k')},
  dirty as (select distinct floor(x / {LEAF}) * {LEAF} as tile_x, floor(y / {LEAF}) * {LEAF} as tile_y from d), {_BY_LEAF},
  rd as (select r.* from r semi join dirty using (tile_x, tile_y)), {_cells('rd', name='cn')}
  select * from cn union all select * from ca anti join (select distinct tile_x, tile_y, resolution from cn) using (tile_x, tile_y, resolution)""")  # fmt: skip
def dirty_tile_update(spark, folder):
    """A batch arrives: only the tiles it touches are gridded again; what else there was stays."""
    every = points(spark, folder)
    before = every.where(F.col("container") != _ONE)
    batch = every.where((F.col("container") == _ONE) & (F.col("x") < 300))
    old = C.variable_resolution(before, leaf=LEAF)
    dirty = with_tiles(batch, LEAF).select("tile_x", "tile_y").distinct()
    touched = with_tiles(before.unionByName(batch), LEAF).join(dirty, ["tile_x", "tile_y"], "left_semi")
    new = C.aggregate_cells(C.with_resolution(touched, C.leaf_resolutions(touched, LEAF, "depth")), "mean", LEAF)
    return C.merge_cells(old, new, touched, dirty, clear=False)


@_add("tile_neighbors", f"""with {_P}, {_tiled(LEAF)}, d as (select distinct tile_x, tile_y from t),
  s as (select * from (values ('south', 0, 0.0, -{LEAF}), ('east', 1, {LEAF}, 0.0), ('north', 2, 0.0, {LEAF}), ('west', 3, -{LEAF}, 0.0)) v(side, position, dx, dy))
  select a.tile_x, a.tile_y, side, position, b.tile_x as neighbor_x, b.tile_y as neighbor_y from d a, s join d b on b.tile_x = a.tile_x + dx and b.tile_y = a.tile_y + dy""")  # fmt: skip
def tile_neighbors(spark, folder):
    """Tiles beside each tile."""
    return neighbors.tile_neighbors(with_tiles(points(spark, folder), LEAF), LEAF)


@_add("halo_points", f"""with {_P}, {_tiled(LEAF)}, d as (select distinct tile_x, tile_y from t), o as (
  select *, tile_x as for_x, tile_y + {LEAF} as for_y from t where y >= tile_y + {LEAF} - {BUFFER} union all
  select *, tile_x, tile_y - {LEAF} from t where y <= tile_y + {BUFFER} union all
  select *, tile_x + {LEAF}, tile_y from t where x >= tile_x + {LEAF} - {BUFFER} union all
  select *, tile_x - {LEAF}, tile_y from t where x <= tile_x + {BUFFER})
  select for_x, for_y, count(*) as n, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, sum(z) as sum_z
  from o where (for_x, for_y) in (select (tile_x, tile_y) from d) group by 1, 2""")  # fmt: skip
def halo_points(spark, folder):
    """What the halo of each tile holds."""
    halo = neighbors.halo_points(with_tiles(points(spark, folder), LEAF), LEAF, BUFFER)
    return halo.groupBy("for_x", "for_y").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.sum("z").alias("sum_z"))


@_add("tile_boundaries", f"""with {_P}, {_tiled(LEAF)}, d as (select distinct tile_x, tile_y from t)
  select tile_x, tile_y, corner, tile_x + dx * {LEAF} as x, tile_y + dy * {LEAF} as y from d, (values (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 0, 0)) v(corner, dx, dy)""")  # fmt: skip
def tile_boundaries(spark, folder):
    """Outlines of the tiles."""
    return neighbors.tile_outlines(with_tiles(points(spark, folder), LEAF), LEAF)


@_add("tile_geotransform", f"""{_VR} select distinct tile_x, tile_y, resolution, cast(cast(tile_x as float) as double) as origin_x, resolution as pixel_width, 0.0::double as skew_x,
  cast(cast(tile_y + {LEAF} as float) as double) as origin_y, 0.0::double as skew_y, -resolution as pixel_height from c""")  # fmt: skip
def tile_geotransform(spark, folder):
    """Geotransform of each tile's raster."""
    return neighbors.geotransforms(_vr(spark, folder), LEAF)


CHUNK = 384.0
_SECTION = "cast(case when i < (n % k) * (n // k + 1) then i // (n // k + 1) else n % k + (i - (n % k) * (n // k + 1)) // (n // k) end as int)"
_CHUNKS = f"""with {_P}, {_tiled(LEAF)}, d as (select distinct tile_x, tile_y from t),
  e as (select min(tile_x) as x0, min(tile_y) as y0, cast((max(tile_x) - min(tile_x)) / {LEAF} + 1 as bigint) as nx, cast((max(tile_y) - min(tile_y)) / {LEAF} + 1 as bigint) as ny from d),
  rows_ as (select tile_x, tile_y, {_SECTION} as chunk_row from (select tile_x, tile_y, cast((tile_y - y0) / {LEAF} as bigint) as i, ny as n, cast(ceil(ny / 3.0) as bigint) as k from d, e)),
  cols_ as (select tile_x, tile_y, k, {_SECTION} as chunk_col from (select tile_x, tile_y, cast((tile_x - x0) / {LEAF} as bigint) as i, nx as n, cast(ceil(nx / 3.0) as bigint) as k from d, e)),
  h as (select tile_x, tile_y, cast(chunk_row * k + chunk_col as int) as chunk, chunk_row, chunk_col from rows_ join cols_ using (tile_x, tile_y))"""


@_add("chunk_assignment", f"{_CHUNKS} select * from h")
def chunk_assignment(spark, folder):
    """The block of each tile."""
    return chunks.chunk_tiles(with_tiles(points(spark, folder), LEAF), LEAF, CHUNK)


@_add("chunk_geotransform", f"""{_CHUNKS} select chunk, cast(cast(min(tile_x) as float) as double) as origin_x, cast(cast(max(tile_y) + {LEAF} as float) as double) as origin_y,
  cast((max(tile_x) - min(tile_x) + {LEAF}) / {FIXED} as bigint) as n_cols, cast((max(tile_y) - min(tile_y) + {LEAF}) / {FIXED} as bigint) as n_rows,
  case when count(*) > 1 then greatest(max(tile_x) - min(tile_x), max(tile_y) - min(tile_y)) + {LEAF} else 0 end::double as longest from h group by 1""")  # fmt: skip
def chunk_geotransform(spark, folder):
    """Corner and shape of each block's raster."""
    return chunks.chunk_geotransforms(chunks.chunk_tiles(with_tiles(points(spark, folder), LEAF), LEAF, CHUNK), FIXED, LEAF)


_UV = "(x - tile_x - floor((x - tile_x) / 32.0) * 32.0)", "(y - tile_y - floor((y - tile_y) / 32.0) * 32.0)"


@_add("plane_slopes", f"""with {_P}, {_tiled(TILE)}, r as (select *, 32.0::double as resolution from t),
  k as (select {_CELL}, count(*) as n, var_pop({_UV[0]}) as uu, var_pop({_UV[1]}) as vv, covar_pop({_UV[0]}, {_UV[1]}) as uv, covar_pop({_UV[0]}, z) as uz, covar_pop({_UV[1]}, z) as vz from r group by all)
  select tile_x, tile_y, resolution, row, col, round((uz * vv - vz * uv) / (uu * vv - uv * uv), 6) + 0.0 as x_slope, round((vz * uu - uz * uv) / (uu * vv - uv * uv), 6) + 0.0 as y_slope
  from k where n >= 3 and uu * vv - uv * uv > uu * vv * 1e-3""")  # fmt: skip
def plane_slopes_query(spark, folder):
    """Slopes of the planes that are well determined, to six decimals."""
    tiled = with_tiles(points(spark, folder), TILE).withColumn("resolution", F.lit(32.0))
    keys = list(layers.KEYS)
    u, v = F.pmod(F.col("x") - F.col("tile_x"), F.lit(32.0)), F.pmod(F.col("y") - F.col("tile_y"), F.lit(32.0))
    sound = with_cells(tiled).groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop(u).alias("uu"), F.var_pop(v).alias("vv"), F.covar_pop(u, v).alias("uv")).where("n >= 3 and uu * vv - uv * uv > uu * vv * 1e-3")
    six = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)
    return plane_slopes(tiled).join(sound.select(*keys), keys, "left_semi").select(*keys, six("x_slope"), six("y_slope"))


@_add("plane_slopes_all", f"""with {_P}, {_tiled(TILE)}, r as (select *, 4.0::double as resolution from t),
  k0 as (select *, {_CELL.replace('tile_x, tile_y, resolution, ', '')} from r),
  k as (select tile_x, tile_y, resolution, row, col, count(*) as n, var_pop(x - tile_x - col * 4.0::double) as uu, var_pop(y - tile_y - row * 4.0::double) as vv, covar_pop(x - tile_x - col * 4.0::double, y - tile_y - row * 4.0::double) as uv,
    covar_pop(x - tile_x - col * 4.0::double, z) as uz, covar_pop(y - tile_y - row * 4.0::double, z) as vz, avg(x) as p, avg(y) as q, avg(z) as z from k0 group by all),
  g as (select *, n >= 3 and uu * vv - uv * uv > uu * vv * 1e-9 and uu * vv - uv * uv > 0 as good, uu + vv as spread, atan2(case when uu >= vv then uv else vv end, case when uu >= vv then uu else uv end) as angle, p * p + q * q + 1 as r from k),
  h as (select *, cos(angle) as e, sin(angle) as f, cos(angle) * p + sin(angle) * q as m, (cos(angle) * uz + sin(angle) * vz) / nullif(spread, 0) as along from g),
  w as (select *, case when spread > 0 then (z - m * along) / ((f * p - e * q) * (f * p - e * q) + 1) else z / r end as b from h)
  select tile_x, tile_y, resolution, row, col,
    round(case when good then (uz * vv - vz * uv) / (uu * vv - uv * uv) when spread > 0 then (along - m * b) * e + b * p else b * p end + 3e-8, 6) + 0.0 as x_slope,
    round(case when good then (vz * uu - uz * uv) / (uu * vv - uv * uv) when spread > 0 then (along - m * b) * f + b * q else b * q end + 3e-8, 6) + 0.0 as y_slope from w""")  # fmt: skip
def plane_slopes_all(spark, folder):
    """Slopes of every cell of 4 m, to six decimals; few points, or points on a line, give the solution of least norm."""
    found = plane_slopes(with_tiles(points(spark, folder), TILE).withColumn("resolution", F.lit(4.0)))
    return found.withColumns({c: F.round(F.col(c) + F.lit(3e-8), 6) + F.lit(0.0) for c in ("x_slope", "y_slope")})  # off the ties, where engines differ


@_add("grid_extents", f"""with {_P} select floor(min(x) / {TILE}) * {TILE} as min_x, floor(min(y) / {TILE}) * {TILE} as min_y,
  case when ceil(max(x) / {TILE}) * {TILE} = max(x) then max(x) + {TILE} else ceil(max(x) / {TILE}) * {TILE} end as max_x,
  case when ceil(max(y) / {TILE}) * {TILE} = max(y) then max(y) + {TILE} else ceil(max(y) / {TILE}) * {TILE} end as max_y from p""")  # fmt: skip
def grid_extents(spark, folder):
    """The box of all points on tile borders."""
    return aligned_extents(points(spark, folder), TILE)


@_add("time_extent", "select strftime(make_timestamp(min(min_time) * 1000000), '%Y-%m-%dT%H:%M:%S') as min_time, strftime(make_timestamp(max(max_time) * 1000000), '%Y-%m-%dT%H:%M:%S') as max_time from containers")
def time_extent(spark, folder):
    """Earliest and latest time of all containers."""
    return table(spark, folder, "containers").agg(utc_text(F.min("min_time")).alias("min_time"), utc_text(F.max("max_time")).alias("max_time"))


@_add("backscatter_mean", f"{_SR} select tile_x, tile_y, resolution, row, col, depth as intensity, density from c")
def backscatter_mean(spark, folder):
    """Cells of backscatter: the depth layer is called intensity."""
    cells = C.single_resolution(points(spark, folder).select("x", "y", "z"), "mean", FIXED, tile_size=TILE)
    return cells.withColumnRenamed("depth", "intensity")


@_add("layer_range", f"""{_SR} select 'depth' as layer, min(depth) as least, max(depth) as greatest from c
  union all select 'vertical_uncertainty', min(vertical_uncertainty), max(vertical_uncertainty) from c""")  # fmt: skip
def layer_range(spark, folder):
    """Least and greatest values, as raster headers want them."""
    return stats.layer_range(_sr(spark, folder), ["depth", "vertical_uncertainty"])


@_add("trial_cell_counts", f"with {_P}, {_tiled(LEAF)} select tile_x, tile_y, floor(x / 16.0) * 16.0 as cell_x, floor(y / 16.0) * 16.0 as cell_y, count(*) as n from t group by all")
def trial_cell_counts(spark, folder):
    """Points in the cells of a resolution under trial."""
    return stats.trial_counts(with_tiles(points(spark, folder), LEAF), 16.0)


@_add("grid_mean_depth", f"with {_P}, k as (select max(container) as c from p) select container, round_even(avg(z), 3) as mean_depth from p where container = (select c from k) group by 1")
def grid_mean_depth(spark, folder):
    """Mean depth of the batch added last."""
    every = points(spark, folder)
    newest = every.agg(F.max("container").alias("container"))
    return every.join(F.broadcast(newest), "container").groupBy("container").agg(to_mm(F.avg("z")).alias("mean_depth"))  # one row


@_add("resolutions", f"{_VR} select distinct resolution from c")
def resolutions(spark, folder):
    """The resolutions in use."""
    return _vr(spark, folder).select("resolution").distinct()


@_add("power_of_two_sizes", """select grid_name, tile_size, subtile_size, coalesce(tile_size > 0 and pow(2.0, round(log2(tile_size))) = tile_size, false) as tile_ok,
  coalesce(subtile_size > 0 and pow(2.0, round(log2(subtile_size))) = subtile_size, false) as subtile_ok from grids""")  # fmt: skip
def power_of_two_sizes(spark, folder):
    """Whether the sizes of each grid are powers of two."""
    return table(spark, folder, "grids").select("grid_name", "tile_size", "subtile_size", power_of_two(F.col("tile_size")).alias("tile_ok"), power_of_two(F.col("subtile_size")).alias("subtile_ok"))


@_add("container_times", "select container, strftime(make_timestamp(min_time * 1000000), '%Y-%m-%dT%H:%M:%S') as min_time, strftime(make_timestamp(max_time * 1000000), '%Y-%m-%dT%H:%M:%S') as max_time, true as round_trip from containers")
def container_times(spark, folder):
    """Times as text, and whether they come back as the seconds they were."""
    told = table(spark, folder, "containers").withColumn("_text", utc_text(F.col("min_time")))
    same = F.coalesce(utc_seconds(F.col("_text")) == F.col("min_time"), F.lit(True))
    return told.select("container", F.col("_text").alias("min_time"), utc_text(F.col("max_time")).alias("max_time"), same.alias("round_trip"))


_SOUNDINGS = "s as (select distinct point_id, x, y, z, tile_name, cell_index from points where x is not null and y is not null)"


def _soundings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "points").select("point_id", "x", "y", "z", "tile_name", "cell_index").where("x is not null and y is not null").distinct()


@_add("soundings_cell_index", f"""with {_SOUNDINGS}, r as (select s.*, t.tile_x, t.tile_y, t.resolution from s join tiles t using (tile_name)),
  k as (select *, cast(floor((y - tile_y) / resolution) as int) as row, cast(floor((x - tile_x) / resolution) as int) as col, cast(1024.0 / resolution as int) as n from r)
  select tile_name, row, col, row * n + col as flat_index, count(*) as n_soundings, count(*) filter (where cell_index <> -1 and cell_index <> row * n + col) as n_other from k group by all""")  # fmt: skip
def soundings_cell_index(spark, folder):
    """Cell of each sounding at its tile's resolution, its flat index, and how many soundings were stored with another."""
    tiles = table(spark, folder, "tiles").select("tile_name", "tile_x", "tile_y", "resolution")
    keyed = with_cells(_soundings(spark, folder).join(tiles, "tile_name"))
    flat = keyed.withColumn("flat_index", flat_index(F.col("row"), F.col("col"), TILE, F.col("resolution")))
    back = flat.withColumn("_b", row_col(F.col("flat_index"), F.ceil(F.lit(TILE) / F.col("resolution"))))
    other = F.count(F.when((F.col("cell_index") != -1) & (F.col("cell_index") != F.col("flat_index")), 1))
    return back.groupBy("tile_name", F.col("_b.row").alias("row"), F.col("_b.col").alias("col"), "flat_index").agg(F.count("*").alias("n_soundings"), other.alias("n_other"))


@_add("soundings_shoalest", f"""with {_SOUNDINGS}, r as (select s.*, t.tile_x, t.tile_y, t.resolution from s join tiles t using (tile_name) where isfinite(z))
  select {_CELL}, min(z) as depth, count(*) as density from r group by all""")  # fmt: skip
def soundings_shoalest(spark, folder):
    """Shoalest sounding of each cell, at the resolution stored with the tile."""
    finite = F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < F.lit(float("inf")))
    tiles = table(spark, folder, "tiles").select("tile_name", "tile_x", "tile_y", "resolution")
    keyed = with_cells(_soundings(spark, folder).where(finite).join(tiles, "tile_name"))
    return keyed.groupBy(*layers.KEYS).agg(F.min("z").alias("depth"), F.count("*").alias("density"))


@_add("cube_density", f"{_VR} select tile_x, tile_y, resolution, row, col, density from c")
def cube_density(spark, folder):
    """Points in each node's cell, as the CUBE method counts them; nodes with an estimate but no point of their own have none."""
    return _vr(spark, folder, CUBE).where("density > 0").select(*layers.KEYS, "density")


@_add("total_uncertainty_histogram")
def total_uncertainty_histogram(spark, folder):
    """Histogram of the total uncertainty of the CUBE nodes."""
    return stats.histogram(_vr(spark, folder, CUBE).select(F.col("total_uncertainty").alias("value")))


@_add("cube_grid")
def cube_grid(spark, folder):
    """Depth, uncertainty and hypotheses of each node, at the resolution that goes with the depth of each leaf tile."""
    return _vr(spark, folder, CUBE)
