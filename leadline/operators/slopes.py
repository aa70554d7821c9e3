"""The plane through a cell's points, by least squares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import with_cells


def plane_slopes(keyed: DataFrame, prefix: str = "tile", fill_singular: bool = True) -> DataFrame:
    """``({prefix}_x, {prefix}_y, resolution, row, col, x_slope, y_slope)``: a and b of z = ax + by + c.

    One aggregation, combined before the shuffle, gives means and covariances
    in coordinates about the cell's corner; the rest is arithmetic.  Cells
    whose points lie on a line or are fewer than three have no single plane:
    of all that fit best, they get the one whose (a, b, c) in full coordinates
    is shortest, or null if not ``fill_singular``.  Points without depth don't
    count; a cell without any has no row.
    """
    keys = [f"{prefix}_x", f"{prefix}_y", "resolution", "row", "col"]
    cells = with_cells(keyed.where("z is not null"), prefix)
    # Sums about the corner keep their digits where coordinates are in the millions.
    corner_x, corner_y = F.col(keys[0]) + F.col("col") * F.col("resolution"), F.col(keys[1]) + F.col("row") * F.col("resolution")
    u, v, z = F.col("x") - F.col(keys[0]) - F.col("col") * F.col("resolution"), F.col("y") - F.col(keys[1]) - F.col("row") * F.col("resolution"), F.col("z").cast("double")
    plane = cells.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.var_pop(u).alias("_uu"), F.var_pop(v).alias("_vv"), F.covar_pop(u, v).alias("_uv"), F.covar_pop(u, z).alias("_uz"), F.covar_pop(v, z).alias("_vz"),
        F.avg(u).alias("_u"), F.avg(v).alias("_v"), F.avg(z).alias("_z"),
    )
    det = F.col("_uu") * F.col("_vv") - F.col("_uv") * F.col("_uv")
    good = (F.col("_n") >= 3) & (det > F.col("_uu") * F.col("_vv") * F.lit(1e-9)) & (det > 0)
    slope = lambda a, b, c, d: (F.col(a) * F.col(b) - F.col(c) * F.col(d)) / det
    if not fill_singular:
        return plane.select(*keys, F.when(good, slope("_uz", "_vv", "_vz", "_uv")).alias("x_slope"), F.when(good, slope("_vz", "_uu", "_uz", "_uv")).alias("y_slope"))
    # A line through the middle (p, q) in direction (e, f): a e + b f is the slope along it, a p + b q + c the mean.
    p, q = corner_x + F.col("_u"), corner_y + F.col("_v")
    spread = F.col("_uu") + F.col("_vv")
    rows = plane.withColumns({"_good": good, "_p": p, "_q": q, "_spread": spread})
    # A direction, from the larger of the two variances, and the slope along it.
    flat = F.col("_uu") >= F.col("_vv")
    length = F.sqrt(F.when(flat, F.col("_uu") ** 2 + F.col("_uv") ** 2).otherwise(F.col("_vv") ** 2 + F.col("_uv") ** 2))
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    e, f = over(F.when(flat, F.col("_uu")).otherwise(F.col("_uv")), length), over(F.when(flat, F.col("_uv")).otherwise(F.col("_vv")), length)
    rows = rows.withColumns({"_e": e, "_f": f})
    along = over(F.col("_e") * F.col("_uz") + F.col("_f") * F.col("_vz"), F.col("_spread"))
    # The shortest solution is a mix of (e, f, 0) and (p, q, 1); its weights solve two equations, whose products are m and r.
    m, r = F.col("_e") * F.col("_p") + F.col("_f") * F.col("_q"), F.col("_p") ** 2 + F.col("_q") ** 2 + 1
    # r - m m, without the loss of digits far from the origin.
    second = (F.col("_z") - m * along) / ((F.col("_f") * F.col("_p") - F.col("_e") * F.col("_q")) ** 2 + 1)
    first = along - m * second
    one = F.col("_z") / r
    rows = rows.withColumns({"_first": F.when(F.col("_spread") > 0, first).otherwise(F.lit(0.0)), "_second": F.when(F.col("_spread") > 0, second).otherwise(one)})
    side = lambda direction, middle: F.when(F.col("_spread") > 0, F.col("_first") * F.col(direction)).otherwise(F.lit(0.0)) + F.col("_second") * F.col(middle)
    return rows.select(*keys, F.when(F.col("_good"), slope("_uz", "_vv", "_vz", "_uv")).otherwise(side("_e", "_p")).alias("x_slope"), F.when(F.col("_good"), slope("_vz", "_uu", "_uz", "_uv")).otherwise(side("_f", "_q")).alias("y_slope"))
