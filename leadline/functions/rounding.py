"""Rounding and number formats that decide results to the last digit."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_mm(c: Column, single: bool = False) -> Column:
    """Round half-even to three decimals; ``single`` does so in 32-bit floats."""
    if not single:
        return F.bround(c, 3)
    milli = F.rint((c.cast("float") * F.lit(1000).cast("float")).cast("double"))
    return (milli / F.lit(1000.0)).cast("float")


def power_of_two(c: Column) -> Column:
    """Whether a number is a power of two, fractions included."""
    e = F.rint(F.log2(c))
    return F.coalesce((c > 0) & (F.pow(F.lit(2.0), e) == c), F.lit(False))


def is_power_of_two(n: float) -> bool:
    """The same for a plain number."""
    if n is None or n <= 0:
        return False
    m, _ = math.frexp(float(n))
    return m == 0.5
