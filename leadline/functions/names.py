"""Names: tiles, container families, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_name(x: Column, y: Column) -> Column:
    """``x_y`` of a tile's south-west corner, each with one decimal at least."""
    return F.concat(x.cast("double").cast("string"), F.lit("_"), y.cast("double").cast("string"))


def family(container: Column) -> Column:
    """What stands before ``__``, if it occurs exactly once; else the whole name."""
    parts = F.split(container, "__")
    return F.when(F.size(parts) == 2, parts[0]).otherwise(container)


def utc_text(seconds: Column) -> Column:
    """Whole UTC seconds as ``YYYY-MM-DDTHH:MM:SS``, whatever the session's zone."""
    at = F.to_utc_timestamp(F.timestamp_seconds(seconds.cast("bigint")), F.current_timezone())
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def utc_seconds(text: Column) -> Column:
    """The seconds of :func:`utc_text`."""
    at = F.from_utc_timestamp(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss"), F.current_timezone())
    return F.unix_seconds(at)
