"""What can be added to a grid: DataFrames, pandas frames, structured arrays, mappings of arrays."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("x", "y", "z", "tvu", "thu")
_TYPES = {"x": "double", "y": "double", "z": "float", "tvu": "float", "thu": "float"}


def schema_of(columns: list[str]) -> T.StructType:
    """The stored columns of points, in their types, with container and leaf tile."""
    kinds = [*[(c, T.DoubleType() if _TYPES[c] == "double" else T.FloatType()) for c in COLUMNS if c in columns], ("container", T.StringType()), ("tile_x", T.DoubleType()), ("tile_y", T.DoubleType())]
    return T.StructType([T.StructField(c, t) for c, t in kinds])


def to_frame(spark: SparkSession, data) -> DataFrame:
    """The columns x, y, z and, if there are any, tvu and thu, in their types; others are dropped.

    Takes a Spark or pandas DataFrame, a one-dimensional structured array, a
    mapping of arrays, a dataset of variables, coordinates among them, or
    anything with ``compute`` that gives one of these.
    x, y and z must be there.
    """
    if isinstance(data, DataFrame):
        found = data
    else:
        if hasattr(data, "compute"):
            data = data.compute()
        if isinstance(data, np.ndarray):
            if data.dtype.names is None or data.ndim != 1:
                raise ValueError("an array must be one-dimensional and structured")
            data = pd.DataFrame({n: data[n] for n in data.dtype.names if n in COLUMNS})
        elif not isinstance(data, pd.DataFrame) and hasattr(data, "variables"):
            # A dataset is a mapping, too, but of its data only; what is a coordinate in it counts as well.
            data = pd.DataFrame({n: np.asarray(data[n]).ravel() for n in COLUMNS if n in data.variables})
        elif isinstance(data, Mapping):
            data = pd.DataFrame({n: np.asarray(data[n]) for n in data if n in COLUMNS})
        if not isinstance(data, pd.DataFrame):
            raise ValueError(f"can't take points from a {type(data).__name__}")
        found = data
    missing = [c for c in ("x", "y", "z") if c not in found.columns]
    if missing:
        raise ValueError(f"points lack {missing}")
    keep = [c for c in COLUMNS if c in found.columns]
    if isinstance(found, pd.DataFrame):
        found = spark.createDataFrame(found[keep].astype({c: "float64" if _TYPES[c] == "double" else "float32" for c in keep}))
    return found.select(*[F.col(c).cast(_TYPES[c]).alias(c) for c in keep])
