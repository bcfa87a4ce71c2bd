"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 16 << 20


def usable(vector: str) -> Column:
    """True for a vector that is there and holds no null and no component that isn't finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component as long; what doesn't fit a long is the largest or smallest one."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def blocks_mapped(df: DataFrame, function: Callable, schema: str, rows: int) -> DataFrame:
    """``mapInArrow`` in batches of at most ``rows`` rows or about BATCH_BYTES, for rows that hold whole blocks of vectors.

    Spark has these as settings of the session only, so they stay set there.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A list column of equally long lists of long as rows of a matrix."""
    values = pa.concat_arrays([column]).flatten()
    return np.asarray(values, np.int64).reshape(rows, len(values) // rows if rows else 0)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
