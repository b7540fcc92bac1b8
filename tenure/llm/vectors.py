"""Which vectors take part in a search, and their rows as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: Column) -> Column:
    """No null, no non-finite component, and not the zero vector."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.coalesce(
        vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part: those with an id and a usable
    vector of the most frequent dimension (the larger one, if two are equally so)."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")
    ).where(F.col("id").isNotNull() & is_usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    first = sizes.first()
    return rows.where(F.size("vector") == (first["d"] if first else 0))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """The rows of a list column of equal lengths, none if the column is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1), kind))
