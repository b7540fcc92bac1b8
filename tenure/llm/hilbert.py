"""Shards of rows that are close in several columns at once, by Hilbert order.

Each dimension is quantised at its quantiles over all rows, the cell numbers become one
index along a Hilbert curve, and the rows, ordered by it, are cut into runs of equal
length. Neighbours on the curve are neighbours in every dimension, so the least and
greatest values of a shard (``manifest``) are narrow in all of them and a reader can
skip files by any.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import cut

# Bits per dimension: 2 ** 5 - 2 quantiles, and a cell of its own for nulls.
BITS = 5
# Rows of a partition are numbered in the low bits of monotonically_increasing_id().
ROW_BITS = 33


def rank_strings(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the strings of ``column`` as numbers in the order of their bytes.

    The distinct values are sorted by range and numbered in their partitions, so only the
    order of two numbers means anything. Nulls stay. A value that a third of the rows
    have is one row of the joined side.
    """
    ranked = cut(
        rows.select(F.col(column).alias("__value"))
        .where("__value is not null")
        .distinct()
        .repartitionByRange("__value")
        .sortWithinPartitions("__value")
        .withColumn("__number", F.monotonically_increasing_id())
    )
    return (
        rows.join(ranked, F.col(column) == F.col("__value"), "left")
        .drop("__value", column)
        .withColumnRenamed("__number", column)
    )


def curve_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points given by their cells, by Skilling's
    transposition (AIP Conference Proceedings 707, 2004)."""
    x = [np.asarray(c, np.int64).copy() for c in cells]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(len(x)):
            odd = (x[i] >> level) & 1 == 1
            swap = np.where(odd, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(odd, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        gray ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for own in x:
            index = (index << 1) | (((own ^ gray) >> level) & 1)
    return index


def _curve_column(cells: list[Column], bits: int) -> Column:
    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(curve_index([c.to_numpy() for c in columns], bits))

    return index(*cells)


def _cells(rows: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Per dimension the cell of a value: 0 for null, then one for each quantile range."""
    shares = [i / ((1 << bits) - 1) for i in range(1, (1 << bits) - 1)]
    edges = rows.agg(*(F.percentile_approx(d, shares, 10_000).alias(d) for d in dims)).first()
    return [
        F.coalesce(
            F.when(
                F.col(d).isNotNull(),
                1 + sum(((F.col(d) > edge).cast("int") for edge in (edges[d] or [])), F.lit(0)),
            ),
            F.lit(0),
        ).cast("long")
        for d in dims
    ]


def shards(
    rows: DataFrame,
    dims: dict[str, Column],
    n_shards: int = 8,
    tie: Sequence[str] = (),
    bits: int = BITS,
) -> DataFrame:
    """The columns of ``rows`` with ``curve`` (index along the curve), ``shard`` and
    ``slot`` (place in the shard, from 0 without gaps).

    Shards are runs along the curve whose numbers of rows differ by one at most, so a
    group of equal rows is cut only where a shard is full. ``dims`` are numeric
    or string expressions over ``rows``, strings in the order of their bytes; ``tie`` are
    the columns that order rows of one cell. Nulls have a cell of their own; equal rows are interchangeable; no rows give no rows. Columns
    named like those added, or ``__dim_0`` and so on, must be left out of ``rows``. Only
    quantiles and one count per partition are gathered, the latter in a window over those
    counts.
    """
    names = [f"__dim_{i}" for i in range(len(dims))]
    own = rows.columns
    placed = rows.select(*own, *(d.alias(n) for n, d in zip(names, dims.values(), strict=True)))
    for name, kind in placed.select(*names).dtypes:
        if kind == "string":
            placed = rank_strings(placed, name)
    placed = cut(placed.select(*own, *(F.col(n).cast("long").alias(n) for n in names)))
    index = _curve_column(_cells(placed, names, bits), bits)
    order = ["curve", *tie, *(c for c in own if c not in tie)]
    ranged = (
        placed.withColumn("curve", index)
        .drop(*names)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    numbered = cut(ranged).withColumn("__part", F.shiftright("__at", ROW_BITS))
    line = Window.orderBy("__part")
    parts = (
        numbered.groupBy("__part")
        .count()
        .withColumn("__before", F.sum("count").over(line) - F.col("count"))
        .withColumn("__n", F.sum("count").over(Window.orderBy(F.lit(0)).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))
        .drop("count")
    )
    rank = F.col("__before") + F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)
    first = F.expr(f"(shard * __n + {n_shards - 1}) div {n_shards}")
    return (
        numbered.join(parts, "__part")
        .withColumn("__rank", rank)
        .withColumn("shard", F.expr(f"cast(__rank * {n_shards} div __n as int)"))
        .withColumn("slot", F.col("__rank") - first)
        .select(*own, "curve", "shard", "slot")
    )


def manifest(sharded: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Per shard its rows and each column's least and greatest value, for skipping files."""
    ends = [f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *ends)


def write(sharded: DataFrame, folder: str) -> None:
    """One folder a shard, its rows in the order of the curve, in as many files as ranges of
    rows meet the shard."""
    (
        sharded.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(folder)
    )
