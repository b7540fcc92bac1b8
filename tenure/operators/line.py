"""One sorted line of rows per key, cut wherever the data is, with running values along it.

The rows of all keys are range-partitioned by key and order, so the cuts follow the data:
a key, a day or a single instant that holds a third of all rows is spread like anything
else (only rows that agree in key and order stay together). Within a partition the
rows are walked once. What a partition needs from those before it, if its first key began
there, is found from one row per partition and joined back by partition number.

Both readers, the walk and those totals, need the same cuts, so they share one exchange.
That is checked in the plan itself: a mark of each partition's first row travels along
both ways, and if they differ the query fails.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The walk travels with its tasks: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_UNSHARED = "the cuts of a line differ between its readers; keep spark.sql.exchange.reuse on"


class _Walk:
    """What is known of the current key while rows go by in order, batch after batch."""

    def __init__(self, on: list[str], exclusive: bool) -> None:
        self.on, self.exclusive = on, exclusive
        self.key: list[pa.Scalar] | None = None
        self.first_key: list[pa.Scalar] = []
        self.mark = 0
        self.n = 0
        self.last: pa.Array | None = None
        self.first: pa.Array | None = None
        self.in_head = True

    def _new_key(self, batch: pa.RecordBatch) -> np.ndarray:
        """Where a row's key is not that of the row before it."""
        new = np.zeros(batch.num_rows, bool)
        for name, before in zip(self.on, self.key, strict=True):
            own = batch[name]
            whole = pa.concat_arrays([pa.array([before.as_py()], own.type), own])
            differs = pc.fill_null(pc.not_equal(whole[1:], whole[:-1]), False)
            nulls = pc.xor(whole[1:].is_null(), whole[:-1].is_null())
            new |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
        return new

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """Of each row the running sum, the last value and the first one of its key, and
        whether its key is the partition's first."""
        size = batch.num_rows
        at = np.arange(size)
        if self.key is None:
            self.key = self.first_key = [batch[name][0] for name in self.on]
            seen = [k.as_py() for k in self.key] + [batch["at"][0].as_py()]
            self.mark = zlib.crc32(repr(seen).encode())
            self.last = pa.nulls(1, batch["value"].type)
            self.first = pa.nulls(1, batch["first"].type)
        new = self._new_key(batch)
        # Part 0 goes on with the key before; each further one begins a key.
        part = np.cumsum(new)
        begin = np.concatenate([[0], np.flatnonzero(new)])
        n = batch["n"].to_numpy()
        total = np.cumsum(n)
        before = np.concatenate([[-self.n], (total - n)[begin[1:]]])
        run = total - before[part]

        held = batch["value"].is_valid().to_numpy(zero_copy_only=False)
        latest = np.maximum.accumulate(np.where(held, at, -1))
        values = pa.concat_arrays([batch["value"], self.last])

        def taken(places: np.ndarray) -> np.ndarray:
            return np.where(places >= begin[part], places, np.where(part == 0, size, -1))

        inclusive = taken(latest)
        shown = taken(np.concatenate([[-1], latest[:-1]])) if self.exclusive else inclusive
        last = values.take(pa.array(shown, mask=shown < 0))

        named = np.flatnonzero(batch["first"].is_valid().to_numpy(zero_copy_only=False))
        earliest = np.full(len(begin), size + 1)
        np.minimum.at(earliest, part[named], named)
        if self.first[0].is_valid:
            earliest[0] = -1
        place = np.where(earliest[part] <= at, earliest[part], size + 1)
        place = np.where(place == -1, size, place)
        first = pa.concat_arrays([batch["first"], self.first]).take(pa.array(place, mask=place > size))

        head = (part == 0) & self.in_head
        self.in_head = bool(head[-1])
        self.key = [batch[name][size - 1] for name in self.on]
        self.n = int(run[-1])
        self.last = values.take(pa.array(inclusive[-1:], mask=inclusive[-1:] < 0))
        self.first = first[size - 1 :]
        return run, last, first, head


@dataclass(frozen=True)
class Line:
    """A line of ``points``: their keys ``on`` (null is a key like any other), their order, and
    the columns ``at`` (for the mark), ``n``, ``value`` and ``first``. Made by ``line``."""

    spread: DataFrame
    on: list[str]
    order: list[Column]
    exclusive: bool

    def _sorted(self) -> DataFrame:
        return self.spread.sortWithinPartitions(*self.on, *self.order)

    def rows(self, wanted: str | None = None) -> DataFrame:
        """The points, or those where the boolean column ``wanted`` is true, with ``run``, the
        sum of ``n`` up to and including each, ``last``, the last ``value`` that is not null up to
        there (before it, if the line is exclusive), and ``first``, the first ``first``."""
        on, exclusive = self.on, self.exclusive
        kinds = {f.name: f.dataType for f in self.spread.schema}
        kept = [f for f in self.spread.schema if f.name not in ("n", "value", "first", wanted)]
        added = T.StructType(
            [
                T.StructField("run", T.LongType()),
                T.StructField("last", kinds["value"]),
                T.StructField("first", kinds["first"]),
                T.StructField("_head", T.BooleanType()),
                T.StructField("_mark", T.LongType()),
            ]
        )
        names = [f.name for f in kept]

        def walk(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = _Walk(on, exclusive)
            for batch in given:
                if not batch.num_rows:
                    continue
                run, last, first, head = state.rows(batch)
                mark = np.full(batch.num_rows, state.mark, np.int64)
                out = pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in names), pa.array(run), last, first, pa.array(head), pa.array(mark)],
                    names=[*names, *added.names],
                )
                yield out if wanted is None else out.filter(batch[wanted])

        walked = self._sorted().mapInArrow(walk, T.StructType([*kept, *added.fields]))
        # One row per partition, so the broadcast is bounded by their number.
        found = walked.withColumn("_part", F.spark_partition_id()).join(
            F.broadcast(self._carried()), "_part", "left"
        )
        shared = F.col("_mark").eqNullSafe(F.col("_mark_there"))
        run = F.col("run") + F.when(F.col("_head"), F.col("_n")).otherwise(F.lit(0))
        return found.select(
            *names,
            F.when(shared, run).otherwise(F.raise_error(F.lit(_UNSHARED)).cast("long")).alias("run"),
            F.coalesce("last", F.when(F.col("_head"), F.col("_last"))).alias("last"),
            F.coalesce(F.when(F.col("_head"), F.col("_first")), "first").alias("first"),
        )

    def _carried(self) -> DataFrame:
        """Per partition what its first key has gathered in the partitions before it."""
        on, exclusive = self.on, self.exclusive
        kinds = {f.name: f.dataType for f in self.spread.schema}
        schema = T.StructType(
            [
                *(T.StructField(f"_from_{i}", kinds[c]) for i, c in enumerate(on)),
                *(T.StructField(f"_to_{i}", kinds[c]) for i, c in enumerate(on)),
                T.StructField("n", T.LongType()),
                T.StructField("last", kinds["value"]),
                T.StructField("first", kinds["first"]),
                T.StructField("mark", T.LongType()),
            ]
        )

        def total(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, types = _Walk(on, exclusive), []
            for batch in given:
                if batch.num_rows:
                    state.rows(batch)
                    types = [batch[c].type for c in on]
            if state.key is not None:
                ends = zip([*state.first_key, *state.key], types * 2, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([k.as_py()], t) for k, t in ends),
                        pa.array([state.n]),
                        state.last,
                        state.first,
                        pa.array([state.mark], pa.int64()),
                    ],
                    names=schema.names,
                )

        sums = self._sorted().mapInArrow(total, schema).withColumn("_part", F.spark_partition_id())
        none = {c: F.lit(None).cast(sums.schema[c].dataType) for c in ("n", "last", "first")}
        tail = F.struct(
            *(F.col(f"_to_{i}").alias(f"_key_{i}") for i in range(len(on))),
            "n", "last", "first", F.lit(False).alias("asks"),
        )
        head = F.struct(
            *(F.col(f"_from_{i}").alias(f"_key_{i}") for i in range(len(on))),
            *(v.alias(c) for c, v in none.items()), F.lit(True).alias("asks"),
        )
        earlier = (
            Window.partitionBy(*(f"_key_{i}" for i in range(len(on))))
            .orderBy("_part")
            .rangeBetween(Window.unboundedPreceding, -1)
        )
        return (
            sums.select("_part", "mark", F.inline(F.array(tail, head)))
            .select(
                "_part",
                F.col("mark").alias("_mark_there"),
                "asks",
                F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"),
                F.last("last", ignorenulls=True).over(earlier).alias("_last"),
                F.first("first", ignorenulls=True).over(earlier).alias("_first"),
            )
            .where("asks")
            .drop("asks")
        )


def line(points: DataFrame, on: list[str], order: list[Column], exclusive: bool = False) -> Line:
    """The line of ``points``, range-partitioned into ``spark.sql.shuffle.partitions`` parts.

    ``points`` need the columns ``at``, ``n`` (long, not null), ``value`` and ``first``, of any type.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Line(points.repartitionByRange(parts, *on, *order), on, order, exclusive)
