"""Whitened leading components of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed. A pass over them multiplies the centred
rows X by a block Q of a few columns and gives X'(XQ) / n: tasks add up d x b matrices, a
second, bounded step adds the tasks. A polynomial of V, by the Chebyshev recurrence, one
pass a degree, damps the part of the spectrum below the block and lifts what is above it;
QR makes the block orthonormal again, and Rayleigh-Ritz gives eigenpairs with their
residuals. That goes on until the residuals of all wanted pairs certify them and no
longer fall.

Entries are whole numbers, ``floor(1024 c) + 100000``, so counts and sums are exact and a
centred entry, (n x - S) / n, is rounded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import stage

# Components, and columns of the block for each of them.
COMPONENTS, BLOCK_FACTOR = 8, 4
# Degrees of a filter; fewer where the wanted part grows by LIFT before.
DEGREES, LIFT = 40, 1e8
# A residual, relative to the largest eigenvalue, that certifies a pair, and one that
# further passes cannot make smaller.
CERTIFIED, EXACT = 1e-10, 2e-14
# Rounds after which a spectrum that does not let itself be certified is an error.
ROUNDS = 50
# The matrices that the driver adds; those of more tasks are added in as many groups first.
SLOTS = 64
SCALE, SHIFT = 1024, 100_000
# Entries are cut off at this size, far from where whole numbers stop being exact.
LARGEST = 1 << 52


def is_complete(vector: Column) -> Column:
    """Not null, and no null or non-finite entry."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``x``, the whole-number entries, of the complete vectors."""

    def whole(c: Column) -> Column:
        size = F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
        return F.floor(size).cast("long") + SHIFT

    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return own.where(is_complete(F.col("v"))).select("id", F.transform("v", whole).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part``, which maps a matrix of rows to numbers of a shape
    that does not depend on them. Tasks are added in the order of their numbers."""

    def add(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, shape = None, ()
        for batch in given:
            if batch.num_rows:
                own = part(_matrix(batch["x"]))
                total, shape = own if total is None else total + own, own.shape
        if total is not None:
            task = TaskContext.get().partitionId()
            arrays = [
                pa.array([task % SLOTS], pa.int32()),
                pa.array([task], pa.int32()),
                pa.array([list(shape)], pa.list_(pa.int32())),
                pa.array([total.tobytes()], pa.binary()),
                pa.array([total.dtype.str]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["slot", "task", "shape", "sum", "kind"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        kind = table["kind"][0].as_py()
        total = sum(np.frombuffer(s.as_buffer(), kind) for s in table["sum"])
        one = table.slice(0, 1).drop_columns(["sum"])
        return one.append_column("sum", pa.array([total.tobytes()], pa.binary())).select(table.column_names)

    schema = "slot int, task int, shape array<int>, sum binary, kind string"
    sums = rows.select("x").mapInArrow(add, schema)
    if rows.rdd.getNumPartitions() > SLOTS:
        sums = sums.groupBy("slot").applyInArrow(merge, schema)
    parts = [
        np.frombuffer(r["sum"], r["kind"]).reshape(r["shape"])
        for r in sorted(sums.collect(), key=lambda r: (r["slot"], r["task"]))
    ]
    return sum(parts[1:], parts[0])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S as whole numbers, of Python's kind where 64 bits might not do."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if n * largest < 1 << 61 and all(abs(s) < 1 << 61 for s in sums):
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _doubles(z: np.ndarray, n: int) -> np.ndarray:
    return (z / n).astype(np.float64)


@dataclass(frozen=True)
class Model:
    """What a fit found: ``vectors`` has the eigenvectors as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float


def fit(rows: DataFrame, k: int = COMPONENTS, seed: int = 0) -> Model | None:
    """The first ``k`` eigenpairs of the covariance (divisor n) of column ``x``, fewer if
    there are fewer of a positive value; None without rows or entries.

    All rows must be of one length. The driver holds a block of ``BLOCK_FACTOR`` times k
    columns and at most ``SLOTS`` matrices of that size.
    """
    first = rows.select(F.size("x").alias("d")).first()
    if first is None or not first["d"]:
        return None
    d, low_bits = first["d"], 20
    mask = (1 << low_bits) - 1
    counted = _added(
        rows, lambda x: np.stack([np.full(x.shape[1], len(x)), (x >> low_bits).sum(0), (x & mask).sum(0)])
    )
    n = int(counted[0, 0])
    sums = [(int(high) << low_bits) + int(low) for high, low in zip(counted[1], counted[2], strict=True)]
    trace = float(_added(rows, lambda x: np.array([(_doubles(_centred(x, n, sums), n) ** 2).sum()]))[0]) / n
    none = np.zeros((d, 0))
    if trace == 0:
        return Model(n, sums, trace, np.zeros(0), none, 0.0)

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            own = _doubles(_centred(x, n, sums), n)
            return own.T @ (own @ q)

        return _added(rows, part) / n

    width = min(d, BLOCK_FACTOR * k)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))
    before = np.inf
    for _ in range(ROUNDS):
        product = times(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        positive = values > 1e-13 * d * values[0]
        wanted = min(k, int(positive.sum()))
        residual = np.linalg.norm(product - q * values, axis=0)[:wanted].max() / values[0]
        settled = residual <= EXACT or (residual <= CERTIFIED and residual > before / 2)
        if width == d or settled:
            break
        before = residual
        y = _filtered(times, q, product, values, wanted, min(LIFT, 10 * residual / EXACT))
        q, _ = np.linalg.qr(y)
    else:
        raise RuntimeError(f"no certified components: residual {residual}")
    return Model(n, sums, trace, values[:wanted], q[:, :wanted], float(residual))


def _filtered(times, q: np.ndarray, product: np.ndarray, values: np.ndarray, k: int, lift: float) -> np.ndarray:
    """The scaled Chebyshev recurrence over [0, least Ritz value], its first product given,
    until pair ``k`` has gained a factor of ``lift`` on that interval."""
    edge = values[-1]
    if edge <= 1e-12 * values[0]:
        return product
    half = edge / 2
    outside = (values[k - 1] - half) / half
    growth = outside + np.sqrt(max(outside * outside - 1, 0))
    degrees = int(np.clip(np.ceil(np.log(lift) / np.log(max(growth, 1 + 1e-9))), 2, DEGREES))
    sigma = first = half / (values[0] - half)
    previous, current = q, (product - half * q) * (sigma / half)
    for _ in range(degrees - 1):
        following = 1 / (2 / first - sigma)
        previous, current = current, (
            (times(current) - half * current) * (2 * following / half) - (sigma * following) * previous
        )
        sigma = following
    return current


def _identity_error(rows: DataFrame, model: Model) -> float:
    """How far the covariance of the whitened rows is from the identity."""
    turn, n, sums = model.vectors / np.sqrt(model.values), model.n, model.sums

    def white(x: np.ndarray) -> np.ndarray:
        return _doubles(_centred(x, n, sums), n) @ turn

    mean = _added(rows, lambda x: white(x).sum(0)) / n

    def products(x: np.ndarray) -> np.ndarray:
        own = white(x) - mean
        return own.T @ own

    return float(np.abs(_added(rows, products) / n - np.eye(len(model.values))).max())


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS
) -> DataFrame:
    """Per complete vector and component, numbered from 1 by falling eigenvalue: ``id_col``,
    ``component``, ``n`` (vectors of the fit), ``deviation`` (sum of (n x - S) ** 2, exact),
    ``whitened``, ``explained`` (share of the trace) and ``identity_error``.

    Vectors that are null or hold null or non-finite entries give no rows and are not in
    the fit; nor are those of another length than most (of two lengths equally frequent,
    the greater). Zero vectors, repeated rows, repeated ids and null ids count as they are.
    Entries of more than 2 ** 42 are taken as that. A component without variance cannot be
    whitened and has no rows, so an empty table, a single vector or equal ones give none. A
    deviation beyond 64 bits is null. Other columns play no part. Passes run when this is
    called; the result is a last one.
    """
    complete = scaled(vectors, id_col, vector_col)
    sizes = complete.groupBy(F.size("x").alias("d")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    kind = complete.schema["id"].dataType.simpleString()
    rows, _ = stage(complete.where(F.size("x") == (first["d"] if first else 0)))
    model = fit(rows, k)
    schema = (
        f"id {kind}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error = _identity_error(rows, model)
    turn, n, sums = model.vectors / np.sqrt(model.values), model.n, model.sums
    explained = model.values / model.trace
    wide = len(explained)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in given:
            if not batch.num_rows:
                continue
            z = _centred(_matrix(batch["x"]), n, sums)
            own = _doubles(z, n)
            far = ((own * n) ** 2).sum(axis=1) >= 9e18
            if far.any() or z.dtype == object:
                exact = [sum(int(v) ** 2 for v in row) for row in z]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            else:
                deviation = pa.array((z * z).sum(axis=1))
            each = np.repeat(np.arange(len(z)), wide)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), len(z))),
                    pa.array(np.full(len(each), n)),
                    deviation.take(pa.array(each)),
                    pa.array((own @ turn).reshape(-1)),
                    pa.array(np.tile(explained, len(z))),
                    pa.array(np.full(len(each), error)),
                ],
                names=names,
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
