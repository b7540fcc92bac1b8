"""How frequent hashes are, in a table of fixed size that counts all of the data.

A hash counts in the cell that its first bits name, so a cell holds at least what any
of its hashes has. That is good enough to put members of sets in an order from rare to
frequent: any order that is the same for all sets gives the same result, a better one
less work. Tasks count into a table each, slices of the tables are added up in tasks of
their own, and only the sum, whose size does not depend on the data, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 64
# What a cell that was hit once holds.
ONCE = 8


def cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def count(
    texts: DataFrame, hashes_of: Callable[[pa.Array], Iterator[np.ndarray]], bits: int
) -> np.ndarray:
    """Counts of ``2 ** bits`` cells over column ``text``, eight steps to each doubling, in
    a byte per cell. ``hashes_of`` gives the hashes of a batch of texts in portions."""
    size = (1 << bits) // SLICES
    names = ["slice", "counts"]

    def tally(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in given:
            for hashes in hashes_of(batch["text"]):
                # In place: a second table of all cells would be larger than the first.
                np.add.at(total, cell(hashes, bits), np.uint32(1))
        for number, part in enumerate(total.reshape(SLICES, size)):
            if part.any():
                arrays = [pa.array([number], pa.int32()), pa.array([part.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint64)
        number = 0
        for batch in tables:
            for number, counts in zip(batch["slice"].to_pylist(), batch["counts"], strict=True):
                total += np.frombuffer(counts.as_buffer(), np.uint32)
        steps = np.minimum(8 * np.log2(1.0 + total), 255).astype(np.uint8)
        arrays = [pa.array([number], pa.int32()), pa.array([steps.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "slice int, counts binary"
    table = np.zeros((SLICES, size), np.uint8)
    for part in texts.mapInArrow(tally, schema).groupBy("slice").applyInArrow(add, schema).collect():
        table[part["slice"]] = np.frombuffer(part["counts"], np.uint8)
    return table.reshape(-1)
