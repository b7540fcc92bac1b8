"""Documents with nearly the same word n-grams, exactly.

A document is the set of its n-word shingles; two link when 80 of 100 shingles in either
are in both. Candidates come from prefixes of the sets, rare shingles first (``setjoin``
and ``rarity``), so that a passage which many documents quote does not tie them
together. They are banded by size and cut into tiles, and tiles are compared by hashed bitmaps, whose differing bits bound the overlap from above, before sorted arrays are
intersected. A task holds two tiles; it skips pairs that it has connected already and
hands on a forest of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import cut
from tenure.llm.components import components
from tenure.llm.hashing import fingerprint, shingle_sets
from tenure.llm.rarity import cell, count
from tenure.llm.setjoin import (
    KEY_BITS,
    TILE,
    candidates,
    compare,
    meetings,
    prefix_length,
)

WORDS = 5
# Cells of the rarity table: 2 ** 22 of one byte, 4 MB.
CELL_BITS = 22


def _extra(n):
    """Shared members that a prefix of a set of ``n`` must hold."""
    return np.maximum(1, n // 10)


def _needed(n: Column) -> Column:
    """The same for the smallest match that a set of ``n`` may have."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * 0.8) / 10))


def describe(docs: DataFrame, words: int) -> DataFrame:
    """``id``, ``content`` (hash of the text), ``n`` and ``fp`` of the shingle set of each row."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            sizes = np.zeros(batch.num_rows, np.int64)
            prints = np.zeros(batch.num_rows, np.int64)
            for i, members in enumerate(shingle_sets(batch["text"], words)):
                sizes[i], prints[i] = len(members), fingerprint(members)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["content"], pa.array(sizes), pa.array(prints)],
                names=["id", "content", "n", "fp"],
            )

    return docs.mapInArrow(run, "id long, content long, n long, fp long")


def rare_first(members: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` first of a set in the order of their counts, ties by hash."""
    if k >= len(members):
        return members
    frequency = counts[cell(members, CELL_BITS)].astype(np.uint64)
    order = (frequency << np.uint64(56)) | (members >> np.uint64(8))
    return members[np.argpartition(order, k - 1)[:k]]


def prefixes(docs: DataFrame, words: int) -> DataFrame:
    """The postings (``key``, ``fp``, ``n``) of all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(
        count(docs.select("text"), lambda texts: shingle_sets(texts, words), CELL_BITS)
    )

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held):
            keys, prints, sizes = zip(*held, strict=True)
            lengths = [len(k) for k in keys]
            key = np.concatenate(keys) >> np.uint64(64 - KEY_BITS)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(key.astype(np.int64)),
                    pa.array(np.repeat(np.array(prints, np.int64), lengths)),
                    pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                ],
                names=["key", "fp", "n"],
            )

        counts = shared.value
        for batch in given:
            held, total = [], 0
            for members in shingle_sets(batch["text"], words):
                if not len(members):
                    continue
                n = len(members)
                first = rare_first(members, counts, int(prefix_length(n, _extra(n))))
                held.append((first, fingerprint(members), n))
                total += len(first)
                if total > 1 << 18:
                    yield packed(held)
                    held, total = [], 0
            if held:
                yield packed(held)

    return docs.select("text").mapInArrow(run, "key long, fp long, n int")


def _linked(given_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    _, first, second = (k.as_py() for k in given_key)
    prints = table["fp"].to_numpy()
    sets = [np.asarray(s.values) for s in table["members"].combine_chunks()]
    tile, cluster = table["tile"].to_numpy(), table["cluster"].to_numpy()
    root = np.arange(len(prints))

    def apart(i: int, js: np.ndarray) -> np.ndarray:
        js = js[(cluster[js] == cluster[i]) & (root[js] != root[i])]
        return js[js > i] if first == second else js

    a, b = [], []
    for i, j in compare(sets, np.flatnonzero(tile == first), np.flatnonzero(tile == second), apart):
        root[root == root[j]] = root[i]
        a.append(prints[i])
        b.append(prints[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    tile: int = TILE,
) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id``, the smallest id that is reachable over
    links, for every row.

    A text of fewer words is one shingle; one without words, or null, has none and links
    with nothing. Rows with equal sets are linked whatever their ids; rows with a null id
    take part and are never the smallest, so a component of such rows alone has a null.
    Repeated rows each give a row. Other columns play no part.
    """
    own = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("content"),
    )
    described = cut(describe(own.select("id", "content", "text"), words))
    members = candidates(prefixes(own, words), _needed)
    meet = meetings(members, tile)
    holders = (
        described.where(F.col("n") > 0)
        .groupBy("fp")
        .agg(F.min(F.struct("id", "content")).alias("holder"))
        .join(meet, "fp")
        .select("fp", "meets", "holder.id", "holder.content")
    )
    joined = own.alias("d").join(
        holders.alias("h"),
        F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.content") == F.col("h.content")),
    )

    @F.arrow_udf("array<long>")
    def shingle_set(text: pa.Array) -> pa.Array:
        found = [s.view(np.int64) for s in shingle_sets(text, words)]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(ends, pa.array(flat))

    met = joined.select("fp", "meets", shingle_set(F.col("d.text")).alias("members")).select(
        "fp", "members", F.inline("meets")
    )
    links = met.groupBy("pack", "first", "second").applyInArrow(_linked, "a long, b long")
    labels = cut(components(links).withColumnRenamed("id", "fp"))
    rooted = described.join(labels, "fp", "left").withColumn(
        "root", F.coalesce("component", "fp")
    )
    least = (
        rooted.where(F.col("n") > 0).groupBy("root").agg(F.min("id").alias("component_id"))
    )
    return rooted.join(least, "root", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
