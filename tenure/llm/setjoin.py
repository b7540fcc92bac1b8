"""Exact similarity of sets of hashes (Jaccard of 0.8 and more): candidates and tiles.

Two sets with a Jaccard of at least t share nearly all of their members, so whatever
fixed order the members have, among the first n - ceil(t n) + l of each set of n are at
least l common ones. These prefixes are the only members that travel. A set with fewer
than l prefix members that any other set has, too, has no partner and is done; the others
form clusters through the members they share and sizes that allow a match. Every
similar pair is inside one cluster. A cluster is ordered by size and cut into tiles; two
tiles meet in one task if sizes in them are close enough, and no pair leaves the task.

Sets are known by a fingerprint (``fp``), so equal sets count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import discard, stage
from tenure.llm.components import components

# Similarity as a fraction: 100 * |A and B| >= 80 * |A or B|.
PERCENT = 80
# Sets of a tile.
TILE = 256
# Sets of one size in a cluster are numbered in as many parts as this many bits tell apart.
HEAD_BITS = 8
# Widest bitmap of a set, in bits. Longer sets are told apart less well by it and are
# intersected all the same.
MOST_BITS = 1 << 16
# Prefix members are known by this many bits of their hash; a clash only adds candidates.
KEY_BITS = 48


def prefix_length(n: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Members of a set of ``n`` that hold ``extra`` of those it shares with any match."""
    return np.minimum(n, n - (PERCENT * n + 99) // 100 + extra)


def least_overlap(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Common members that sets of these sizes need to be similar."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def candidates(postings: DataFrame, needed: Callable[[Column], Column]) -> DataFrame:
    """``fp``, ``n`` and ``cluster`` of the sets that may have a partner.

    ``postings`` are the prefixes as (``key``, ``fp``, ``n``), repeated rows allowed.
    ``needed`` gives, from the size of a set, the number of prefix members it shares
    with any match.
    """
    schema = "key long, fp long, n int"
    shared, folder = stage(
        postings.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_in_two_sets, schema)
    )
    alive = (
        shared.groupBy("fp")
        .agg(F.count(F.lit(1)).alias("common"), F.first("n").alias("n"))
        .where(F.col("common") >= needed(F.col("n")))
        .select("fp", "n")
    )
    links = (
        shared.join(alive.select("fp"), "fp", "left_semi")
        .repartition("key")
        .sortWithinPartitions("key", "n", "fp")
        .mapInArrow(_neighbours, "a long, b long")
    )
    members = clusters(links, alive)
    discard(members.sparkSession, folder)
    return members


def clusters(links: DataFrame, sets: DataFrame) -> DataFrame:
    """``fp``, ``n`` and ``cluster`` of the linked sets, written; ``sets`` has the sizes."""
    found = components(links).select(F.col("id").alias("fp"), F.col("component").alias("cluster"))
    members, _ = stage(found.join(sets.select("fp", "n"), "fp"))
    return members


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch[name].to_numpy(zero_copy_only=False) for name in ("key", "fp", "n")]


def _in_two_sets(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by key and set, each once, those whose key is in two sets."""
    names = ["key", "fp", "n"]
    held: list[np.ndarray] | None = None
    paired = False  # whether the held row has a partner before it
    for batch in given:
        rows = _columns(batch)
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        same_key = rows[0][1:] == rows[0][:-1]
        fresh = np.concatenate([[True], ~same_key | (rows[1][1:] != rows[1][:-1])])
        rows = [r[fresh] for r in rows]
        same_key = rows[0][1:] == rows[0][:-1]
        before = np.concatenate([[paired], same_key])
        keep = before[:-1] | same_key
        yield pa.RecordBatch.from_arrays([pa.array(r[:-1][keep]) for r in rows], names=names)
        held, paired = [r[-1:] for r in rows], bool(before[-1])
    if held is not None and paired:
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in held], names=names)


def _neighbours(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by key, size and set, each set with the first one of its run: rows of
    one key whose sizes, each and the next, allow a match. Sizes in between allow it, too,
    so all possible partners are in one run."""
    held: list[np.ndarray] | None = None
    head = 0
    for batch in given:
        rows = _columns(batch)
        fresh = held is None
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        key, fp, n = rows
        near = (key[1:] == key[:-1]) & (100 * n[:-1].astype(np.int64) >= PERCENT * n[1:].astype(np.int64))
        starts = np.concatenate([[True], ~near])
        first = fp[np.flatnonzero(starts)]
        if not fresh:
            first[0] = head
        heads = first[np.cumsum(starts) - 1]
        apart = heads != fp
        pairs = np.unique(np.stack([fp[apart], heads[apart]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in pairs], names=["a", "b"])
        held, head = [r[-1:] for r in rows], int(heads[-1])


def meetings(members: DataFrame, tile: int = TILE) -> DataFrame:
    """``fp``, ``n`` and ``meets``: the groups (``pack``, ``first``, ``second``) in which a set is
    compared, with its ``cluster`` and ``tile``.

    A group is a pair of tiles of a cluster. Clusters of a single tile are packed together,
    about four tiles to a group.
    """
    packs = members.count() // (4 * tile) + 1
    # Numbers in the order of size and set: counted within the sets of one size whose
    # fingerprints begin alike, behind those before, so that no cluster is sorted whole.
    band = ["cluster", "n", "head"]
    banded = members.withColumn("head", F.shiftright("fp", 64 - HEAD_BITS).cast("int"))
    line = Window.partitionBy("cluster").orderBy("n", "head")
    whole = Window.partitionBy("cluster")
    bands = (
        banded.groupBy(*band)
        .agg(F.count(F.lit(1)).alias("own"))
        .select(
            *band,
            (F.sum("own").over(line) - F.col("own")).alias("before"),
            F.sum("own").over(whole).alias("n_cluster"),
        )
    )
    place = F.row_number().over(Window.partitionBy(*band).orderBy("fp")) - 1 + F.col("before")
    small = F.col("n_cluster") <= tile
    placed = (
        banded.join(bands, band)
        .withColumns(
            {
                "tile": F.floor(place / tile).cast("int"),
                "pack": F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(
                    F.col("cluster")
                ),
            }
        )
        .select("fp", "n", "cluster", "tile", "pack")
    )
    tiles = placed.groupBy("cluster", F.col("tile").alias("other")).agg(
        F.min("n").alias("low"), F.max("n").alias("high")
    )
    close = (100 * F.col("high") >= PERCENT * F.col("n")) & (
        PERCENT * F.col("low") <= 100 * F.col("n")
    )
    meet = F.struct(
        "pack",
        F.least("tile", "other").alias("first"),
        F.greatest("tile", "other").alias("second"),
        "cluster",
        "tile",
    )
    return (
        placed.join(tiles, "cluster")
        .where(close)
        .groupBy("fp", "n")
        .agg(F.collect_list(meet).alias("meets"))
    )


def compare(
    sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, open_pairs: Callable
) -> Iterator[tuple[int, int]]:
    """Similar pairs (i, j) of ``sets``, i in ``rows`` and j in ``columns``.

    The parity of the members in each of a number of hashed bits is a bitmap; the bits in
    which two differ are at most the members that only one has, which bounds the overlap
    from above. Pairs that pass are intersected as sorted arrays. ``open_pairs`` (i, js)
    tells which js still matter; it is asked again after every result.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    longest = int(sizes.max(initial=1))
    bits = min(max(64, 1 << (longest - 1).bit_length()), MOST_BITS)
    bitmap = np.zeros((len(sets), bits // 64), np.uint64)
    for i, members in enumerate(sets):
        odd = np.bincount((members.view(np.uint64) >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1
        bitmap[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    for i in rows:
        js = columns[columns != i]
        a, b = np.minimum(sizes[i], sizes[js]), np.maximum(sizes[i], sizes[js])
        js = js[100 * a >= PERCENT * b]
        js = open_pairs(i, js)
        if not len(js):
            continue
        differ = np.bitwise_count(bitmap[js] ^ bitmap[i]).sum(axis=1, dtype=np.int64)
        total = sizes[i] + sizes[js]
        for j in js[total - differ >= 2 * least_overlap(sizes[i], sizes[js])]:
            if not len(open_pairs(i, np.array([j]))):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= PERCENT * (sizes[i] + sizes[j] - common):
                yield int(i), int(j)
