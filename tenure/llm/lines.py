"""Repeated lines, exactly: every line with a similar one before it goes.

A line is the set of its words; two are similar if 80 of 100 words in either are in
both. Words are ordered by rarity, counted over all lines in a table of fixed size (words
that share a counter count together, which changes the order and never the result).
Prefixes of the lines in that order are brought together by word. In the list of a word
the sizes, the positions in the prefixes and 128 bits of parities of the words leave few
pairs; they tie lines to groups, and within a group the lines are compared as sets
(``setjoin``). A line that has a match before it needs no other, so a task stops there.

Lines are ordered by document id (null last), then the hash of the text, then their
number in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import discard, stage
from tenure.llm.hashing import BLOCK, NEWLINE, bytes_of, fingerprints, words
from tenure.llm.pivots import forest
from tenure.llm.rarity import ONCE, cell, count
from tenure.llm.setjoin import (
    MOST_BITS,
    PERCENT,
    TILE,
    clusters,
    least_overlap,
    meetings,
    prefix_length,
)

# Cells of the rarity table: 2 ** 23 of one byte, 8 MB.
CELL_BITS = 23
# Bits of a posting for the place of a word in its line's order; later places count as the
# last of these, which only admits more candidates. The others are the word's.
PLACE_BITS = 20
# Lists of a word up to this length are compared pair by pair, all at once.
SHORT = 1024


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In blocks of whole strings: word hashes, and the row and line in it of each word."""
    data, at = bytes_of(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + 2 * BLOCK, "right")) - 1)
        own, starts = data[at[i] : at[j]], at[i : j + 1] - at[i]
        hashes, first = words(own, starts[:-1])
        breaks = np.flatnonzero(own == NEWLINE)
        row = np.searchsorted(starts, first, "right") - 1
        line = np.searchsorted(breaks, first) - np.searchsorted(breaks, starts[row])
        yield hashes, row + i, line
        i = j


def _words_of(column: pa.Array) -> Iterator[np.ndarray]:
    return (hashes for hashes, *_ in _blocks(column))


def _in_order(hashes: np.ndarray, frequency: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Words by line number, frequency and hash."""
    if number[-1] < 1 << 16:
        # One sort of numbers that hold all three, if what is cut off ties no two words.
        key = (number.astype(np.uint64) << np.uint64(48)) | (frequency.astype(np.uint64) << np.uint64(40))
        key |= hashes >> np.uint64(24)
        order = np.argsort(key)
        tied = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        if (hashes[order[tied]] == hashes[order[tied + 1]]).all():
            return order
    return np.lexsort((hashes, frequency, number))


@dataclass(frozen=True)
class Block:
    """Lines with words: their row, number, fingerprint, and where their words begin in
    ``members``; each line's words are distinct, from rare to frequent."""

    row: np.ndarray
    line: np.ndarray
    fp: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    members: np.ndarray


def _sets(column: pa.Array, counts: np.ndarray) -> Iterator[Block]:
    for hashes, row, line in _blocks(column):
        if not len(hashes):
            continue
        new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(line) != 0)])
        number = np.cumsum(new) - 1
        order = _in_order(hashes, counts[cell(hashes, CELL_BITS)], number)
        hashes, number = hashes[order], number[order]
        fresh = np.concatenate([[True], (np.diff(number) != 0) | (hashes[1:] != hashes[:-1])])
        members, number = hashes[fresh], number[fresh]
        begin = np.flatnonzero(np.concatenate([[True], np.diff(number) != 0]))
        size = np.diff(np.append(begin, len(members)))
        at = np.flatnonzero(new)
        yield Block(row[at], line[at], fingerprints(members, begin, size), begin, size, members)


def describe(docs: DataFrame, shared_counts) -> DataFrame:
    """Every line with words: ``id``, ``content``, ``line``, ``n_lines`` of its text, ``fp`` and ``n``; the
    parities of all its words in 128 bits, ``low`` and ``high``; and ``prefix``, the words of its
    prefix that any other line may have, each with its place in the order. A batch gives the
    prefix of a repeated line once, and words that were counted once have no other line."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared_counts.value
        for batch in given:
            seen = np.zeros(0, np.int64)
            for block in _sets(batch["text"], counts):
                fp, first = np.unique(block.fp, return_index=True)
                first = first[~np.isin(fp, seen)]
                seen = np.union1d(seen, fp)
                length = np.zeros(len(block.fp), np.int64)
                length[first] = prefix_length(block.size[first], 1)
                ends = np.cumsum(length)
                place = np.arange(length.sum()) - np.repeat(ends - length, length)
                key = block.members[np.repeat(block.begin, length) + place]
                known = counts[cell(key, CELL_BITS)] > ONCE
                kept = np.concatenate([[0], np.cumsum(known)])
                offsets = kept[np.concatenate([[0], ends])].astype(np.int32)
                place = np.minimum(place[known], (1 << PLACE_BITS) - 1)
                packed = (key[known] >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)).view(np.int64) | place
                low, high = _parities(block)
                taken = pa.array(block.row)
                # A block holds whole texts.
                n_lines = np.bincount(block.row - block.row[0])[block.row - block.row[0]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].take(taken),
                        batch["content"].take(taken),
                        pa.array(block.line.astype(np.int32)),
                        pa.array(n_lines),
                        pa.array(block.fp),
                        pa.array(block.size.astype(np.int32)),
                        pa.array(low),
                        pa.array(high),
                        pa.ListArray.from_arrays(offsets, pa.array(packed)),
                    ],
                    names=["id", "content", "line", "n_lines", "fp", "n", "low", "high", "prefix"],
                )

    ddl = (
        "id long, content long, line int, n_lines long, fp long, n int, low long, high long, "
        "prefix array<long>"
    )
    return docs.mapInArrow(run, ddl)


def postings(lines: DataFrame) -> DataFrame:
    """The prefixes of all lines in lists by word: ``word`` with its place, ``fp``, ``n``, ``low``,
    ``high``, ordered by word: Spark sorts by the digits of a single number, without comparing."""
    return (
        lines.select("fp", "n", "low", "high", F.explode("prefix").alias("word"))
        .repartition(F.shiftright("word", PLACE_BITS))
        .sortWithinPartitions("word")
    )


def _parities(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """In each of 128 bits whether an odd number of a line's words falls on it."""
    at = block.members >> np.uint64(9)
    bit = np.uint64(1) << (at & np.uint64(63))
    upper = (at & np.uint64(64)) != 0
    return tuple(
        np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), block.begin).view(np.int64)
        for half in (~upper, upper)
    )


def _alike(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings ordered by word, a forest of the pairs in each list that sizes, places and
    parities allow to be similar."""
    names = ["word", "fp", "n", "low", "high"]
    held: list[np.ndarray] | None = None
    for batch in given:
        rows = [batch[name].to_numpy(zero_copy_only=False) for name in names]
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        # The last list may go on in the next batch.
        begin = int(np.searchsorted(rows[0], rows[0][-1] >> PLACE_BITS << PLACE_BITS))
        held = [r[begin:] for r in rows]
        if begin:
            yield _forest(_by_size([r[:begin] for r in rows]))
    if held is not None:
        yield _forest(_by_size(held))


def _by_size(postings: list[np.ndarray]) -> list[np.ndarray]:
    """Key, line, size, place and parities of postings, in the order of key and size."""
    word, fp, n, low, high = postings
    key = word >> PLACE_BITS
    number = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    # Sizes have 31 bits.
    order = np.argsort((number << 32) | n)
    place = word & ((1 << PLACE_BITS) - 1)
    return [r[order] for r in (key, fp, n.astype(np.int64), place, low, high)]


def _may_match(rows: list[np.ndarray], i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """Whether sizes, places and parities allow rows ``i`` and ``j`` of one list to be similar."""
    _, fp, n, place, low, high = rows
    least = least_overlap(n[j], n[i])
    rest = np.minimum(n[j] - place[j], n[i] - place[i])
    # Unsigned: of a negative number the bits of its absolute value would be counted.
    odd = ((half[j] ^ half[i]).view(np.uint64) for half in (low, high))
    differ = sum(np.bitwise_count(x).astype(np.int64) for x in odd)
    sizes = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
    return sizes & (fp[i] != fp[j]) & (rest >= least) & (n[j] + n[i] - differ >= 2 * least)


def _forest(rows: list[np.ndarray]) -> pa.RecordBatch:
    key, fp = rows[:2]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    lengths = np.diff(cuts)
    a, b = [], []
    # All pairs of the short lists at once, by their distance in the list. Lists are in the
    # order of sizes, so a line that is too long for one before it is so for all further on.
    i = np.flatnonzero(np.repeat(lengths <= SHORT, lengths))
    step = 0
    while len(i):
        step += 1
        i = i[i >= step]
        j = i - step
        near = (key[i] == key[j]) & (100 * rows[2][j] >= PERCENT * rows[2][i])
        i, j = i[near], j[near]
        found = _may_match(rows, i, j)
        a.append(i[found])
        b.append(j[found])
    ends = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b)]
    root = forest(len(fp), *ends)
    moved = np.flatnonzero(root != np.arange(len(fp)))
    a, b = [fp[moved]], [fp[root[moved]]]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end - begin > SHORT and (fp[begin:end] != fp[begin]).any():
            for one, other in _long_list(rows, begin, end):
                a.append(one)
                b.append(other)
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(p) for p in pairs], names=["a", "b"])


def _long_list(rows: list[np.ndarray], begin: int, end: int):
    """Links of one list; lines that are tied already are not looked at again."""
    _, fp, n, *_ = rows
    root = np.arange(begin, end)
    for i in range(begin + 1, end):
        start = begin + int(np.searchsorted(n[begin:i], -(-PERCENT * n[i] // 100)))
        js = np.arange(start, i)
        js = js[root[js - begin] != root[i - begin]]
        js = js[_may_match(rows, i, js)]
        if len(js):
            tied = np.unique(root[js - begin])
            yield fp[tied], np.full(len(tied), fp[i])
            root[np.isin(root, tied)] = root[i - begin]


def _matched(given_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Which lines of two tiles have a similar one before them. Repeated rows of a document
    bring a line more than once; it counts once, and never as its own match."""
    _, first, second = (k.as_py() for k in given_key)
    once = np.unique(table["fp"].to_numpy(), return_index=True)[1]
    table = table.take(pa.array(once))
    ids = table["id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    missing = table["id"].is_null().to_numpy()
    cluster = table["cluster"].to_numpy()
    # Similar lines are in one cluster: each stands behind those that are before it.
    order = np.lexsort((table["line"].to_numpy(), table["content"].to_numpy(), ids, missing, cluster))
    table = table.take(pa.array(order))
    cluster, tile, prints = cluster[order], table["tile"].to_numpy(), table["fp"].to_numpy()
    members = table["members"].combine_chunks()
    at = members.offsets.to_numpy().astype(np.int64)
    flat = members.values.to_numpy().view(np.uint64)
    cuts = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1], [True]]))
    found = []
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end - begin > 1:
            own = at[begin : end + 1]
            tiles = None if first == second else tile[begin:end]
            later = _with_earlier(flat[own[0] : own[-1]], own - own[0], tiles)
            found += prints[begin:end][later].tolist()
    return pa.table({"fp": pa.array(found, pa.int64())})


def _with_earlier(flat: np.ndarray, at: np.ndarray, tile: np.ndarray | None) -> list[int]:
    """Which sets, that lie end to end in ``flat``, have a similar one before them, of another
    ``tile`` if those are given. A bitmap of the parities of the words bounds what two sets
    have in common; those that may be similar are compared, the likeliest first."""
    size = np.diff(at)
    width = min(max(256, 1 << int(size.max() - 1).bit_length()), MOST_BITS) // 64
    bit = flat >> np.uint64(7)
    slot = ((bit >> np.uint64(6)) % np.uint64(width)).astype(np.int64)
    slot += np.repeat(np.arange(len(size)) * width, size)
    bitmap = np.zeros(len(size) * width, np.uint64)
    np.bitwise_xor.at(bitmap, slot, np.uint64(1) << (bit & np.uint64(63)))
    bitmap = bitmap.reshape(-1, width)
    whole: dict[int, set[int]] = {}

    def members(i: int) -> set[int]:
        if i not in whole:
            whole[i] = set(flat[at[i] : at[i + 1]].tolist())
        return whole[i]

    found = []
    for i in range(1, len(size)):
        n = int(size[i])
        differ = np.bitwise_count(bitmap[:i] ^ bitmap[i]).sum(axis=1, dtype=np.int64)
        least = least_overlap(size[:i], n)
        # The least overlap is more than the smaller set has where sizes are too far apart.
        may = (size[:i] + n - differ >= 2 * least) & (np.minimum(size[:i], n) >= least)
        if tile is not None:
            may &= tile[:i] != tile[i]
        js = np.flatnonzero(may)
        for j in js[np.argsort(differ[js])].tolist():
            common = len(members(i) & members(j))
            if 100 * common >= PERCENT * (n + int(size[j]) - common):
                found.append(i)
                break
    return found


def kept_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE
) -> DataFrame:
    """``id``, ``content`` (hash of the text), ``n_lines`` with words and ``kept``, the numbers of
    those that stay, for every distinct (id, text) that has any.

    Rows that agree in id and text are one document, however often they occur, and keep the
    same lines; so are such rows without an id, which come after all others. Of equal ids
    the text with the smaller hash comes first. Of equal or similar lines the first in that
    order stays. Null and empty texts and lines without words are not listed; a text may
    have any length. An empty table gives none. Other columns play no part.
    """
    own = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("content"),
    )
    counts = own.sparkSession.sparkContext.broadcast(count(own.select("text"), _words_of, CELL_BITS))
    lines, folder = stage(describe(own.select("id", "content", "text"), counts))
    links = postings(lines).mapInArrow(_alike, "a long, b long")
    members = clusters(links, lines.groupBy("fp").agg(F.first("n").alias("n")))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "content", "line")
    # No print is null; said here, as a join says it, so that both joins read one shuffle.
    first = lines.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min(place).alias("at"))
    wanted = (
        meetings(members, tile)
        .join(first, "fp")
        .groupBy(F.col("at.id").alias("id"), F.col("at.content").alias("content"))
        .agg(F.collect_list(F.struct("fp", F.col("at.line").alias("line"), "meets")).alias("wanted"))
    )
    texts = own.alias("d").join(
        wanted.alias("w"),
        F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.content") == F.col("w.content")),
    )

    @F.arrow_udf("array<array<long>>")
    def sets_of(text: pa.Array, numbers: pa.Array) -> pa.Array:
        known = counts.value
        asked = [{line: at for at, line in enumerate(n)} for n in numbers.to_pylist()]
        out: list[list] = [[None] * len(a) for a in asked]
        for block in _sets(text, known):
            lines_of = zip(block.row.tolist(), block.line.tolist(), block.begin, block.size, strict=True)
            for row, line, begin, size in lines_of:
                if line in asked[row]:
                    own = block.members[begin : begin + size]
                    out[row][asked[row][line]] = own.view(np.int64)
        return pa.array(out, pa.list_(pa.list_(pa.int64())))

    met = (
        texts.select("w.id", "w.content", "wanted", sets_of(F.col("d.text"), F.col("wanted.line")).alias("sets"))
        .select("id", "content", F.inline(F.arrays_zip("wanted", "sets")))
        .select("id", "content", "wanted.line", "wanted.fp", F.col("sets").alias("members"), F.inline("wanted.meets"))
    )
    matched = met.groupBy("pack", "first", "second").applyInArrow(_matched, "fp long").distinct()
    stays = first.join(matched, "fp", "left_anti").select("at.*")
    result, _ = stage(
        lines.groupBy("id", "content")
        .agg(F.max("n_lines").alias("n_lines"))
        .join(
            stays.groupBy(F.col("id").alias("i"), F.col("content").alias("c")).agg(
                F.sort_array(F.collect_list("line")).alias("kept")
            ),
            F.col("id").eqNullSafe(F.col("i")) & (F.col("content") == F.col("c")),
            "left",
        )
        .select(
            "id",
            "content",
            "n_lines",
            F.coalesce("kept", F.array().cast("array<int>")).alias("kept"),
        )
    )
    discard(result.sparkSession, folder)
    return result


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE
) -> DataFrame:
    """``docs`` with only the lines in ``text_col`` that no earlier line is similar to.

    Lines without words stay where they are. A document that had words and has none left
    is dropped; one that never had any, or a null text, stays as it is. All columns are
    carried; names that begin with ``__`` are the operator's own.
    """
    decided = kept_lines(docs, id_col, text_col, tile).select(
        F.col("id").alias("__id"), F.col("content").alias("__content"), F.col("kept").alias("__kept")
    )
    numbered = F.filter(
        F.split(F.col(text_col), "\n", -1),
        lambda text, at: F.array_contains("__kept", at) | ~text.rlike(r"[^\x20\x09-\x0D]"),
    )
    joined = docs.join(
        decided,
        F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
        & (F.xxhash64(text_col) == F.col("__content")),
        "left",
    )
    left = F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(F.array_join(numbered, "\n"))
    return (
        joined.where(F.col("__kept").isNull() | (F.size("__kept") > 0))
        .withColumn(text_col, left)
        .select(*docs.columns)
    )
