"""Repeated passages, exactly: words that an earlier document has in the same window.

Windows get longer level by level, each twice as long as the last, and only those that
are repeated at one length are looked at at the next:

- Half windows. A window's name is made of the names of its two halves. Of all half
  windows in a window the one with the smallest name (the first of those) speaks for
  it, so equal windows have equal speakers in the same place and one in thirteen is
  enough. Speakers that no document before has, too, have no repeated window around
  them and are done.
- Contexts: all that the windows of a speaker cover, less than two windows long. Where a
  document before has the same context, all windows in it are repeated. Of each context
  only its first occurrence is left, and only if its speaker occurs in others.
- Windows: what is left is compared window by window.

What lies in a repeated window of that length is found by then; longer repeats are made
of such windows, so no candidate survives.

Names have 64 bits and are compared together with the speaker's, so two different
windows would have to agree in 128.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import batches, discard, stage
from tenure.llm.hashing import AS_IS, BLOCK, PLACE, SPACE, bytes_of, mixed, words

# Words of a window.
WINDOW = 50
# Stands for a missing id, which comes after all others.
LAST = (1 << 63) - 1


def names(hashes: np.ndarray, length: int) -> np.ndarray:
    """A name for each run of ``length`` hashes, made of the names of its two halves (which
    overlap by one if the length is odd)."""
    if length == 1:
        return hashes
    half = (length + 1) // 2
    own = names(hashes, half)
    n = max(len(hashes) - length + 1, 0)
    shift = length - half
    return mixed(own[:n] * PLACE[0] + own[shift : shift + n] * PLACE[1] + np.uint64(length))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the smallest, the first of equal ones."""
    best = np.arange(len(values))
    held = 1
    while held < width and len(best):
        step = min(held, width - held)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        held += step
    return best


@dataclass(frozen=True)
class Block:
    """Whole texts: row of each and where its words begin and end in ``hashes``."""

    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray


def _blocks(column: pa.Array) -> Iterator[Block]:
    data, at = bytes_of(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + 2 * BLOCK, "right")) - 1)
        own, starts = data[at[i] : at[j]], at[i : j + 1] - at[i]
        hashes, first = words(own, starts[:-1], AS_IS)
        bounds = np.searchsorted(first, starts)
        yield Block(np.arange(i, j), bounds[:-1], bounds[1:], hashes)
        i = j


def _speakers(window: int):
    """Of texts the speakers: place ``at``, first and last window ``low`` and ``high``, names."""
    half = (window + 1) // 2

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for block in _blocks(batch["text"]):
                if not (block.end - block.begin >= window).any():
                    continue
                halves, whole = names(block.hashes, half), names(block.hashes, window)
                row = np.repeat(np.arange(len(block.row)), block.end - block.begin)[: len(whole)]
                start = np.flatnonzero(np.arange(len(whole)) + window <= block.end[row])
                speaker = smallest(halves, window - half + 1)[start]
                new = np.flatnonzero(np.concatenate([[True], speaker[1:] != speaker[:-1]]))
                at, low, high = speaker[new], start[new], start[np.append(new[1:], len(start)) - 1]
                row = row[low]
                left = np.maximum(block.begin[row], at - (window - half))
                right = np.minimum(at, block.end[row] - window)
                context = mixed(
                    whole[left] * PLACE[2]
                    + whole[right] * PLACE[3]
                    + (at - left).astype(np.uint64) * PLACE[4]
                    + (at - right).astype(np.uint64) * PLACE[5]
                )
                taken = pa.array(block.row[row])
                own = block.begin[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].take(taken),
                        batch["content"].take(taken),
                        pa.array((low - own).astype(np.int32)),
                        pa.array((high - own).astype(np.int32)),
                        pa.array(halves[at].view(np.int64)),
                        pa.array(context.view(np.int64)),
                    ],
                    names=["id", "content", "low", "high", "speaker", "context"],
                )

    return run, "id long, content long, low int, high int, speaker long, context long"


def _windows(window: int):
    """The windows of texts that lie in the ``asked`` ranges, with their names."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            asked = batch["asked"]
            counts = np.diff(asked.offsets.to_numpy())
            fields = asked.flatten()
            low, high, speaker = (fields.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            first = np.concatenate([[0], np.cumsum(counts)])
            for block in _blocks(batch["text"]):
                mine = slice(first[block.row[0]], first[block.row[-1] + 1])
                row = np.repeat(np.arange(len(block.row)), counts[block.row])
                own_low, size = low[mine].astype(np.int64), (high[mine] - low[mine] + 1).astype(np.int64)
                which = np.repeat(np.arange(len(size)), size)
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + own_low[which]
                name = names(block.hashes, window)[at + block.begin[row[which]]]
                taken = pa.array(block.row[row[which]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].take(taken),
                        batch["content"].take(taken),
                        pa.array(at.astype(np.int32)),
                        pa.array(speaker[mine][which]),
                        pa.array(name.view(np.int64)),
                    ],
                    names=["id", "content", "low", "speaker", "name"],
                )

    return run, "id long, content long, low int, speaker long, name long"


def _same_document(left: str, right: str):
    return F.expr(f"{left}.id <=> {right}.id and {left}.content = {right}.content")


def _first(rows: DataFrame, by: list[str]) -> tuple[DataFrame, str]:
    """The smallest document of each group, where there are others; written, so that joins
    with it can be split by Spark where a group is large."""
    order = F.coalesce("id", F.lit(LAST))
    return stage(
        rows.groupBy(*by)
        .agg(F.min(order).alias("first"), F.max(order).alias("last"))
        .where("first < last")
        .drop("last")
    )


def repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``id``, ``content`` (hash of the text) and ``spans``, ranges of words (from, to) that lie in
    windows of ``window`` words which a document with a smaller id has, too. Ranges may
    overlap. Documents without any are not listed; see ``without_repeats`` for the cases."""
    spark = docs.sparkSession
    own = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("content"),
    )
    rank = F.coalesce("id", F.lit(LAST))
    spoken, spoken_at = stage(own.select("id", "content", "text").mapInArrow(*_speakers(window)))
    # Half windows that two documents have.
    known, known_at = _first(spoken, ["speaker"])
    alive, alive_at = stage(
        spoken.join(known.withColumnRenamed("first", "earliest"), "speaker").withColumn("rank", rank)
    )
    # Contexts, each with the first document that has it.
    firsts, firsts_at = stage(
        alive.groupBy("speaker", "context").agg(
            F.min("rank").alias("first"), F.min("earliest").alias("earliest")
        )
    )
    judged, judged_at = stage(alive.drop("earliest").join(firsts, ["speaker", "context"]))
    in_context = judged.where("rank > first").select(
        "id", "content", F.struct("low", (F.col("high") + window).alias("to")).alias("span")
    )
    # First occurrences, where another context of the speaker begins in a later document.
    others = firsts.where("first > earliest").select("speaker").distinct()
    asked = (
        judged.where("rank = first")
        .join(others, "speaker", "left_semi")
        .groupBy("id", "content")
        .agg(F.collect_set(F.struct("low", "high", "speaker")).alias("asked"))
    )
    compared, compared_at = stage(
        own.alias("d")
        .join(asked.alias("a"), _same_document("d", "a"))
        .select("d.id", "d.content", "d.text", "a.asked")
        .mapInArrow(*_windows(window))
    )
    seen, seen_at = _first(compared, ["speaker", "name"])
    in_window = (
        compared.join(seen, ["speaker", "name"])
        .where(rank > F.col("first"))
        .select("id", "content", F.struct("low", (F.col("low") + window).alias("to")).alias("span"))
    )
    found, _ = stage(
        in_context.unionByName(in_window)
        .groupBy("id", "content")
        .agg(F.collect_set("span").alias("spans"))
    )
    for path in (spoken_at, known_at, alive_at, firsts_at, judged_at, compared_at, seen_at):
        discard(spark, path)
    return found


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, list[list[int]], bytes | None]:
    """Number of words, merged spans, and the other words joined by one space."""
    data = np.frombuffer(text, np.uint8)
    solid = ~SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    first, end = edges[::2], edges[1::2]
    cover = np.zeros(len(first) + 1, np.int32)
    if len(spans):
        bounds = np.array(spans, np.int64)
        np.add.at(cover, bounds[:, 0], 1)
        np.add.at(cover, bounds[:, 1], -1)
    gone = np.cumsum(cover[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8)))
    merged = turns.reshape(-1, 2).tolist()
    size = np.where(gone, 0, end - first + 1)
    change = np.zeros(len(data) + 2, np.int32)
    change[first] += size > 0
    change[end + 1] -= size > 0
    kept = np.cumsum(change[: len(data)]) > 0
    out = np.where(solid, data, 0x20).astype(np.uint8)[kept].tobytes()
    return len(first), merged, out.removesuffix(b" ")


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """For every row ``id_col``, ``n_words``, ``n_removed``, ``removed`` (ranges of words, from and to,
    apart from each other), ``kept_text`` (the other words, joined by one space) and
    ``kept_sha256``.

    A word goes if it lies in a window of ``window`` consecutive words that starts, word for
    word, in a document with a smaller id, too; windows are those of the given texts. Words
    are runs of anything but ASCII white space. Texts without a whole window keep all
    words; null and empty ones have none. Equal ids are not smaller than each other, so
    repeated rows keep what they have in common; rows without an id come after all others
    (as does the largest 64-bit id) and keep what only they share. Other columns play no
    part. An empty table gives none.
    """
    found = repeated(docs, id_col, text_col, window)
    own = docs.select(
        F.col(id_col).alias("given_id"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("content"),
    )
    joined = own.alias("d").join(found.alias("f"), _same_document("d", "f"), "left").select(
        "d.given_id", "d.text", "f.spans"
    )
    kind = own.schema["given_id"].dataType.simpleString()
    ddl = f"given_id {kind}, n_words long, removed array<struct<from:int,to:int>>, kept_text string"
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            schema = pa.schema(
                [("given_id", batch["given_id"].type), ("n_words", pa.int64()), ("removed", span), ("kept_text", pa.binary())]
            )

            def rows(batch=batch):
                for i, text, spans in zip(*(batch[c] for c in ("given_id", "text", "spans")), strict=True):
                    raw = text.as_buffer() if text.is_valid else b""
                    listed = [(s["low"], s["to"]) for s in spans.as_py()] if spans.is_valid else []
                    n, merged, kept = _kept(raw, listed)
                    ranges = [{"from": a, "to": b} for a, b in merged]
                    yield len(kept), (i.as_py(), n, ranges, kept)

            for out in batches(rows(), schema):
                arrays = [*out.columns[:3], out["kept_text"].view(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return joined.mapInArrow(run, ddl).select(
        F.col("given_id").alias(id_col),
        "n_words",
        removed.alias("n_removed"),
        "removed",
        "kept_text",
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )
