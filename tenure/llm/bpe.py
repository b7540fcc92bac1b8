"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is encoded as the concatenation of its pre-tokens, each match of the pattern
on its own. A long text is cut into chunks that overlap; every chunk is pre-tokenised
by itself, from wherever it happens to start. A match depends on the text from its
start onwards only, so as soon as the boundaries of a chunk and of the one before
it coincide, they stay the same: there the two are stitched, and the pieces between
stitches are encoded independently, in any task. Decoding concatenates raw bytes.

Defined cases: a null text counts as empty and an empty text has no ids; repeated
rows are encoded once each; other columns of the input play no part. Where two chunks
share no boundary (one pre-token longer than the overlap), the rest of that text is
one piece, which is slower and still right.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import batches

# Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 11
# A boundary this close to the end of a chunk may move once more text is seen.
MARGIN = 8


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        pairs = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def encoding_of(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        "from_file", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={}
    )


def boundaries(text: str, pattern: regex.Pattern) -> list[int]:
    """Starts of the matches that no further text can change."""
    safe = len(text) - MARGIN
    return [m.start() for m in pattern.finditer(text) if m.start() <= safe]


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for every row.

    ``path`` is a tiktoken rank file that the executors can read; ``pattern`` cuts
    pre-tokens.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    short = _encoded(rows.where(F.length("text") <= chunk), path, pattern, ["id"])
    long = (
        rows.where(F.length("text") > chunk)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(_chunker(chunk, overlap), "id long, row long, k int, text string")
        .repartition("row", "k")
        .mapInArrow(
            _pretokeniser(pattern, chunk, overlap),
            "id long, row long, k int, text string, head array<int>, tail array<int>",
        )
    )
    pieces = _pieces(long, chunk).repartition("row", "piece")
    parts = _encoded(pieces, path, pattern, ["id", "row", "piece"])
    joined = (
        parts.groupBy("row", "id")
        .agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
        .select("id", F.flatten("parts.ids").alias("ids"))
    )
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def _chunker(chunk: int, overlap: int):
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("k", pa.int32()), ("text", pa.string())])

    def cut(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in given:
                for key, text, row in zip(*(batch[c] for c in ("id", "text", "row")), strict=True):
                    text = text.as_py()
                    for k, start in enumerate(range(0, len(text), chunk)):
                        piece = text[start : start + chunk + overlap]
                        yield len(piece), (key.as_py(), row.as_py(), k, piece)

        return batches(rows(), schema)

    return cut


def _pretokeniser(pattern: str, chunk: int, overlap: int):
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("row", pa.int64()),
            ("k", pa.int32()),
            ("text", pa.string()),
            ("head", pa.list_(pa.int32())),
            ("tail", pa.list_(pa.int32())),
        ]
    )

    def pretokenise(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)

        def rows():
            for batch in given:
                for row in batch.to_pylist():
                    starts = boundaries(row["text"], compiled)
                    head = [p for p in starts if p < overlap]
                    tail = [p - chunk for p in starts if p >= chunk]
                    yield len(row["text"]), (*row.values(), head, tail)

        return batches(rows(), schema)

    return pretokenise


def _pieces(chunks: DataFrame, chunk: int) -> DataFrame:
    """Texts from stitch to stitch. The first border without a common boundary ends
    the trust in what follows, so everything after it goes into one piece."""
    line = Window.partitionBy("row").orderBy("k")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(line)))
    lost = F.max(F.col("stitch").isNull().cast("int")).over(so_far) == 1
    following = F.lead("from").over(line)
    return (
        chunks.withColumn("stitch", F.when(F.col("k") == 0, F.lit(0)).otherwise(common))
        .withColumn("from", F.when(~lost, F.col("stitch")))
        # Text up to the next stitch; without one, this chunk's share without overlap.
        .withColumn("to", F.coalesce(F.lit(chunk) + following, F.lit(chunk)))
        .withColumn("piece", F.last(F.when(F.col("from").isNotNull(), F.col("k")), True).over(so_far))
        .withColumn("begin", F.coalesce("from", F.lit(0)))
        .withColumn("text", F.expr("substring(text, begin + 1, to - begin)"))
        .groupBy("id", "row", "piece")
        .agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("texts"))
        .select("id", "row", "piece", F.array_join("texts.text", "").alias("text"))
    )


def _encoded(rows: DataFrame, path: str, pattern: str, keys: list[str]) -> DataFrame:
    kinds = {"id": pa.int64(), "row": pa.int64(), "piece": pa.int32()}
    schema = pa.schema([*((k, kinds[k]) for k in keys), ("ids", pa.list_(pa.int32()))])
    ddl = ", ".join([*(f"{k} {'int' if k == 'piece' else 'long'}" for k in keys), "ids array<int>"])

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(path, pattern)

        def encoded():
            for batch in given:
                own = [batch[k] for k in keys]
                for values in zip(*own, batch["text"], strict=True):
                    ids = encoding.encode_ordinary(values[-1].as_py())
                    # A Python list of small ints takes about eight times the array.
                    yield 32 * len(ids), (*(v.as_py() for v in values[:-1]), ids)

        return batches(encoded(), schema)

    return rows.select(*keys, "text").mapInArrow(run, ddl)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids`` and ``data``, the raw bytes that the ids stand for."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("data", pa.binary())])

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: data for data, rank in ranks_of(path).items()}

        def decoded():
            for batch in given:
                for key, ids in zip(batch["id"], batch["ids"], strict=True):
                    listed = ids.values.to_numpy().tolist()
                    yield 40 * len(listed), (
                        key.as_py(),
                        ids.values.to_numpy(),
                        b"".join(map(token.__getitem__, listed)),
                    )

        return batches(decoded(), schema)

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, ids array<int>, data binary").withColumnRenamed(
        "id", id_col
    )


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of ids and SHA-256 of the ids and of the decoded bytes."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
