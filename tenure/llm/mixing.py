"""A mix of sources at target weights, in blocks of equally many words.

Every source's target is its weight's share of the whole, but never more than
``repeats`` times what the source has; the excess goes to the others by weight until
none is above. Blocks are apportioned by Sainte-Laguë: seats go to the highest quotients
target / (2k - 1). All seats with a quotient of at least half a block are given, which
is the rounding of target / block, and the first j of n shards get the apportionment of
j/n of the house, so quotas of a shard are differences of two roundings and never
negative. A source's documents, in an order drawn by seed, form one stream of words
that starts anew when it ends; a shard's quota is the next blocks of that stream.

Everything is counts per source, sums per source and bucket, and one window per bucket:
the order is by MD5, whose first digits are the buckets, so no task holds a source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import cut, n_words
from tenure.llm.hashing import SPACE

# Words of a block.
BLOCK = 32
# Hexadecimal digits of the draw that are counted, and bits that a bucket has at most.
DIGITS = 5
MOST_BITS = 4 * DIGITS
# Parts into which the rows of a source are dealt where they meet what is known of it.
PARTS = 64
WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """``sources`` (``source``, ``source_size`` and others) with ``target``.

    Sources are weighed in the order of their code points, null last, by ``weights`` in
    turn. The table has a row per source, so its windows hold no more than that.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.asc_nulls_last("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    # From the source that fills first to the one that fills last.
    by_level = everything.orderBy("full_at", F.asc_nulls_last("source"))
    up_to = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onwards = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - (
        F.sum("most").over(up_to) - F.col("most")
    )
    level = left / F.sum("weight").over(onwards)
    return (
        sources.withColumn("most", F.col("source_size").cast("double") * repeats)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn(
            "level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
        )
        .withColumn(
            "target",
            F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))),
        )
        .select(*sources.columns, "target")
    )


def quotas(sources: DataFrame, share: float, n_shards: int, block: int) -> DataFrame:
    """``source`` and ``seats``: the blocks that the first 0, 1, ... ``n_shards`` shards take
    together of it, from ``source``, ``source_size`` and ``target``.

    With n sources and a house of H, rounding shares of H - n/2 gives no more than H seats,
    all among the highest quotients, and rounding shares of H + n/2 no fewer than H. Only the
    seats between, at most 2n and two more a source for rounding errors, are compared.
    """
    everything = Window.partitionBy(F.lit(0))
    whole = F.lit(float(share)) * F.sum("source_size").over(everything)
    houses = (
        sources.select(
            "source",
            "target",
            whole.alias("whole"),
            F.count(F.lit(1)).over(everything).alias("n"),
        )
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(n_shards))))
        .withColumn(
            "house", F.floor(F.floor(F.col("whole") / block + 0.5) * F.col("shard") / n_shards)
        )
        .withColumn("part", F.coalesce(F.try_divide("target", "whole"), F.lit(0.0)))
    )

    def rounded(house: Column) -> Column:
        return F.floor(F.col("part") * house + 0.5)

    of_house = Window.partitionBy("shard")
    open_seats = (
        houses.withColumn("sure", F.greatest(rounded(F.col("house") - F.col("n") / 2) - 1, F.lit(0)))
        .withColumn("left", F.col("house") - F.sum("sure").over(of_house))
        .withColumn("seat", F.explode(F.sequence(
            F.col("sure") + 1, F.greatest(F.col("sure"), rounded(F.col("house") + F.col("n") / 2)) + 1
        )))
        .withColumn("quotient", F.col("target") / (2 * F.col("seat") - 1))
    )
    place = F.row_number().over(of_house.orderBy(F.desc("quotient"), F.asc_nulls_last("source")))
    given = (
        open_seats.withColumn("won", (place <= F.col("left")) & (F.col("quotient") > 0))
        .groupBy("source", "shard")
        .agg((F.max("sure") + F.count_if("won")).alias("seats"))
    )
    # A row per shard, so the list has no more.
    by_shard = F.sort_array(F.collect_list(F.struct("shard", "seats")))
    return given.groupBy("source").agg(
        F.concat(F.array(F.lit(0).cast("long")), F.transform(by_shard, lambda s: s["seats"])).alias("seats")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    n_shards: int = 8,
    block: int = BLOCK,
    seed: int = 7,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target``, ``taken`` and ``spans`` for every
    row, with the columns in ``carry`` as they are.

    ``spans`` are (shard, pass, from, to): words ``from`` up to ``to`` of the text go into
    the shard; ``pass`` counts the rounds through the source. ``taken`` adds them up. A
    null text has no words, and a source without words a target of 0; a null source is a
    source of its own, and so are empty ones. Rows are drawn by id, those without one by
    text; rows that agree in it and in size are interchangeable, and one task orders them.
    Each source's words come near its target, unless that is all it has: within a block,
    but for the blocks by which all roundings together miss the house. Carried columns must
    not have the names of those added. An empty table gives none.
    """
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    told = F.when(F.col(id_col).isNull(), F.concat(F.lit("|"), F.col(text_col)))
    draw = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), told)
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.md5(draw).alias("draw"),
        F.struct(*(F.col(c) for c in carry), F.lit(0).alias("__")).alias("carried"),
    ).withColumns({"key": key, "beginning": F.conv(F.substring("draw", 1, DIGITS), 16, 10).cast("int")})
    dealt = F.pmod("beginning", F.lit(PARTS))
    counted = cut(
        sized.groupBy("key", "source", "beginning").agg(
            F.sum("size").alias("bucket_size"), F.count(F.lit(1)).alias("n_rows")
        )
    )
    weighed = targets(
        counted.groupBy("key", "source").agg(
            F.sum("bucket_size").alias("source_size"), F.sum("n_rows").alias("n_rows")
        ),
        weights, share, repeats,
    )
    bits = F.least(F.ceil(F.log2("n_rows") / 2), F.lit(MOST_BITS)).cast("int")
    seats = quotas(weighed, min(share, repeats), n_shards, block).withColumn("key", key)
    sources = cut(
        weighed.withColumn("bits", bits)
        .join(seats.drop("source"), "key")
        .select("key", "source_size", "target", "seats", "bits")
    ).withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    bucket = F.expr(f"shiftright(beginning, {MOST_BITS} - bits)")
    line = Window.partitionBy("key").orderBy("bucket")
    starts = (
        counted.withColumn("dealt", dealt)
        .join(sources.select("key", "dealt", "bits"), ["key", "dealt"])
        .groupBy("key", bucket.alias("bucket"))
        .agg(F.sum("bucket_size").alias("bucket_size"))
        .withColumn("start", F.sum("bucket_size").over(line) - F.col("bucket_size"))
        .select("key", "bucket", "start")
    )
    in_bucket = (
        Window.partitionBy("key", "bucket")
        .orderBy("draw", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        sized.withColumn("dealt", dealt)
        .join(sources, ["key", "dealt"])
        .withColumn("bucket", bucket)
        .join(starts, ["key", "bucket"])
        .withColumn("start", F.col("start") + F.sum("size").over(in_bucket) - F.col("size"))
    )
    spans = F.flatten(
        F.array(*(_spans(turn, shard, block) for shard in range(n_shards) for turn in range(repeats)))
    )
    result = placed.withColumn("spans", spans)
    return result.select(
        F.col("id").alias(id_col),
        *(F.col(f"carried.{c}").alias(c) for c in carry),
        "size",
        "source_size",
        "target",
        F.aggregate(
            "spans", F.lit(0).cast("long"), lambda total, s: total + s["to"] - s["from"]
        ).alias("taken"),
        "spans",
    )


def word_range(text: Column, begin: Column, end: Column) -> Column:
    """The part of a text from its word ``begin`` up to word ``end`` (not with it), as it
    stands there with all white space between; null where the text is."""

    @F.arrow_udf("string")
    def part(texts: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for own, low, high in zip(texts, begins.to_pylist(), ends.to_pylist(), strict=True):
            if not own.is_valid:
                out.append(None)
                continue
            raw = own.as_buffer().to_pybytes()
            solid = ~SPACE[np.frombuffer(raw, np.uint8)]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
            first, last = edges[::2], edges[1::2]
            high = min(high, len(first))
            out.append(raw[first[low] : last[high - 1]] if low < high else b"")
        return pa.array(out, pa.binary()).view(pa.string())

    return part(text, begin.cast("long"), end.cast("long"))


def _spans(turn: int, shard: int, block: int) -> Column:
    """What the shard takes of a document in one round, in an array of one or none."""
    at = F.col("start") + F.col("source_size") * turn
    begin = F.greatest(F.col("seats")[shard] * block - at, F.lit(0))
    end = F.least(F.col("seats")[shard + 1] * block - at, F.col("size"))
    span = F.struct(
        F.lit(shard).alias("shard"),
        F.lit(turn).alias("pass"),
        begin.cast("long").alias("from"),
        end.cast("long").alias("to"),
    )
    return F.filter(F.array(span), lambda s: s["to"] > s["from"])
