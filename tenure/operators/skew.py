"""Joins on keys that may hold a large share of all rows.

One plan for every size: nothing is counted on the driver, nothing is broadcast by
hint, and no bound decides between two ways. Where one side has a row per key, the join
is left to Spark, which broadcasts a side by its size and splits skewed partitions at
run time (adaptive execution). Where both sides have many rows, the number of pairs of
a key is counted in the plan, and its rows are dealt out accordingly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.predicates import is_to_fix

# Rows of one key that a task joins before the key is dealt into parts.
ROWS_PER_PART = 1 << 20
# Copies of a row that are made at a time.
COPIES_AT_ONCE = 1 << 10
# Parts into which rows without a key are dealt.
MISSING_PARTS = 1024
# Pairs of one key that a task makes before the key is dealt into parts.
PAIRS_PER_TASK = 20_000_000


def _names(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def all_present(names: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(name).isNotNull() for name in names))


def only_accounts_to_fix(df: DataFrame, relation: DataFrame) -> DataFrame:
    """``df`` without the accounts that have nothing to fix.

    The log outgrows the relations, and the repair concerns part of the accounts. Where
    those are few Spark broadcasts them and the rest of the log ends at its scan. Where
    they are many it joins by account; a Bloom filter of them then goes to the scan of the
    log, if that is large (``spark.sql.optimizer.runtime.bloomFilter``). An account may
    come several times: taking those out would hide the filter on the relations, without
    which Spark makes no Bloom filter.
    """
    accounts = relation.where(is_to_fix()).select("account_id")
    return df.join(accounts, "account_id", "left_semi")


def lookup_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join many ``left`` rows to the one ``right`` row of their key.

    Rows without a key match nothing. Where they stay they are dealt out by their content,
    so that they do not meet in one task; ``left`` is read once. The zero of the other side is
    taken from its key: Spark would move a literal out of the join's keys, and with it the
    dealing.
    """
    on = _names(on)
    if how not in ("left", "left_anti"):
        return left.where(all_present(on)).join(right, on, how)
    told = [f.name for f in left.schema if "map" not in f.dataType.simpleString()]
    part = 1 + F.pmod(F.xxhash64(*told), F.lit(MISSING_PARTS))
    salted = left.withColumn("_salt", F.when(all_present(on), F.lit(0).cast("long")).otherwise(part))
    there = right.withColumn("_salt", F.pmod(F.xxhash64(*on), F.lit(1)))
    return salted.join(there, [*on, "_salt"], how).drop("_salt")


def account_lookup(relation: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join relations to what is known of their account, one row per account."""
    return lookup_join(relation, right, "account_id", how)


def expand_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    n_rows: DataFrame,
    pairs: int = PAIRS_PER_TASK,
) -> DataFrame:
    """Inner join where both sides may have many rows per key.

    ``n_rows`` has a row for each key that is joined, with ``n_left`` and ``n_right``, the rows
    it has on either side; it comes from totals that a query has anyway, and what it leaves
    out ends at its first join. The work is the output, as nearly every pair is part of the
    result; what matters is that no task makes all pairs of a large key. A key with more than
    ``pairs`` of them is cut into a grid: its left rows are dealt into a number of parts and
    its right rows likewise, each side is copied to the other's parts, and every pair meets
    in one cell. The part of a row comes from its content, so a recomputed task deals the
    same way; copies of a row are told apart by their input partition.
    """
    on = _names(on)
    n_left, n_right = F.col("n_left").cast("double"), F.col("n_right").cast("double")
    side = F.ceil(F.sqrt(n_left * n_right / pairs))
    grid = n_rows.select(
        *on,
        F.greatest(F.least(side, n_left), F.lit(1)).cast("int").alias("_left"),
        F.greatest(F.least(side, n_right), F.lit(1)).cast("int").alias("_right"),
    )

    def deal(df: DataFrame, own: str, other: str) -> DataFrame:
        content = F.xxhash64(*df.columns, F.spark_partition_id())
        part = F.pmod(content, F.col(own)).cast("int")
        copies = F.sequence(F.lit(0), F.col(other) - 1)
        return (
            df.where(all_present(on))
            .join(grid, on)
            .select(*df.columns, part.alias(f"{own}_part"), copies.alias("_copies"))
            .withColumn(f"{other}_part", F.explode("_copies"))
            .drop("_copies")
        )

    return (
        deal(left, "_left", "_right")
        .join(deal(right, "_right", "_left"), [*on, "_left_part", "_right_part"])
        .drop("_left_part", "_right_part")
    )


def dealt_join(
    left: DataFrame, right: DataFrame, on: str, counts: DataFrame, n_rows: str
) -> DataFrame:
    """Inner join of many ``left`` rows to few ``right`` ones per key, ``left`` dealt out in place.

    ``counts`` has ``on`` and ``n_rows``, how many left rows a key has; ``right`` has that number,
    too, and loses it. Keys with more than ``ROWS_PER_PART`` rows are dealt into parts by the
    content of a row, and the right rows are copied once for each part. Those keys are
    broadcast: of N rows there are at most N / ``ROWS_PER_PART``.
    """
    n_parts = F.ceil(F.col(n_rows) / ROWS_PER_PART).cast("int")
    heavy = counts.where(F.col(n_rows) > ROWS_PER_PART).select(on, n_parts.alias("_parts"))
    part = F.pmod(F.xxhash64(*left.columns), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(heavy), on, "left").select(*left.columns, part.alias("_part"))
    copied = right.withColumn("_part", F.explode(F.sequence(F.lit(0), n_parts - 1))).drop(n_rows)
    return dealt.join(copied, [on, "_part"]).drop("_part")


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as column ``times`` says, without it; no long array is built."""
    rest = F.col(times) - F.col("_step") * COPIES_AT_ONCE
    steps = F.sequence(F.lit(0), F.floor((F.col(times) - 1) / COPIES_AT_ONCE).cast("int"))
    return (
        df.where(F.col(times) > 0)
        .withColumn("_step", F.explode(steps))
        .withColumn(
            "_copy",
            F.explode(F.sequence(F.lit(1), F.least(rest, F.lit(COPIES_AT_ONCE)).cast("int"))),
        )
        .drop(times, "_step", "_copy")
    )
