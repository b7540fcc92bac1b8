"""Tables kept between runs: laid out for the queries, rewritten only where they change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tenure.functions.predicates import RULES, LogRules, is_owner_change
from tenure.sources.tables import Tables

# Bytes of a row group in a table that is read by account or id.
GROUP_BYTES = 8 << 20


class WriteError(RuntimeError):
    """What was written is not what was computed."""


# --- layouts -----------------------------------------------------------------


def write_for_lookups(
    df: DataFrame, path: str, order: Sequence[str] = ("account_id", "id"), group_bytes: int = GROUP_BYTES
) -> None:
    """Write ``df`` sorted by ``order``, in small row groups with Bloom filters on those columns.

    A reader that asks for one account skips all row groups but its own by their least and
    greatest values; one that asks for an id skips most by the Bloom filters. The sort is by
    ranges of all columns in ``order``, so a large account is spread over files.
    """
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write
    for column in order:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("parquet.block.size", str(group_bytes)).mode("errorifexists").parquet(path)


def bucketed(tables: Tables, names: tuple[str, str], n_buckets: int, folder: str | None = None) -> Tables:
    """Save relations and log as tables (``names``) that are bucketed and sorted by account, and
    read them back: joins and counts by account then need no shuffle of either.

    ``folder`` keeps them outside of the warehouse. A large account fills one bucket: the
    queries along a line, which cut anywhere, do not depend on buckets.
    """

    def saved(df: DataFrame, name: str) -> DataFrame:
        writer = df.write.bucketBy(n_buckets, "account_id").sortBy("account_id").format("parquet")
        if folder is not None:
            writer = writer.option("path", f"{folder}/{name}")
        writer.mode("errorifexists").saveAsTable(name)
        return df.sparkSession.table(name)

    relation, log = (saved(df, name) for df, name in zip((tables.relation, tables.owner_history), names))
    return Tables(relation, log, tables.users, tables.excluded)


# --- output that can be written again ----------------------------------------


def replace_parts(df: DataFrame, path: str, part: str) -> int:
    """Write ``df`` to a table partitioned by ``part``: partitions that ``df`` has rows of are
    replaced, all others stay. Running it again leaves the same rows; a run that fails
    before its commit leaves the old ones.

    The rows are counted while they are written, and again in what was written: a
    difference is an error. Returns their number.
    """
    counted = Observation()
    watched = df.observe(
        counted,
        F.count(F.lit(1)).alias("n"),
        F.collect_set(part).alias("parts"),
        F.count_if(F.col(part).isNull()).alias("n_null"),
    )
    (
        watched.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(part)
        .parquet(path)
    )
    seen = counted.get
    if not seen["n"]:
        return 0
    same = F.col(part).isin(list(seen["parts"]))
    if seen["n_null"]:
        same = same | F.col(part).isNull()
    found = df.sparkSession.read.parquet(path).where(same).count()
    if found != seen["n"]:
        raise WriteError(f"{seen['n']} rows computed, {found} found in {path}")
    return found


# --- totals of an append-only log --------------------------------------------


def period(at: Column) -> Column:
    """The month of a change, as ``yyyyMM``: the partitions of the log and of its totals."""
    return F.date_format(at, "yyyyMM").cast("int")


def append_log(rows: DataFrame, log_path: str) -> None:
    """Add rows to the log, which is kept by period; rows without a time have none."""
    rows.withColumn("period", period(F.col("changed_at"))).write.mode("append").partitionBy(
        "period"
    ).parquet(log_path)


def refresh_totals(
    spark: SparkSession, periods: Sequence[int | None], log_path: str, totals_path: str, rules: LogRules = RULES
) -> int:
    """Count the owner changes of these periods anew, per account, and put the counts in the
    place of the old ones. Only those partitions of the log are read, no other is written.
    Returns the number of counts."""
    log = spark.read.parquet(log_path)
    chosen = F.col("period").isin([p for p in periods if p is not None])
    if None in periods:
        chosen = chosen | F.col("period").isNull()
    totals = (
        log.where(chosen & is_owner_change(rules) & F.col("account_id").isNotNull())
        .groupBy("period", "account_id")
        .agg(
            F.count(F.lit(1)).alias("n_changes"),
            F.min("changed_at").alias("first_at"),
            F.max("changed_at").alias("last_at"),
        )
    )
    return replace_parts(totals, totals_path, "period")


def add_to_log(rows: DataFrame, log_path: str, totals_path: str, rules: LogRules = RULES) -> int:
    """Append rows and bring the totals of the periods they touch up to date."""
    found = rows.select(period(F.col("changed_at")).alias("p")).distinct().collect()
    append_log(rows, log_path)
    return refresh_totals(rows.sparkSession, [r["p"] for r in found], log_path, totals_path, rules)


def account_totals(spark: SparkSession, totals_path: str) -> DataFrame:
    """Owner changes per account, their first and last time, from the stored totals."""
    return (
        spark.read.parquet(totals_path)
        .groupBy("account_id")
        .agg(
            F.sum("n_changes").alias("n_changes"),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
        )
    )
