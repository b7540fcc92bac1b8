"""Load, stage and write the tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tenure.functions.predicates import RULES, LogRules, is_owner_row
from tenure.sources import schemas


@dataclass(frozen=True)
class Tables:
    """The inputs of the queries. ``excluded`` holds relation ids to leave out."""

    relation: DataFrame
    owner_history: DataFrame
    users: DataFrame
    excluded: DataFrame | None = None


def checked(tables: Tables) -> Tables:
    """``tables`` with every column present and of a usable type."""
    schemas.check_schema(tables.relation, schemas.RELATION)
    schemas.check_schema(tables.owner_history, schemas.OWNER_HISTORY)
    schemas.check_schema(tables.users, schemas.USERS)
    if tables.excluded is not None:
        schemas.check_schema(tables.excluded, schemas.EXCLUDED)
    return tables


def from_parquet(
    spark: SparkSession, relation: str, owner_history: str, users: str, excluded: str | None = None
) -> Tables:
    """Read tables that already carry our column names."""
    read = spark.read.parquet
    return checked(
        Tables(read(relation), read(owner_history), read(users), excluded and read(excluded))
    )


def from_names(
    spark: SparkSession, relation: str, owner_history: str, users: str, excluded: str | None = None
) -> Tables:
    """Take catalog tables or temporary views that carry our column names."""
    table = spark.table
    return checked(
        Tables(table(relation), table(owner_history), table(users), excluded and table(excluded))
    )


def from_staging(
    relation: DataFrame, owner_history: DataFrame, users: DataFrame, excluded: DataFrame | None = None
) -> Tables:
    """Take CRM staging tables under their own column names."""
    return checked(
        Tables(
            schemas.renamed(relation, schemas.RELATION_NAMES),
            schemas.renamed(owner_history, schemas.OWNER_HISTORY_NAMES),
            schemas.renamed(users, schemas.USERS_NAMES),
            excluded,
        )
    )


def stage_owner_log(history: DataFrame, path: str, rules: LogRules = RULES) -> DataFrame:
    """Write the part of the log that any query can use, and read it back.

    Every query keeps owner entries that hold names, so the rest of the log need
    be read once only. The result has the log's columns and replaces it.
    """
    write(history.where(is_owner_row(rules)), path)
    return history.sparkSession.read.parquet(path)


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a result as Parquet; the inputs are never updated in place."""
    df.write.mode(mode).parquet(path)


def shared_folder(spark: SparkSession) -> str | None:
    """A new folder inside the one that the session names in ``spark.checkpoint.dir``, which
    every executor can reach; None if it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return f"{named.rstrip('/')}/tenure-{uuid.uuid4().hex}" if named else None


def remove(spark: SparkSession, path: str) -> None:
    """Take away a folder that this application has written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
