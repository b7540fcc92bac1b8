"""The four tables, derived from order, line item and supplier tables.

The library itself needs relations, an owner log and users. This module makes
them from a TPC-H-like star schema, so that the queries can be run and checked at
any scale factor: an account is a customer, a relation is an order, a change is a
shipping day. Those tables hold no nulls; here they come from key arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenure.functions.predicates import OWNER_FIELD, POOL_NAME, USER_ID_PREFIX
from tenure.operators.sequence import with_next_assignment
from tenure.plans.repair import same_day_duplicates
from tenure.sources.tables import Tables, checked, write


def _person(number: Column) -> Column:
    return F.concat(F.lit("Supplier#"), F.lpad(number.cast("string"), 9, "0"))


def _user_id(number: Column) -> Column:
    return F.concat(F.lit(USER_ID_PREFIX), number.cast("string"))


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def relation(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    owner = (
        F.when(key % 63 == 0, _person(F.lit(1)))
        .when((key % 9 == 0) | (F.col("o_orderstatus") == "F"), _nothing("string"))
        .otherwise(_person(key % 10))
    )
    started = orders.select(
        F.concat(F.lit("REL-"), F.lpad(key.cast("string"), 10, "0")).alias("id"),
        F.col("o_custkey").alias("account_id"),
        F.when(key % 101 != 0, key % 37 == 0).alias("is_deleted"),
        F.when(key % 9 != 0, F.col("o_orderdate")).alias("assigned_at"),
        owner.alias("owner"),
        F.col("o_orderdate").cast("date").alias("created_on"),
        (key % 11 == 0).alias("stays_open"),
    )
    dated = with_next_assignment(started.where("assigned_at is not null"))
    undated = started.where("assigned_at is null").withColumn("next_at", F.col("assigned_at"))
    ended_at = F.when(~F.col("stays_open"), F.col("next_at"))
    return dated.unionByName(undated).select(
        "id",
        "account_id",
        "is_deleted",
        "assigned_at",
        ended_at.alias("ended_at"),
        "owner",
        "created_on",
    )


def owner_history(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    account, k = F.col("account_id"), F.col("k")
    days = (
        lineitem.select("l_orderkey", "l_suppkey", F.col("l_shipdate").alias("changed_at"))
        .join(
            orders.where("o_custkey % 10 < 8").select(
                F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account_id")
            ),
            "l_orderkey",
        )
        .groupBy("account_id", "changed_at")
        .agg(F.min("l_suppkey").alias("k"))
    )
    kind = account % 10
    # One row per account and day from here on: the calendar bounds the window.
    in_time = Window.partitionBy("account_id").orderBy("changed_at")
    new_value = (
        F.when((kind == 5) | ((kind < 5) & (k % 10 == 3)), POOL_NAME)
        .when(kind >= 6, "Reassignment Pool 0")
        .when(k % 10 == 4, "Reassignment Pool 4")
        .otherwise(_person(k % 10))
    )
    log = days.withColumn("new_value", new_value).withColumns(
        {"rn": F.row_number().over(in_time), "previous": F.lag("new_value").over(in_time)}
    )
    old_value = (
        F.when(k % 23 == 0, _nothing("string"))
        .when(kind == 7, POOL_NAME)
        .when(F.col("rn") == 1, _person((account + k) % 10))
        .otherwise(F.col("previous"))
    )

    def entry(field: str, old: Column, new: Column, where: Column) -> Column:
        values = F.struct(
            F.lit(field).alias("field"), old.alias("old_value"), new.alias("new_value")
        )
        return F.when(where, values)

    named = (kind < 5) | (F.col("rn") == 1)
    entries = F.array(
        entry(OWNER_FIELD, old_value, F.col("new_value"), named),
        entry(OWNER_FIELD, _user_id(k), _user_id(k + 1), named),
        entry("Status", F.lit("Open"), F.lit("Closed"), k % 7 == 0),
    )
    return log.select(
        "account_id", "changed_at", F.inline(F.array_compact(entries))
    )


def users(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        _user_id(F.col("s_suppkey")).alias("id"),
        F.col("s_name").alias("name"),
        (F.col("s_suppkey") % 4 != 0).alias("is_active"),
    )


def derive(spark: SparkSession, folder: str) -> Tables:
    """The tables as DataFrames over ``folder``; excluded are same-day duplicates."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    orders = read("orders")
    relations = relation(orders)
    return checked(
        Tables(
            relations,
            owner_history(orders, read("lineitem")),
            users(read("supplier")),
            same_day_duplicates(relations),
        )
    )


def stage(tables: Tables, folder: str) -> Tables:
    """Write the tables to ``folder`` once and read them back.

    Queries then start from a Parquet scan that takes their filters and columns,
    and do not derive the tables again.
    """

    def written(name: str, df: DataFrame) -> DataFrame:
        write(df, f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")

    return Tables(
        written("relation", tables.relation),
        written("owner_history", tables.owner_history),
        written("users", tables.users),
        written("excluded", tables.excluded),
    )
