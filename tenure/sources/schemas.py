"""The tables' columns, their accepted types, and the check made on load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = (T.StringType(), T.LongType(), T.IntegerType())
_TIME = (T.TimestampNTZType(), T.TimestampType(), T.DateType())
_TEXT = (T.StringType(),)
_FLAG = (T.BooleanType(),)

RELATION = {
    "id": _TEXT,
    "account_id": _KEY,
    "is_deleted": _FLAG,
    "assigned_at": _TIME,
    "ended_at": _TIME,
    "owner": _TEXT,
}
OWNER_HISTORY = {
    "account_id": _KEY,
    "changed_at": _TIME,
    "field": _TEXT,
    "old_value": _TEXT,
    "new_value": _TEXT,
}
USERS = {"id": _TEXT, "name": _TEXT, "is_active": _FLAG}
EXCLUDED = {"id": _TEXT}

# The CRM staging tables' column names, and ours.
RELATION_NAMES = {
    "id": "id",
    "account__c": "account_id",
    "isdeleted": "is_deleted",
    "assignement_date__c": "assigned_at",
    "end_relation_date__c": "ended_at",
    "owner_relation__c": "owner",
}
OWNER_HISTORY_NAMES = {
    "accountid": "account_id",
    "createddate": "changed_at",
    "field": "field",
    "oldvalue__string": "old_value",
    "newvalue__string": "new_value",
}
USERS_NAMES = {"id": "id", "name": "name", "isactive": "is_active"}


class SchemaError(ValueError):
    """A table lacks a column or has it in a type the queries cannot use."""


def check_schema(df: DataFrame, columns: dict[str, tuple[T.DataType, ...]]) -> DataFrame:
    """``df`` unchanged; fails on a missing column or a wrong type."""
    found = {field.name: field.dataType for field in df.schema.fields}
    problems = [
        f"{name}: {'missing' if name not in found else found[name].simpleString()}"
        f", want {' or '.join(kind.simpleString() for kind in kinds)}"
        for name, kinds in columns.items()
        if found.get(name) not in kinds
    ]
    if problems:
        raise SchemaError("; ".join(problems))
    return df


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` under our column names; columns without one are left out."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise SchemaError(f"missing: {', '.join(missing)}")
    return df.select(*(F.col(f"`{old}`").alias(new) for old, new in names.items()))


def repeated_ids(relation: DataFrame) -> DataFrame:
    """Ids that occur more than once: must be empty before the in-window queries."""
    return relation.groupBy("id").count().where(F.col("count") > 1)
