"""The filters every query is made of, as Spark columns.

Comparisons are the plain SQL ones on purpose: a null ``is_deleted`` drops the
relation and a null ``old_value`` or ``new_value`` drops the owner change. All of
them are comparisons of a bare column with a literal, so Spark pushes them down
to the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# The spellings in the account-change log.
OWNER_FIELD = "Owner"
USER_ID_PREFIX = "0053X"
POOL_NAME = "Outbound Database"
POOL_WORD = "Reassignment"
# Fixed value: what an owner that cannot be recovered is set to.
LOST = "LOST"


@dataclass(frozen=True)
class LogRules:
    """How the change log spells owners, pools and rows that hold user ids."""

    field: str = OWNER_FIELD
    id_prefix: str = USER_ID_PREFIX
    pool_name: str = POOL_NAME
    pool_word: str = POOL_WORD


RULES = LogRules()


# --- relations ---------------------------------------------------------------


def not_deleted() -> Column:
    return ~F.col("is_deleted")


def is_assigned() -> Column:
    return F.col("assigned_at").isNotNull()


def has_owner() -> Column:
    return F.col("owner").isNotNull()


def has_no_owner() -> Column:
    return F.col("owner").isNull()


def is_to_fix() -> Column:
    """A live relation that was assigned but shows no owner."""
    return not_deleted() & is_assigned() & has_no_owner()


def is_backlog() -> Column:
    """Waiting for an assignment: neither owner nor assignment date."""
    return ~is_assigned() & has_no_owner()


def relation_in(ids: list[str]) -> Column:
    return F.col("id").isin(ids)


def on_account(account) -> Column:
    return F.col("account_id") == F.lit(account)


# --- log rows ----------------------------------------------------------------


def is_no_pool(column: str, rules: LogRules = RULES) -> Column:
    """The value is a person, not one of the pools (case-sensitive)."""
    value = F.col(column)
    return (value != rules.pool_name) & ~value.contains(rules.pool_word)


def is_owner_row(rules: LogRules = RULES) -> Column:
    """An owner entry that holds names, not its twin that holds user ids."""
    return (F.col("field") == rules.field) & ~F.col("old_value").startswith(
        rules.id_prefix
    )


def is_owner_change(rules: LogRules = RULES) -> Column:
    """The owner really changed, and not into a pool."""
    return (
        is_owner_row(rules)
        & (F.col("old_value") != F.col("new_value"))
        & is_no_pool("new_value", rules)
    )


def is_first_owner_row(rules: LogRules = RULES) -> Column:
    """The row names a person as the owner before it, whatever came after."""
    return is_owner_row(rules) & is_no_pool("old_value", rules)


# --- counting ----------------------------------------------------------------


def count_where(condition: Column) -> Column:
    """``sum(1 or 0)``: null on empty input, where ``count_if`` gives 0."""
    return F.sum(F.when(condition, 1).otherwise(0))
