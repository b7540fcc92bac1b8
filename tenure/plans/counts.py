"""How big the problem is: scans and counts of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.predicates import (
    RULES,
    LogRules,
    count_where,
    has_no_owner,
    has_owner,
    is_assigned,
    is_backlog,
    is_owner_change,
    is_to_fix,
    not_deleted,
)


def to_fix(relation: DataFrame) -> DataFrame:
    """Live, assigned relations without owner."""
    return relation.where(is_to_fix())


def owner_changes(history: DataFrame, rules: LogRules = RULES) -> DataFrame:
    """The real owner changes of the log."""
    return history.where(is_owner_change(rules)).select(
        "account_id", "changed_at", "old_value", "new_value"
    )


def owner_change_accounts(history: DataFrame, rules: LogRules = RULES) -> DataFrame:
    """How many accounts have a real owner change."""
    return owner_changes(history, rules).agg(F.countDistinct("account_id").alias("n_accounts"))


def relation_counts(relation: DataFrame) -> DataFrame:
    """All live relations, those with an assignment date, and those to fix."""
    return relation.where(not_deleted()).agg(
        F.countDistinct("id").alias("total_nb_lars"),
        count_where(is_assigned()).alias("nb_lars_not_in_backlog"),
        count_where(is_assigned() & has_no_owner()).alias("nb_lars_to_fix"),
    )


def to_fix_counts(relation: DataFrame) -> DataFrame:
    """Relations to fix, and their accounts."""
    return to_fix(relation).agg(
        F.count("id").alias("lars_to_fix"),
        F.countDistinct("account_id").alias("accounts_w_lar_to_fix"),
    )


def unresolved_relations(relation: DataFrame) -> DataFrame:
    """Ids that are still without owner; run on repaired relations to mark losses."""
    return to_fix(relation).select("id").distinct()


def backlog(relation: DataFrame) -> DataFrame:
    """Live relations waiting for an assignment."""
    return relation.where(not_deleted() & is_backlog())


def backlog_counts(relation: DataFrame) -> DataFrame:
    """The backlog by date alone, by date and owner, and where the two disagree."""
    return relation.where(not_deleted()).agg(
        count_where(~is_assigned()).alias("nb_undated"),
        count_where(is_backlog()).alias("nb_backlog"),
        count_where(~is_assigned() & has_owner()).alias("nb_undated_with_owner"),
    )
