"""Relations against the whole owner log of their account, whatever the dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.predicates import (
    RULES,
    LogRules,
    has_owner,
    is_first_owner_row,
    is_owner_change,
    is_owner_row,
    not_deleted,
)
from tenure.operators.skew import (
    account_lookup,
    dealt_join,
    expand_join,
    lookup_join,
    only_accounts_to_fix,
    repeated,
)
from tenure.plans.counts import owner_changes, to_fix


def account_log(history: DataFrame, rules: LogRules = RULES) -> DataFrame:
    """One row per account with owner entries, from one pass over the log.

    ``n_changes`` and ``n_first`` count its real changes and its first-owner
    rows; ``first_owner`` is the oldest of the latter, ties broken by name. The
    rows of an account combine on the map side.
    """
    first = is_first_owner_row(rules)
    oldest = F.min(F.when(first, F.struct("changed_at", "old_value")))
    return (
        history.where(is_owner_row(rules) & F.col("account_id").isNotNull())
        .groupBy("account_id")
        .agg(
            F.count_if(is_owner_change(rules)).alias("n_changes"),
            F.count_if(first).alias("n_first"),
            oldest.getField("old_value").alias("first_owner"),
        )
    )


def unchanged_accounts(history: DataFrame, rules: LogRules = RULES) -> DataFrame:
    """Accounts with no real change whose log still names a first owner."""
    return account_log(history, rules).where((F.col("n_changes") == 0) & (F.col("n_first") > 0))


def first_owner_rows(history: DataFrame, rules: LogRules = RULES) -> DataFrame:
    return history.where(is_first_owner_row(rules)).select(
        "account_id", "changed_at", "old_value", "new_value"
    )


def to_fix_with_history(
    relation: DataFrame, history: DataFrame, rules: LogRules = RULES
) -> DataFrame:
    """Pairs of a relation to fix and a change of its account, and the relations.

    The changes are counted per account first, so no pair is ever formed.
    """
    needed = only_accounts_to_fix(history, relation)
    changes = owner_changes(needed, rules).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n_changes")
    )
    found = account_lookup(to_fix(relation).select("id", "account_id"), changes, "inner")
    return found.agg(
        F.coalesce(F.sum("n_changes"), F.lit(0)).alias("tot_nb_lines"),
        F.countDistinct("id").alias("nb_lars_to_fix"),
    )


def without_history(
    relation: DataFrame, history: DataFrame, rules: LogRules = RULES
) -> DataFrame:
    """The given relations whose account shows no real change, or is not known."""
    changed = owner_changes(history, rules).select("account_id").distinct()
    return account_lookup(relation, changed, "left_anti")


def to_fix_without_history(
    relation: DataFrame, history: DataFrame, rules: LogRules = RULES
) -> DataFrame:
    """How many relations to fix have an account without a real change."""
    needed = only_accounts_to_fix(history, relation)
    left = without_history(to_fix(relation).select("id", "account_id"), needed, rules)
    return left.agg(F.countDistinct("id").alias("nb_lars_w_no_history"))


def on_unchanged_accounts(
    relation: DataFrame, history: DataFrame, rules: LogRules = RULES
) -> DataFrame:
    """The given relations that are on unchanged accounts with a first owner."""
    accounts = unchanged_accounts(history, rules).select("account_id")
    return account_lookup(relation, accounts, "left_semi")


def _owned(relation: DataFrame) -> DataFrame:
    """Live relations with an owner, assigned or not."""
    return relation.where(not_deleted() & has_owner()).select("id", "account_id", "owner")


def first_owner_evidence(
    relation: DataFrame, history: DataFrame, rules: LogRules = RULES
) -> DataFrame:
    """Owned relations on unchanged accounts beside what the log says of them.

    The totals of the accounts in question cut both tables down to them and say how many
    pairs there will be.
    """
    owned = _owned(relation)
    n_rows = (
        owned.where(F.col("account_id").isNotNull())
        .groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("n_left"))
        .join(unchanged_accounts(history, rules), "account_id")
        .select("account_id", "n_left", F.col("n_first").alias("n_right"))
    )
    return expand_join(owned, first_owner_rows(history, rules), "account_id", n_rows).select(
        "id", "account_id", "owner", "changed_at", "old_value", "new_value"
    )


def first_owner_agreement(
    relation: DataFrame, history: DataFrame, rules: LogRules = RULES
) -> DataFrame:
    """How often the evidence agrees with the known owner, per row and relation.

    The same figures as counting the rows of ``first_owner_evidence``, from two
    counts per account instead of its rows.
    """
    owned = _owned(relation)
    accounts = unchanged_accounts(history, rules).select("account_id", "n_first")
    values = (
        first_owner_rows(history, rules)
        .groupBy("account_id", F.col("old_value").alias("owner"))
        .agg(F.count(F.lit(1)).alias("n_matching"))
    )
    on_value = ["account_id", "owner"]
    found = lookup_join(
        account_lookup(owned, accounts, "inner"),
        values,
        on_value,
        "left",
    )
    return found.agg(
        F.coalesce(F.sum("n_first"), F.lit(0)).alias("n_rows"),
        F.sum(F.coalesce("n_matching", F.lit(0))).alias("n_rows_matching"),
        F.countDistinct("id").alias("n_relations"),
        F.countDistinct(F.when(F.col("n_matching").isNotNull(), F.col("id"))).alias(
            "n_relations_matching"
        ),
    )


def first_owner_recoverable(
    relation: DataFrame, history: DataFrame, rules: LogRules = RULES
) -> DataFrame:
    """How many relations to fix without history have a first owner in the log."""
    missing = to_fix(relation).select("id", "account_id")
    needed = only_accounts_to_fix(history, relation)
    found = on_unchanged_accounts(missing, needed, rules)
    return found.agg(F.countDistinct("id").alias("n_recoverable"))


def first_owner_candidates(
    relation: DataFrame,
    history: DataFrame,
    users: DataFrame,
    rules: LogRules = RULES,
) -> DataFrame:
    """Every first owner the log offers for a relation to fix without history.

    With the id of each active user of that name, or null. One relation may get
    several rows: one per log row, and one per user of the same name.
    """
    missing = to_fix(relation).where(F.col("account_id").isNotNull()).select("id", "account_id")
    accounts = missing.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_rows"))
    name = F.when(is_first_owner_row(rules), F.col("old_value"))
    # A row per account and name from here on, so the window holds no more than the names.
    offers = (
        history.where(is_owner_row(rules))
        .join(accounts, "account_id")
        .groupBy("account_id", "n_rows", name.alias("old_value"))
        .agg(
            F.count_if(is_owner_change(rules)).alias("n_changes"),
            F.count(F.lit(1)).alias("n_offers"),
        )
        .withColumn("n_changes", F.sum("n_changes").over(Window.partitionBy("account_id")))
        .where((F.col("n_changes") == 0) & F.col("old_value").isNotNull())
        .select("account_id", "n_rows", "old_value", "n_offers")
    )
    active = users.where("is_active").select(
        F.col("name").alias("old_value"), F.col("id").alias("owner_id")
    )
    named = offers.join(active, "old_value", "left")
    found = dealt_join(missing.distinct(), named, "account_id", accounts, "n_rows")
    return repeated(found, "n_offers").select("id", "old_value", "owner_id")
