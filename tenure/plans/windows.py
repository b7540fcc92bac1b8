"""Relations against the owner changes inside their own period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.predicates import (
    RULES,
    LogRules,
    count_where,
    has_owner,
    is_assigned,
    not_deleted,
    on_account,
    relation_in,
)
from tenure.operators.intervals import (
    change_points,
    changes_in_window,
    count_in_window,
    per_relation,
    relation_points,
    time_line,
    time_type,
)
from tenure.operators.skew import account_lookup, only_accounts_to_fix
from tenure.plans.counts import owner_changes, to_fix


def relation_changes(
    relation: DataFrame,
    history: DataFrame,
    rules: LogRules = RULES,
    end_of_day: bool = False,
) -> DataFrame:
    """Every live, assigned relation beside each change in its period."""
    live = relation.where(not_deleted() & is_assigned())
    return changes_in_window(live, owner_changes(history, rules), end_of_day)


def owner_agreement(
    relation: DataFrame,
    history: DataFrame,
    rules: LogRules = RULES,
    end_of_day: bool = False,
) -> DataFrame:
    """Owned relations with a change in their period, and changes to their owner.

    ``total`` counts relations and ``lar_owner_is_account_owner`` counts changes,
    so their quotient is no rate; ``nb_lars_matching`` counts the relations with
    at least one such change. A line has a lane for all changes of an account and one for
    those to each owner; every point is on the first and on that of its owner.
    """
    owned = relation.where(not_deleted() & is_assigned() & has_owner())
    changes = owner_changes(history, rules)
    time = time_type(changes, owned)

    def in_lanes(points: DataFrame, owner: str) -> DataFrame:
        lanes = F.array(F.lit(None).cast("string"), F.col(owner))
        return points.withColumn("lane", F.explode(lanes))

    points = in_lanes(change_points(changes, time), "value").unionByName(
        in_lanes(relation_points(owned, time, end_of_day, ("owner",)), "owner"),
        allowMissingColumns=True,
    )
    on = ["account_id", "lane"]
    found = per_relation(time_line(points, on).rows("is_end"), [*on, "id"])
    to_owner = F.col("lane").isNotNull()
    return found.agg(
        F.count_if(~to_owner).alias("total"),
        F.sum(F.when(to_owner, F.col("n_changes")).otherwise(0)).alias("lar_owner_is_account_owner"),
        F.count_if(to_owner).alias("nb_lars_matching"),
    )


def attributions(
    relation: DataFrame,
    history: DataFrame,
    excluded: DataFrame | None = None,
    rules: LogRules = RULES,
    end_of_day: bool = False,
    among: DataFrame | None = None,
) -> DataFrame:
    """Relations to fix with a change in their period: how many, and the last one.

    Excluded relations are taken out of the counted ones, which are fewer. ``among`` is the
    table that ``relation`` was derived from, if it was: it has the same accounts to fix and
    is read with less work.
    """
    needed = only_accounts_to_fix(history, relation if among is None else among)
    changes = owner_changes(needed, rules)
    counted = count_in_window(to_fix(relation), changes, end_of_day).select(
        "id", "account_id", "n_changes", "last_value"
    )
    if excluded is None:
        return counted
    # A missing id is not known to be outside the list, so it goes, too.
    return counted.where(F.col("id").isNotNull()).join(excluded.select("id"), "id", "left_anti")


def changes_per_relation(relation, history, excluded=None, **options) -> DataFrame:
    """Changes in the period of each relation to fix that has any."""
    return attributions(relation, history, excluded, **options).select(
        "id", F.col("n_changes").alias("nb_attribution")
    )


def change_count_buckets(relation, history, excluded=None, **options) -> DataFrame:
    """How many relations to fix have one, two, three or more changes."""
    n = F.col("n_changes")
    return attributions(relation, history, excluded, **options).agg(
        F.count("id").alias("n_relations"),
        count_where(n == 1).alias("nb_one_assignment"),
        count_where(n == 2).alias("nb_two_assignments"),
        count_where(n == 3).alias("nb_three_assignments"),
        count_where(n > 3).alias("nb_more_than_three_assignments"),
    )


def single_change_relations(relation, history, excluded=None, **options) -> DataFrame:
    """Relations to fix with exactly one change: safe to repair."""
    return (
        attributions(relation, history, excluded, **options)
        .where(F.col("n_changes") == 1)
        .select(F.col("id").alias("lar_id"))
    )


def _ambiguous(relation, history, excluded, options) -> DataFrame:
    return attributions(relation, history, excluded, **options).where(F.col("n_changes") > 1)


def ambiguous_relations(relation, history, excluded=None, **options) -> DataFrame:
    """Relations to fix with more than one change."""
    return _ambiguous(relation, history, excluded, options).select(F.col("id").alias("lar_id"))


def ambiguous_sample(relation, history, excluded=None, size: int = 20, **options) -> DataFrame:
    """The first ``size`` ambiguous relations, to look at by hand."""
    return (
        ambiguous_relations(relation, history, excluded, **options).orderBy("lar_id").limit(size)
    )


def ambiguous_accounts(relation, history, excluded=None, **options) -> DataFrame:
    """Accounts of the ambiguous relations; ids are unique, so no join back."""
    return _ambiguous(relation, history, excluded, options).select("account_id").distinct()


def ambiguous_account_audit(
    relation: DataFrame,
    history: DataFrame,
    excluded: DataFrame | None = None,
    **options,
) -> DataFrame:
    """All relations of the ambiguous accounts, deleted ones too, in time order."""
    accounts = ambiguous_accounts(relation, history, excluded, **options)
    periods = relation.select("account_id", "id", "assigned_at", "ended_at", "owner")
    return account_lookup(periods, accounts, "left_semi").orderBy(
        "account_id", F.asc_nulls_last("assigned_at"), "id"
    )


def accounts_of_relations(relation: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Accounts of the given relations, deleted ones too.

    ``ids`` is a list, or a DataFrame whose only column holds the ids.
    """
    if isinstance(ids, DataFrame):
        named = ids.select(F.col(ids.columns[0]).alias("id"))
        chosen = relation.join(named, "id", "left_semi")
    else:
        chosen = relation.where(relation_in(ids))
    return chosen.select("account_id").distinct()


def account_timeline(relation: DataFrame, account) -> DataFrame:
    """All relations of one account, newest first; those without date lead.

    ``account`` is a value, or a one-row DataFrame with an ``account_id``.
    """
    if isinstance(account, DataFrame):
        chosen = relation.join(account.select("account_id"), "account_id", "left_semi")
    else:
        chosen = relation.where(on_account(account))
    return chosen.select("id", "account_id", "assigned_at", "ended_at", "owner").orderBy(
        F.desc_nulls_first("assigned_at"), "id"
    )
