"""The repairs, and the report that adds them up.

Order: end dates first, then relations with one change, then relations without
history, and what is left is lost. ``repair_end_dates`` and
``same_day_duplicates`` are rules of our own; no other query applies them unless
it is handed their result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tenure.functions.predicates import (
    LOST,
    RULES,
    LogRules,
    is_assigned,
    is_first_owner_row,
    is_owner_change,
    is_owner_row,
    is_to_fix,
    not_deleted,
)
from tenure.operators.intervals import CHANGE, END, START, end_time, time_type
from tenure.operators.line import line
from tenure.operators.sequence import with_next_assignment
from tenure.operators.skew import account_lookup, lookup_join, only_accounts_to_fix, repeated
from tenure.plans.counts import to_fix
from tenure.plans.log import unchanged_accounts
from tenure.plans.windows import attributions

BY_CHANGE, BY_FIRST_OWNER, NOT_FOUND = "owner_change", "first_owner", "lost"


def _holds(condition: Column) -> Column:
    """Null counts as no, so that a condition and its opposite cover all rows."""
    return F.coalesce(condition, F.lit(False))


def same_day_duplicates(relation: DataFrame) -> DataFrame:
    """Ids of relations created on the same account on the same day."""
    on = ["account_id", "created_on"]
    crowded = (
        relation.where(F.col("account_id").isNotNull() & F.col("created_on").isNotNull())
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(*on)
    )
    dated = relation.select("id", *on)
    return lookup_join(dated, crowded, on, "left_semi").select("id")


def repair_end_dates(relation: DataFrame) -> DataFrame:
    """A missing end becomes the start of the account's next live relation.

    Same columns as ``relation`` and ``end_repaired``, true where the end was
    filled. The last relation of an account stays open.
    """
    in_line = _holds(not_deleted() & is_assigned() & F.col("account_id").isNotNull())
    kind = relation.schema["ended_at"].dataType
    missing = F.col("ended_at").isNull() & F.col("next_at").isNotNull()
    return with_next_assignment(relation, in_line).select(
        *(c for c in relation.columns if c != "ended_at"),
        F.coalesce("ended_at", F.col("next_at").cast(kind)).alias("ended_at"),
        missing.alias("end_repaired"),
    )


def _with_user(owners: DataFrame, users: DataFrame) -> DataFrame:
    """Add the active user of that name; none is picked when there are several."""
    named = (
        users.where(F.col("is_active") & F.col("name").isNotNull())
        .groupBy(F.col("name").alias("new_owner"))
        .agg(F.count("id").alias("n_active_users"), F.min("id").alias("user_id"))
    )
    return lookup_join(owners, named, "new_owner", "left").select(
        "id",
        "account_id",
        "new_owner",
        F.when(F.col("n_active_users") == 1, F.col("user_id")).alias("owner_id"),
        F.coalesce("n_active_users", F.lit(0)).alias("n_active_users"),
    )


def resolve_single_change(
    relation: DataFrame,
    history: DataFrame,
    users: DataFrame,
    excluded: DataFrame | None = None,
    rules: LogRules = RULES,
    end_of_day: bool = False,
) -> DataFrame:
    """Rule 1: a relation to fix with one change gets the owner it changed to."""
    single = _single_owners(relation, history, excluded, rules, end_of_day)
    return _with_user(single, users)


def _single_owners(relation, history, excluded, rules, end_of_day) -> DataFrame:
    return (
        attributions(relation, history, excluded, rules, end_of_day)
        .where(F.col("n_changes") == 1)
        .select("id", "account_id", F.col("last_value").alias("new_owner"))
    )


def first_recorded_owner(
    relation: DataFrame,
    history: DataFrame,
    users: DataFrame,
    rules: LogRules = RULES,
) -> DataFrame:
    """Rule 2: without history, the oldest owner the log names for the account."""
    needed = only_accounts_to_fix(history, relation)
    owners = unchanged_accounts(needed, rules).select(
        "account_id", F.col("first_owner").alias("new_owner")
    )
    found = account_lookup(to_fix(relation).select("id", "account_id"), owners, "inner")
    return _with_user(found, users)


@dataclass(frozen=True)
class Watch:
    """What a repair sees of its input while it runs; read it after the query has run.

    ``status`` counts the relations to fix: those without an account, with a period that ends
    before it starts, with several changes, and rows that agree with another in account, id
    and period. ``relations`` and ``repaired`` count the rows that go into and come out of
    ``mark_lost``: where ids are repeated, more come out.
    """

    status: Observation = field(default_factory=Observation)
    relations: Observation = field(default_factory=Observation)
    repaired: Observation = field(default_factory=Observation)


def repair_status(
    relation: DataFrame,
    history: DataFrame,
    excluded: DataFrame | None = None,
    rules: LogRules = RULES,
    repair_ends: bool = True,
    end_of_day: bool = False,
    watch: Watch | None = None,
) -> DataFrame:
    """What becomes of each relation to fix.

    ``has_history`` tells whether the account has a real change at all,
    ``new_owner`` is the owner found, ``status`` the rule that found it. ``watch`` counts
    along, without a job of its own.
    """
    found = _account_line(relation, history, rules, repair_ends, end_of_day)
    if watch is not None:
        found = found.observe(
            watch.status,
            F.count(F.lit(1)).alias("n_to_fix"),
            F.count_if(F.col("account_id").isNull()).alias("n_without_account"),
            F.count_if(F.col("ended_at") < F.col("assigned_at")).alias("n_inverted"),
            F.count_if(F.col("n_changes") > 1).alias("n_ambiguous"),
            F.sum(F.col("copies") - 1).alias("n_repeated"),
        )
    found = repeated(found, "copies")
    may_change = F.lit(True)
    if excluded is not None:
        # A missing id is not known to be outside the list.
        listed = excluded.select("id").distinct().withColumn("listed", F.lit(True))
        found = lookup_join(found, listed, "id", "left")
        may_change = F.col("id").isNotNull() & F.col("listed").isNull()
    has_history = F.col("n_account") > 0
    by_change = F.when(may_change & (F.col("n_changes") == 1), F.col("last_value"))
    first_owner = F.when(~has_history, F.col("first_owner"))
    status = (
        F.when(by_change.isNotNull(), BY_CHANGE)
        .when(first_owner.isNotNull(), BY_FIRST_OWNER)
        .otherwise(NOT_FOUND)
    )
    return found.select(
        "id",
        "account_id",
        has_history.alias("has_history"),
        status.alias("status"),
        F.coalesce(by_change, first_owner).alias("new_owner"),
    )


# A relation's last point, behind all dates: what is known of the whole account.
WHOLE = END + 1


def _account_line(
    relation: DataFrame, history: DataFrame, rules: LogRules, repair_ends: bool, end_of_day: bool
) -> DataFrame:
    """All that the log tells of each relation to fix, from one line per account.

    ``n_changes`` and ``last_value``: the changes in its period and the last of them.
    ``n_account`` and ``first_owner``: those of the account, and its oldest first owner, ties by
    name. ``copies`` says how many relations agree in account, id and period.
    """
    live = relation.where(not_deleted() & is_assigned()).select(
        "id", "account_id", "is_deleted", "assigned_at", "ended_at", "owner"
    )
    timed = to_fix(repair_end_dates(live) if repair_ends else live)
    time = time_type(history, timed)
    start, end = F.col("assigned_at").cast(time), end_time(time, end_of_day)
    none = F.lit(None)

    def point(at: Column, kind: int) -> Column:
        return F.struct(at.cast(time).alias("at"), F.lit(kind).alias("kind"))

    dated = F.when(end.isNotNull() & (end >= start), point(end, END))
    relations = timed.select(
        "account_id",
        "id",
        "assigned_at",
        "ended_at",
        F.inline(F.array_compact(F.array(point(start, START), dated, point(none, WHOLE)))),
        F.col("id").alias("tie"),
        F.lit(0).cast("long").alias("n"),
    )
    is_change = F.coalesce(is_owner_change(rules), F.lit(False))
    told = F.col("account_id").isNotNull() & F.col("changed_at").isNotNull()
    entries = history.where(is_owner_row(rules) & told).select(
        "account_id",
        F.col("changed_at").cast(time).alias("at"),
        F.lit(CHANGE).alias("kind"),
        F.col("old_value").alias("tie"),
        F.xxhash64("new_value").alias("spread"),
        is_change.cast("long").alias("n"),
        F.when(is_change, F.col("new_value")).alias("value"),
        F.when(is_first_owner_row(rules), F.col("old_value")).alias("first"),
    )
    points = entries.unionByName(relations, allowMissingColumns=True)
    order = [F.asc_nulls_last("at"), "kind", "tie", "spread"]
    ends = line(
        points.withColumn("is_end", F.col("kind") != CHANGE), ["account_id"], order
    ).rows("is_end")

    def at(kind: int, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    is_open = F.col("ended_at").isNull()
    return (
        ends.groupBy("account_id", "id", "assigned_at", "ended_at")
        .agg(
            at(START, "run").alias("before"),
            at(END, "run").alias("upto"),
            at(END, "last").alias("at_end"),
            at(WHOLE, "run").alias("n_account"),
            at(WHOLE, "last").alias("at_last"),
            at(WHOLE, "first").alias("first_owner"),
            F.count_if(F.col("kind") == WHOLE).alias("copies"),
        )
        .select(
            "account_id",
            "id",
            "n_account",
            "first_owner",
            (F.when(is_open, F.col("n_account")).otherwise(F.col("upto")) - F.col("before")).alias("n_changes"),
            F.when(is_open, F.col("at_last")).otherwise(F.col("at_end")).alias("last_value"),
            "assigned_at",
            "ended_at",
            "copies",
        )
    )


def mark_lost(relation: DataFrame, status: DataFrame, watch: Watch | None = None) -> DataFrame:
    """All relations with their repaired owner; to fix and not found: ``LOST``.

    ``status`` is the result of ``repair_status``. ``status`` is null for the
    relations that needed no repair, which are passed on as they are.
    """
    columns = relation.columns
    if watch is not None:
        relation = relation.observe(watch.relations, F.count(F.lit(1)).alias("n"))
    needs = _holds(is_to_fix())
    found = status.select(
        F.col("id").alias("_id"), "status", F.coalesce("new_owner", F.lit(LOST)).alias("_found")
    )
    joined = lookup_join(relation.withColumn("_id", F.when(needs, F.col("id"))), found, "_id", "left")
    owner = F.when(needs, F.col("_found")).otherwise(F.col("owner"))
    repaired = joined.withColumn("owner", owner).select(*columns, "status")
    if watch is not None:
        repaired = repaired.observe(watch.repaired, F.count(F.lit(1)).alias("n"))
    return repaired


def repair_funnel(status: DataFrame) -> DataFrame:
    """Relations to fix by history and outcome; the rows add up to all of them."""
    return status.groupBy("has_history", "status").agg(F.count(F.lit(1)).alias("n_relations"))
