"""Which log changes fall inside a relation's period, without trying all pairs.

A relation's period is closed on both ends, and open-ended when ``ended_at`` is
null. Put on one time line, the number of changes in it is

    (changes up to the end) - (changes before the start)

so one running count per account answers it in linear time, where a join on the
account would test every change against every relation of that account. At equal
times the order is start, change, end, which makes both ends closed.

The line is cut where the data is (``line``): an account, a day or an instant may hold any
share of the rows.

The running count also numbers the changes of an account. A relation covers a
range of these numbers, so the pairs themselves (``changes_in_window``) come from
an equi-join on blocks of numbers: a relation only meets blocks it has changes in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.functions.predicates import is_assigned
from tenure.operators.line import Line, line
from tenure.operators.skew import repeated

START, CHANGE, END = 0, 1, 2

# Changes per join block, as a power of two. A relation tests at most two blocks
# of changes beyond its own and is copied once per block it spans.
BLOCK_BITS = 9

# Blocks are listed in two steps, so that no array is longer than about this many.
STEP_BITS = 10

# --- points on the time line -------------------------------------------------


def time_type(changes: DataFrame, relation: DataFrame) -> T.DataType:
    """One type for both time lines; a date counts as its midnight."""
    kinds = [
        changes.schema["changed_at"].dataType,
        relation.schema["assigned_at"].dataType,
        relation.schema["ended_at"].dataType,
    ]
    return next((k for k in kinds if not isinstance(k, T.DateType)), T.TimestampNTZType())


def _end_of_day(column: str, time: T.DataType) -> Column:
    """The last microsecond of the day of ``column``."""
    next_midnight = F.date_add(F.to_date(column), 1).cast(time)
    return next_midnight - F.expr("INTERVAL '0.000001' SECOND")


def change_points(
    changes: DataFrame, time: T.DataType, payload: tuple[str, ...] = ()
) -> DataFrame:
    """One point per change, whose ``value`` is the new owner."""
    return changes.where(F.col("account_id").isNotNull() & F.col("changed_at").isNotNull()).select(
        "account_id",
        *payload,
        F.col("changed_at").cast(time).alias("at"),
        F.lit(CHANGE).alias("kind"),
        F.col("new_value").alias("tie"),
        F.xxhash64("old_value").alias("spread"),
        F.lit(1).cast("long").alias("n"),
        F.col("new_value").alias("value"),
    )


def relation_points(
    relation: DataFrame,
    time: T.DataType,
    end_of_day: bool = False,
    payload: tuple[str, ...] = (),
) -> DataFrame:
    """Two points, start and end, per relation that can contain a change."""
    start = F.col("assigned_at").cast(time)
    end = end_time(time, end_of_day)
    return relation.where(
        F.col("account_id").isNotNull() & is_assigned() & (end.isNull() | (end >= start))
    ).select(
        "account_id",
        "id",
        *payload,
        F.inline(
            F.array(
                F.struct(start.alias("at"), F.lit(START).alias("kind")),
                F.struct(end.alias("at"), F.lit(END).alias("kind")),
            )
        ),
        F.col("id").alias("tie"),
        F.lit(0).cast("long").alias("spread"),
        F.lit(0).cast("long").alias("n"),
    )


def end_time(time: T.DataType, end_of_day: bool) -> Column:
    return _end_of_day("ended_at", time) if end_of_day else F.col("ended_at").cast(time)


# At equal times the start comes first and the end last; open ends come after all dates.
ORDER = ["at", "kind", "tie", "spread"]


def time_line(points: DataFrame, on: list[str]) -> Line:
    """The line of start, change and end points; ``last`` is the new owner of the last change,
    of several at one instant the greatest."""
    order = [F.asc_nulls_last("at"), *(F.asc_nulls_first(c) for c in ORDER[1:])]
    return line(
        points.withColumns({"first": F.lit(None).cast("string"), "is_change": F.col("kind") == CHANGE})
        .withColumn("is_end", ~F.col("is_change")),
        on,
        order,
    )


# --- what the queries use ----------------------------------------------------


def count_in_window(
    relation: DataFrame,
    changes: DataFrame,
    end_of_day: bool = False,
    payload: tuple[str, ...] = (),
) -> DataFrame:
    """Relations with at least one change in their period.

    Columns: ``account_id``, ``id``, ``payload``; ``n_changes``; ``before`` and ``upto``, so that the
    relation holds the changes numbered before+1 .. upto of its account; ``copies``, how many
    relations agree in all of that; ``last_value``, the new owner of the last change.
    Relations of one account that share an id and the payload are counted together, as
    grouping their pairs by it would.
    """
    time = time_type(changes, relation)
    points = change_points(changes, time).unionByName(
        relation_points(relation, time, end_of_day, payload), allowMissingColumns=True
    )
    on = ["account_id"]
    return per_relation(time_line(points, on).rows("is_end"), [*on, "id", *payload])


def per_relation(ends: DataFrame, by: list[str]) -> DataFrame:
    """Both ends of each relation side by side, where there are changes between them."""

    def at(kind: int, column: str) -> Column:
        return F.when(F.col("kind") == kind, F.col(column))

    return (
        ends.groupBy(*by)
        .agg(
            (F.sum(at(END, "run")) - F.sum(at(START, "run"))).alias("n_changes"),
            F.max(at(START, "run")).alias("before"),
            F.max(at(END, "run")).alias("upto"),
            F.count(at(START, "run")).alias("copies"),
            F.max(at(END, "last")).alias("last_value"),
        )
        .where(F.col("n_changes") > 0)
    )


def changes_in_window(
    relation: DataFrame, changes: DataFrame, end_of_day: bool = False
) -> DataFrame:
    """Every relation beside each change in its period.

    A relation's ``owner``, ``assigned_at`` and ``ended_at`` come with the change's
    ``changed_at``, ``old_value`` and ``new_value``. The join key is the account and a block of
    change numbers. A block has a bounded number of changes, and a relation is compared
    with what it contains and little else; a block that very many relations span is
    split by Spark like any skewed join.
    """
    on, payload = ["account_id"], ("assigned_at", "ended_at", "owner")
    time = time_type(changes, relation)
    points = change_points(changes, time, ("changed_at", "old_value", "new_value")).unionByName(
        relation_points(relation, time, end_of_day, payload), allowMissingColumns=True
    )
    whole = time_line(points, on)
    first, last = (
        F.shiftright(number, BLOCK_BITS) for number in (F.col("before") + 1, F.col("upto"))
    )
    step = F.shiftleft("step", STEP_BITS)
    spans = (
        per_relation(whole.rows("is_end"), [*on, "id", *payload])
        .drop("n_changes", "last_value")
        .withColumns({"first": first, "final": last})
        .withColumn(
            "step",
            F.explode(
                F.sequence(F.shiftright("first", STEP_BITS), F.shiftright("final", STEP_BITS))
            ),
        )
        .withColumn(
            "block",
            F.explode(
                F.sequence(
                    F.greatest("first", step), F.least("final", step + (1 << STEP_BITS) - 1)
                )
            ),
        )
        .drop("first", "final", "step")
    )
    numbered = (
        whole.rows("is_change")
        .select(*on, "changed_at", "old_value", "new_value", "run")
        .withColumn("block", F.shiftright("run", BLOCK_BITS))
    )
    inside = (F.col("run") > F.col("before")) & (F.col("run") <= F.col("upto"))
    return (
        repeated(spans.join(numbered, [*on, "block"]).where(inside), "copies")
        .select(
            "id",
            "account_id",
            "assigned_at",
            "ended_at",
            "owner",
            "changed_at",
            "old_value",
            "new_value",
        )
    )
