"""Which changes fall inside a period: every edge on an account of its own.

All cases share one run; literal answers.
"""

import pytest
from conftest import day

from tenure.plans import windows

JAN, FEB, MAR = day("01-01"), day("02-01"), day("03-01")


@pytest.fixture(autouse=True, params=[2, 13], ids=["few cuts", "many cuts"])
def cuts(request, spark):
    """Where an account's line is cut must not matter."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


# name: (start, end, times of changes, inside, inside with end_of_day)
CASES = {
    "both bounds belong": (JAN, FEB, [JAN, FEB], 2, 2),
    "a microsecond outside": (JAN, FEB, [day("01-01", -1), day("02-02")], 0, 0),
    "open end": (JAN, None, [day("01-01", -1), MAR, day("12-31 23:59")], 2, 2),
    "no start": (None, None, [MAR], 0, 0),
    "no start but an end": (None, FEB, [JAN], 0, 0),
    "end before start": (FEB, JAN, [JAN, day("01-15"), FEB], 0, 0),
    "one instant": (FEB, FEB, [FEB, FEB, FEB], 3, 3),
    "later on the last day": (JAN, FEB, [day("02-01 08:00"), day("02-02", -1), day("02-02")], 0, 2),
    "no changes": (JAN, FEB, [], 0, 0),
    "across hours": (
        day("01-01 10:30"), day("01-01 12:10"),
        [day("01-01 10:29"), day("01-01 10:30", 5), day("01-01 11:00"), day("01-01 12:10"),
         day("01-01 12:10", 1)], 3, 4,
    ),
    "a skipped hour of the clock": (
        day("03-14 02:30"), day("03-14 03:10"),
        [day("03-14 01:59"), day("03-14 02:30"), day("03-14 03:10"), day("03-14 03:40")], 2, 3,
    ),
    "before 1970": (day("01-01").replace(year=1969), day("01-03").replace(year=1969),
                    [day("01-02 13:01", 7).replace(year=1969)], 1, 1),
}


@pytest.fixture
def tables(make):
    numbered = list(enumerate(CASES.items(), start=1))
    relation = make.relations(
        *({"id": name, "account": n, "start": c[0], "end": c[1]} for n, (name, c) in numbered),
        # two neighbours that share a bound, and one change on it
        {"id": "left", "account": 100, "start": JAN, "end": FEB},
        {"id": "right", "account": 100, "start": FEB, "end": MAR},
        {"id": "no account", "account": None, "start": JAN, "end": None},
    )
    history = make.history(
        *((n, at, "A", f"P{i}") for n, (_, c) in numbered for i, at in enumerate(c[2])),
        (100, FEB, "A", "B"),
        (200, FEB, "A", "B"),
    )
    return relation, history


def expected(column):
    found = [(name, case[column]) for name, case in CASES.items() if case[column]]
    return sorted([*found, ("left", 1), ("right", 1)], key=repr)


def test_counts(tables, rows):
    assert rows(windows.changes_per_relation(*tables)) == expected(3)


def test_pairs(tables, rows):
    pairs = rows(windows.relation_changes(*tables), "id", "changed_at")
    wanted = [
        (name, at)
        for name, (start, end, times, inside, _) in CASES.items()
        for at in times
        if inside and start <= at and (end is None or at <= end)
    ]
    assert pairs == sorted([*wanted, ("left", FEB), ("right", FEB)], key=repr)


def test_whole_last_day(tables, rows):
    right = ("right", 1)
    got = rows(windows.changes_per_relation(*tables, end_of_day=True))
    assert right in got
    assert got == expected(4)


def test_the_single_change_is_the_one_inside(tables, rows):
    found = windows.attributions(*tables).where("n_changes = 1")
    assert rows(found, "id", "last_value") == [
        ("before 1970", "P0"), ("left", "B"), ("right", "B"),
    ]


def test_dates_count_as_their_midnight(tables, rows):
    relation, history = tables
    relation = relation.where("id in ('both bounds belong', 'later on the last day')").selectExpr(
        "id", "account_id", "is_deleted", "date(assigned_at) assigned_at",
        "date(ended_at) ended_at", "owner",
    )
    assert rows(windows.changes_per_relation(relation, history)) == [
        ("both bounds belong", 2)
    ]
    assert rows(
        windows.changes_per_relation(relation, history, end_of_day=True)
    ) == [("both bounds belong", 2), ("later on the last day", 2)]


def test_zoned_times_follow_instants_through_a_clock_change(spark, rows):
    seconds = [1636261200 + 60 * m for m in (30, 45, 70, 100, 130)]  # 01:30 EDT to 02:10 EST
    history = spark.createDataFrame([(s,) for s in seconds], "s long").selectExpr(
        "1L account_id", "timestamp_seconds(s) changed_at", "'Owner' field",
        "'A' old_value", "'B' new_value",
    )
    relation = spark.sql(
        f"select 'r' id, 1L account_id, false is_deleted,"
        f" timestamp_seconds({seconds[1]}) assigned_at,"
        f" timestamp_seconds({seconds[3]}) ended_at, cast(null as string) owner"
    )
    assert rows(windows.changes_per_relation(relation, history)) == [("r", 3)]
