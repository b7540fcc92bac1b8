"""Hand-made rows with literal answers: nulls, pools, ties, names, repairs."""

import datetime as dt
from collections import Counter

import pytest
from conftest import day
from pyspark.sql import functions as F

from tenure.functions.predicates import LogRules
from tenure.operators.skew import expand_join, lookup_join
from tenure.plans import counts, log, repair, windows

JAN, FEB = day("01-01"), day("02-01")


def one(**fields):
    return {"id": "r", "start": JAN, "end": FEB, **fields}


# --- the log -----------------------------------------------------------------


def test_what_is_an_owner_change(make, rows):
    history = make.history(
        (1, JAN, "A", "B"),
        (2, JAN, None, "B"),
        (3, JAN, "A", None),
        (4, JAN, "A", "A"),
        (5, JAN, "A", "Outbound Database"),
        (6, JAN, "A", "Old Reassignment Pool"),
        (7, JAN, "A", "outbound database"),
        (8, JAN, "Outbound Database", "B"),
        (9, JAN, "0053X1", "0053X2"),
        (10, JAN, "Status", "A", "B"),
        (11, JAN, "A", "x reassignment"),
    )
    assert [r[0] for r in rows(counts.owner_changes(history))] == [1, 11, 7, 8]
    assert rows(counts.owner_change_accounts(history)) == [(4,)]
    assert [r[0] for r in rows(log.first_owner_rows(history))] == [1, 11, 3, 4, 5, 6, 7]


def test_the_spellings_are_parameters(make, rows):
    rules = LogRules("Keeper", "ID-", "Shelf", "Queue")
    history = make.history(
        (1, JAN, "Keeper", "A", "B"),
        (2, JAN, "Keeper", "A", "Shelf"),
        (3, JAN, "Keeper", "A", "My Queue"),
        (4, JAN, "Keeper", "ID-1", "ID-2"),
        (5, JAN, "Owner", "A", "B"),
    )
    assert [r[0] for r in rows(counts.owner_changes(history, rules))] == [1]


# --- counts of relations -----------------------------------------------------


def test_an_unknown_deletion_drops_the_relation(make, rows):
    relation = make.relations(
        one(id="a", deleted=None), one(id="b", deleted=True), one(id="c", end=None),
        one(id="d", owner="A"), one(id="e", start=None, end=None),
        one(id="f", start=None, end=None, owner="A"),
    )
    history = make.history((1, day("01-05"), "A", "B"), (1, day("01-06"), "B", "C"))
    assert rows(counts.relation_counts(relation)) == [(4, 2, 1)]
    assert rows(counts.backlog_counts(relation)) == [(2, 1, 1)]
    assert rows(counts.backlog(relation), "id") == [("e",)]
    assert rows(counts.unresolved_relations(relation)) == [("c",)]
    assert rows(windows.changes_per_relation(relation, history)) == [("c", 2)]
    assert rows(windows.accounts_of_relations(relation, ["a", "b"])) == [(1,)]
    assert rows(windows.account_timeline(relation, 1), "id") == [(x,) for x in "abcdef"]
    audit = windows.ambiguous_account_audit(relation, history)
    assert rows(audit, "id") == [(x,) for x in "abcdef"]


def test_empty_tables_give_zero_counts_and_null_sums(make, rows):
    relation, history = make.relations(), make.history()
    assert rows(counts.relation_counts(relation)) == [(0, None, None)]
    assert rows(windows.change_count_buckets(relation, history)) == [
        (0, None, None, None, None)
    ]
    assert rows(windows.owner_agreement(relation, history)) == [(0, None, 0)]
    assert rows(log.to_fix_with_history(relation, history)) == [(0, 0)]
    assert rows(log.to_fix_without_history(relation, history)) == [(0,)]


def test_buckets(make, rows):
    relation = make.relations(*(one(id=f"r{n}", account=n) for n in range(1, 6)))
    history = make.history(
        *((n, day(f"01-0{i}"), "A", "B") for n in range(1, 6) for i in range(1, n + 1))
    )
    assert rows(windows.change_count_buckets(relation, history)) == [(5, 1, 1, 1, 2)]


def test_a_relation_without_account_has_no_history(make, rows):
    relation = make.relations(one(id="a", account=None), one(id="b"))
    history = make.history((1, day("01-05"), "A", "B"), (2, day("01-05"), "A", "B"))
    assert rows(log.to_fix_without_history(relation, history)) == [(1,)]
    assert rows(log.to_fix_with_history(relation, history)) == [(1, 1)]
    status = repair.repair_status(relation, history)
    assert rows(status, "id", "has_history", "status") == [
        ("a", False, "lost"), ("b", True, "owner_change"),
    ]


def test_excluded_relations_are_left_out_but_audited(make, rows, spark):
    relation = make.relations(one(id="a"), one(id="b"))
    history = make.history((1, day("01-05"), "A", "B"), (1, day("01-06"), "B", "C"))
    x = spark.createDataFrame([("a",)], "id string")
    assert rows(windows.changes_per_relation(relation, history, x)) == [("b", 2)]
    assert rows(windows.single_change_relations(relation, history, x)) == []
    assert rows(windows.ambiguous_sample(relation, history, x)) == [("b",)]
    assert rows(windows.change_count_buckets(relation, history, x)) == [(1, 0, 1, 0, 0)]
    audit = windows.ambiguous_account_audit(relation, history, x)
    assert rows(audit, "id") == [("a",), ("b",)]


def test_orders_are_written_out(make):
    relation = make.relations(
        one(id="b", start=None, end=None), one(id="a", start=FEB, end=None),
        one(id="c"), one(id="d", account=2),
    )
    newest = windows.account_timeline(relation, 1).collect()
    assert [r.id for r in newest] == ["b", "a", "c"]
    history = make.history((1, day("01-05"), "A", "B"), (1, day("01-06"), "B", "C"))
    audit = windows.ambiguous_account_audit(relation, history).collect()
    assert [r.id for r in audit] == ["c", "a", "b"]


def test_owner_agreement_counts_relations_and_changes(make, rows):
    relation = make.relations(one(id="a", owner="B"), one(id="b", owner="Z"), one(id="c"))
    history = make.history(
        (1, day("01-05"), "A", "B"), (1, day("01-06"), "C", "B"), (1, day("01-07"), "B", "C")
    )
    assert rows(windows.owner_agreement(relation, history)) == [(2, 2, 1)]


# --- first owners ------------------------------------------------------------


def test_first_owner_queries(make, rows):
    relation = make.relations(
        one(id="fix"), one(id="owned", owner="A", start=None, end=None),
        one(id="other", owner="Q"), one(id="changed", account=2), one(id="silent", account=3),
    )
    history = make.history(
        (1, FEB, "B", "Outbound Database"),
        (1, JAN, "A", None),
        (1, day("01-15"), "Outbound Database", "Reassignment Pool"),
        (2, JAN, "A", "B"),
    )
    users = make.users(("u1", "A", True), ("u2", "B", False))
    assert rows(log.first_owner_candidates(relation, history, users)) == [
        ("fix", "A", "u1"), ("fix", "B", None),
    ]
    assert rows(repair.first_recorded_owner(relation, history, users)) == [
        ("fix", 1, "A", "u1", 1)
    ]
    assert rows(log.first_owner_recoverable(relation, history)) == [(1,)]
    evidence = log.first_owner_evidence(relation, history)
    assert rows(evidence, "id", "owner", "old_value") == [
        ("other", "Q", "A"), ("other", "Q", "B"), ("owned", "A", "A"), ("owned", "A", "B"),
    ]
    assert rows(log.first_owner_agreement(relation, history)) == [(4, 1, 2, 1)]


def test_the_oldest_owner_wins_and_ties_go_by_name(make, rows):
    relation = make.relations(one())
    history = make.history((1, JAN, "Z", None), (1, JAN, "M", None), (1, FEB, "A", None))
    users = make.users(("u", "M", False))
    assert rows(repair.first_recorded_owner(relation, history, users)) == [
        ("r", 1, "M", None, 0)
    ]


def test_two_active_users_of_one_name_are_flagged(make, rows):
    relation = make.relations(one(), one(id="s", account=2))
    history = make.history((1, JAN, "A", None), (2, day("01-05"), "B", "A"))
    users = make.users(("u1", "A", True), ("u2", "A", True), ("u3", "A", False))
    assert rows(log.first_owner_candidates(relation, history, users)) == [
        ("r", "A", "u1"), ("r", "A", "u2"),
    ]
    assert rows(repair.first_recorded_owner(relation, history, users)) == [
        ("r", 1, "A", None, 2)
    ]
    assert rows(repair.resolve_single_change(relation, history, users)) == [
        ("s", 2, "A", None, 2)
    ]


def test_identical_log_rows_keep_their_number(make, rows):
    relation = make.relations(*(one(id=f"r{i}") for i in range(4)))
    history = make.history(*[(1, JAN, "A", None)] * 5)
    found = log.first_owner_candidates(relation, history, make.users())
    assert len(rows(found)) == 20


# --- repairs -----------------------------------------------------------------


def test_missing_ends_become_the_next_start(make, rows):
    relation = make.relations(
        one(id="a", end=None), one(id="b", start=JAN, end=None),
        one(id="c", start=FEB, end=day("02-02")), one(id="d", start=day("03-01"), end=None),
        one(id="x", start=day("01-10"), end=None, deleted=True),
        one(id="y", start=None, end=None), one(id="z", account=None, end=None),
        one(id="n", start=day("01-11"), end=None, deleted=None),
    )
    repaired = repair.repair_end_dates(relation)
    assert rows(repaired, "id", "ended_at", "end_repaired") == [
        ("a", JAN, True), ("b", FEB, True), ("c", day("02-02"), False), ("d", None, False),
        ("n", None, False), ("x", None, False), ("y", None, False), ("z", None, False),
    ]


def test_same_day_duplicates(make, rows):
    first, second = dt.date(2021, 1, 1), dt.date(2021, 1, 2)
    relation = make.relations(
        one(id="a", created=first), one(id="b", created=first), one(id="c", created=second),
        one(id="d", account=2, created=first),
        one(id="e", account=None, created=first), one(id="f", account=None, created=first),
    )
    assert rows(repair.same_day_duplicates(relation)) == [("a",), ("b",)]


def test_repair_end_to_end(make, rows):
    relation = make.relations(
        one(id="one", end=None),
        one(id="next", start=FEB, end=day("02-10"), owner="K"),
        one(id="first", account=2),
        one(id="lost", account=3),
        one(id="many", account=4),
        one(id="gone", account=5, deleted=True),
        one(id="odd", account=5, deleted=None),
        one(id="wait", account=6, start=None, end=None),
    )
    history = make.history(
        (1, day("01-05"), "A", "B"), (1, day("03-05"), "B", "C"),
        (2, JAN, "F", "Outbound Database"),
        (4, day("01-05"), "A", "B"), (4, day("01-06"), "B", "C"),
    )
    status = repair.repair_status(relation, history)
    assert rows(status) == [
        ("first", 2, False, "first_owner", "F"),
        ("lost", 3, False, "lost", None),
        ("many", 4, True, "lost", None),
        ("one", 1, True, "owner_change", "B"),
    ]
    assert rows(repair.mark_lost(relation, status), "id", "owner", "status") == [
        ("first", "F", "first_owner"), ("gone", None, None), ("lost", "LOST", "lost"),
        ("many", "LOST", "lost"), ("next", "K", None), ("odd", None, None),
        ("one", "B", "owner_change"), ("wait", None, None),
    ]
    assert rows(repair.repair_funnel(status)) == [
        (False, "first_owner", 1), (False, "lost", 1), (True, "lost", 1), (True, "owner_change", 1),
    ]
    open_ended = repair.repair_status(relation, history, repair_ends=False)
    assert ("one", 1, True, "lost", None) in rows(open_ended)
    assert rows(counts.unresolved_relations(repair.mark_lost(relation, status))) == []


def test_a_repeated_relation_counts_as_often_as_it_occurs(make, rows):
    relation = make.relations(one(), one(), one(id="s"))
    history = make.history((1, day("01-05"), "A", "B"))
    assert rows(windows.changes_per_relation(relation, history)) == [("r", 2), ("s", 1)]


def test_repeated_ids_keep_their_pairs(make, rows):
    relation = make.relations(
        {"id": "a", "start": day("01-01"), "end": day("01-03"), "owner": "P"},
        {"id": "a", "start": day("01-10"), "end": day("01-12"), "owner": "P"},
        {"id": "b", "start": day("01-10"), "end": day("01-12"), "owner": "P"},
        {"id": "b", "start": day("01-10"), "end": day("01-12"), "owner": "P"},
    )
    history = make.history(*((1, day(d), "A", "P") for d in ("01-02", "01-05", "01-11")))
    pairs = rows(windows.relation_changes(relation, history), "id", "changed_at")
    assert pairs == sorted(
        [("a", day("01-02")), ("a", day("01-11")), ("b", day("01-11")), ("b", day("01-11"))],
        key=repr,
    )


def test_repeated_ids_count_once_as_relations(make, rows):
    owned = {"id": "a", "start": day("01-01"), "owner": "A"}
    relation = make.relations(owned, owned)
    history = make.history((1, day("01-02"), "A", "Reassignment Pool"))
    assert rows(log.first_owner_agreement(relation, history)) == [(2, 2, 1, 1)]


def test_a_missing_id_is_not_outside_a_list(make, rows, spark):
    relation = make.relations(
        {"id": None, "start": day("01-01")}, {"id": "a", "start": day("01-01")}
    )
    history = make.history((1, day("01-02"), "A", "B"))
    excluded = spark.createDataFrame([("z",)], "id string")
    assert rows(windows.changes_per_relation(relation, history, excluded)) == [("a", 1)]
    assert rows(windows.changes_per_relation(relation, history)) == [(None, 1), ("a", 1)][::-1]


def test_one_owner_name_on_all_rows(make, rows):
    relation = make.relations(
        *({"id": f"r{i}", "account": i, "start": day("01-01")} for i in range(30))
    )
    history = make.history(*((i, day("01-02"), "A", "B") for i in range(30)))
    users = make.users(("u1", "B", True), ("u2", "B", False), (None, None, True))
    found = rows(repair.resolve_single_change(relation, history, users), "id", "owner_id")
    assert found == sorted(((f"r{i}", "u1") for i in range(30)), key=repr)


def test_large_keys_are_dealt_into_parts(spark, rows):
    left = spark.range(60).selectExpr("id % 2 as k", "id as a").union(
        spark.sql("select cast(null as long), 1L")
    )
    right = spark.range(40).selectExpr("id % 3 as k", "id as b")
    n_rows = left.groupBy("k").count().withColumnRenamed("count", "n_left").join(
        right.groupBy("k").count().withColumnRenamed("count", "n_right"), "k"
    )
    dealt = expand_join(left, right, "k", n_rows, pairs=50)
    assert rows(dealt) == rows(left.join(right, "k"))
    some = expand_join(left, right, "k", n_rows.where("k = 1"), pairs=50)
    assert rows(some) == rows(left.join(right, "k").where("k = 1"))
    tasks = dealt.where("k = 0").selectExpr("spark_partition_id() p").distinct().count()
    assert tasks > 1


@pytest.mark.parametrize(("how", "expected"), [("left", 2000), ("left_anti", 1800)])
def test_rows_without_a_key_are_dealt_out(spark, how, expected):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(2000).selectExpr("if(id % 10 = 0, id, null) AS k", "id")
        right = spark.range(2000).selectExpr("id AS k", "2 * id AS v")
        joined = lookup_join(left, right, "k", how).withColumn("part", F.spark_partition_id())
        found = joined.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r.id for r in found}) == len(found) == expected
    if how == "left":
        assert all(r.v == (None if r.k is None else 2 * r.k) for r in found)
    sizes = Counter(r.part for r in found if r.k is None)
    assert len(sizes) == 8 and max(sizes.values()) < 600
