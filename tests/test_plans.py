"""The physical plans: what reaches the scan, what is shuffled, what is not joined."""

import re

import pytest

import __spark_entry__ as entry
import oracle_queries
from conftest import day
from pyspark.sql import functions as F

from tenure.operators import intervals, line
from tenure.plans import counts, log, repair, windows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def tables(make, tmp_path, spark):
    """Two Parquet tables and a session that never broadcasts by size."""
    make.relations({"id": "r", "start": day("01-01")}).write.parquet(str(tmp_path / "r"))
    make.history((1, day("01-02"), "A", "B")).write.parquet(str(tmp_path / "h"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.read.parquet(str(tmp_path / "r")), spark.read.parquet(str(tmp_path / "h"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text, *keys):
    named = r"#\d+L?, ".join(keys)
    return len(re.findall(rf"Exchange hashpartitioning\({named}#\d+L?, \d+\)", text))


def test_filters_and_columns_reach_the_scan(tables):
    text = plan(counts.owner_change_accounts(tables[1]))
    for pushed in (
        "EqualTo(field,Owner)",
        "Not(StringStartsWith(old_value,0053X))",
        "Not(EqualTo(new_value,Outbound Database))",
        "Not(StringContains(new_value,Reassignment))",
    ):
        assert pushed in text
    scan = plan(counts.unresolved_relations(tables[0]))
    for pushed in ("Not(EqualTo(is_deleted,true))", "IsNotNull(assigned_at)", "IsNull(owner)"):
        assert pushed in scan
    assert "ended_at" not in scan and "created_on" not in scan


def executed(df):
    """The lines of the plan as it was run, without what was reused."""
    df._jdf.collectToPython()
    text = plan(df).split("== Initial Plan ==")[0]
    return [row for row in text.split("\n") if "ReusedExchange" not in row]


def scans(rows, table):
    return sum("FileScan parquet" in row and f"/{table}" in row for row in rows)


def moved(rows, kind=r"hash|range|Single"):
    return sum(bool(re.search(rf"Exchange ({kind})", row)) for row in rows)


@pytest.mark.parametrize(
    ("name", "relations", "logs", "shuffles"),
    [
        ("changes_per_relation", 2, 1, 4),
        ("single_change_relations", 2, 1, 4),
        ("relation_changes", 1, 1, 5),
        ("owner_agreement", 1, 1, 4),
        ("changes_after_end_repair", 2, 1, 6),
        ("repair_end_dates", 1, 0, 2),
        ("repair_status", 1, 1, 6),
        ("mark_lost", 2, 1, 8),
        ("resolve_single_change", 2, 1, 5),
        ("first_owner_candidates", 2, 1, 5),
        ("first_recorded_owner", 2, 1, 4),
        ("first_owner_evidence", 2, 2, 6),
        ("first_owner_agreement", 1, 2, 4),
    ],
)
def test_executed_plans_read_little_and_move_little(spark, name, relations, logs, shuffles):
    rows = executed(entry.queries()[name](spark, FOLDER))
    assert scans(rows, "relation") <= relations and scans(rows, "owner_history") <= logs
    assert moved(rows) <= shuffles


@pytest.mark.parametrize(
    ("name", "lines"),
    [("changes_per_relation", 1), ("relation_changes", 1), ("owner_agreement", 1), ("repair_status", 2)],
)
def test_both_readers_of_a_line_share_its_exchange(spark, name, lines):
    assert moved(executed(entry.queries()[name](spark, FOLDER)), "range") == lines


def test_a_line_whose_cuts_differ_is_an_error(spark, make, monkeypatch):
    points = spark.range(2000).selectExpr(
        "id % 2 k", "id at", "1L n", "string(id) value", "string(null) first"
    )
    right = line.line(points, ["k"], ["at"])
    assert right.rows().where("run != 1 + at div 2").count() == 0
    other = line.line(points.where("id != 0"), ["k"], ["at"])._carried()
    monkeypatch.setattr(line.Line, "_carried", lambda self: other)
    with pytest.raises(Exception, match="cuts of a line differ"):
        right.rows().collect()


@pytest.fixture
def eight_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("one_instant", [False, True])
def test_a_hot_day_of_one_account_is_spread(spark, eight_parts, one_instant):
    n = 100_000
    second = "0" if one_instant else "id % 40000"
    at = f"timestamp_ntz'2021-05-05' + make_dt_interval(0, 0, 0, {second})"
    relation = spark.range(n).selectExpr(
        "concat('r', id) id", "1L account_id", "false is_deleted", f"{at} assigned_at",
        "cast(null as timestamp_ntz) ended_at", "cast(null as string) owner",
    )
    history = spark.range(n).selectExpr(
        "1L account_id", f"{at} changed_at", "'Owner' field", "concat('a', id) old_value",
        "concat('b', id) new_value",
    )
    changes = counts.owner_changes(history)
    time = intervals.time_type(changes, relation)
    points = intervals.change_points(changes, time).unionByName(
        intervals.relation_points(relation, time), allowMissingColumns=True
    )
    spread = intervals.time_line(points, ["account_id"]).spread
    sizes = sorted(r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    found = intervals.count_in_window(relation, changes)
    got = found.agg(F.count("id"), F.sum("n_changes"), F.min("n_changes")).first()
    if one_instant:
        assert tuple(got) == (n, n * n, n)
    else:
        per = [3 if s < 20_000 else 2 for s in range(40_000)]
        tail, total = 0, 0
        for own in reversed(per):
            tail += own
            total += own * tail
        assert tuple(got) == (n, total, 2)


def test_building_a_plan_runs_no_job(tables, spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "building")
    plan(repair.mark_lost(tables[0], repair.repair_status(*tables)))
    plan(windows.relation_changes(*tables))
    assert list(tracker.getJobIdsForGroup("plans")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_pairs_meet_by_block_of_changes(tables):
    text = plan(windows.relation_changes(*tables))
    assert re.search(r"SortMergeJoin\(?.*\[account_id#\d+L?, block#", text)
    assert shuffles(text, "account_id", "block") == 2


def test_names_are_counted_before_they_meet_owners(tables, make):
    text = plan(repair.first_recorded_owner(*tables, make.users(("u", "A", True))))
    assert "Aggregate" not in text[: text.index("Join")]


def test_history_is_counted_before_it_meets_relations(tables):
    text = plan(log.to_fix_with_history(*tables))
    join = text[text.index("Join") :]
    assert "HashAggregate(keys=[account_id" in join
    assert shuffles(text, "account_id") >= 1


@pytest.mark.parametrize("name", oracle_queries.oracle_sql())
def test_no_query_tries_all_pairs(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
