"""Queries over tables derived from the smallest scale factor.

Every registered query against its SQL, heavy against plain paths, the figures
the derived tables must give, and identities the counts must satisfy.
"""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import oracle_queries
from tenure.operators import skew
from tenure.plans import counts, log, repair, windows
from tenure.sources import derived

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def given(spark):
    return entry.inputs(spark, FOLDER)


@pytest.fixture(scope="module")
def results(spark, given):
    """Every registered query's columns and rows, run once."""
    found = {}
    for name in oracle_queries.oracle_sql():
        df = entry.queries()[name](spark, FOLDER)
        found[name] = (df.columns, [tuple(row) for row in df.collect()])
    return found


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", oracle_queries.oracle_sql())
def test_same_as_sql(results, duck, name):
    columns, rows = results[name]
    check = duck.execute(entry.oracle_sql()[name])
    names = [column[0] for column in check.description]
    assert sorted(names) == sorted(columns)
    assert by_name(columns, rows) == by_name(names, check.fetchall())


def test_every_query_has_sql():
    optional = {n for n in entry.queries() if n == "pipeline" or n.startswith("op")}
    assert set(oracle_queries.oracle_sql()) == set(entry.queries()) - optional


def test_entry(spark):
    assert [tuple(row) for row in entry.entry(spark).collect()] == [(168, 37, 40, 23, 68)]


def test_more_cuts_change_nothing(spark, given, results, monkeypatch):
    """Every account's line in many parts, for all queries that count along it, and every
    account dealt into parts."""
    monkeypatch.setattr(skew, "ROWS_PER_PART", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 150)
    for name in (
        "relation_changes", "owner_agreement", "changes_per_relation", "repair_end_dates",
        "repair_status", "mark_lost", "resolve_single_change", "changes_after_end_repair",
        "first_owner_candidates",
    ):
        df = entry.queries()[name](spark, FOLDER)
        assert by_name(df.columns, [tuple(r) for r in df.collect()]) == by_name(*results[name])
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_generated_code_gives_the_same(spark, given, results):
    """One sweep with code generation, which the other tests leave out for speed."""
    off = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    on = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    for key, value in on.items():
        spark.conf.set(key, value)
    try:
        for name in oracle_queries.oracle_sql():
            df = entry.queries()[name](spark, FOLDER)
            assert by_name(df.columns, [tuple(r) for r in df.collect()]) == by_name(*results[name]), name
    finally:
        for key, value in off.items():
            spark.conf.set(key, value)


def test_known_figures(given, results):
    def size(name):
        return len(results[name][1])

    def only(name):
        return results[name][1][0]

    t = given
    assert (t.relation.count(), t.owner_history.count(), t.users.count(), t.excluded.count()) == (
        1500, 6522, 10, 2,
    )
    assert size("owner_changes") == 1748 and only("owner_change_accounts") == (75,)
    assert only("relation_counts") == (1445, 1284, 420)
    assert only("to_fix_counts") == (420, 141)
    assert only("to_fix_with_history") == (5384, 207)
    assert only("to_fix_without_history") == (213,)
    assert size("first_owner_evidence") == 171
    assert only("first_owner_agreement")[:2] == (171, 25)
    assert size("first_owner_candidates") == 87
    assert size("relation_changes") == 1974
    assert only("owner_agreement")[:2] == (309, 121)
    assert only("change_count_buckets") == (168, 37, 40, 23, 68)
    assert only("first_owner_recoverable") == (87,)
    assert (size("ambiguous_relations"), size("ambiguous_accounts")) == (131, 65)
    assert size("ambiguous_account_audit") == 649
    assert only("backlog_counts")[:2] == (161, 138)


def test_identities(results):
    def column(name, index=0):
        return [row[index] for row in results[name][1]]

    total, dated, missing = results["relation_counts"][1][0]
    undated = column("backlog_counts")[0]
    assert total == dated + undated
    assert missing == column("to_fix_counts")[0]
    with_history = column("to_fix_with_history", 1)[0]
    without_history = column("to_fix_without_history")[0]
    assert missing == with_history + without_history
    assert sorted(column("unresolved_relations")) == sorted(column("repair_status"))

    counted = set(column("changes_per_relation"))
    single, several = column("single_change_relations"), column("ambiguous_relations")
    assert len(counted) == sum(results["change_count_buckets"][1][0][1:])
    assert set(single) | set(several) == counted and not set(single) & set(several)
    assert set(column("ambiguous_sample")) <= set(several)
    assert len(column("ambiguous_sample")) == min(20, len(several))

    candidates = set(column("first_owner_candidates"))
    assert len(candidates) == column("first_owner_recoverable")[0] <= without_history
    by_change, by_first = column("resolve_single_change"), column("first_recorded_owner")
    assert set(by_change) == set(single) and set(by_first) == candidates
    assert not set(by_change) & set(by_first)

    assert sum(column("repair_funnel", 2)) == missing
    lost = [owner for owner in column("mark_lost", 2) if owner == "LOST"]
    assert len(lost) == column("repair_status", 3).count("lost")


def test_repair_leaves_nothing_to_fix(given):
    t = given
    status = repair.repair_status(t.relation, t.owner_history, t.excluded)
    repaired = repair.mark_lost(t.relation, status)
    assert counts.unresolved_relations(repaired).count() == 0
    assert repaired.count() == t.relation.count()


def test_without_a_shared_folder_the_tables_are_derived_in_the_query(spark, given, rows):
    lazy = derived.derive(spark, FOLDER)
    got = windows.change_count_buckets(
        lazy.relation, lazy.owner_history, lazy.excluded
    )
    assert rows(got) == [(168, 37, 40, 23, 68)]
