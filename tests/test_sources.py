"""Loading, checking, staging and writing tables."""

import pytest
from conftest import day

from tenure.plans import counts, windows
from tenure.sources import schemas, tables


@pytest.fixture
def small(make):
    return tables.Tables(
        make.relations({"id": "r", "start": day("01-01")}),
        make.history(
            (1, day("01-02"), "A", "B"),
            (1, day("01-02"), "0053X1", "0053X2"),
            (1, day("01-02"), "Status", "A", "B"),
        ),
        make.users(("u", "B", True)),
    )


def test_from_parquet_and_from_names(small, spark, tmp_path, rows):
    paths = {n: str(tmp_path / n) for n in ("relation", "owner_history", "users")}
    for name, path in paths.items():
        tables.write(getattr(small, name), path)
    read = tables.from_parquet(spark, *paths.values())
    assert read.excluded is None
    for name in paths:
        assert rows(getattr(read, name)) == rows(getattr(small, name))
        getattr(read, name).createOrReplaceTempView(f"t_{name}")
    named = tables.from_names(spark, *(f"t_{name}" for name in paths))
    assert rows(windows.changes_per_relation(named.relation, named.owner_history)) == [("r", 1)]
    with pytest.raises(Exception, match="already exists"):
        tables.write(small.users, paths["users"])


def test_staging_tables_under_their_own_names(small, rows):
    def undone(df, names):
        return df.selectExpr(*(f"{new} as {old}" for old, new in names.items()))

    renamed = tables.from_staging(
        undone(small.relation, schemas.RELATION_NAMES).selectExpr("*", "1 as other"),
        undone(small.owner_history, schemas.OWNER_HISTORY_NAMES),
        undone(small.users, schemas.USERS_NAMES),
    )
    assert renamed.relation.columns == list(schemas.RELATION)
    assert rows(counts.owner_changes(renamed.owner_history)) == [(1, day("01-02"), "A", "B")]
    with pytest.raises(schemas.SchemaError, match="missing"):
        tables.from_staging(small.relation, small.owner_history, small.users)


def test_a_wrong_type_or_missing_column_fails(small):
    wrong = small.relation.selectExpr("id", "account_id", "1 as is_deleted", "assigned_at", "owner")
    with pytest.raises(schemas.SchemaError) as error:
        schemas.check_schema(wrong, schemas.RELATION)
    assert "is_deleted: int, want boolean" in str(error.value)
    assert "ended_at: missing" in str(error.value)


def test_repeated_ids_are_found(make, rows):
    relation = make.relations({"id": "a"}, {"id": "b"}, {"id": "a"})
    assert rows(schemas.repeated_ids(relation), "id") == [("a",)]


def test_the_staged_log_keeps_every_answer(small, rows, tmp_path):
    staged = tables.stage_owner_log(small.owner_history, str(tmp_path / "log"))
    assert staged.columns == small.owner_history.columns
    assert staged.count() == 1
    assert rows(counts.owner_changes(staged)) == rows(counts.owner_changes(small.owner_history))


def test_shared_folder_is_the_one_the_session_names(spark):
    folder = tables.shared_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir") + "/tenure-")
