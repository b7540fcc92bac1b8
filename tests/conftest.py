import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

RELATION = (
    "id string, account_id long, is_deleted boolean, assigned_at timestamp_ntz, "
    "ended_at timestamp_ntz, owner string, created_on date"
)
HISTORY = (
    "account_id long, changed_at timestamp_ntz, field string, old_value string, new_value string"
)
USERS = "id string, name string, is_active boolean"

@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text, micros=0):
    """``MM-DD`` or ``MM-DD HH:MM`` in 2021, plus microseconds."""
    form = "%Y-%m-%d %H:%M" if ":" in text else "%Y-%m-%d"
    return dt.datetime.strptime(f"2021-{text}", form) + dt.timedelta(microseconds=micros)


class Maker:
    """Hand-made tables: only what a case is about need be spelled out."""

    def __init__(self, spark):
        self.spark = spark

    def relations(self, *rows):
        full = [
            (
                row["id"],
                row.get("account", 1),
                row.get("deleted", False),
                row.get("start"),
                row.get("end"),
                row.get("owner"),
                row.get("created", dt.date(2021, 1, 1)),
            )
            for row in rows
        ]
        return self.spark.createDataFrame(full, RELATION)

    def history(self, *rows):
        """Rows of (account, time, old, new) or with the field in front of old."""
        full = [row if len(row) == 5 else (*row[:2], "Owner", *row[2:]) for row in rows]
        return self.spark.createDataFrame(full, HISTORY)

    def users(self, *rows):
        return self.spark.createDataFrame(list(rows), USERS)


@pytest.fixture
def make(spark):
    return Maker(spark)


@pytest.fixture
def rows():
    """A result as a sorted list of tuples."""

    def collected(df, *columns):
        chosen = df.select(*columns) if columns else df
        return sorted((tuple(row) for row in chosen.collect()), key=repr)

    return collected
