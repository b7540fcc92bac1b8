"""The next assignment on the same account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.operators.line import line


def with_next_assignment(relation: DataFrame, in_line: Column | None = None) -> DataFrame:
    """``relation`` with ``next_at``: when the account's next relation starts.

    Relations of an account are ordered by ``assigned_at``, then ``id``. Rows outside of
    ``in_line``, or without an account or an assignment date, neither have a next one nor are
    one. The line runs backwards, so the next start is the last one seen; it is cut where
    the data is, so no task holds a whole account.
    """
    counts = F.col("account_id").isNotNull() & F.col("assigned_at").isNotNull()
    if in_line is not None:
        counts = F.coalesce(counts & in_line, F.lit(False))
    points = relation.withColumns(
        {
            "_line": F.when(counts, F.col("account_id")),
            "at": F.col("assigned_at"),
            "n": F.lit(0).cast("long"),
            "value": F.when(counts, F.col("assigned_at")),
            "first": F.lit(None).cast("string"),
        }
    )
    backwards = line(points, ["_line"], [F.desc("assigned_at"), F.desc("id")], exclusive=True)
    return backwards.rows().select(*relation.columns, F.col("last").alias("next_at"))
