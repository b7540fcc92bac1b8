"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
# A batch that a task hands back holds about this much.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    The session names it in ``spark.checkpoint.dir``. A session without one gets a temporary
    folder if driver and executors are one process, as in tests; on a cluster, where each
    machine would see another folder, that is an error. What this application wrote there
    is removed at its end.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        atexit.register(_remove_at_end, spark, context.getCheckpointDir())
    return context.getCheckpointDir()


def _remove_at_end(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        discard(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once, lineage gone."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared checkpoint folder, and its path. Unlike ``cut`` it
    is compressed, and ``discard`` takes it away once nothing reads it any more."""
    spark = df.sparkSession
    shared = checkpoint_folder(spark)
    path = f"{shared}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Take away the shuffle files of plans that have run and that nothing holds any more:
    Spark keeps them until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from (bytes, values) pairs."""
    held: list[tuple] = []
    total = 0
    for size, row in rows:
        held.append(row)
        total += size + 64
        if total >= BATCH_BYTES:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
