"""What several operators need: tables in the shared folder, sized partitions, words and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch for whole texts; Spark's default of 10,000 long texts does not fit in a small worker.
BATCH_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; made under /tmp only for a local session that names none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, readable by every executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's rows per Arrow batch to ``rows``; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over bounded batches; ``each`` turns one batch into any number of batches."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from each(batch)

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def word_count(text) -> Column:
    """Number of runs of anything but space and \\x09-\\x0D; null is 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def smallest(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The rows with the ``n`` smallest values of a numeric ``key`` (more only by ties at the last of them).

    Only keys are sorted; the rows themselves stay where they are.
    """
    keyed = df.withColumn("_key", key)
    last = keyed.select("_key").orderBy("_key").limit(n).agg(F.max("_key")).first()[0]
    return keyed.where(F.col("_key") <= F.lit(last)).drop("_key")
