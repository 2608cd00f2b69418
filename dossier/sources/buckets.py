"""Tables in buckets of their key: a change reads and writes the buckets that it touches, and no other file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import fresh_folder


@dataclass(frozen=True)
class BucketTable:
    """Parquet table with one folder per bucket; ``count`` is fixed for the life of the table."""

    path: str
    keys: tuple[str, ...]
    count: int = 256

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int")

    def write(self, rows: DataFrame) -> None:
        """All rows of a new table; every bucket gets a folder, so that a later change finds it."""
        self._save(rows, self.path, "overwrite")

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets: others are pruned before any file is opened."""
        rows = spark.read.parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def change(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets that ``incoming`` has keys of by ``merge(their rows, incoming)``; returns them.

        The merged rows are written to the shared folder first, so nothing that is read is overwritten and a failed run
        is repeated from there. Each bucket is then replaced as a whole; one that is left without rows keeps an empty
        file. At most ``count`` bucket numbers reach the driver.
        """
        spark = incoming.sparkSession
        touched = sorted(r[0] for r in incoming.select(self.bucket().alias("bucket")).distinct().collect())
        if not touched:
            return []
        staged = fresh_folder(spark, "buckets")
        result = merge(self.read(spark, touched), incoming)
        self._save(result, staged, "error")
        merged = spark.read.schema(result.withColumn("bucket", F.lit(0)).schema).parquet(staged)
        full = {r[0] for r in merged.select("bucket").distinct().collect()}
        if full - set(touched):
            raise ValueError("a change must not move rows into buckets that its keys are not in")
        rows = merged.repartition(len(touched), "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for bucket in sorted(set(touched) - full):
            merged.drop("bucket").limit(0).write.mode("overwrite").parquet(f"{self.path}/bucket={bucket}")
        return touched

    def _save(self, rows: DataFrame, path: str, mode: str) -> None:
        keyed = rows.withColumn("bucket", self.bucket())
        keyed.repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.mode(mode).partitionBy("bucket").parquet(path)


def store_for_joins(rows: DataFrame, table: str, keys: list[str], buckets: int) -> DataFrame:
    """``rows`` as a catalog table that Spark knows to be bucketed and sorted by ``keys``; joins on them need no exchange of it."""
    dealt = rows.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)
