"""Ranking helpers that stay exact when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.session import fresh_folder


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key.

    ``row_number() <= k`` is planned as a group limit on both sides of the exchange, so at most ``k`` rows per key
    and map task are shuffled and a hot key never reaches one task whole.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def dense_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str = "position",
) -> DataFrame:
    """Zero-based row number per key in ``order``, computed bucket by bucket.

    ``bucket`` must grow with the order (for instance ``id div 65536``). Rows are numbered inside (key, bucket); the
    offset of a bucket is a running sum over the pre-aggregated bucket counts, so a hot key is spread over as many
    tasks as it has buckets.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # Null-safe on purpose: a null key or bucket must keep its rows.
    left, right = keyed.alias("l"), offsets.alias("r")
    condition = F.col("l._bucket").eqNullSafe(F.col("r._bucket"))
    for key in keys:
        condition = condition & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    joined = left.join(right, condition).select("l.*", F.col("r._offset").alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return joined.withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1).drop("_bucket", "_offset")


def ranged_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """Zero-based row number per key in ``order`` (unique inside a key), whatever the values and their frequencies are.

    Rows are dealt by ranges of (keys, order) with cuts that Spark samples, sorted, and numbered where they stand: the
    number of a row in its range plus the rows of the ranges before it. The sorted rows are written to the shared folder
    once, as another run of the sampling could cut elsewhere. Offsets are one row per range.
    """
    spark, sort = df.sparkSession, [*[F.asc(k) for k in keys], *order]
    path = fresh_folder(spark, "ranged")
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path).withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = rows.join(offsets, "_range").withColumn(name, F.col("_offset") + F.col("_at")).drop("_range", "_at", "_offset")
    if not keys:
        return numbered
    first = numbered.groupBy(*keys).agg(F.min(name).alias("_first")).alias("r")
    condition = F.lit(True)
    for key in keys:  # null-safe on purpose: a null key keeps its rows
        condition = condition & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return numbered.alias("l").join(first, condition).select("l.*", F.col("r._first").alias("_first")).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def count_before(marks: DataFrame, asks: DataFrame, keys: Sequence[str], at: str, bucket: Column, name: str = "before") -> DataFrame:
    """``asks`` with the number of ``marks`` of their key that stand strictly before them, by ``at``.

    Marks and asks go into one sorted pass per (key, bucket), in which a running sum counts the marks; earlier buckets
    are added from pre-aggregated counts. ``bucket`` must grow with ``at``. No mark meets an ask in a row of its own.
    """
    columns = list(asks.columns)
    none = [F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in columns if c not in (*keys, at)]
    both = asks.select(*columns, F.lit(0).alias("_mark")).unionByName(marks.select(*keys, at, *none, F.lit(1).alias("_mark"))).withColumn("_bucket", bucket)
    sums = both.groupBy(*keys, "_bucket").agg(F.sum("_mark").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("_inside", F.coalesce(F.sum("_mark").over(inside), F.lit(0))).where("_mark = 0")
    return counted.join(offsets, [*keys, "_bucket"]).withColumn(name, F.col("_offset") + F.col("_inside")).select(*columns, name)
