"""Small list and order helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.ranking import dense_position, ranged_position


def distinct_in_order(items: Column) -> Column:
    """Members without repeats, first occurrence kept."""
    return F.array_distinct(items)


def dense_front_order(pages: DataFrame) -> DataFrame:
    """Running number in front-page order, starting at zero."""
    numbered = dense_position(pages.select("doc_id", "page_number", F.col("front_order").alias("_key")), ["doc_id"], [F.asc("_key")], F.expr("_key div 4096"))
    return numbered.select("doc_id", "page_number", F.col("position").alias("front_order"))


def order_chunks(df: DataFrame) -> DataFrame:
    """Chunk index upwards with unknown ones last, then id; ``position`` numbers all of them from zero."""
    return ranged_position(df, [], [F.asc_nulls_last("chunk_index"), F.asc("id")]).orderBy("position")
