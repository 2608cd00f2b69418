"""Where a document's file is, and what the extraction step wrote about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.pages import clean_page_numbers
from dossier.functions.text import strip

PRIMARY = "s3"
FALLBACK = "public"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Path and size of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    )


def resolve_storage(documents: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Disk and availability per document: the object store first, then the local disk, else the object store without a file."""
    first = primary.select("path").distinct().withColumn("_first", F.lit(True))
    second = fallback.select("path").distinct().withColumn("_second", F.lit(True))
    joined = documents.join(first, "path", "left").join(second, "path", "left")
    on_first, on_second = F.coalesce("_first", F.lit(False)), F.coalesce("_second", F.lit(False))
    has_path = F.coalesce(F.col("path") != "", F.lit(False))
    return (
        joined.withColumn("disk", F.when(has_path & ~on_first & on_second, FALLBACK).otherwise(PRIMARY))
        .withColumn("available", has_path & (on_first | on_second))
        .withColumn("path", F.when(has_path, F.col("path")))
        .drop("_first", "_second")
    )


PAYLOAD_SCHEMA = (
    "struct<method:string,chars:int,text:string,index_text:string,error:string,index_pages:array<struct<page_number:string,text:string>>,"
    "vision_pages:array<string>,vision_page_numbers:array<string>,vision_first_pages:array<string>,vision_first_page_numbers:array<string>>"
)


def _page_number(c: Column) -> Column:
    """Whole part of a number; null for anything that is no number or does not fit."""
    return c.try_cast("double").try_cast("int")


def parse_payloads(raw: DataFrame) -> DataFrame:
    """One row per document from the extraction output in ``payload``; unreadable output gets an ``error``."""
    p = F.col("p")
    parsed = raw.withColumn("p", F.from_json("payload", PAYLOAD_SCHEMA))
    images = lambda c: F.coalesce(F.filter(c, lambda x: strip(x) != ""), F.array().cast("array<string>"))
    numbers = lambda c: F.coalesce(clean_page_numbers(c), F.array().cast("array<int>"))
    return parsed.select(
        "doc_id",
        F.when(p["text"].isNull(), F.coalesce(p["error"], F.lit("unexpected_output"))).alias("error"),
        p["method"].alias("method"),
        F.coalesce(p["chars"], F.length(p["text"])).alias("chars"),
        p["text"].alias("text"),
        F.coalesce(p["index_text"], p["text"]).alias("index_text"),
        p["index_pages"].alias("index_pages"),
        images(p["vision_pages"]).alias("vision_pages"),
        numbers(p["vision_page_numbers"]).alias("vision_page_numbers"),
        images(p["vision_first_pages"]).alias("vision_first_pages"),
        numbers(p["vision_first_page_numbers"]).alias("vision_first_page_numbers"),
    )


def read_page_payloads(raw: DataFrame) -> DataFrame:
    """Page rows of the extraction outputs: numeric page numbers above zero, trimmed text."""
    pages = parse_payloads(raw).select("doc_id", "method", "chars", F.inline("index_pages"))
    return pages.select(
        "doc_id", _page_number(F.col("page_number")).alias("page_number"), strip(F.coalesce("text", F.lit(""))).alias("text"), "method", "chars"
    ).where(F.col("page_number") > 0)
