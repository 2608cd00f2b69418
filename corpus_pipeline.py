"""Documents from raw table to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import language, mixing, packing, pii, simhash
from dossier.llm.shared import written

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in no learned language: without a letter, or far from every model.

    Models are learned from the labelled documents that are not held out. A missing label is filled with the prediction.
    """
    model = language.train(docs.where(~language.held_out()))
    named = language.identify(docs, model, keep=tuple(DOCUMENT)).where("not rejected")
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*DOCUMENT)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, keep one document: that with the smallest id, one without an id only if none has any.

    Rows are told apart by a hash of id and text, so rows that share an id are documents of their own, and near copies
    without ids go like all others. A row repeated with the same id and text stays once.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text"))
    keyed = docs.select(*DOCUMENT).withColumn("row_key", key)
    groups = simhash.near_duplicates(keyed, id_column="row_key").select(F.col("doc_id").alias("row_key"), "component_id")
    rows = keyed.select("row_key", "doc_id").distinct().join(groups.distinct(), "row_key")
    heads = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("head")).select("head.row_key")
    return keyed.join(heads, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*DOCUMENT)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text by its kind in brackets."""
    clean = pii.redact(docs.select(*DOCUMENT), pii.train(docs))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source comes near its target; a row per copy."""
    keyed = docs.select(*DOCUMENT).withColumn("mix_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")))
    copies = mixing.mix_documents(keyed, id_column="mix_key").groupBy(F.col("doc_id").alias("mix_key")).agg(F.max("copies").alias("copies"))
    repeated = keyed.join(copies.where("copies > 0"), "mix_key")
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*DOCUMENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 token ids; one row per piece."""
    return packing.piece_rows(packing.pack_documents(docs))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", deduplicate),
    ("PII", redact),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: No twin: language models, tokenizing and packing are not SQL. The tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir).select(*DOCUMENT), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
