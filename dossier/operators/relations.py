"""Relational loads: to-one, to-many, polymorphic, semi/anti, bridge and through joins.

Dimension sides are left unhinted: Spark broadcasts them only while their measured size is under its threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.ranking import dense_position


def with_company(tenders: DataFrame, companies: DataFrame) -> DataFrame:
    dim = companies.select(F.col("id").alias("company_id"), "nombre", "rfc")
    return tenders.join(dim, "company_id", "left")


def company_profile(
    companies: DataFrame, deeds: DataFrame, opinions: DataFrame, statements: DataFrame, declarations: DataFrame, letterheads: DataFrame
) -> DataFrame:
    """Every child of every company with its place in the company's ordered list.

    One row per child instead of five nested lists per company, so a company with very many children never has to fit
    into one cell. Lists are newest first; ``position`` starts at zero.
    """

    def section(df: DataFrame, name: str, first: Column, second: Column | None = None) -> DataFrame:
        return df.select(
            "company_id", F.lit(name).alias("section"), F.col("id").alias("child_id"),
            F.coalesce(first.cast("long"), F.lit(-(2**40))).alias("k1"),
            F.coalesce((second if second is not None else F.lit(0)).cast("long"), F.lit(-(2**40))).alias("k2"),
        )

    rows = reduce(
        DataFrame.unionByName,
        [
            section(deeds, "deeds", F.unix_date("fecha_registro")),
            section(opinions, "opinions", F.unix_date("fecha_emision")),
            section(statements, "statements", F.col("year"), F.col("month")),
            section(declarations, "declarations", F.col("year"), F.col("month")),
            section(letterheads, "letterheads", F.col("is_default").cast("int")),
        ],
    ).join(companies.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    order = [F.desc("k1"), F.desc("k2"), F.desc("child_id")]
    bucket = F.struct(-F.col("k1"), -F.col("k2"), F.expr("-(child_id div 65536)"))
    return dense_position(rows, ["company_id", "section"], order, bucket).select("company_id", "section", "position", "child_id")


def with_document_index(entities: DataFrame, index: DataFrame, entity_type: str) -> DataFrame:
    """Polymorphic one-to-one load; the type is pushed into the index scan."""
    one = index.where(F.col("documentable_type") == entity_type).select(
        F.col("documentable_id").alias("id"), F.col("id").alias("index_id"), F.col("status").alias("index_status")
    )
    return entities.join(one, "id", "left")


def having_related(df: DataFrame, child: DataFrame, key: str, child_key: str | None = None) -> DataFrame:
    return df.join(child.select(F.col(child_key or key).alias(key)), key, "left_semi")


def lacking_related(df: DataFrame, child: DataFrame, key: str, child_key: str | None = None) -> DataFrame:
    return df.join(child.select(F.col(child_key or key).alias(key)), key, "left_anti")


def with_regulations(tenders: DataFrame, bridge: DataFrame, regulations: DataFrame) -> DataFrame:
    reg = regulations.select(F.col("id").alias("regulation_id"), F.col("title").alias("regulation_title"), "scope", "country_code")
    ten = tenders.select(F.col("id").alias("licitacion_id"), F.col("title").alias("tender_title"))
    return bridge.join(reg, "regulation_id").join(ten, "licitacion_id")


def sync_bridge(current: DataFrame, desired: DataFrame) -> DataFrame:
    """Changes that turn ``current`` into ``desired`` for the tenders named there: rows to detach and to attach."""
    keys = ["licitacion_id", "regulation_id"]
    pairs = desired.where(F.col("regulation_id").isNotNull()).select(*keys).distinct()
    touched = current.join(desired.select("licitacion_id"), "licitacion_id", "left_semi")
    detach = touched.join(pairs, keys, "left_anti").select(*keys, F.lit("detach").alias("action"))
    attach = pairs.join(current, keys, "left_anti").select(*keys, F.lit("attach").alias("action"))
    return detach.unionByName(attach)


def user_letterheads(users: DataFrame, companies: DataFrame, letterheads: DataFrame) -> DataFrame:
    """Letterheads of a user through the user's companies, defaults first then by title (order columns kept)."""
    own = companies.select(F.col("id").alias("company_id"), "user_id")
    return (
        letterheads.select("id", "company_id", "title", "is_default")
        .join(own, "company_id")
        .join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    )


def letterhead_options(letterheads: DataFrame) -> DataFrame:
    """Choices of every company: its own letterheads, defaults first, then by title; ``position`` starts at zero."""
    order = [F.desc("is_default"), F.asc("title"), F.asc("id")]
    bucket = F.struct(~F.col("is_default"), F.left("title", F.lit(4)))
    options = dense_position(letterheads.select("company_id", "id", "title", "is_default"), ["company_id"], order, bucket)
    return options.select("company_id", "position", "id", "title", "is_default")


def vectors_for_document(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors of each document. The document key inside the id is split off, so that 1 and 11 never mix."""
    key = F.regexp_extract("id", r"^(.+)-[0-9]+$", 1)
    wanted = documents.select(F.concat_ws("-", "document_type", F.col("document_id").cast("string")).alias("base_id"))
    return vectors.withColumn("base_id", key).join(wanted.distinct(), "base_id", "left_semi")


def with_actor(events: DataFrame, users: DataFrame) -> DataFrame:
    who = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    return events.join(who, "user_id", "left")
