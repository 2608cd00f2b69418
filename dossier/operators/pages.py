"""Page tables: cleaning, variant choice, page selection, document assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.pages import ocr_text_score, registry_score, rules_checklist
from dossier.functions.ranking import dense_position
from dossier.functions.text import clean_lines, collapse_ws, drop_noisy_lines, restore_tilde_words, single_blank_lines

MIN_NATIVE_CHARS = 120
GOOD_SCORE = 12
LAYOUT_PAGES = 3


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Cleaned lines, repaired tilde words, single blank lines. The steps are separate projections because the repair
    reads its input more than once."""
    cleaned = pages.withColumn("text", clean_lines(F.col("text")))
    return cleaned.withColumn("text", single_blank_lines(restore_tilde_words(F.col("text"))))


def build_index_pages(pages: DataFrame) -> DataFrame:
    """Normalised pages with ``index_text``, the same text without noisy lines."""
    return normalize_pages(pages).withColumn("index_text", drop_noisy_lines(F.col("text")))


def assemble_documents(pages: DataFrame) -> DataFrame:
    """One row per document: ``index_text`` joins the non-empty index pages by a blank line, ``text`` is the collapsed
    join of the page texts. Takes ``text`` and ``index_text`` per page."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", "text", "index_text")))

    def joined(field: str):
        texts = F.filter(F.transform("parts", lambda p: p[field]), lambda t: t != "")
        return F.array_join(texts, "\n\n")

    grouped = pages.groupBy("doc_id").agg(parts.alias("parts"))
    return grouped.select("doc_id", collapse_ws(joined("text")).alias("text"), joined("index_text").alias("index_text"))


def document_parts(pages: DataFrame) -> DataFrame:
    """Index text of documents in ordered parts, one per non-empty page: ``(doc_id, position, page_number, index_text)``.

    Use it instead of ``assemble_documents`` where a document may be too large for one cell.
    """
    some = pages.where(F.coalesce("index_text", F.lit("")) != "").select("doc_id", "page_number", "index_text")
    return dense_position(some, ["doc_id"], [F.asc("page_number")], F.expr("page_number div 4096"))


def choose_extraction(native: DataFrame, scanned: DataFrame) -> DataFrame:
    """Native text when it has at least 120 characters, else the scanned text (empty if there is none)."""
    other = scanned.select("doc_id", F.col("text").alias("_text"), F.col("index_text").alias("_index"))
    short = F.coalesce(F.length("text"), F.lit(0)) < MIN_NATIVE_CHARS
    return native.join(other, "doc_id", "full_outer").select(
        "doc_id",
        F.when(short, "ocr").otherwise("native").alias("method"),
        F.when(short, F.coalesce("_text", F.lit(""))).otherwise(F.col("text")).alias("text"),
        F.when(short, F.coalesce("_index", F.lit(""))).otherwise(F.col("index_text")).alias("index_text"),
    ).withColumn("chars", F.length("text"))


def best_page_variant(variants: DataFrame) -> DataFrame:
    """Best reading of every page: score, then length, then the earlier variant.

    Variants other than the default (0) only compete on the first pages or when the default reads badly. Everything is
    one aggregation with partial results on the map side.
    """
    scored = variants.withColumn("score", ocr_text_score(F.col("text")))
    rank = F.struct(F.col("score"), F.length("text"), -F.col("variant"))
    default = F.col("variant") == 0
    best = scored.groupBy("doc_id", "page_number").agg(
        F.max(F.when(default, F.col("score"))).alias("default_score"),
        F.max_by(F.struct("variant", "score", "text"), rank).alias("best_of_all"),
        F.max_by(F.when(default, F.struct("variant", "score", "text")), F.when(default, rank)).alias("default_only"),
    )
    open_choice = (F.col("page_number") <= LAYOUT_PAGES) | (F.col("default_score") < GOOD_SCORE)
    picked = best.withColumn("pick", F.when(open_choice, F.col("best_of_all")).otherwise(F.col("default_only")))
    return picked.select("doc_id", "page_number", "pick.variant", "pick.score", "pick.text")


def select_tail_pages(pages: DataFrame, max_pages: int = 3, scan_pages: int = 8) -> DataFrame:
    """Pages near the end worth a second look, by registry wording with a bonus for the last three.

    Only the last ``scan_pages`` pages of a document are scored and ranked, so each window holds a fixed number of
    rows whatever the document's size. The last page is always kept, in place of the weakest pick if need be.
    """
    totals = pages.groupBy("doc_id").agg(F.max("page_number").alias("total"))
    tail = pages.join(totals, "doc_id").where(F.col("page_number") >= F.greatest(F.lit(1), F.col("total") - max(scan_pages, 1) + 1))
    bonus = F.when(F.col("page_number") >= F.greatest(F.lit(1), F.col("total") - 2), 2).otherwise(0)
    scored = tail.withColumn("score", registry_score(F.col("text")) + bonus)
    last = F.col("page_number") == F.col("total")
    ranked = scored.withColumn(
        "rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("page_number")))
    ).withColumn("last_rn", F.max(F.when(last, F.col("rn"))).over(Window.partitionBy("doc_id")))
    eligible = (F.col("score") > 0) | (F.col("rn") == 1)
    picked = eligible & ((F.col("rn") < max_pages) | ((F.col("rn") == max_pages) & (F.col("last_rn") <= max_pages)))
    keep = (picked | last) & F.lit(max_pages > 0)
    return ranked.where(keep).select("doc_id", "page_number", "score")


def select_head_pages(pages: DataFrame, n: int = 3) -> DataFrame:
    return pages.where((F.col("page_number") >= 1) & (F.col("page_number") <= n))


def front_page_order(pages: DataFrame) -> DataFrame:
    """Reading order of front pages: page 2, page 1, then upwards. The order is a key, not a running number."""
    number = F.col("page_number")
    return pages.withColumn("front_order", F.when(number == 2, 0).when(number == 1, 1).otherwise(number).cast("long"))


def analyze_rules_text(documents: DataFrame) -> DataFrame:
    return documents.withColumn("checklist", rules_checklist(F.col("text")))
