"""Pages in, rated chunks and vectors out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.embedding import Embedder, embed_chunks
from dossier.operators.chunk_quality import chunk_quality
from dossier.operators.chunking import chunk_pages
from dossier.operators.vectors import build_vectors


def rated_chunks(index_pages: DataFrame) -> DataFrame:
    """Page-aware chunks of the index text with their quality.

    The text of these documents is put together from the same pages, so a document without usable pages has no other text
    to fall back on.
    """
    return chunk_quality(chunk_pages(index_pages.select("doc_id", "page_number", F.col("index_text").alias("text")), None))


def chunk_vectors(chunks: DataFrame, documents: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Vector rows of stored chunks; ``documents`` holds type, path and user."""
    notes = F.create_map(
        F.lit("page_ids"), F.array_join("page_ids", ","), F.lit("page_numbers_csv"), F.col("page_numbers_csv"),
        F.lit("primary_page"), F.col("primary_page").cast("string"),
    )
    rows = build_vectors(chunks.select("doc_id", "chunk_index", "text", notes.alias("metadata")), documents)
    return embed_chunks(rows, embedder)
