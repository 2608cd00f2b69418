"""Vector rows, index maintenance and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.embedding import cosine, embed_chunks, hashed_vector
from dossier.functions.pages import parse_page_numbers
from dossier.functions.ranking import dense_position, top_per_key
from dossier.sources.buckets import BucketTable, store_for_joins
from dossier.functions.text import limit_text, strip
from dossier.operators.chunk_quality import chunk_quality, correction_flags
from dossier.operators.chunking import attach_page_map, chunk_text_for_index
from dossier.operators.resolution import retry_queries

NO_CONTEXT = "Sin contexto recuperado."
# The general queries of a deed.
BROAD_QUERIES = {
    "registro_rpc": "fecha de registro del acta, folio mercantil rpc, fecha de inscripción en registro público de comercio, lugar de inscripción",
    "apoderados_facultades": "apoderados legales, nombre completo, ine, documento de poder, facultades otorgadas, pleitos y cobranzas, administración, dominio",
    "accionistas_direccion": "participación accionaria, socios accionistas, porcentajes, consejo de administración, director general, miembros de dirección",
    "notaria_instrumento": "notaría número, lugar de notaría, nombre completo del notario, escritura número, libro número, fecha de inscripción, acto jurídico",
}
BROAD_K, FOCUSED_K = 6, 8
# Snippets and characters of the fallback, broad and focused.
BROAD_FALLBACK, FOCUSED_FALLBACK = (8, 8000), (10, 10000)
NAMESPACE_PREFIX = "documents-"
# What names a document: ids are only unique within a type, and types within a namespace.
DOCUMENT = ["namespace", "document_type", "doc_id"]


def merge_metadata(base: Column, *more: Column) -> Column:
    """Maps merged from left to right; the right side wins."""
    merged = base
    for right in more:
        keys = F.map_keys(right)
        merged = F.map_concat(F.map_filter(merged, lambda k, _: ~F.array_contains(keys, k)), right)
    return merged


def clean_metadata(m: Column) -> Column:
    """Trimmed values without the blank ones."""
    trimmed = F.transform_values(m, lambda _, value: strip(value))
    return F.map_filter(trimmed, lambda _, value: value.isNotNull() & (value != ""))


def build_vectors(chunks: DataFrame, documents: DataFrame, prefix: str = NAMESPACE_PREFIX) -> DataFrame:
    """Vector rows without values: ids, namespace and merged metadata. Blank chunks are dropped before numbering.

    ``chunks``: ``(doc_id, chunk_index, text, metadata)``; ``documents``: ``(doc_id, document_type, storage_path, user_id)``. The text
    itself stays a column and is not repeated inside the metadata.
    """
    kept = chunks.withColumn("text", strip(F.col("text"))).where(F.col("text") != "").withColumnRenamed("chunk_index", "_order")
    numbered = dense_position(kept, ["doc_id"], [F.asc("_order")], F.expr("_order div 4096"), "chunk_index")
    joined = numbered.drop("_order").join(documents, "doc_id")
    base_id = F.concat_ws("-", "document_type", F.col("doc_id").cast("string"))
    index = F.col("chunk_index").cast("string")
    base = F.create_map(
        F.lit("document_type"), F.col("document_type"), F.lit("document_id"), F.col("doc_id").cast("string"),
        F.lit("storage_path"), F.col("storage_path"), F.lit("user_id"), F.col("user_id").cast("string"),
    )
    own = clean_metadata(F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    prepared = joined.withColumn("_base", base).withColumn("_own", own)
    return prepared.select(
        F.concat(F.lit(prefix), "document_type").alias("namespace"),
        F.concat_ws("-", base_id, index).alias("id"),
        "doc_id", "document_type", "chunk_index", "text",
        merge_metadata(F.col("_base"), F.col("_own"), F.create_map(F.lit("chunk_index"), index)).alias("metadata"),
    )


def index_changes(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an index must do to hold the incoming documents' vectors instead of its own: rows to upsert, keys to delete.

    Only vectors of the incoming documents are looked at; apply both per partition of the document key. Repeating them
    changes nothing.
    """
    documents = incoming.select(*DOCUMENT).distinct()
    mine = current.select(*DOCUMENT, "id").join(documents, DOCUMENT, "left_semi")
    return incoming, mine.join(incoming.select("namespace", "id"), ["namespace", "id"], "left_anti")


def apply_index_changes(table: BucketTable, incoming: DataFrame) -> list[int]:
    """The incoming documents' vectors in place of their own in a stored index with keys ``DOCUMENT``.

    Upserts and deletes stay in the documents' buckets, so those are written anew and all other files stay as they are.
    """
    return table.change(incoming, lambda current, new: maintain_index(current, new)[0].select(*current.columns))


def maintain_index(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole index after :func:`index_changes`, for indexes small enough to be written anew, and the stale rows."""
    documents = incoming.select(*DOCUMENT).distinct()
    untouched = current.join(documents, DOCUMENT, "left_anti")
    deleted = current.join(documents, DOCUMENT, "left_semi").join(incoming.select("namespace", "id"), ["namespace", "id"], "left_anti")
    return untouched.unionByName(incoming), deleted


def is_synthetic_summary(text: Column) -> Column:
    upper = F.upper(strip(text))
    labelled = upper.contains("FECHA DE REGISTRO:")
    for label in ("RPC FOLIO:", "NOTAR", "ESCRITURA N", "ACTO:"):
        labelled = labelled & upper.contains(label)
    return upper.contains("RESUMEN ESTRUCTURADO DEL ACTA") | labelled


def _snippets(ranked: DataFrame) -> DataFrame:
    """Usable snippets of ranked hits; repeated texts keep their best rank."""
    usable = ranked.where((F.coalesce(strip(F.col("text")), F.lit("")) != "") & ~is_synthetic_summary(F.col("text")))
    return usable.groupBy(*DOCUMENT, "query_key", strip(F.col("text")).alias("snippet")).agg(
        F.min("rank").alias("rank"), F.max("similarity").alias("similarity")
    )


def _best(scored: DataFrame, k: int) -> DataFrame:
    """Snippets of the first ``k`` hits per document and query, ranked by the full similarity, then id."""
    return _snippets(top_per_key(scored, [*DOCUMENT, "query_key"], [F.desc("similarity"), F.asc("id")], k, rank="rank"))


def retrieve(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Top ``k`` chunks per query inside its document, by cosine.

    ``queries``: ``(namespace, document_type, doc_id, query_key, vector)``. Queries and vectors meet on the document key
    before any similarity is computed, the vectors are dropped right after it, and the cut to ``k`` starts on the map side.
    Filtering happens after the cut, so fewer than ``k`` snippets may remain.
    """
    pairs = vectors.select(*DOCUMENT, "id", "text", "values").join(queries.select(*DOCUMENT, "query_key", "vector"), DOCUMENT)
    return _best(pairs.select(*DOCUMENT, "query_key", "id", "text", cosine(F.col("values"), F.col("vector")).alias("similarity")), k)


def store_vectors(vectors: DataFrame, table: str, buckets: int = 512) -> DataFrame:
    """Vectors as a catalog table bucketed by their document, which :func:`retrieve` reads without an exchange of it."""
    return store_for_joins(vectors, table, DOCUMENT, buckets)


def broad_context(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = BROAD_K) -> DataFrame:
    """Snippets of the four general queries, else the first chunks of a document whose queries all came back empty.

    Only vectors and chunks of the given documents count. The queries are the same for every document, so they are
    attached as literals instead of being joined.
    """
    canned = F.array(
        *[F.struct(F.lit(key).alias("query_key"), F.array(*[F.lit(x) for x in hashed_vector(text)]).alias("vector")) for key, text in BROAD_QUERIES.items()]
    )
    own = vectors.join(documents.select(*DOCUMENT), DOCUMENT, "left_semi")
    scored = own.select(*DOCUMENT, "id", "text", "values", F.explode(canned).alias("q")).select(
        *DOCUMENT, "q.query_key", "id", "text", cosine(F.col("values"), F.col("q.vector")).alias("similarity")
    )
    return _with_fallback(_best(scored, k), chunks, documents, "local_fallback", *BROAD_FALLBACK)


def focused_context(missing: DataFrame, vectors: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = FOCUSED_K) -> DataFrame:
    """Snippets for the missing fields of each document, with the same kind of fallback.

    ``missing``: the document key and the array ``missing``.
    """
    queries = embed_chunks(retry_queries(missing, DOCUMENT), text="query_text", out="vector")
    asked = missing.where(F.size("missing") > 0).select(*DOCUMENT)
    found = _with_fallback(retrieve(queries, vectors, k), chunks, documents, "retry_local_fallback", *FOCUSED_FALLBACK)
    return found.join(asked, DOCUMENT, "left_semi")


def _with_fallback(hits: DataFrame, chunks: DataFrame, documents: DataFrame, key: str, n: int, max_chars: int) -> DataFrame:
    """Hits, or the fallback snippets of a document without any hit.

    Fallback snippets are taken for every document and dropped where there are hits, so the hits are computed once
    instead of once per branch. The window sees at most queries times k plus ``n`` rows per document.
    """
    local = fallback_snippets(chunks, documents, n, max_chars).select(
        *DOCUMENT, F.lit(key).alias("query_key"), "snippet", "rank", F.lit(None).cast("double").alias("similarity"), F.lit(0).alias("_hit")
    )
    both = hits.withColumn("_hit", F.lit(1)).unionByName(local)
    found = both.withColumn("_found", F.max("_hit").over(Window.partitionBy(*DOCUMENT)))
    return found.where(F.col("_hit") == F.col("_found")).drop("_hit", "_found")


def fallback_snippets(chunks: DataFrame, documents: DataFrame, n: int, max_chars: int) -> DataFrame:
    """First ``n`` non-empty chunks of a document, or the head of its text when it has none."""
    own = chunks.join(documents.select(*DOCUMENT), DOCUMENT, "left_semi")
    usable = own.where((F.col("text") != "") & (F.col("text") != "0"))
    first = top_per_key(usable, DOCUMENT, [F.asc("chunk_index")], n, rank="rank").select(*DOCUMENT, F.col("text").alias("snippet"), "rank")
    bare = documents.where(F.col("text") != "").join(chunks.select(*DOCUMENT), DOCUMENT, "left_anti")
    return first.unionByName(bare.select(*DOCUMENT, limit_text(F.col("text"), max_chars).alias("snippet"), F.lit(1).alias("rank")))


def format_context(documents: DataFrame, snippets: DataFrame, max_snippets: int = 0, max_chars: int = 1800) -> DataFrame:
    """Prompt block per document: a heading per query, then its numbered snippets.

    ``snippets``: the document key and ``(query_order, query_key, idx, snippet)`` with ``idx`` from zero. A document has at most queries times k
    snippets, so the window is small by construction.
    """
    usable = snippets.where(F.coalesce(strip(F.col("snippet")), F.lit("")) != "")
    order = Window.partitionBy(*DOCUMENT).orderBy("query_order", "idx")
    numbered = usable.withColumn("n", F.row_number().over(order))
    kept = numbered.where(F.col("n") <= max_snippets) if max_snippets > 0 else numbered
    line = F.concat(F.lit("["), (F.col("idx") + 1).cast("string"), F.lit("] "), limit_text(strip(F.col("snippet")), max_chars))
    blocks = kept.groupBy(*DOCUMENT, "query_order", "query_key").agg(
        F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("lines")
    ).select(
        *DOCUMENT, "query_order",
        F.concat(F.upper("query_key"), F.lit(":\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("block"),
    )
    texts = blocks.groupBy(*DOCUMENT).agg(F.array_sort(F.collect_list(F.struct("query_order", "block"))).alias("b")).select(
        *DOCUMENT, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context")
    )
    return documents.select(*DOCUMENT).join(texts, DOCUMENT, "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def snippet_counts(snippets: DataFrame) -> DataFrame:
    """Snippets and queries used per document."""
    return snippets.groupBy(*DOCUMENT).agg(F.count(F.lit(1)).alias("match_count"), F.sort_array(F.collect_set("query_key")).alias("queries_used"))


def reindex(index: DataFrame, stored: DataFrame, page_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors for documents that already have text, and their index rows.

    Stored chunks are used as they are; other documents are cut again and get their stored page map. Documents without
    text are skipped.
    """
    text = strip(F.coalesce("index_text", "extracted_text", F.lit("")))
    ready = index.withColumn("text", text).where(F.col("text") != "")
    keep = ["doc_id", "chunk_index", "text", "page_numbers_csv"]
    from_store = stored.join(ready.select("doc_id"), "doc_id", "left_semi").select(*keep)
    cut = chunk_text_for_index(ready.join(stored.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text"))
    from_text = attach_page_map(cut, page_map).select(*keep)
    pages = F.create_map(F.lit("page_numbers_csv"), F.col("page_numbers_csv"))
    chunks = from_store.unionByName(from_text).withColumn("metadata", pages)
    vectors = build_vectors(chunks, ready.select("doc_id", "document_type", "storage_path", "user_id"))
    indexed = ready.join(vectors.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit("indexed").alias("status"))
    return vectors, indexed


def inspect_records(vectors: DataFrame) -> DataFrame:
    """Vector rows with dimension, pages and quality; order columns are ``chunk_index`` (unknown last) and ``id``."""
    numbers = F.coalesce(parse_page_numbers(F.col("metadata")["page_numbers_csv"]), F.array().cast("array<int>"))
    rated = chunk_quality(correction_flags(vectors))
    return rated.withColumn("dimension", F.coalesce(F.size("values"), F.lit(0))).withColumn("page_numbers", numbers)


def inspect_index(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per document: number of vectors, of suspicious and of corrected ones, and whether anything was found."""
    counts = inspect_records(vectors).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("record_count"), F.count_if("suspicious").alias("suspicious_count"), F.count_if("corrected").alias("corrected_count")
    )
    joined = documents.select("doc_id").join(counts, "doc_id", "left").fillna(0)
    return joined.withColumn("available", F.col("record_count") > 0).withColumn(
        "error", F.when(F.col("record_count") == 0, "No vectors were found for this document.")
    )
