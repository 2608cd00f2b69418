"""Queries over vectors, retrieval and chunk correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import register, view_sql
from dossier.catalog.extraction import documents as document_ids
from dossier.catalog.extraction import missing
from dossier.functions.embedding import embed_chunks, hashed_vector
from dossier.functions.pages import page_overlap
from dossier.functions.similarity import text_similarity
from dossier.operators import correction, ranked_lists, vectors
from dossier.operators.resolution import RETRY_QUERIES
from dossier.session import fresh_folder
from dossier.sources.buckets import BucketTable

# A text as a unit vector over 64 hashed word slots.
_SLOTS = r"list_transform(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> ''), lambda t: CAST('0x' || md5(t)[1:8] AS BIGINT) % 64)"
view_sql.register_view("v_embedded", f"""
    SELECT doc_id, chunk_index, text, CASE WHEN norm > 0 THEN list_transform(counts, lambda c: c / norm) ELSE list_transform(counts, lambda c: 0::DOUBLE) END AS values FROM (
      SELECT *, sqrt(list_sum(list_transform(counts, lambda c: c * c))) AS norm FROM (
        SELECT doc_id, chunk_index, text, list_transform(range(64), lambda i: CAST(len(list_filter(slots, lambda s: s = i)) AS DOUBLE)) AS counts
        FROM (SELECT *, {_SLOTS} AS slots FROM v_turns)))""")


def turn_chunks(v):
    return v.table("conversations").selectExpr("conv_id as doc_id", "cast(turn as int) as chunk_index", "text")


def embedded(v):
    return embed_chunks(turn_chunks(v))


@register("embed_chunks", "SELECT doc_id, chunk_index, CAST(unnest(range(64)) AS INTEGER) AS slot, round(unnest(values), 6) AS value FROM v_embedded")
def _(v):
    return embedded(v).select("doc_id", "chunk_index", F.posexplode("values").alias("slot", "value")).withColumn("value", F.round("value", 6))


view_sql.register_view("v_noted_chunks", """
    SELECT doc_id, chunk_index, CASE WHEN chunk_index % 3 = 1 THEN '  ' ELSE ' ' || text END AS text FROM v_turns""")


def noted_chunks(v):
    rows = turn_chunks(v).withColumn("text", F.expr("case when chunk_index % 3 = 1 then '  ' else concat(' ', text) end"))
    notes = F.create_map(
        F.lit("page_numbers_csv"), F.concat(F.lit(" "), F.col("chunk_index").cast("string")), F.lit("storage_path"),
        F.when(F.col("chunk_index") % 2 == 0, "propio").otherwise(""), F.lit("vacio"), F.lit(None).cast("string"),
    )
    return rows.withColumn("metadata", notes)


def vector_documents(v):
    return v.table("conversations").select("conv_id").distinct().selectExpr(
        "conv_id as doc_id", "case when conv_id % 2 = 0 then 'acta' else 'opinion' end as document_type", "concat('f/', cast(conv_id as string)) as storage_path", "conv_id % 25 as user_id"
    )


@register("build_vectors", r"""
    SELECT 'documents-' || t AS namespace, t || '-' || doc_id || '-' || n AS id, n AS chunk_index, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text,
           CAST(chunk_index AS VARCHAR) AS pages, CASE WHEN chunk_index % 2 = 0 THEN 'propio' ELSE 'f/' || doc_id END AS storage_path, CAST(doc_id % 25 AS VARCHAR) AS user_id, 6 AS entries
    FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'acta' ELSE 'opinion' END AS t, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS n
          FROM v_noted_chunks WHERE trim(text) <> '')""")
def _(v):
    built = vectors.build_vectors(noted_chunks(v), vector_documents(v))
    m = F.col("metadata")
    return built.select(
        "namespace", "id", "chunk_index", "text", m["page_numbers_csv"].alias("pages"), m["storage_path"].alias("storage_path"),
        m["user_id"].alias("user_id"), F.size(m).alias("entries"),
    )


@register("merge_metadata", "SELECT c_custkey, c_name AS a, c_mktsegment AS b, 'x' AS c, 3 AS entries FROM customer")
def _(v):
    left = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("c_mktsegment"))
    right = F.create_map(F.lit("a"), F.col("c_name"))
    merged = vectors.merge_metadata(left, right, F.create_map(F.lit("c"), F.lit("x")))
    rows = v.table("customer").select("c_custkey", merged.alias("m"))
    return rows.select("c_custkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"), F.size("m").alias("entries"))


view_sql.register_view("v_incoming", """
    SELECT namespace, document_type, doc_id, id FROM v_vectors WHERE doc_id IN (SELECT doc_id FROM labels) AND values[1] > 0 AND document_type = 'acta'""")


def incoming(v):
    """New vectors for the deeds among the labelled documents; opinions of the same number stay."""
    labelled = v.table("labels").select("doc_id")
    columns = v.vectors().columns
    return v.vectors().where("values[0] > 0 and document_type = 'acta'").join(labelled, "doc_id", "left_semi").withColumn("text", F.lit("nuevo")).select(*columns)


_REPLACED = "document_type = 'acta' AND doc_id IN (SELECT doc_id FROM v_incoming)"


@register("maintain_index", f"""
    SELECT id, doc_id, CASE WHEN {_REPLACED} THEN 'nuevo' ELSE text END AS text FROM v_vectors WHERE NOT ({_REPLACED}) OR id IN (SELECT id FROM v_incoming)""")
def _(v):
    return vectors.maintain_index(v.vectors(), incoming(v))[0].select("id", "doc_id", "text")


@register("apply_index_changes", f"""
    SELECT id, doc_id, CASE WHEN {_REPLACED} THEN 'nuevo' ELSE text END AS text FROM v_vectors WHERE NOT ({_REPLACED}) OR id IN (SELECT id FROM v_incoming)""")
def _(v):
    table = BucketTable(fresh_folder(v.spark, "vectors"), tuple(vectors.DOCUMENT), 16)
    table.write(v.vectors())
    vectors.apply_index_changes(table, incoming(v))
    return table.read(v.spark).select("id", "doc_id", "text")


@register("stale_vectors", f"SELECT id, doc_id FROM v_vectors WHERE {_REPLACED} AND id NOT IN (SELECT id FROM v_incoming)")
def _(v):
    return vectors.maintain_index(v.vectors(), incoming(v))[1].select("id", "doc_id")


@register("index_changes", f"""
    SELECT id, doc_id, 'upsert' AS change FROM v_incoming UNION ALL SELECT id, doc_id, 'delete' FROM v_vectors WHERE {_REPLACED} AND id NOT IN (SELECT id FROM v_incoming)""")
def _(v):
    upserts, deletes = vectors.index_changes(v.vectors(), incoming(v))
    return upserts.select("id", "doc_id", F.lit("upsert").alias("change")).unionByName(deletes.select("id", "doc_id", F.lit("delete").alias("change")))


view_sql.register_view("v_centroids", """
    SELECT document_type, doc_id, list(m ORDER BY i) AS vector FROM (
      SELECT document_type, doc_id, i, avg(CAST(values[i] AS DOUBLE)) AS m FROM v_vectors, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2""")


def centroids(v):
    """Mean vector per document; the queries thus cost one comparison per vector."""
    key = vectors.DOCUMENT
    parts = v.vectors().select(*key, F.posexplode("values").alias("i", "x")).groupBy(*key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"])
    return parts.groupBy(*key).agg(listed.alias("vector")).select(*key, F.lit("centro").alias("query_key"), "vector")


def _dot_sql(a, b):
    """Dot product summed from left to right, as the operator sums it."""
    return f"list_reduce(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)), lambda x, y: x + y)"


def _cosine_sql(a, b):
    norms = f"(sqrt({_dot_sql(a, a)}) * sqrt({_dot_sql(b, b)}))"
    return f"CASE WHEN {norms} > 0 THEN {_dot_sql(a, b)} / {norms} ELSE 0 END"


_USABLE = "trim(text) <> '' AND NOT contains(upper(text), 'RESUMEN ESTRUCTURADO DEL ACTA')"


@register("retrieve", f"""
    SELECT document_type, doc_id, trim(text) AS snippet, CAST(min(rank) AS BIGINT) AS rank, round(max(similarity), 6) AS similarity FROM (
      SELECT document_type, doc_id, text, similarity, row_number() OVER (PARTITION BY document_type, doc_id ORDER BY similarity DESC, id) AS rank FROM (
        SELECT x.document_type, x.doc_id, x.id, x.text, {_cosine_sql("x.values", "q.vector")} AS similarity
        FROM v_vectors x JOIN v_centroids q ON q.document_type = x.document_type AND q.doc_id = x.doc_id))
    WHERE rank <= 6 AND {_USABLE} GROUP BY 1, 2, 3""")
def _(v):
    hits = vectors.retrieve(centroids(v), v.vectors(), 6)
    return hits.select("document_type", "doc_id", "snippet", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


# Every conversation is a deed and an opinion of the same number; the opinion has a mark before each turn.
view_sql.register_view("v_typed", """
    SELECT 'acta' AS document_type, doc_id, chunk_index, text, values FROM v_embedded
    UNION ALL SELECT 'opinion', doc_id, chunk_index, 'O ' || text, values FROM v_embedded""")


def two_types(rows):
    """Chunks as those of a deed and of an opinion with the same number."""
    both = rows.withColumn("document_type", F.explode(F.array(F.lit("acta"), F.lit("opinion"))))
    shown = F.when(F.col("document_type") == "opinion", F.concat(F.lit("O "), "text")).otherwise(F.col("text"))
    return both.withColumn("text", shown).withColumn("namespace", F.concat(F.lit("documents-"), "document_type"))


def typed_vectors(v):
    return two_types(embedded(v)).withColumn("id", F.concat_ws("-", "document_type", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


def typed_texts(v):
    """Documents asked about: deeds, and opinions of odd number."""
    return two_types(v.table("documents").select("doc_id", "text")).where("document_type = 'acta' or doc_id % 2 = 1")


view_sql.register_view("v_asked", """
    SELECT 'acta' AS document_type, doc_id, text FROM documents UNION ALL SELECT 'opinion', doc_id, 'O ' || text FROM documents WHERE doc_id % 2 = 1""")
_BROAD = ", ".join(f"('{k}', {hashed_vector(t)})" for k, t in vectors.BROAD_QUERIES.items())
view_sql.register_view("v_broad_hits", f"""
    SELECT document_type, doc_id, query_key, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS snippet, CAST(min(rank) AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY document_type, doc_id, query_key ORDER BY similarity DESC, id) AS rank FROM (
        SELECT e.document_type, e.doc_id, q.k AS query_key, e.document_type || '-' || e.doc_id || '-' || chunk_index AS id, e.text, {_cosine_sql("e.values", "q.vec")} AS similarity
        FROM v_typed e JOIN v_asked a ON a.document_type = e.document_type AND a.doc_id = e.doc_id, (VALUES {_BROAD}) AS q(k, vec)))
    WHERE rank <= 6 AND {_USABLE} GROUP BY 1, 2, 3, 4""")


def broad(v):
    return vectors.broad_context(typed_vectors(v), two_types(turn_chunks(v)), typed_texts(v))


def _fallback_sql(hits, key, chars, among="v_asked"):
    """Documents without hits have no usable chunk here, so their text stands in."""
    return f"""SELECT a.document_type, a.doc_id, '{key}', CASE WHEN length(a.text) <= {chars} THEN a.text ELSE rtrim(a.text[1:{chars}]) END, 1
        FROM {among} a LEFT JOIN (SELECT DISTINCT document_type, doc_id FROM {hits}) h ON h.document_type = a.document_type AND h.doc_id = a.doc_id
        WHERE h.doc_id IS NULL AND a.text <> ''"""


view_sql.register_view("v_broad", f"SELECT document_type, doc_id, query_key, snippet, rank FROM v_broad_hits UNION ALL {_fallback_sql('v_broad_hits', 'local_fallback', 8000)}")


@register("broad_context", "SELECT document_type, doc_id, query_key, snippet, rank FROM v_broad")
def _(v):
    return broad(v).select("document_type", "doc_id", "query_key", "snippet", F.col("rank").cast("long").alias("rank"))


_FOCUSED = ", ".join(f"('{k}', {hashed_vector(t)})" for k, t in RETRY_QUERIES.items())
view_sql.register_view("v_typed_missing", """
    SELECT a.document_type, a.doc_id, m.missing, a.text FROM v_missing m JOIN v_asked a ON a.doc_id = m.doc_id WHERE len(m.missing) > 0""")
view_sql.register_view("v_focused_hits", f"""
    SELECT document_type, doc_id, query_key, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS snippet, CAST(min(rank) AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY document_type, doc_id, query_key ORDER BY similarity DESC, id) AS rank FROM (
        SELECT e.document_type, e.doc_id, 'retry_' || q.k AS query_key, e.document_type || '-' || e.doc_id || '-' || chunk_index AS id, e.text, {_cosine_sql("e.values", "q.vec")} AS similarity
        FROM v_typed e JOIN (SELECT DISTINCT document_type, doc_id, split_part(m, '.', 1) AS f FROM (SELECT document_type, doc_id, unnest(missing) AS m FROM v_typed_missing)) w
          ON w.document_type = e.document_type AND w.doc_id = e.doc_id
        JOIN (VALUES {_FOCUSED}) AS q(k, vec) ON q.k = w.f))
    WHERE rank <= 8 AND {_USABLE} GROUP BY 1, 2, 3, 4""")


@register("focused_context", f"""
    SELECT document_type, doc_id, query_key, snippet, rank FROM v_focused_hits
    UNION ALL {_fallback_sql("v_focused_hits", "retry_local_fallback", 10000, "v_typed_missing")}""")
def _(v):
    texts = typed_texts(v)
    typed = missing(v).join(texts.select(*vectors.DOCUMENT), "doc_id")
    found = vectors.focused_context(typed, typed_vectors(v), two_types(turn_chunks(v)), texts)
    return found.select("document_type", "doc_id", "query_key", "snippet", F.col("rank").cast("long").alias("rank"))


@register("fallback_snippets", """
    SELECT document_type, doc_id, snippet, CAST(rank AS BIGINT) AS rank FROM (
      SELECT e.document_type, e.doc_id, e.text AS snippet, row_number() OVER (PARTITION BY e.document_type, e.doc_id ORDER BY chunk_index) AS rank
      FROM v_typed e JOIN v_asked a ON a.document_type = e.document_type AND a.doc_id = e.doc_id WHERE e.text NOT IN ('', '0')) WHERE rank <= 8
    UNION ALL SELECT document_type, doc_id, CASE WHEN length(text) <= 8000 THEN text ELSE rtrim(text[1:8000]) END, 1 FROM v_asked WHERE doc_id NOT IN (SELECT doc_id FROM v_turns)""")
def _(v):
    found = vectors.fallback_snippets(two_types(turn_chunks(v)), typed_texts(v), *vectors.BROAD_FALLBACK)
    return found.select("document_type", "doc_id", "snippet", F.col("rank").cast("long").alias("rank"))


@register("snippet_counts", "SELECT document_type, doc_id, count(*) AS match_count, string_agg(DISTINCT query_key, ',' ORDER BY query_key) AS queries_used FROM v_broad GROUP BY 1, 2")
def _(v):
    return vectors.snippet_counts(broad(v)).select("document_type", "doc_id", "match_count", F.array_join("queries_used", ",").alias("queries_used"))


@register("format_context", r"""
    SELECT d.document_type, d.doc_id, coalesce(c.context, 'Sin contexto recuperado.') AS context FROM v_asked d LEFT JOIN (
      SELECT document_type, doc_id, string_agg(block, chr(10) || chr(10) ORDER BY role) AS context FROM (
        SELECT document_type, doc_id, role, upper(role) || ':' || chr(10) || string_agg('[' || (idx + 1) || '] ' || CASE WHEN length(s) <= 1800 THEN s ELSE rtrim(s[1:1800]) END, chr(10) ORDER BY idx) AS block FROM (
          SELECT *, row_number() OVER (PARTITION BY document_type, doc_id ORDER BY role, idx) AS n FROM (
            SELECT t.document_type, conv_id AS doc_id, role, turn AS idx, trim(CASE WHEN t.document_type = 'opinion' THEN 'O ' ELSE '' END || text, ' ' || chr(9) || chr(10) || chr(13)) AS s
            FROM conversations, (VALUES ('acta'), ('opinion')) AS t(document_type))) WHERE n <= 10 GROUP BY 1, 2, 3) GROUP BY 1, 2) c
      ON c.document_type = d.document_type AND c.doc_id = d.doc_id""")
def _(v):
    turns = two_types(v.table("conversations").selectExpr("conv_id as doc_id", "role as query_order", "role as query_key", "turn as idx", "text"))
    texts = typed_texts(v)
    return vectors.format_context(texts, turns.withColumnRenamed("text", "snippet"), max_snippets=10).select("document_type", "doc_id", "context")


@register("reindex_vectors", r"""
    SELECT 'acta-' || doc_id || '-' || n AS id, pages FROM (
      SELECT doc_id, pages, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS n FROM (
        SELECT t.doc_id, t.chunk_index AS o, CAST(t.chunk_index AS VARCHAR) AS pages FROM v_turns t JOIN v_document_index i ON i.id = t.doc_id
        WHERE trim(coalesce(i.index_text, i.extracted_text, '')) <> '' AND t.doc_id IN (SELECT doc_id FROM labels)
        UNION ALL SELECT i.id, 0, '4,5' FROM v_document_index i WHERE trim(coalesce(i.index_text, i.extracted_text, '')) <> ''
          AND i.id NOT IN (SELECT doc_id FROM v_turns WHERE doc_id IN (SELECT doc_id FROM labels))))""")
def _(v):
    index = v.document_index(with_text=True).selectExpr("id as doc_id", "'acta' as document_type", "storage_path", "user_id", "index_text", "extracted_text")
    good = v.table("labels").select("doc_id")
    stored = turn_chunks(v).join(good, "doc_id", "left_semi").withColumn("page_numbers_csv", F.col("chunk_index").cast("string"))
    page_map = v.table("documents").selectExpr("doc_id", "0 as chunk_index", "array(4, 5) as page_numbers")
    built, _ = vectors.reindex(index, stored, page_map)
    return built.select("id", F.col("metadata")["page_numbers_csv"].alias("pages"))


def inspected(v):
    note = F.create_map(
        F.lit("page_numbers_csv"), F.lit("3,4"), F.lit("page_ids"), F.when(F.col("chunk_index") % 2 == 0, "page-3").otherwise(""),
        F.lit("correction_engine"), F.when(F.col("chunk_index") % 5 == 0, "targeted-ocr"),
        F.lit("corrected_with_targeted_ocr"), F.when(F.col("chunk_index") % 5 == 0, "true").otherwise("false"),
    )
    return v.vectors().withColumn("metadata", note)


@register("inspect_records", """
    SELECT id, len(values) AS dimension, chunk_index % 5 = 0 AS corrected, chunk_index % 5 = 0 AS corrected_with_targeted_ocr, chunk_index % 2 = 0 AS correction_available,
           CASE WHEN trim(text) = '' THEN 4 ELSE 0 END AS score FROM v_vectors""")
def _(v):
    return vectors.inspect_records(inspected(v)).select(
        "id", F.col("dimension").cast("long").alias("dimension"), "corrected", "corrected_with_targeted_ocr", "correction_available", "score"
    )


@register("inspect_index", """
    SELECT d.doc_id, count(x.id) AS record_count, count(x.id) FILTER (trim(x.text) = '') AS suspicious_count, count(x.id) FILTER (x.chunk_index % 5 = 0) AS corrected_count,
           count(x.id) > 0 AS available FROM documents d LEFT JOIN v_vectors x ON x.doc_id = d.doc_id GROUP BY 1""")
def _(v):
    return vectors.inspect_index(document_ids(v), inspected(v)).select("doc_id", "record_count", "suspicious_count", "corrected_count", "available")


@register("order_chunks", "SELECT id, i AS chunk_index, row_number() OVER (ORDER BY i ASC NULLS LAST, id) - 1 AS position FROM (SELECT id, CASE WHEN chunk_index % 7 <> 3 THEN chunk_index % 50 END AS i FROM v_vectors)")
def _(v):
    odd = v.vectors().withColumn("chunk_index", F.expr("case when chunk_index % 7 <> 3 then chunk_index % 50 end"))
    return ranked_lists.order_chunks(odd).select("id", "chunk_index", "position")


@register("page_overlap", "SELECT conv_id, turn, len(list_intersect([turn, turn + 1, turn + 2], [2, 3, turn])) AS shared FROM conversations")
def _(v):
    rows = v.table("conversations").select("conv_id", "turn", F.expr("array(turn, turn + 1, turn + 2)").alias("a"), F.expr("array(2L, 3L, turn)").alias("b"))
    return rows.select("conv_id", "turn", page_overlap(F.col("a"), F.col("b")).cast("long").alias("shared"))


def paged_chunks(v):
    return turn_chunks(v).withColumn("page_numbers", F.expr("case when chunk_index % 4 = 3 then cast(array() as array<int>) else array(chunk_index + 1, chunk_index + 2) end"))


def targets(v):
    return paged_chunks(v).where("size(page_numbers) > 0").select("doc_id", "chunk_index", F.col("text").alias("current_text"), "page_numbers")


view_sql.register_view("v_paged", "SELECT *, CASE WHEN chunk_index % 4 = 3 THEN CAST([] AS INTEGER[]) ELSE [chunk_index + 1, chunk_index + 2] END AS page_numbers FROM v_turns")


@register("related_chunks", """
    SELECT a.doc_id, a.chunk_index AS target_index, b.chunk_index FROM v_paged a JOIN v_paged b ON a.doc_id = b.doc_id
    WHERE list_has_any(a.page_numbers, b.page_numbers)""")
def _(v):
    return correction.related_chunks(paged_chunks(v), targets(v))


@register("correction_requests", """
    WITH req AS (SELECT doc_id, chunk_index + k AS chunk_index FROM v_turns, (VALUES (0), (9)) AS t(k) UNION ALL SELECT doc_id + 50000, 0 FROM documents),
    c AS (SELECT *, CASE WHEN chunk_index % 5 = 2 THEN ' ' ELSE text END AS shown FROM v_paged)
    SELECT r.doc_id, r.chunk_index, CASE WHEN NOT coalesce(k.known, FALSE) THEN 'no_chunks' WHEN c.doc_id IS NULL THEN 'unknown_chunk' WHEN trim(c.shown) = '' THEN 'empty_chunk'
             WHEN c.chunk_index % 4 = 3 THEN 'no_pages' WHEN r.doc_id % 3 = 0 THEN 'source_missing' END AS reason
    FROM req r LEFT JOIN c ON c.doc_id = r.doc_id AND c.chunk_index = r.chunk_index LEFT JOIN (SELECT DISTINCT doc_id, TRUE AS known FROM v_turns) k ON k.doc_id = r.doc_id""")
def _(v):
    requests = turn_chunks(v).select("doc_id", F.explode(F.array(F.col("chunk_index"), F.col("chunk_index") + 9)).alias("chunk_index")).unionByName(
        v.table("documents").selectExpr("doc_id + 50000 as doc_id", "0 as chunk_index")
    )
    chunks = paged_chunks(v).withColumn("text", F.expr("case when chunk_index % 5 = 2 then ' ' else text end"))
    sources = turn_chunks(v).select("doc_id").distinct().withColumn("available", F.col("doc_id") % 3 != 0)
    return correction.correction_requests(requests, chunks, chunks, sources).select("doc_id", "chunk_index", "reason")


_VISION = "length(text) >= 700"
view_sql.register_view("v_chosen", """
    SELECT doc_id, chunk_index, text AS current_text, page_numbers,
           CASE WHEN length(text) >= 700 AND doc_id % 4 <> 0 THEN 'ollama-vision' WHEN length(text) >= 200 THEN 'targeted-ocr' END AS engine,
           trim(CASE WHEN length(text) >= 700 AND doc_id % 4 <> 0 THEN reverse(text) WHEN length(text) >= 200 THEN CASE WHEN doc_id % 2 = 0 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) ELSE 'corto ' || chunk_index END END, ' ' || chr(9) || chr(10) || chr(13)) AS corrected_text,
           CASE WHEN length(text) >= 700 THEN CASE WHEN doc_id % 4 = 0 THEN 'tiempo' END ELSE 'No se pudieron extraer imágenes de las páginas del chunk.' END AS fallback_error
    FROM v_paged WHERE len(page_numbers) > 0""")


def chosen(v):
    vision = turn_chunks(v).where(_VISION).selectExpr("doc_id", "chunk_index", "reverse(text) as text", "case when doc_id % 4 = 0 then 'tiempo' end as error")
    scanned = turn_chunks(v).where("length(text) >= 200").selectExpr(
        "doc_id", "chunk_index", "case when doc_id % 2 = 0 then text else concat('corto ', cast(chunk_index as string)) end as text"
    )
    return correction.choose_correction(targets(v), vision, scanned)


@register("choose_correction", "SELECT doc_id, chunk_index, engine, corrected_text, fallback_error FROM v_chosen")
def _(v):
    return chosen(v).select("doc_id", "chunk_index", "engine", "corrected_text", "fallback_error")


_BOUNDS = """CASE WHEN coalesce(corrected_text, '') = '' THEN 'empty_correction' WHEN length(corrected_text) < greatest(40, floor(length(current_text) * 0.30::DOUBLE)) THEN 'too_short'
     WHEN length(corrected_text) > greatest(1800, ceil(length(current_text) * 2.20::DOUBLE)) THEN 'too_long' END"""


@register("check_bounds", f"SELECT doc_id, chunk_index, {_BOUNDS} AS rejection FROM v_chosen")
def _(v):
    return correction.check_bounds(chosen(v)).select("doc_id", "chunk_index", "rejection")


view_sql.register_view("v_corrected", f"""
    SELECT p.doc_id, p.chunk_index, p.text, c.engine, c.corrected_text, coalesce(c.corrected_text <> trim(p.text, ' ' || chr(9) || chr(10) || chr(13)), FALSE) AS changed
    FROM v_paged p LEFT JOIN (SELECT * FROM v_chosen WHERE {_BOUNDS} IS NULL) c ON c.doc_id = p.doc_id AND c.chunk_index = p.chunk_index""")


def corrected(v):
    accepted = correction.check_bounds(chosen(v)).where("rejection is null")
    noted = paged_chunks(v).withColumn("metadata", F.create_map(F.lit("origen"), F.lit("x")))
    return correction.apply_corrections(noted, accepted, "2024-01-30T00:00:00+00:00")


@register("apply_corrections", """
    SELECT doc_id, chunk_index, CASE WHEN changed THEN corrected_text ELSE text END AS text, changed, CASE WHEN changed THEN engine END AS engine,
           CASE WHEN changed THEN CASE WHEN engine = 'ollama-vision' THEN 'manual_chunk_vision' ELSE 'manual_chunk_targeted_ocr' END END AS reason, 'x' AS origen FROM v_corrected""")
def _(v):
    m = F.col("metadata")
    return corrected(v).select("doc_id", "chunk_index", "text", "changed", "engine", m["correction_reason"].alias("reason"), m["origen"].alias("origen"))


@register("correction_history", """
    SELECT doc_id, chunk_index, updated_at, previous_preview FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC, chunk_index DESC) AS n FROM (
        SELECT doc_id, chunk_index, '2024-01-30T00:00:00+00:00' AS updated_at, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(t[1:220]) || '...' END AS previous_preview
        FROM (SELECT doc_id, chunk_index, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM v_corrected WHERE changed)
        UNION ALL SELECT user_id % 100, CAST(event_id AS INTEGER), '2023-01-01', 'viejo' FROM events)) WHERE n <= 50""")
def _(v):
    old = v.table("events").selectExpr(
        "user_id % 100 as doc_id", "'2023-01-01' as updated_at", "cast(event_id as int) as chunk_index", "'targeted-ocr' as engine", "'viejo' as previous_preview", "'' as corrected_preview"
    )
    return correction.correction_history(old, corrected(v), "2024-01-30T00:00:00+00:00").select("doc_id", "chunk_index", "updated_at", "previous_preview")


@register("corrected_document_status", """
    SELECT i.id AS doc_id, CASE WHEN i.id IN (SELECT doc_id FROM v_corrected WHERE changed) THEN CASE WHEN status <> 'failed' THEN 'indexed' ELSE 'processed' END ELSE status END AS status FROM v_document_index i""")
def _(v):
    index = v.document_index().selectExpr("id as doc_id", "status")
    return correction.document_status(index, corrected(v), index.where("status <> 'failed'"))


def scanned_candidates(v):
    """Per chunk: itself and the next one, each on its own page."""
    return (
        turn_chunks(v).select("doc_id", "text", F.posexplode(F.array(F.col("chunk_index"), F.col("chunk_index") - 1)).alias("candidate_index", "chunk_index"))
        .withColumn("page_numbers", F.array(F.col("chunk_index") + 1))
        .where("chunk_index >= 0")
    )


@register("best_candidate")
def _(v):
    best = correction.best_candidate(scanned_candidates(v), paged_chunks(v), targets(v))
    return best.select("doc_id", "chunk_index", "candidate_index", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


# The similarity itself on short texts. Each step takes the longest common stretch (first in a, then in b) and leaves what is
# left and right of it to the next.
def _longest(a: str, b: str) -> str:
    length = f"list_max(list_filter(range(0, least(length({a}) - i, length({b}) - j) + 2), lambda k: substring({a}, i, k) = substring({b}, j, k)))"
    starts = f"list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({b}) + 1), lambda j: {{'n': {length}, 'i': -i, 'j': -j}}))"
    return f"list_sort(flatten({starts}), 'DESC')[1]"


view_sql.register_view("v_name_pairs", "SELECT DISTINCT p.p_name || ' ' || lower(p.p_type) AS x, q.p_name || ' ' || lower(q.p_type) AS y FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1")
view_sql.register_view("v_name_similarity", f"""
    SELECT x, y, sum(n) * 200.0 / (length(x) + length(y)) AS similarity FROM (
      WITH RECURSIVE walk AS (
          SELECT x, y, a, b, s.n, -s.i AS i, -s.j AS j FROM (SELECT x, y, x AS a, y AS b, {_longest('x', 'y')} AS s FROM v_name_pairs)
          UNION ALL
          SELECT x, y, a, b, s.n, -s.i, -s.j FROM (
            SELECT x, y, a, b, {_longest('a', 'b')} AS s FROM (
              SELECT x, y, substring(a, 1, i - 1) AS a, substring(b, 1, j - 1) AS b FROM walk WHERE n > 0
              UNION ALL SELECT x, y, substring(a, i + n), substring(b, j + n) FROM walk WHERE n > 0) WHERE a <> '' AND b <> ''))
      SELECT * FROM walk) GROUP BY x, y""")


@register("text_similarity", """
    SELECT p.p_partkey, round(similarity, 6) AS similarity FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1
    JOIN v_name_similarity ON x = p.p_name || ' ' || lower(p.p_type) AND y = q.p_name || ' ' || lower(q.p_type)""")
def _(v):
    named = v.table("part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"))
    pairs = named.join(named.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("name").alias("other")), "p_partkey")
    return pairs.select("p_partkey", F.round(text_similarity("name", "other"), 6).alias("similarity"))


# The same choice with a similarity that SQL can state: the share of equal lengths in percent of the longer text.
@register("pick_candidate", """
    WITH options AS (
      SELECT doc_id, k AS candidate_index, chunk_index - k AS chunk_index, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS candidate FROM v_turns, (VALUES (0), (1)) AS t(k) WHERE chunk_index >= k),
    places AS (
      SELECT a.doc_id, a.chunk_index, count(DISTINCT CASE WHEN b.chunk_index < a.chunk_index THEN b.chunk_index END) AS place FROM v_paged a JOIN v_paged b ON a.doc_id = b.doc_id
      WHERE list_has_any(a.page_numbers, b.page_numbers) GROUP BY 1, 2),
    scored AS (
      SELECT o.doc_id, o.chunk_index, candidate_index, 50 * (length(candidate) % 7) / 7.0::DOUBLE AS similarity,
             50 * (length(candidate) % 7) / 7.0::DOUBLE + 12 + 18 * (least(length(candidate), length(p.text)) / greatest(length(candidate), length(p.text))::DOUBLE) - 8 * abs(candidate_index - place) AS score
      FROM options o JOIN v_paged p ON p.doc_id = o.doc_id AND p.chunk_index = o.chunk_index JOIN places l ON l.doc_id = o.doc_id AND l.chunk_index = o.chunk_index
      WHERE candidate <> '' AND len(p.page_numbers) > 0)
    SELECT doc_id, chunk_index, candidate_index, round(similarity, 6) AS similarity, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY score DESC, candidate_index) AS n FROM scored) WHERE n = 1""")
def _(v):
    pointed = correction.candidate_points(scanned_candidates(v), paged_chunks(v), targets(v))
    measured = pointed.withColumn("similarity", 50 * (F.length("candidate_text") % 7) / F.lit(7.0))
    return correction.pick_candidate(measured).select("doc_id", "chunk_index", "candidate_index", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))
