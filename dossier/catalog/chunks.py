"""Queries over chunking and chunk quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import register, view_sql
from dossier.operators import chunk_quality, chunking


@register("chunk_fixed", r"""
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, chunk AS text FROM (
      SELECT doc_id, s, trim(substr(t, CAST(s + 1 AS BIGINT), 1200)) AS chunk FROM (
        SELECT doc_id, t, unnest(range(0, length(t), 1050)) AS s FROM (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents))) WHERE chunk <> ''""")
def _(v):
    return chunking.chunk_fixed(v.table("documents").select("doc_id", "text"))


view_sql.register_view("v_paragraphs", r"""
    SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY i) - 1 AS INTEGER) AS paragraph_index, p AS text FROM (
      SELECT doc_id, page_number, i, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)) AS p FROM (
        SELECT doc_id, page_number, unnest(bs) AS b, unnest(range(len(bs))) AS i FROM (
          SELECT doc_id, page_number, string_split_regex(trim(regexp_replace(text, '\r\n?', chr(10), 'g'), ' ' || chr(9) || chr(10)), '\n\s*\n') AS bs FROM v_pages))) WHERE p <> ''""")


def fold_sql(items: str, glue: str, alone: str) -> str:
    """Greedy packing of a list of texts as a fold: ``b`` is the open buffer, ``o`` the closed pieces; ``alone`` handles an oversized item."""
    grown = f"CASE WHEN a.b = '' THEN e.b ELSE a.b || {glue} || e.b END"
    closed = "a.o || CASE WHEN a.b <> '' THEN [a.b] ELSE CAST([] AS VARCHAR[]) END"
    none = "CAST([] AS VARCHAR[])"
    return f"""list_reduce(list_transform({items}, lambda l: {{'b': l, 'o': {none}}}), lambda a, e:
        CASE WHEN length({grown}) <= 1200 THEN {{'b': {grown}, 'o': a.o}} {alone.format(closed=closed)} ELSE {{'b': e.b, 'o': {closed}}} END, {{'b': '', 'o': {none}}})"""


_WINDOWS = r"list_filter(list_transform(range(0, length(regexp_replace(e.b, '\s+', ' ', 'g')), 1200), lambda s: trim(substr(regexp_replace(e.b, '\s+', ' ', 'g'), CAST(s + 1 AS BIGINT), 1200))), lambda w: w <> '')"
_LONG_LINE = "WHEN length(e.b) > 1200 THEN {{'b': '', 'o': {closed} || " + _WINDOWS + "}}"


def pieces_sql(c: str) -> str:
    lines = f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"
    return f"""CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) WHEN length({c}) <= 1200 THEN [{c}] ELSE (SELECT list_filter(list_transform(r.o || [r.b], lambda x: trim(x)), lambda x: x NOT IN ('', '0'))
        FROM (SELECT {fold_sql(lines, 'chr(10)', _LONG_LINE)} AS r)) END"""


@register("split_paragraphs", "SELECT doc_id, page_number, paragraph_index, text FROM v_paragraphs")
def _(v):
    return v.pages().select("doc_id", "page_number", F.posexplode(chunking.paragraphs(F.col("text"))).alias("paragraph_index", "text"))


@register("split_oversized", f"""
    SELECT doc_id, CAST(unnest(range(len(ps))) AS INTEGER) AS piece_index, unnest(ps) AS text
    FROM (SELECT doc_id, {pieces_sql('t')} AS ps FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents))""")
def _(v):
    return v.table("documents").select("doc_id", F.posexplode(chunking.split_oversized(F.col("text"))).alias("piece_index", "text"))


view_sql.register_view("v_packed", f"""
    SELECT doc_id * 100 + page_number AS doc_id, r.o || CASE WHEN r.b <> '' THEN [r.b] ELSE CAST([] AS VARCHAR[]) END AS chunks
    FROM (SELECT doc_id, page_number, {fold_sql("list(text ORDER BY paragraph_index)", "chr(10) || chr(10)", "")} AS r FROM v_paragraphs GROUP BY doc_id, page_number)""")


@register("chunk_text_for_index", "SELECT doc_id, CAST(unnest(range(len(chunks))) AS INTEGER) AS chunk_index, unnest(chunks) AS text FROM v_packed")
def _(v):
    return chunking.chunk_text_for_index(v.pages().select((F.col("doc_id") * 100 + F.col("page_number")).alias("doc_id"), "text"))


view_sql.register_view("v_pieces", f"""
    SELECT doc_id, page_number, paragraph_index, unnest(range(len(ps))) AS piece_index, unnest(ps) AS text
    FROM (SELECT doc_id, page_number, paragraph_index, {pieces_sql('text')} AS ps FROM v_paragraphs)""")
# The fold keeps page lists next to the texts: buffer text and pages, closed texts and closed page lists.
view_sql.register_view("v_page_chunks", """
    SELECT doc_id, CASE WHEN r.b <> '' THEN r.o || [r.b] ELSE r.o END AS texts, CASE WHEN r.b <> '' THEN r.po || [r.p] ELSE r.po END AS pages FROM (
      SELECT doc_id, list_reduce(list({'b': text, 'p': [page_number], 'o': CAST([] AS VARCHAR[]), 'po': CAST([] AS BIGINT[][])} ORDER BY page_number, paragraph_index, piece_index),
        lambda a, e: CASE WHEN a.b = '' THEN {'b': e.b, 'p': e.p, 'o': a.o, 'po': a.po}
                          WHEN length(a.b) + 2 + length(e.b) <= 1200 THEN {'b': a.b || chr(10) || chr(10) || e.b, 'p': CASE WHEN list_contains(a.p, e.p[1]) THEN a.p ELSE a.p || e.p END, 'o': a.o, 'po': a.po}
                          ELSE {'b': e.b, 'p': e.p, 'o': a.o || [a.b], 'po': a.po || [a.p]} END) AS r
      FROM v_pieces GROUP BY doc_id)""")
view_sql.register_view("v_loose_documents", """
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v_page_chunks)""")


def page_chunks(v):
    documents = v.table("documents").select("doc_id", "text")
    return chunking.chunk_pages(v.pages(), documents)


@register("chunk_pages", """
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, text, array_to_string(list_transform(p, lambda n: 'page-' || n), ',') AS page_ids,
           array_to_string(p, ',') AS page_numbers_csv, CAST(p[1] AS INTEGER) AS primary_page
    FROM (SELECT doc_id, unnest(range(len(texts))) AS i, unnest(texts) AS text, unnest(pages) AS p FROM v_page_chunks)
    UNION ALL SELECT doc_id, 0, text, NULL, NULL, NULL FROM v_loose_documents WHERE text <> ''""")
def _(v):
    return page_chunks(v).select("doc_id", "chunk_index", "text", F.array_join("page_ids", ",").alias("page_ids"), "page_numbers_csv", "primary_page")


view_sql.register_view("v_turns", "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS chunk_index, text FROM conversations")


def turns(v):
    return v.table("conversations").selectExpr("conv_id as doc_id", "cast(turn as int) as chunk_index", "text")


@register("chunk_page_map", """
    SELECT doc_id, chunk_index, (chunk_index + 1) || '|' || (chunk_index + 2) AS page_numbers, 'page-' || (chunk_index + 1) || '|page-' || (chunk_index + 2) AS page_ids FROM v_turns""")
def _(v):
    chunks = turns(v).withColumn("page_numbers", F.expr("array(chunk_index + 1, chunk_index + 2)"))
    return chunking.chunk_page_map(chunks).select(
        "doc_id", "chunk_index", F.array_join("page_numbers", "|").alias("page_numbers"), F.array_join("page_ids", "|").alias("page_ids")
    )


@register("attach_page_map", r"""
    SELECT doc_id, chunk_index, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, CASE WHEN chunk_index <> 1 THEN (chunk_index + 1) || ',' || (chunk_index + 2) END AS page_numbers_csv,
           CASE WHEN chunk_index <> 1 THEN chunk_index + 1 END AS primary_page FROM v_turns WHERE trim(text) <> ''""")
def _(v):
    stored = turns(v).withColumn("page_numbers", F.expr("case when chunk_index <> 1 then array(chunk_index + 1, chunk_index + 2) end"))
    return chunking.attach_page_map(turns(v), stored).select("doc_id", "chunk_index", "text", "page_numbers_csv", "primary_page")


_TRIM = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"
view_sql.register_view("v_quality", rf"""
    SELECT doc_id, page_number, CASE WHEN t = '' THEN 4 ELSE 0 END AS q_empty, least(length(t) - length(replace(t, '~', '')), 3) AS q_tilde,
           CASE WHEN regexp_matches(t, '[�£¤€¢]') THEN 2 ELSE 0 END AS q_glyph,
           CASE WHEN len(list_filter(string_split_regex(t, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '\p{{L}}*\d[\p{{L}}\d]*'))) >= 2 THEN 1 ELSE 0 END AS q_mixed,
           CASE WHEN regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_])\p{{L}}{{2,}}[''"`]\p{{L}}{{2,}}($|[^\p{{L}}\p{{N}}_])') THEN 1 ELSE 0 END AS q_quote,
           CASE WHEN len(list_filter(string_split(t, chr(10)), lambda w: regexp_full_match(trim(w, ' ' || chr(9) || chr(13)), '[\p{{L}}\d]{{1,2}}'))) >= 4 THEN 2 ELSE 0 END AS q_short,
           CASE WHEN len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\s]')) / greatest(length(regexp_replace(t, '\s+', '', 'g')), 1) >= 0.14 THEN 1 ELSE 0 END AS q_symbol
    FROM (SELECT doc_id, page_number, {_TRIM} AS t FROM v_quality_texts)""")
view_sql.register_view("v_quality_texts", """
    SELECT doc_id, page_number, text FROM v_pages
    UNION ALL SELECT doc_id + 100000, 0, CASE WHEN doc_id % 4 = 0 THEN text ELSE text || chr(10) || 'a' || chr(10) || 'b1' || chr(10) || chr(10) || 'c' || chr(10) || '7 £ pa''labra' END FROM documents""")
_SUM = "q_empty + q_tilde + q_glyph + q_mixed + q_quote + q_short + q_symbol"


@register("chunk_quality", f"""
    SELECT doc_id, page_number, CAST({_SUM} AS BIGINT) AS score, {_SUM} >= 3 AS suspicious,
           CAST((CASE WHEN q_empty > 0 THEN 1 ELSE 0 END) + (CASE WHEN q_tilde > 0 THEN 1 ELSE 0 END) + (CASE WHEN q_glyph > 0 THEN 1 ELSE 0 END)
             + q_mixed + q_quote + (CASE WHEN q_short > 0 THEN 1 ELSE 0 END) + q_symbol AS BIGINT) AS reasons FROM v_quality""")
def _(v):
    extra = v.table("documents").selectExpr(
        "doc_id + 100000 as doc_id", "0L as page_number",
        r"""case when doc_id % 4 = 0 then text else concat(text, '\na\nb1\n\nc\n7 £ pa\'labra') end as text""",
    )
    rated = chunk_quality.chunk_quality(v.pages().unionByName(extra))
    return rated.select("doc_id", "page_number", F.col("score").cast("long").alias("score"), "suspicious", F.size("reasons").cast("long").alias("reasons"))
