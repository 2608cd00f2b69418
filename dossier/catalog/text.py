"""Queries over page text and page selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import register, view_sql
from dossier.functions import pages as page_functions
from dossier.functions import text
from dossier.functions.tilde_words import TILDE_WORDS
from dossier.operators import pages, ranked_lists
from dossier.session import fresh_folder
from dossier.sources import entities, storage, tables
from dossier.sources.buckets import BucketTable

_MAP = "MAP {" + ", ".join(f"'{k}': '{w}'" for k, w in TILDE_WORDS.items()) + "}"
_TILDE = r"(?i)\b(?:" + "|".join(TILDE_WORDS) + r")\b"
_FIX = f"""lambda h: CASE WHEN h = upper(h) THEN upper(({_MAP})[lower(h)]) WHEN h = lower(h) THEN ({_MAP})[lower(h)]
     WHEN h[1] = upper(h[1]) AND h[2:] = lower(h[2:]) THEN upper((({_MAP})[lower(h)])[1]) || (({_MAP})[lower(h)])[2:] ELSE ({_MAP})[lower(h)] END"""


def tilde_sql(c: str) -> str:
    hits = f"list_transform(regexp_extract_all({c}, '{_TILDE}'), {_FIX})"
    gaps = f"string_split_regex({c}, '{_TILDE}')"
    return f"CASE WHEN {c} LIKE '%~%' THEN list_reduce(list_transform(list_zip({gaps}, {hits}), lambda z: z[1] || coalesce(z[2], '')), lambda a, b: a || b) ELSE {c} END"


_RUN = r"[ \t\f]*[-—](?:[ \t\f]*[-—])+[ \t\f]*"
view_sql.register_view("v_lines_cleaned", rf"""
    SELECT doc_id, page_number,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
        '(?m){_RUN}$', '', 'g'), '{_RUN}', ' ', 'g'), '[ \t\xA0]+', ' ', 'g'), '(?m)^[ \t\f]+|[ \t\f]+$', '', 'g') AS text
    FROM v_pages""")
view_sql.register_view("v_normalized", rf"""
    SELECT doc_id, page_number, regexp_replace(regexp_replace({tilde_sql('text')}, '\n{{3,}}', chr(10) || chr(10), 'g'), '\A\n+|\n+\z', '', 'g') AS text
    FROM v_lines_cleaned""")
_L, _N, _S = r"len(regexp_extract_all(x, '\p{L}'))", r"len(regexp_extract_all(x, '[\p{L}\p{N}]'))", r"len(regexp_extract_all(x, '[^\p{L}\p{N}\s]'))"
NOISY = (
    r"""(x <> '' AND (regexp_full_match(x, '[-—_=~.*,:;|\\/()\[\]{}''"`]+')"""
    + f" OR ({_N} = 0 AND {_S} >= 4) OR ({_L} < 3 AND {_S} > {_N})))"
)
view_sql.register_view("v_index_pages", rf"""
    SELECT doc_id, page_number, text, regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT {NOISY}), chr(10)),
        '\n{{3,}}', chr(10) || chr(10), 'g'), '\A\n+|\n+\z', '', 'g') AS index_text
    FROM v_normalized""")
view_sql.register_view("v_assembled", r"""
    SELECT doc_id, trim(regexp_replace(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_number) FILTER (text <> ''), ''), '\s+', ' ', 'g')) AS text,
           coalesce(string_agg(index_text, chr(10) || chr(10) ORDER BY page_number) FILTER (index_text <> ''), '') AS index_text
    FROM v_index_pages GROUP BY doc_id""")


@register("collapse_whitespace", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def _(v):
    return v.table("documents").select("doc_id", text.collapse_ws(F.col("text")).alias("text"))


@register("normalize_newlines", r"SELECT doc_id, page_number, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM v_pages")
def _(v):
    return v.pages().withColumn("text", text.normalize_newlines(F.col("text")))


@register("clean_hyphen_runs", rf"""
    SELECT doc_id, page_number, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m){_RUN}$', '', 'g'), '{_RUN}', ' ', 'g') AS text FROM v_pages""")
def _(v):
    return v.pages().withColumn("text", text.clean_hyphen_runs(text.normalize_newlines(F.col("text"))))


@register("restore_tilde_words", f"SELECT doc_id, page_number, {tilde_sql('text')} AS text FROM v_pages")
def _(v):
    return v.pages().withColumn("text", text.restore_tilde_words(F.col("text")))


@register("normalize_pages", "SELECT doc_id, page_number, text FROM v_normalized")
def _(v):
    return pages.normalize_pages(v.pages())


@register("noisy_lines", f"""
    SELECT doc_id, page_number, len(lines) AS lines, len(list_filter(lines, lambda x: {NOISY})) AS noisy
    FROM (SELECT doc_id, page_number, string_split(text, chr(10)) AS lines FROM v_lines_cleaned)""")
def _(v):
    lines = F.split(text.clean_lines(F.col("text")), "\n", -1)
    counted = v.pages().withColumn("lines", lines)
    return counted.select(
        "doc_id", "page_number", F.size("lines").cast("long").alias("lines"),
        F.size(F.filter("lines", text.is_noisy_line)).cast("long").alias("noisy"),
    )


@register("index_pages", "SELECT doc_id, page_number, index_text FROM v_index_pages")
def _(v):
    return pages.build_index_pages(v.pages()).select("doc_id", "page_number", "index_text")


@register("assemble_documents", "SELECT doc_id, text, index_text FROM v_assembled")
def _(v):
    return pages.assemble_documents(pages.build_index_pages(v.pages()))


@register("document_parts", """
    SELECT doc_id, page_number, index_text, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1 AS position FROM v_index_pages WHERE index_text <> ''""")
def _(v):
    return pages.document_parts(pages.build_index_pages(v.pages())).select("doc_id", "page_number", "index_text", "position")


view_sql.register_view("v_native", """
    SELECT conv_id AS doc_id, CASE WHEN conv_id % 3 = 0 THEN CAST(count(*) AS VARCHAR) ELSE string_agg(text, chr(10) ORDER BY turn) END AS text,
           'i:' || string_agg(text, '|' ORDER BY turn) AS index_text FROM conversations GROUP BY conv_id""")


@register("choose_extraction", """
    SELECT coalesce(n.doc_id, s.doc_id) AS doc_id, CASE WHEN coalesce(length(n.text), 0) < 120 THEN 'ocr' ELSE 'native' END AS method,
           CASE WHEN coalesce(length(n.text), 0) < 120 THEN coalesce(s.text, '') ELSE n.text END AS text,
           CASE WHEN coalesce(length(n.text), 0) < 120 THEN coalesce(s.index_text, '') ELSE n.index_text END AS index_text
    FROM v_native n FULL OUTER JOIN v_assembled s ON s.doc_id = n.doc_id""")
def _(v):
    turns = v.table("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.expr("transform(array_sort(collect_list(struct(turn, text))), t -> t.text)").alias("t"))
    native = turns.selectExpr("doc_id", "case when doc_id % 3 = 0 then cast(size(t) as string) else array_join(t, '\n') end as text", "concat('i:', array_join(t, '|')) as index_text")
    scanned = pages.assemble_documents(pages.build_index_pages(v.pages()))
    return pages.choose_extraction(native, scanned).select("doc_id", "method", "text", "index_text")


_REGISTRY = " + ".join(f"CASE WHEN lower(text) LIKE '%{w}%' THEN {n} ELSE 0 END" for w, n in page_functions.REGISTRY_WORDS.items())
_SCAN = " + ".join(
    [f"(length(u) - length(replace(u, '{w}', ''))) // {len(w)} * {n}" for w, n in page_functions.SCAN_WORDS.items()]
    + [f"CASE WHEN regexp_matches(u, '{p}') THEN {n} ELSE 0 END" for p, n in page_functions.SCAN_PATTERNS.items()]
)
view_sql.register_view("v_scored", rf"""
    SELECT doc_id, page_number, variant, text, CAST({_SCAN} + {_REGISTRY} + CAST(floor(6.0::DOUBLE * (len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]')) / length(regexp_replace(text, '\s+', '', 'g')))) AS INTEGER)
           + least(length(text) // 120, 4) AS BIGINT) AS score
    FROM (SELECT *, upper(text) AS u FROM v_page_variants)""")


@register("registry_score", f"SELECT doc_id, page_number, CAST({_REGISTRY} AS BIGINT) AS score FROM v_pages")
def _(v):
    return v.pages().select("doc_id", "page_number", page_functions.registry_score(F.col("text")).cast("long").alias("score"))


@register("ocr_text_score", "SELECT doc_id, page_number, variant, score FROM v_scored")
def _(v):
    score = page_functions.ocr_text_score(F.col("text")).cast("long")
    return v.page_variants().select("doc_id", "page_number", "variant", score.alias("score"))


@register("best_page_variant", """
    SELECT doc_id, page_number, variant, score FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY score DESC, length(text) DESC, variant) AS rn FROM (
        SELECT *, max(CASE WHEN variant = 0 THEN score END) OVER (PARTITION BY doc_id, page_number) AS d FROM v_scored)
      WHERE variant = 0 OR page_number <= 3 OR d < 12) WHERE rn = 1""")
def _(v):
    best = pages.best_page_variant(v.page_variants())
    return best.select("doc_id", "page_number", "variant", F.col("score").cast("long").alias("score"))


@register("select_tail_pages", f"""
    WITH s AS (SELECT *, {_REGISTRY} + CASE WHEN page_number >= greatest(1, total - 2) THEN 2 ELSE 0 END AS score
               FROM (SELECT *, max(page_number) OVER (PARTITION BY doc_id) AS total FROM v_pages) WHERE page_number >= greatest(1, total - 4)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_number DESC) AS rn FROM s),
    e AS (SELECT * FROM r WHERE (score > 0 OR rn = 1) AND rn <= 2),
    hit AS (SELECT doc_id, bool_or(page_number = total) AS has_last, count(*) AS n FROM e GROUP BY 1)
    SELECT e.doc_id, e.page_number, CAST(e.score AS BIGINT) AS score FROM e JOIN hit h ON h.doc_id = e.doc_id WHERE h.has_last OR h.n < 2 OR e.rn < 2
    UNION
    SELECT doc_id, page_number, CAST(score AS BIGINT) FROM r WHERE page_number = total""")
def _(v):
    return pages.select_tail_pages(v.pages(), max_pages=2, scan_pages=5).select("doc_id", "page_number", F.col("score").cast("long").alias("score"))


@register("select_head_pages", "SELECT doc_id, page_number FROM v_pages WHERE page_number BETWEEN 1 AND 3")
def _(v):
    return pages.select_head_pages(v.pages()).select("doc_id", "page_number")


@register("front_page_order", """
    SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY CASE page_number WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END, page_number) - 1 AS front_order
    FROM v_pages""")
def _(v):
    return ranked_lists.dense_front_order(pages.front_page_order(v.pages()))


_RULES = page_functions.RULES_CHECKLIST
_RULES_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, {' OR '.join(f'contains(lower(text), $${w}$$)' for w in words)} AS checked FROM documents" for label, words in _RULES.items()
)


@register("analyze_rules_text", _RULES_SQL)
def _(v):
    return pages.analyze_rules_text(v.table("documents").select("doc_id", "text")).select("doc_id", F.inline("checklist"))


@register("limit_text", "SELECT doc_id, CASE WHEN length(text) <= 220 THEN text ELSE rtrim(text[1:220]) || '...' END AS preview FROM documents")
def _(v):
    return v.table("documents").select("doc_id", text.limit_text(F.col("text"), 220, "...").alias("preview"))


@register("parse_page_numbers", r"""
    SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter(list_transform(string_split(csv, ','), lambda x: TRY_CAST(trim(x) AS INTEGER)), lambda x: x > 0), '|') AS numbers
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, concat_ws(',', l_linenumber, ' ' || (l_partkey + 10) || ' ', '-3', 'x', '', '0') AS csv FROM lineitem)""")
def _(v):
    csv = F.concat_ws(
        ",", F.col("l_linenumber").cast("string"), F.concat(F.lit(" "), (F.col("l_partkey") + 10).cast("string"), F.lit(" ")), F.lit("-3"), F.lit("x"), F.lit(""), F.lit("0")
    )
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return rows.withColumn("numbers", F.array_join(page_functions.parse_page_numbers(csv), "|"))


_PAYLOAD = """to_json(struct('native' as method, length(text) as chars, text, array(
    struct(cast(turn + 1 as string) as page_number, concat(' ', text, '\t') as text), struct('0' as page_number, 'x' as text),
    struct(cast(null as string) as page_number, 'y' as text), struct('1e12' as page_number, 'z' as text), struct('NaN' as page_number, 'z' as text),
    struct('Infinity' as page_number, 'z' as text), struct('dos' as page_number, 'z' as text), struct('99999999999999999999' as page_number, 'z' as text), struct('3e2' as page_number, 'w' as text), struct(concat(cast(turn + 2 as string), '.0') as page_number, cast(null as string) as text)) as index_pages,
    array(' ', 'img') as vision_pages, array('3', 'x', '3', '-1', cast(turn as string)) as vision_page_numbers))"""


@register("read_page_payloads", r"""
    SELECT conv_id * 100 + turn AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, 'native' AS method, CAST(length(text) AS INTEGER) AS chars FROM conversations
    UNION ALL SELECT conv_id * 100 + turn, 300, 'w', 'native', CAST(length(text) AS INTEGER) FROM conversations
    UNION ALL SELECT conv_id * 100 + turn, CAST(turn + 2 AS INTEGER), '', 'native', CAST(length(text) AS INTEGER) FROM conversations""")
def _(v):
    return storage.read_page_payloads(v.table("conversations").selectExpr("conv_id * 100 + turn as doc_id", f"{_PAYLOAD} as payload"))


@register("parse_payloads", """
    SELECT conv_id * 100 + turn AS doc_id, CASE WHEN turn % 2 = 1 THEN 'unexpected_output' END AS error, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS images,
           CASE WHEN turn % 2 = 1 THEN '' WHEN turn IN (0, 3) THEN '3' ELSE '3|' || turn END AS numbers FROM conversations""")
def _(v):
    raw = v.table("conversations").selectExpr("conv_id * 100 + turn as doc_id", f"case when turn % 2 = 1 then 'no json' else {_PAYLOAD} end as payload")
    return storage.parse_payloads(raw).select(
        "doc_id", "error", F.size("vision_pages").alias("images"), F.array_join("vision_page_numbers", "|").alias("numbers")
    )


@register("resolve_storage", """
    SELECT id, CASE WHEN p THEN documento_path END AS path, CASE WHEN p AND NOT a AND b THEN 'public' ELSE 's3' END AS disk, p AND (a OR b) AS available
    FROM (SELECT id, documento_path, documento_path IS NOT NULL AS p, documento_path IN (SELECT 'actas/' || c_custkey || '.pdf' FROM customer WHERE c_mktsegment = 'BUILDING') AS a,
                 documento_path IN (SELECT 'actas/' || c_custkey || '.pdf' FROM customer WHERE c_acctbal > 3000) AS b FROM v_deeds)""")
def _(v):
    listing = v.table("customer").selectExpr("concat('actas/', cast(c_custkey as string), '.pdf') as path", "c_mktsegment", "c_acctbal")
    documents = v.deeds().select("id", F.col("documento_path").alias("path"))
    return storage.resolve_storage(documents, listing.where("c_mktsegment = 'BUILDING'"), listing.where("c_acctbal > 3000")).select(
        "id", "path", "disk", "available"
    )


@register("typed_scan", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_name FROM customer")
def _(v):
    scanned = entities.typed_scan(v.spark, f"{v.folder}/customer.parquet", "c_custkey long, c_nationkey int, c_name string")
    return scanned.select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_name")


# Customers as they might be delivered: balances and nations that are no numbers, lines that are cut.
_DELIVERED = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, absent date"
view_sql.register_view("v_delivered", """
    SELECT c_custkey, c_name, c_custkey % 7 = 3 AS cut, c_custkey % 11 = 5 AS no_balance, c_custkey % 13 = 1 AS no_nation, c_nationkey, c_acctbal FROM customer""")


def delivered(v):
    return v.table("customer").selectExpr(
        "c_custkey", "c_name", "case when c_custkey % 13 = 1 then 'none' else cast(c_nationkey as string) end as c_nationkey",
        "case when c_custkey % 11 = 5 then '12,50 x' else cast(c_acctbal as string) end as c_acctbal",
    )


def _checked(v, path, file_format):
    good, bad = entities.load_checked(v.spark, path, _DELIVERED, file_format)
    rows = good.selectExpr("c_custkey", "c_name", "cast(c_nationkey as bigint) as c_nationkey", "round(c_acctbal, 2) as c_acctbal", "cast(null as string) as problems")
    key = F.regexp_extract("raw", r'"c_custkey":(\d+)', 1).cast("long")
    kept = bad.select(key.alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("long").alias("c_nationkey"), F.lit(None).cast("double").alias("c_acctbal"), F.array_join("problems", ",").alias("problems"))
    return rows.unionByName(kept)


@register("load_checked_parquet", """
    SELECT c_custkey, CASE WHEN p = '' THEN c_name END AS c_name, CASE WHEN p = '' THEN CAST(c_nationkey AS BIGINT) END AS c_nationkey, CASE WHEN p = '' THEN round(c_acctbal, 2) END AS c_acctbal,
           CASE WHEN p <> '' THEN p END AS problems
    FROM (SELECT *, concat_ws(',', CASE WHEN no_nation THEN 'c_nationkey' END, CASE WHEN no_balance THEN 'c_acctbal' END) AS p FROM v_delivered)""")
def _(v):
    path = fresh_folder(v.spark, "delivered")
    delivered(v).write.parquet(path)
    return _checked(v, path, "parquet")


@register("load_checked_json", """
    SELECT c_custkey, CASE WHEN p = '' THEN c_name END AS c_name, CASE WHEN p = '' THEN CAST(c_nationkey AS BIGINT) END AS c_nationkey, CASE WHEN p = '' THEN round(c_acctbal, 2) END AS c_acctbal,
           CASE WHEN p <> '' THEN p END AS problems
    FROM (SELECT *, CASE WHEN cut THEN '_corrupt_record' ELSE concat_ws(',', CASE WHEN no_nation THEN 'c_nationkey' END, CASE WHEN no_balance THEN 'c_acctbal' END) END AS p FROM v_delivered)""")
def _(v):
    path = fresh_folder(v.spark, "delivered")
    line = F.to_json(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal"))
    delivered(v).select(F.when(F.col("c_custkey") % 7 == 3, F.concat(F.left(line, F.length(line) - 9), F.lit(" ..."))).otherwise(line).alias("value")).write.text(path)
    return _checked(v, path, "json")


_SUBMITTED = """
    WITH incoming AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'Acta' ELSE 'Regulation' END AS t, user_id % 40 AS d, arg_max(event_id, event_id) AS seq FROM events GROUP BY 1, 2)
    SELECT coalesce(documentable_type, t) AS documentable_type, coalesce(documentable_id, d) AS documentable_id,
           CASE WHEN seq IS NOT NULL THEN 'pending' ELSE status END AS status, CASE WHEN seq IS NOT NULL THEN 'nuevo/' || seq ELSE storage_path END AS storage_path, x.id
    FROM v_document_index x FULL OUTER JOIN incoming i ON x.documentable_type = t AND x.documentable_id = d"""


@register("change_document_index", _SUBMITTED)
def _(v):
    incoming = v.table("events").selectExpr(
        "case when event_id % 2 = 0 then 'Acta' else 'Regulation' end as documentable_type", "user_id % 40 as documentable_id", "event_id as seq",
        "user_id", "'acta' as document_type", "'s3' as storage_disk", "concat('nuevo/', cast(event_id as string)) as storage_path",
    )
    table = BucketTable(fresh_folder(v.spark, "index"), tuple(tables.INDEX_KEY), 16)
    table.write(v.document_index().withColumn("storage_disk", F.lit("s3")))
    tables.change_document_index(table, incoming)
    return table.read(v.spark).select("documentable_type", "documentable_id", "status", "storage_path", "id")


@register("upsert_document_index", """
    WITH incoming AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'Acta' ELSE 'Regulation' END AS t, user_id % 40 AS d, arg_max(event_id, event_id) AS seq FROM events GROUP BY 1, 2)
    SELECT coalesce(documentable_type, t) AS documentable_type, coalesce(documentable_id, d) AS documentable_id,
           CASE WHEN seq IS NOT NULL THEN 'pending' ELSE status END AS status, CASE WHEN seq IS NULL THEN error_message END AS error_message,
           CASE WHEN seq IS NOT NULL THEN 'nuevo/' || seq ELSE storage_path END AS storage_path, x.id
    FROM v_document_index x FULL OUTER JOIN incoming i ON x.documentable_type = t AND x.documentable_id = d""")
def _(v):
    incoming = v.table("events").selectExpr(
        "case when event_id % 2 = 0 then 'Acta' else 'Regulation' end as documentable_type", "user_id % 40 as documentable_id", "event_id as seq",
        "user_id", "'acta' as document_type", "'s3' as storage_disk", "concat('nuevo/', cast(event_id as string)) as storage_path",
    )
    current = v.document_index().withColumn("storage_disk", F.lit("s3"))
    return tables.upsert_document_index(current, incoming).select(
        "documentable_type", "documentable_id", "status", "error_message", "storage_path", "id"
    )


def trace_steps(v):
    return v.table("events").selectExpr(
        "user_id as doc_id", "event_id as seq", "cast(ts as timestamp) as at", "event_type as step",
        "case when event_type = 'error' then 'failed' else 'completed' end as status", "event_type in ('error', 'purchase') and value > 20 as final",
    )


@register("trace_reference", """
    SELECT user_id AS doc_id, count(*) FILTER (NOT f) AS step_count,
           coalesce(arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END, event_id) FILTER (f), 'running') AS status,
           strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at, strftime(max(ts) FILTER (f), '%Y-%m-%d %H:%M:%S') AS completed_at
    FROM (SELECT *, event_type IN ('error', 'purchase') AND value > 20 AS f FROM events) GROUP BY 1""")
def _(v):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return tables.trace_reference(trace_steps(v)).select("doc_id", "step_count", "status", shown("updated_at"), shown("completed_at"))


@register("latest_step", "SELECT user_id AS doc_id, max(event_id) AS seq, arg_max(event_type, event_id) AS step FROM events GROUP BY 1")
def _(v):
    return tables.latest_step(trace_steps(v)).select("doc_id", "seq", "step")


@register("event_rows", """
    SELECT user_id, event_type, entity_type, entity_id, request_method, status_code, metadata, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM v_audit_events""")
def _(v):
    return tables.event_rows(v.audit_events()).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@register("distinct_in_order", """
    SELECT conv_id, turn, array_to_string(list_distinct_ordered, '|') AS words FROM (
      SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (
        SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations))""")
def _(v):
    words = ranked_lists.distinct_in_order(F.split(F.lower("text"), " "))
    return v.table("conversations").select("conv_id", "turn", F.array_join(words, "|").alias("words"))
