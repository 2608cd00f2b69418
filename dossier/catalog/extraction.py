"""Queries over field extraction and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import register, view_sql
from dossier.functions import dates, values
from dossier.operators import extraction, resolution
from dossier.operators.extraction import ARRAY_FIELDS, DATE_FIELDS, DEED_FIELDS, LIST_FIELDS

_NULLS = ", ".join(f"'{n}'" for n in values.NULL_LIKE)
_ARRAYS = ", ".join(f"'{f}'" for f in ARRAY_FIELDS)
_DATES = ", ".join(f"'{f}'" for f in DATE_FIELDS)


def meaningful_sql(c: str) -> str:
    return f"coalesce(trim({c}) <> '' AND lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) NOT IN ({_NULLS}), FALSE)"


def date_sql(c: str) -> str:
    s = f"replace({c}, '/', '-')"
    part = lambda i: f"CAST(split_part({s}, '-', {i}) AS INTEGER)"

    def rolled(y, m, d):
        return f"CASE WHEN {m} <= 12 AND {d} <= 31 THEN strftime(make_date({y}, 1, 1) + to_months({m} - 1) + to_days({d} - 1), '%Y-%m-%d') END"

    short = f"CASE WHEN {part(1)} < 70 THEN 2000 + {part(1)} ELSE 1900 + {part(1)} END"
    return f"""CASE WHEN regexp_full_match({s}, '[0-3]?[0-9]-[01]?[0-9]-[0-9]{{4}}') THEN {rolled(part(3), part(2), part(1))}
        WHEN regexp_full_match({s}, '[0-9]{{4}}-[01]?[0-9]-[0-3]?[0-9]') THEN {rolled(part(1), part(2), part(3))}
        WHEN regexp_full_match({s}, '[0-9]{{1,2}}-[01]?[0-9]-[0-3]?[0-9]') THEN {rolled(short, part(2), part(3))} END"""


_LEGAL = r"(?i)(^|[^\p{L}\p{N}_])(constituci[oó]n|asamblea|poder(es)?|estatutos|nombramiento|revocaci[oó]n|reforma|protocoli[sz]aci[oó]n|acta constitutiva|administraci[oó]n|apoderad(o|os|a|as)|fusi[oó]n|escisi[oó]n|capital|sociedad|otorgamiento)($|[^\p{L}\p{N}_])"
_PROSE = r"(?i)(^|[^\p{L}\p{N}_])(candidates?|contrataci[oó]n|proponer\s+a\s+sus\s+clientes|aptos?\s+de\s+contrataci[oó]n)($|[^\p{L}\p{N}_])"


def act_sql(c: str, minimum: int = 4) -> str:
    s = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"""CASE WHEN {meaningful_sql(c)} AND length({s}) BETWEEN {minimum} AND 160 AND NOT regexp_matches({s}, '{_PROSE}')
        AND (len(string_split({s}, ' ')) <= 14 OR regexp_matches({s}, '{_LEGAL}')) THEN rtrim({s}, ' ;,.:-') END"""


def sanitize_sql(field: str, c: str) -> str:
    s = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    usable = f"{meaningful_sql(c)} AND lower({s}) NOT IN ('n', 'nmero', 'numero', 'folio', 'mercante')"
    if field == "acto":
        return f"CASE WHEN {usable} THEN {act_sql(c)} END"
    if field in values.NUMBER_FIELDS:
        n = f"regexp_replace({s}, '[^0-9A-Za-z\\-/.,]', '', 'g')"
        return f"CASE WHEN {usable} AND regexp_matches({s}, '\\d') AND length({n}) >= 2 THEN {n} END"
    if field in values.TEXT_FIELDS:
        return f"CASE WHEN {usable} AND length({s}) >= 4 THEN {s} END"
    return c


def _match(pattern: str) -> str:
    return f"nullif(trim(regexp_extract(text, '(?i){pattern}', 1), ' ' || chr(9) || chr(10) || chr(13)), '')"


def _fields_sql(source: str, fields: dict[str, str], inner: str) -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS field, {expr} AS value FROM found" for name, expr in fields.items())
    return f"SELECT * FROM (WITH found AS (SELECT doc_id, text, {inner} FROM {source}) SELECT * FROM ({rows}) WHERE value IS NOT NULL)"


_DEED_EXPR = {n: date_sql(n) if n in DATE_FIELDS else sanitize_sql(n, n) for n in extraction.DEED_PATTERNS}
_DEED_INNER = ", ".join(f"{_match(p)} AS {n}" for n, p in extraction.DEED_PATTERNS.items())
view_sql.register_view("v_deed_fields", _fields_sql("v_deed_texts", _DEED_EXPR, _DEED_INNER))
_OPINION_EXPR = {
    "estado": "CASE WHEN contains(low, 'positiv') THEN 'positivo' WHEN contains(low, 'negativ') THEN 'negativo' END",
    "tipo": "CASE WHEN contains(low, 'infonavit') THEN 'infonavit' WHEN contains(low, 'imss') THEN 'imss' WHEN contains(low, 'sat') OR contains(low, 'tributaria') THEN 'sat' END",
    "fecha_emision": date_sql("fecha_emision"),
    "fecha_vigencia": date_sql("fecha_vigencia"),
}
_OPINION_INNER = "lower(text) AS low, " + ", ".join(f"{_match(p)} AS {n}" for n, p in extraction.OPINION_PATTERNS.items())
view_sql.register_view("v_opinion_fields", _fields_sql("v_deed_texts", _OPINION_EXPR, _OPINION_INNER))
_WS = "' ' || chr(9) || chr(10) || chr(13)"
_REGULATION_EXPR = {
    "title": f"left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_WS})), lambda x: length(x) > 8)[1], 255)",
    "regulatory_body": "body",
    "general_description": f"left(trim(text, {_WS}), 2500)",
}
view_sql.register_view("v_regulation_fields", _fields_sql("v_deed_texts", _REGULATION_EXPR, f"{_match(extraction.BODY_PATTERN)} AS body"))


@register("extract_deed_fields", "SELECT doc_id, field, value FROM v_deed_fields")
def _(v):
    return extraction.extract_deed_fields(v.deed_texts())


@register("extract_opinion_fields", "SELECT doc_id, field, value FROM v_opinion_fields")
def _(v):
    return extraction.extract_opinion_fields(v.deed_texts())


@register("extract_regulation_fields", "SELECT doc_id, field, value FROM v_regulation_fields")
def _(v):
    return extraction.extract_regulation_fields(v.deed_texts())


@register("extract_fields", """
    SELECT f.* FROM v_deed_fields f JOIN v_deed_texts d ON d.doc_id = f.doc_id AND d.document_type = 'acta'
    UNION ALL SELECT f.* FROM v_opinion_fields f JOIN v_deed_texts d ON d.doc_id = f.doc_id AND d.document_type = 'opinion'
    UNION ALL SELECT f.* FROM v_regulation_fields f JOIN v_deed_texts d ON d.doc_id = f.doc_id AND d.document_type = 'regulation'""")
def _(v):
    return extraction.extract_fields(v.deed_texts())


_RAW_DATE = "CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 2 THEN '31-' || (l_orderkey % 12 + 1) || '-' || strftime(l_shipdate, '%Y') WHEN 3 THEN strftime(l_shipdate, '%y-%m-%d') WHEN 4 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 5 THEN 'n/a' WHEN 6 THEN '15 de mayo' ELSE '41-02-2000' END"


@register("normalize_date", f"""
    SELECT l_orderkey, l_linenumber, raw, {date_sql('raw')} AS iso FROM (SELECT DISTINCT l_orderkey, l_linenumber, {_RAW_DATE} AS raw FROM lineitem)""")
def _(v):
    raw = F.expr(
        """case l_linenumber when 1 then date_format(l_shipdate, 'dd/MM/yyyy') when 2 then concat('31-', cast(l_orderkey % 12 + 1 as string), '-', date_format(l_shipdate, 'yyyy'))
           when 3 then date_format(l_shipdate, 'yy-MM-dd') when 4 then date_format(l_shipdate, 'yyyy-MM-dd') when 5 then 'n/a' when 6 then '15 de mayo' else '41-02-2000' end"""
    )
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw")).distinct()
    return rows.withColumn("iso", dates.normalize_date(F.col("raw")))


_ODD = "CASE doc_id % 9 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'sin   datos' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN ' s/d' WHEN 5 THEN 'folio' WHEN 6 THEN ' 12*34 ' WHEN 7 THEN 'a b' ELSE text END"


def odd_values(v):
    return v.table("documents").selectExpr("doc_id", f"{_ODD} as value")


@register("null_like", f"SELECT doc_id, coalesce(lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) IN ({_NULLS}), FALSE) AS null_like, {meaningful_sql('value')} AS meaningful FROM (SELECT doc_id, {_ODD} AS value FROM documents)")
def _(v):
    c = F.col("value")
    return odd_values(v).select("doc_id", F.coalesce(values.is_null_like(c), F.lit(False)).alias("null_like"), values.is_meaningful(c).alias("meaningful"))


@register("clean_values", f"SELECT doc_id, CASE WHEN {meaningful_sql('value')} THEN trim(value, {_WS}) END AS value FROM (SELECT doc_id, {_ODD} AS value FROM documents)")
def _(v):
    return odd_values(v).select("doc_id", values.clean(F.col("value")).alias("value"))


@register("clean_lists", f"""
    SELECT doc_id, CASE WHEN {meaningful_sql('value')} THEN trim(value, {_WS}) || '|' ELSE '' END || 'Ana' AS members,
           coalesce(CASE WHEN {meaningful_sql('value')} THEN trim(value, {_WS}) END, '-') AS person FROM (SELECT doc_id, {_ODD} AS value FROM documents)""")
def _(v):
    listed = odd_values(v).withColumn("items", F.array("value", F.lit(" Ana "), F.lit("0"), F.lit("na")))
    people = F.array(F.struct(F.col("value").alias("socio"), F.lit("x").alias("other")))
    person = values.clean_structs(people, ["socio"])
    return listed.select(
        "doc_id", F.array_join(values.clean_list(F.col("items")), "|").alias("members"), F.coalesce(person[0]["socio"], F.lit("-")).alias("person")
    )


_FIELD_TESTS = ["notaria_numero", "rpc_lugar", "acto", "fecha_registro"]


@register("sanitize_fields", " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, {sanitize_sql(f, 'value')} AS value FROM (SELECT doc_id, {_ODD} AS value FROM documents)" for f in _FIELD_TESTS))
def _(v):
    rows = odd_values(v).select("doc_id", F.explode(F.array(*[F.lit(f) for f in _FIELD_TESTS])).alias("field"), "value")
    return rows.withColumn("value", values.sanitize_field(F.col("field"), F.col("value")))


@register("sanitize_acts", f"""
    SELECT doc_id, {act_sql('raw')} AS act, {act_sql('raw', 0)} AS act_on_save FROM (
      SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Contratación de  obra' WHEN 1 THEN reverse(text) WHEN 2 THEN 'Poder; ' || text || ' .,' WHEN 3 THEN 'ab' ELSE text END AS raw FROM documents)""")
def _(v):
    raw = F.expr(
        "case doc_id % 5 when 0 then 'Contratación de  obra' when 1 then reverse(text) when 2 then concat('Poder; ', text, ' .,') when 3 then 'ab' else text end"
    )
    rows = v.table("documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", values.sanitize_act(F.col("raw")).alias("act"), values.sanitize_act(F.col("raw"), on_save=True).alias("act_on_save"))


_BASE = "CASE source " + " ".join(f"WHEN '{s}' THEN {b}::DOUBLE" for s, b in resolution.SOURCE_BASE.items()) + " ELSE 0.4::DOUBLE END"
_VISION = ", ".join(f"'{f}'" for f in resolution.VISION_FIELDS)
_FRONT = ", ".join(f"'{f}'" for f in resolution.FRONT_FIELDS)
_CONF = f"""least(0.99::DOUBLE, ({_BASE} + CASE WHEN (source = 'vision' AND field IN ({_VISION})) OR (source = 'vision_first' AND field IN ({_FRONT})) THEN 0.1::DOUBLE ELSE 0::DOUBLE END)
    + (CASE WHEN field IN ({_DATES}) AND regexp_full_match(coalesce(value, ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 0.08::DOUBLE ELSE 0::DOUBLE END
       + CASE WHEN field NOT IN ({_ARRAYS}) AND length(trim(coalesce(value, ''))) >= 4 THEN 0.04::DOUBLE ELSE 0::DOUBLE END))"""
_HAS = f"CASE WHEN field IN ({_ARRAYS}) THEN coalesce(value_json, '[]') <> '[]' ELSE {meaningful_sql('value')} END"
view_sql.register_view("v_scored_candidates", f"SELECT *, CASE WHEN meaningful THEN {_CONF} ELSE 0::DOUBLE END AS confidence FROM (SELECT *, {_HAS} AS meaningful FROM v_candidates)")
view_sql.register_view("v_merged", f"""
    SELECT doc_id, field, w.value AS value, w.value_json AS value_json, w.source AS source, w.source_key AS source_key, w.c AS confidence FROM (
      SELECT doc_id, field, list_reduce(list({{'c': confidence, 'value': value, 'value_json': value_json, 'source': source, 'source_key': source_key}} ORDER BY stage_order),
             lambda a, e: CASE WHEN field NOT IN ({_ARRAYS}) AND e.c >= a.c + 0.05::DOUBLE THEN e ELSE a END) AS w
      FROM v_scored_candidates WHERE meaningful GROUP BY doc_id, field)""")


def scored(v):
    return resolution.score_candidates(v.candidates())


def merged(v):
    return resolution.merge_candidates(scored(v))


def _conf():
    return F.round("confidence", 6).alias("confidence")


@register("score_candidates", "SELECT doc_id, source_key, field, meaningful, round(confidence, 6) AS confidence FROM v_scored_candidates")
def _(v):
    return scored(v).select("doc_id", "source_key", "field", "meaningful", _conf())


@register("merge_candidates", "SELECT doc_id, field, value, value_json, source, round(confidence, 6) AS confidence FROM v_merged")
def _(v):
    return merged(v).select("doc_id", "field", "value", "value_json", "source", _conf())


_REQUIRED = resolution.SCALAR_FIELDS_REQUIRED
view_sql.register_view("v_missing", f"""
    SELECT doc_id, list_filter([{", ".join(f"'{f}'" for f in _REQUIRED)}], lambda f: NOT list_contains(have, f))
        || CASE WHEN list_contains(have, 'apoderados') THEN ['apoderados.1.poder_documento', 'apoderados.1.facultades_otorgadas'] ELSE ['apoderados'] END
        || CASE WHEN list_contains(have, 'participacion_accionaria') THEN CAST([] AS VARCHAR[]) ELSE ['participacion_accionaria'] END AS missing
    FROM (SELECT d.doc_id, coalesce(list(m.field) FILTER (m.field IS NOT NULL), []) AS have FROM documents d LEFT JOIN v_merged m ON m.doc_id = d.doc_id GROUP BY 1)""")


def documents(v):
    return v.table("documents").select("doc_id")


def missing(v):
    return resolution.missing_required(documents(v), merged(v))


@register("missing_required", "SELECT doc_id, array_to_string(missing, ',') AS missing FROM v_missing")
def _(v):
    return missing(v).select("doc_id", F.array_join("missing", ",").alias("missing"))


_TARGETS = ", ".join(f"'{f}'" for f in _REQUIRED)


@register("tail_vision_trigger", f"""
    SELECT doc_id, CASE WHEN n = 0 THEN 'no_vision_target_fields_missing' WHEN pages = 0 THEN 'no_vision_pages_available'
                        WHEN causes = '' THEN 'quality_threshold_not_met' ELSE causes END AS reasons, n > 0 AND pages > 0 AND causes <> '' AS enabled
    FROM (SELECT *, concat_ws(',', CASE WHEN lang = 'de' THEN 'ocr_method_detected' END, CASE WHEN n_chars > 0 AND n_chars < 7000 THEN 'low_text_volume' END,
                              CASE WHEN n >= 3 THEN 'high_missing_target_fields' END) AS causes
          FROM (SELECT m.doc_id, d.lang, d.n_chars, len(list_filter(m.missing, lambda f: f IN ({_TARGETS}))) AS n, d.doc_id % 4 AS pages
                FROM v_missing m JOIN documents d ON d.doc_id = m.doc_id))""")
def _(v):
    facts = v.table("documents").selectExpr("doc_id", "case when lang = 'de' then 'ocr' else 'native' end as method", "n_chars as chars", "doc_id % 4 as pages_available")
    return resolution.tail_vision_trigger(missing(v).join(facts, "doc_id")).select("doc_id", "enabled", F.array_join("reasons", ",").alias("reasons"))


view_sql.register_view("v_front_targets", f"""
    SELECT d.doc_id, f.field FROM documents d CROSS JOIN (SELECT unnest([{_FRONT}]) AS field) f
    LEFT JOIN v_merged m ON m.doc_id = d.doc_id AND m.field = f.field
    WHERE m.value IS NULL OR m.confidence < 0.85 OR m.source = 'vision' OR (f.field = 'acto' AND regexp_matches(m.value, '(?i)registro\\s+p[uú]blico\\s+de\\s+comercio'))""")


@register("front_vision_trigger", f"""
    SELECT d.doc_id, coalesce(t.targets, '') AS targets, t.targets IS NOT NULL AND d.doc_id % 3 > 0 AS enabled,
           CASE WHEN t.targets IS NOT NULL THEN 'front_page_fields_need_confirmation' ELSE 'front_page_fields_already_satisfied' END AS reasons
    FROM documents d LEFT JOIN (SELECT doc_id, string_agg(field, ',' ORDER BY list_position([{_FRONT}], field)) AS targets FROM v_front_targets GROUP BY 1) t ON t.doc_id = d.doc_id""")
def _(v):
    docs = v.table("documents").selectExpr("doc_id", "doc_id % 3 as front_pages")
    return resolution.front_vision_trigger(docs, merged(v)).select("doc_id", F.array_join("target_fields", ",").alias("targets"), "enabled", "reasons")


_READING = "CASE WHEN (doc_id * 5 + p * 3 + length(field)) % 4 = 0 THEN NULL WHEN field = 'acto' AND (doc_id + p) % 3 = 0 THEN 'Registro Público de Comercio' ELSE 'Lectura ' || p END"


@register("front_pages_needed", f"""
    WITH r AS (SELECT doc_id, p, field, {_READING} AS value FROM documents, (VALUES (0), (1), (2)) AS a(p), (VALUES ('acto'), ('libro_numero')) AS b(field)),
    w AS (SELECT r.* FROM r WHERE (doc_id, field) IN (SELECT (doc_id, field) FROM v_front_targets)),
    t AS (SELECT doc_id, field FROM v_front_targets WHERE field IN ('acto', 'libro_numero')),
    s AS (SELECT t.doc_id, t.field, q.p, arg_max(w.value, w.p) FILTER (w.value IS NOT NULL AND w.p <= q.p) AS seen
          FROM t CROSS JOIN (VALUES (0), (1), (2)) AS q(p) LEFT JOIN w ON w.doc_id = t.doc_id AND w.field = t.field GROUP BY 1, 2, 3),
    done AS (SELECT doc_id, min(p) FILTER (ok) AS stop FROM (
               SELECT doc_id, p, bool_and(seen IS NOT NULL AND NOT (field = 'acto' AND seen LIKE 'Registro%')) AS ok FROM s GROUP BY 1, 2) GROUP BY 1)
    SELECT DISTINCT r.doc_id, CAST(r.p AS BIGINT) AS front_order FROM r JOIN done ON done.doc_id = r.doc_id WHERE stop IS NULL OR r.p <= stop""")
def _(v):
    readings = (
        v.table("documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("p"))
        .select("*", F.explode(F.array(F.lit("acto"), F.lit("libro_numero"))).alias("field"))
        .selectExpr("doc_id", "cast(p as bigint) as front_order", "field", f"{_READING.replace(chr(39) + 'Lectura ' + chr(39) + ' || p', 'concat(' + chr(39) + 'Lectura ' + chr(39) + ', cast(p as string))')} as value")
    )
    targets = resolution.front_vision_targets(documents(v), merged(v)).where("field in ('acto', 'libro_numero')")
    return resolution.front_pages_needed(readings, targets)


@register("recovery_candidates", f"""
    SELECT c.doc_id, c.field, c.source_key, row_number() OVER (PARTITION BY c.doc_id, c.field ORDER BY c.confidence DESC, c.source_key) AS rank,
           coalesce(c.source = m.source AND CASE WHEN c.field IN ({_ARRAYS}) THEN c.value_json = m.value_json ELSE c.value = m.value END, FALSE) AS selected
    FROM v_scored_candidates c LEFT JOIN v_merged m ON m.doc_id = c.doc_id AND m.field = c.field WHERE c.meaningful""")
def _(v):
    return resolution.recovery_candidates(merged(v), scored(v)).select(
        "doc_id", "field", "source_key", F.col("rank").cast("long").alias("rank"), "selected"
    )


@register("review_fields", f"""
    SELECT doc_id, field, count(*) AS candidates FROM v_scored_candidates WHERE meaningful AND source <> 'regex' AND field NOT IN ({_ARRAYS})
    GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT trim(lower(value))) >= 2""")
def _(v):
    return resolution.review_fields(scored(v))


view_sql.register_view("v_applied", """
    SELECT d.doc_id, d.field, c.value, c.source, c.confidence FROM v_decisions d
    JOIN v_scored_candidates c ON c.doc_id = d.doc_id AND c.field = d.field AND c.source_key = d.source_key AND c.meaningful""")
view_sql.register_view("v_decided", """
    SELECT coalesce(m.doc_id, a.doc_id) AS doc_id, coalesce(m.field, a.field) AS field, CASE WHEN a.doc_id IS NOT NULL THEN a.value ELSE m.value END AS value,
           CASE WHEN a.doc_id IS NULL THEN m.value_json END AS value_json, coalesce(a.source, m.source) AS source,
           coalesce(a.confidence, m.confidence) AS confidence, a.doc_id IS NOT NULL AS decided
    FROM v_merged m FULL OUTER JOIN v_applied a ON a.doc_id = m.doc_id AND a.field = m.field""")


@register("apply_decisions", "SELECT doc_id, field, value, source, round(confidence, 6) AS confidence, decided FROM v_decided")
def _(v):
    decided = resolution.apply_decisions(merged(v), scored(v), v.decisions())
    return decided.select("doc_id", "field", "value", "source", _conf(), "decided")


def regex(v):
    return resolution.as_candidates(extraction.extract_deed_fields(v.deed_texts()))


view_sql.register_view("v_regex", f"SELECT doc_id, field, value, source, {_CONF} AS confidence FROM (SELECT doc_id, field, value, 'regex' AS source FROM v_deed_fields) WHERE {meaningful_sql('value')}")
view_sql.register_view("v_filled", """
    SELECT doc_id, field, value, value_json, source, confidence, decided, FALSE AS fallback FROM v_decided
    UNION ALL SELECT r.doc_id, r.field, r.value, NULL, r.source, r.confidence, FALSE, TRUE FROM v_regex r
    WHERE NOT EXISTS (SELECT 1 FROM v_decided d WHERE d.doc_id = r.doc_id AND d.field = r.field)""")


@register("regex_fallback", "SELECT doc_id, field, value, source, round(confidence, 6) AS confidence, fallback FROM v_filled")
def _(v):
    decided = resolution.apply_decisions(merged(v), scored(v), v.decisions())
    filled = resolution.regex_fallback(decided, resolution.score_candidates(regex(v)))
    return filled.select("doc_id", "field", "value", "source", _conf(), "fallback")


_SANITIZED = "CASE field " + " ".join(f"WHEN '{f}' THEN {sanitize_sql(f, 'value')}" for f in DEED_FIELDS if f not in ARRAY_FIELDS and f not in DATE_FIELDS) + " ELSE value END"
view_sql.register_view("v_resolved", f"""
    SELECT * FROM (SELECT doc_id, field, {_SANITIZED} AS value, value_json, source, confidence, decided, fallback FROM v_filled) WHERE value IS NOT NULL OR field IN ({_ARRAYS})""")


def resolved(v):
    return resolution.resolve_deeds(regex(v), v.candidates(dealt=True), v.decisions(dealt=True), v.parts)


@register("resolve_deeds", "SELECT doc_id, field, value, value_json, source, round(confidence, 6) AS confidence FROM v_resolved")
def _(v):
    return resolved(v).select("doc_id", "field", "value", "value_json", "source", _conf())


@register("provenance", """
    SELECT doc_id, 'base' || CASE WHEN l THEN '+llm' ELSE '' END || CASE WHEN lr THEN '+llm_retry' ELSE '' END || CASE WHEN vi THEN '+vision' ELSE '' END || CASE WHEN vf THEN '+vision_first' ELSE '' END || CASE WHEN adj THEN '+adjudication' ELSE '' END
           || CASE WHEN fb THEN '+regex_fallback' ELSE '' END AS extraction_source, sources, confidences FROM (
      SELECT c.doc_id, bool_or(c.source = 'llm') AS l, bool_or(c.source = 'llm_retry') AS lr, bool_or(c.source = 'vision') AS vi, bool_or(c.source = 'vision_first' AND c.meaningful) AS vf, any_value(coalesce(r.adj, FALSE)) AS adj, any_value(coalesce(r.fb, FALSE)) AS fb,
             any_value(coalesce(r.s, '')) AS sources, any_value(coalesce(r.c, '')) AS confidences
      FROM v_scored_candidates c LEFT JOIN (SELECT doc_id, bool_or(decided) AS adj, bool_or(fallback) AS fb,
        string_agg(field || '=' || source, ',' ORDER BY field) AS s, string_agg(field || '=' || CAST(round(confidence * 100) AS INTEGER), ',' ORDER BY field) AS c FROM v_resolved GROUP BY 1) r ON r.doc_id = c.doc_id
      GROUP BY 1)""")
def _(v):
    trail = resolution.provenance(resolution.score_candidates(v.candidates(dealt=True)), resolved(v))

    def listed(m, shown):
        pairs = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), shown(e["value"]).alias("v"))))
        return F.coalesce(F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), ","), F.lit(""))

    sources = listed("field_sources", lambda x: x)
    return trail.select("doc_id", "extraction_source", sources.alias("sources"), listed("field_confidence", lambda x: F.round(x * 100).cast("int").cast("string")).alias("confidences"))


_QUERIES_SQL = "MAP {" + ", ".join(f"'{k}': '{t}'" for k, t in resolution.RETRY_QUERIES.items()) + "}"


@register("retry_queries", f"""
    SELECT DISTINCT doc_id, 'retry_' || split_part(m, '.', 1) AS query_key, ({_QUERIES_SQL})[split_part(m, '.', 1)] AS query_text
    FROM (SELECT doc_id, unnest(missing) AS m FROM v_missing)""")
def _(v):
    return resolution.retry_queries(missing(v))


_SAVED = "CASE (doc_id + length(field)) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Valor 1' WHEN 2 THEN '2024-03-11 00:00:00' ELSE 'guardado' END"
_SCALARS = [f for f in DEED_FIELDS if f not in ARRAY_FIELDS]
view_sql.register_view("v_saved", f"SELECT doc_id, field, {_SAVED} AS value FROM documents, (SELECT unnest([{', '.join(repr(f) for f in _SCALARS)}]) AS field)")


def saved(v):
    rows = v.dealt_documents().select("doc_id", F.explode(F.array(*[F.lit(f) for f in _SCALARS])).alias("field"))
    return rows.selectExpr("doc_id", "field", f"{_SAVED} as value")


@register("field_differences", f"""
    SELECT r.doc_id, r.field, r.value, coalesce(s.value, '') AS saved, r.source, round(r.confidence, 6) AS confidence
    FROM v_resolved r LEFT JOIN v_saved s ON s.doc_id = r.doc_id AND s.field = r.field
    WHERE r.field NOT IN ({_ARRAYS}) AND r.value <> '' AND CASE WHEN r.field IN ({_DATES}) THEN left(r.value, 10) <> left(coalesce(s.value, ''), 10) ELSE r.value <> coalesce(s.value, '') END""")
def _(v):
    return resolution.field_differences(saved(v), resolved(v), v.parts).select("doc_id", "field", "value", "saved", "source", _conf())


@register("apply_to_deeds", f"""
    SELECT d.doc_id, coalesce(r.libro, s.libro) AS libro_numero, coalesce(r.consejo, '["Ana"]') AS consejo_administracion,
           (CASE WHEN r.consejo IS NOT NULL AND r.consejo <> '["Ana"]' THEN 1 ELSE 0 END) + (CASE WHEN r.libro IS NOT NULL AND r.libro IS DISTINCT FROM s.libro THEN 1 ELSE 0 END) AS changed
    FROM documents d
    JOIN (SELECT doc_id, max(value) FILTER (field = 'libro_numero') AS libro FROM v_saved GROUP BY 1) s ON s.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, max(value) FILTER (field = 'libro_numero') AS libro, max(value_json) FILTER (field = 'consejo_administracion') AS consejo
               FROM v_resolved GROUP BY 1) r ON r.doc_id = d.doc_id""")
def _(v):
    deeds = saved(v).groupBy("doc_id").agg(F.max(F.when(F.col("field") == "libro_numero", F.col("value"))).alias("libro_numero"))
    for field in DEED_FIELDS:
        if field != "libro_numero":
            deeds = deeds.withColumn(field, F.lit('["Ana"]') if field in LIST_FIELDS else F.lit(None).cast("string"))
    written = resolution.apply_to_deeds(deeds, resolution.to_wide(resolved(v)))
    return written.select(
        "doc_id", "libro_numero", "consejo_administracion",
        F.size(F.array_intersect("changed", F.array(F.lit("libro_numero"), F.lit("consejo_administracion")))).alias("changed"),
    )


@register("fill_opinions", """
    SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN 'sat' END, max(f.value) FILTER (f.field = 'tipo')) AS tipo,
           coalesce(nullif(CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE 'pendiente' END, ''), max(f.value) FILTER (f.field = 'estado'), '') AS estado
    FROM documents d LEFT JOIN v_opinion_fields f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(v):
    current = v.table("documents").selectExpr("doc_id", "case when doc_id % 3 = 0 then 'sat' end as tipo", "case when doc_id % 2 = 0 then '' else 'pendiente' end as estado")
    return resolution.fill_when_empty(current, extraction.extract_opinion_fields(v.deed_texts()), ["tipo", "estado"])


_LINES = " || ".join(f"chr(10) || '{label}: ' || coalesce({field}, 'N/A')" for label, field in resolution.SUMMARY_LABELS.items())
_WIDE_SQL = ", ".join(f"max({'value_json' if f in ARRAY_FIELDS else 'value'}) FILTER (field = '{f}') AS {f}" for f in DEED_FIELDS)


@register("structured_summary", f"""
    SELECT w.doc_id, 'RESUMEN ESTRUCTURADO DEL ACTA' || {_LINES}
      || chr(10) || 'Apoderados: ' || CASE WHEN apoderados IS NULL THEN 'N/A' ELSE 'Nombre: Ana | INE: 1 | Poder:  | Facultades: n/a' END
      || chr(10) || 'Participación accionaria: ' || CASE WHEN participacion_accionaria IS NULL THEN 'N/A' ELSE 'Eva 50%' END
      || chr(10) || 'Consejo de administración: ' || CASE WHEN consejo_administracion IS NULL THEN 'N/A' ELSE 'Ana | Eva' END
      || chr(10) || 'Dirección de empresa: ' || CASE WHEN direccion_empresa IS NULL THEN 'N/A' ELSE 'Ana | Eva' END
      || chr(10) || 'Campos obligatorios faltantes: ' || CASE WHEN len(missing) = 0 THEN 'ninguno' ELSE array_to_string(missing, ', ') END AS summary
    FROM (SELECT doc_id, {_WIDE_SQL} FROM v_merged GROUP BY doc_id) w JOIN v_missing m ON m.doc_id = w.doc_id""")
def _(v):
    return resolution.structured_summary(resolution.to_wide(merged(v)), missing(v))


@register("attempt_rollup", """
    SELECT conv_id AS doc_id, coalesce(sum(length(text) % 7) FILTER (turn > 1), 0)::BIGINT AS images_used, coalesce(sum(length(text)) FILTER (turn > 1), 0)::BIGINT AS elapsed_ms,
           count(*) FILTER (turn > 1) AS attempts, coalesce(bool_or(turn > 1 AND length(text) > 900), FALSE) AS budget_exhausted,
           count(DISTINCT role)::INTEGER AS engines,
           string_agg(CASE WHEN length(text) % 3 = 0 THEN 'http_' || turn END, ' | ' ORDER BY turn) AS errors
    FROM conversations GROUP BY 1""")
def _(v):
    attempts = v.table("conversations").selectExpr(
        "conv_id as doc_id", "turn as stage_order", "case when turn > 1 then 'vision' else 'llm' end as kind", "role as engine",
        "case when length(text) % 3 = 0 then concat('http_', cast(turn as string)) end as error", "cast(length(text) % 7 as bigint) as images_used",
        "cast(length(text) as bigint) as elapsed_ms", "95000L as budget_ms", "1L as attempts", "length(text) > 900 as budget_exhausted",
    )
    rolled = resolution.attempt_rollup(attempts)
    return rolled.select("doc_id", "images_used", "elapsed_ms", "attempts", "budget_exhausted", F.size("engines").alias("engines"), "errors")


_RESPONSE = r"""case doc_id % 5 when 0 then ' ' when 1 then 'no es json' else concat('{"rpc_folio": ', case when doc_id % 5 = 2 then '12' else '" F-12 "' end,
    ', "fecha_registro": "', cast(doc_id % 28 + 1 as string), '/02/2024", "acto": "N/A", "libro_numero": null, "consejo_administracion": [" Ana ", "s/d", ""],',
    '"apoderados": [{"ine": " 1 ", "nombre_completo": "na"}]}') end"""


def raw_outputs(v):
    return v.table("documents").selectExpr(
        "doc_id", "'llm' as source_key", "'llm' as source", "1L as stage_order", "cast(null as bigint) as page_number", f"{_RESPONSE} as response"
    )


@register("parse_model_outputs", f"""
    WITH ok AS (SELECT doc_id, {date_sql("(doc_id % 28 + 1) || '/02/2024'")} AS fecha FROM documents WHERE doc_id % 5 > 1)
    SELECT doc_id, field, CASE field WHEN 'rpc_folio' THEN CASE WHEN doc_id % 5 > 2 THEN 'F-12' END WHEN 'fecha_registro' THEN fecha END AS value,
           CASE field WHEN 'consejo_administracion' THEN '["Ana"]' WHEN 'direccion_empresa' THEN '[]' WHEN 'participacion_accionaria' THEN '[]'
                      WHEN 'apoderados' THEN '[{{"ine":"1","poder_documento":null,"nombre_completo":null,"facultades_otorgadas":null}}]' END AS value_json
    FROM ok, (SELECT unnest([{', '.join(repr(f) for f in DEED_FIELDS)}]) AS field)""")
def _(v):
    return resolution.parse_model_outputs(raw_outputs(v))[0].select("doc_id", "field", "value", "value_json")


@register("rejected_model_outputs", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'empty_response' ELSE 'invalid_json' END AS error FROM documents WHERE doc_id % 5 < 2")
def _(v):
    return resolution.parse_model_outputs(raw_outputs(v))[1].select("doc_id", "error")


@register("parse_decisions", """
    SELECT doc_id, 'acto' AS field, 'llm' AS source_key, 'motivo ' || doc_id AS reason FROM documents WHERE lang <> 'en'
    UNION ALL SELECT doc_id, 'rpc_folio', 'vision', NULL FROM documents WHERE lang <> 'en'""")
def _(v):
    raw = v.table("documents").selectExpr(
        "doc_id",
        """case when lang = 'en' then 'nada' else concat('{"decisions": {"acto": {"source_key": "llm", "reason": "motivo ', cast(doc_id as string), '"}, "rpc_folio": {"source_key": "vision"}}}') end as response""",
    )
    return resolution.parse_decisions(raw)
