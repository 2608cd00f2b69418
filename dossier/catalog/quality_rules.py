"""Queries over record rules and reference checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.catalog import register, view_sql
from dossier.functions import values
from dossier.functions.text import display_name
from dossier.operators import quality_rules as rules


@register("scope_to_owner", """
    SELECT id, user_id, status FROM v_tenders WHERE user_id IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA')""")
def _(v):
    regions = v.table("region").where("r_name <> 'AFRICA'").selectExpr("r_regionkey as n_regionkey")
    users = v.table("nation").join(regions, "n_regionkey").selectExpr("cast(n_nationkey as bigint) as id")
    return rules.scope_to_owner(v.tenders(), users).select("id", "user_id", "status")


@register("flag_foreign_parent", """
    SELECT t.id, t.user_id, t.company_id, coalesce(c.user_id <> t.user_id, TRUE) AS forbidden FROM v_tenders t LEFT JOIN v_companies c ON c.id = t.company_id""")
def _(v):
    return rules.flag_foreign_parent(v.tenders(), v.companies(), "company_id").select("id", "user_id", "company_id", "forbidden")


@register("validate_statements", """
    SELECT id, concat_ws(',', CASE WHEN periodicity NOT IN ('mensual', 'anual') THEN 'periodicity:in' END,
        CASE WHEN year < 2000 THEN 'year:min' END, CASE WHEN year > 2100 THEN 'year:max' END,
        CASE WHEN month < 1 THEN 'month:min' END, CASE WHEN month > 12 THEN 'month:max' END,
        CASE WHEN is_audited IS NULL THEN 'is_audited:required' END,
        CASE WHEN file_name NOT LIKE '%.pdf' THEN 'file_name:extension' END, CASE WHEN file_kb > 20480 THEN 'file_kb:max_kb' END) AS errors
    FROM v_statements""")
def _(v):
    return rules.validate_records(v.statements(), rules.STATEMENT_RULES).select("id", F.concat_ws(",", "errors").alias("errors"))


@register("validate_opinions", """
    SELECT id, CASE WHEN fecha_vigencia < fecha_emision THEN 'fecha_vigencia:after_or_equal' ELSE '' END AS errors FROM v_opinions""")
def _(v):
    return rules.validate_records(v.opinions(), rules.OPINION_RULES).select("id", F.concat_ws(",", "errors").alias("errors"))


# Every rule set meets rows that break each of its rules.
view_sql.register_view("v_odd_companies", """
    SELECT id, CASE id % 7 WHEN 1 THEN NULL WHEN 2 THEN repeat('n', 256) ELSE nombre END AS nombre, CASE id % 5 WHEN 1 THEN NULL WHEN 2 THEN 'corto' WHEN 3 THEN rfc || 'x' ELSE rfc END AS rfc FROM v_companies""")


@register("validate_companies", """
    SELECT id, concat_ws(',', CASE WHEN nombre IS NULL THEN 'nombre:required' END, CASE WHEN length(nombre) > 255 THEN 'nombre:max_len' END,
           CASE WHEN rfc IS NULL THEN 'rfc:required' END, CASE WHEN length(rfc) < 12 THEN 'rfc:min_len' END, CASE WHEN length(rfc) > 13 THEN 'rfc:max_len' END) AS errors FROM v_odd_companies""")
def _(v):
    odd = v.companies().selectExpr(
        "id", "case id % 7 when 1 then null when 2 then repeat('n', 256) else nombre end as nombre", "case id % 5 when 1 then null when 2 then 'corto' when 3 then concat(rfc, 'x') else rfc end as rfc"
    )
    return rules.validate_records(odd, rules.COMPANY_RULES).select("id", F.concat_ws(",", "errors").alias("errors"))


view_sql.register_view("v_odd_tenders", """
    SELECT id, CASE id % 7 WHEN 1 THEN NULL WHEN 2 THEN repeat('t', 256) ELSE title END AS title, CASE WHEN id % 5 <> 1 THEN company_id END AS company_id,
           CASE id % 9 WHEN 1 THEN NULL WHEN 2 THEN 'secreta' ELSE process_type END AS process_type, CASE id % 8 WHEN 1 THEN 'bases.doc' WHEN 2 THEN 'BASES.PDF' ELSE bases_document_path END AS bases_document_path FROM v_tenders""")


@register("validate_tenders", """
    SELECT id, concat_ws(',', CASE WHEN title IS NULL THEN 'title:required' END, CASE WHEN length(title) > 255 THEN 'title:max_len' END, CASE WHEN company_id IS NULL THEN 'company_id:required' END,
           CASE WHEN process_type IS NULL THEN 'process_type:required' END, CASE WHEN process_type = 'secreta' THEN 'process_type:in' END,
           CASE WHEN lower(bases_document_path) NOT LIKE '%.pdf' THEN 'bases_document_path:extension' END) AS errors FROM v_odd_tenders""")
def _(v):
    odd = v.tenders().selectExpr(
        "id", "case id % 7 when 1 then null when 2 then repeat('t', 256) else title end as title", "case when id % 5 <> 1 then company_id end as company_id",
        "case id % 9 when 1 then null when 2 then 'secreta' else process_type end as process_type", "case id % 8 when 1 then 'bases.doc' when 2 then 'BASES.PDF' else bases_document_path end as bases_document_path",
    )
    return rules.validate_records(odd, rules.TENDER_RULES).select("id", F.concat_ws(",", "errors").alias("errors"))


@register("validate_letterheads", """
    SELECT id, concat_ws(',', CASE WHEN id % 7 = 1 THEN 'title:required' END, CASE WHEN id % 7 = 2 THEN 'title:max_len' END, CASE WHEN id % 5 = 1 THEN 'is_default:required' END) AS errors FROM v_letterheads""")
def _(v):
    odd = v.letterheads().selectExpr("id", "case id % 7 when 1 then '' when 2 then repeat('t', 256) else title end as title", "case when id % 5 <> 1 then is_default end as is_default")
    return rules.validate_records(odd, rules.LETTERHEAD_RULES).select("id", F.concat_ws(",", "errors").alias("errors"))


@register("validate_deeds", """
    SELECT id, concat_ws(',', CASE WHEN id % 7 = 1 THEN 'tipo:required' END, CASE WHEN id % 7 = 2 THEN 'tipo:in' END, CASE WHEN id % 6 = 1 THEN 'fecha_registro:date' END,
           CASE WHEN documento_path IS NULL THEN 'documento_path:required' END, CASE WHEN documento_path IS NOT NULL AND id % 8 = 1 THEN 'documento_path:extension' END) AS errors FROM v_deeds""")
def _(v):
    odd = v.deeds().selectExpr(
        "id", "case id % 7 when 1 then null when 2 then 'otra' else tipo end as tipo", "case when id % 6 = 1 then 'ayer' else cast(fecha_registro as string) end as fecha_registro",
        "case when documento_path is not null and id % 8 = 1 then 'acta.docx' else documento_path end as documento_path",
    )
    return rules.validate_records(odd, rules.DEED_RULES).select("id", F.concat_ws(",", "errors").alias("errors"))


@register("quarantined_regulations", """
    SELECT id, 'source_pdf_path:required' AS errors FROM v_regulations WHERE source_pdf_path IS NULL""")
def _(v):
    _, rejected = rules.split_valid(rules.validate_records(v.regulations(), rules.REGULATION_RULES))
    return rejected.select("id", F.concat_ws(",", "errors").alias("errors"))


@register("accepted_regulations", "SELECT id, title FROM v_regulations WHERE source_pdf_path IS NOT NULL")
def _(v):
    accepted, _ = rules.split_valid(rules.validate_records(v.regulations(), rules.REGULATION_RULES))
    return accepted.select("id", "title")


@register("normalize_period", """
    SELECT id, periodicity, CASE WHEN periodicity = 'mensual' THEN month END AS month,
           CASE WHEN periodicity = 'mensual' AND coalesce(month, 0) = 0 THEN 'month:required' END AS period_error FROM v_statements""")
def _(v):
    return rules.normalize_period(v.statements()).select("id", "periodicity", "month", "period_error")


@register("infer_format", """
    SELECT id, file_name, CASE WHEN lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) IN ('pdf', 'xml', 'xlsx', 'xls', 'csv')
                               THEN lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) ELSE 'pdf' END AS format FROM v_declarations""")
def _(v):
    return v.declarations().select("id", "file_name", rules.infer_format(F.col("file_name")).alias("format"))


@register("canonical_companies", "SELECT id, upper(nombre) AS nombre, upper(rfc) AS rfc FROM v_companies")
def _(v):
    return rules.canonicalize_company(v.companies()).select("id", "nombre", "rfc")


@register("duplicate_titles", "SELECT title, count(*) AS copies FROM v_letterheads GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return rules.duplicate_keys(v.letterheads(), "title")


_NAME = "CASE WHEN source_pdf_original_name <> '' THEN source_pdf_original_name WHEN source_pdf_path <> '' THEN split_part(source_pdf_path, '/', -1) END"


@register("filter_regulations", f"SELECT id, country_code, scope, {_NAME} AS source_pdf_name FROM v_regulations WHERE country_code = 'US' AND scope = 'federal'")
def _(v):
    return rules.filter_regulations(v.regulations(), "us", "federal").select("id", "country_code", "scope", "source_pdf_name")


@register("unfiltered_regulations", f"SELECT id, {_NAME} AS source_pdf_name FROM v_regulations")
def _(v):
    return rules.filter_regulations(v.regulations()).select("id", "source_pdf_name")


@register("display_name", f"SELECT id, {_NAME} AS shown FROM v_regulations")
def _(v):
    return v.regulations().select("id", display_name(F.col("source_pdf_original_name"), F.col("source_pdf_path")).alias("shown"))


_ENTRIES = "['  ' || c_name || ' ', '', ' ', c_mktsegment]"


@register("normalize_string_array", f"""
    SELECT c_custkey, array_to_string(list_filter(list_transform({_ENTRIES}, lambda x: trim(x)), lambda x: x <> ''), '|') AS members FROM customer""")
def _(v):
    raw = F.array(F.concat(F.lit("  "), "c_name", F.lit(" ")), F.lit(""), F.lit(" "), F.col("c_mktsegment"))
    return v.table("customer").select("c_custkey", F.array_join(values.normalize_string_array(raw), "|").alias("members"))


@register("normalize_entries", """
    SELECT c_custkey, CASE WHEN c_acctbal > 0 OR c_custkey % 2 = 1 THEN
             concat_ws('|', CASE WHEN c_acctbal > 0 THEN c_name || '/' || coalesce(CASE WHEN c_custkey % 3 > 0 THEN '50%' END, '-') END,
                            CASE WHEN c_custkey % 2 = 1 THEN '-/' || c_mktsegment END) END AS members FROM customer""")
def _(v):
    entries = F.expr(
        """array(struct(case when c_acctbal > 0 then concat(' ', c_name) else ' ' end as socio,
                        case when c_acctbal > 0 and c_custkey % 3 > 0 then '50%' else '' end as porcentaje),
                 struct('\t' as socio, case when c_custkey % 2 = 1 then c_mktsegment end as porcentaje))"""
    )
    cleaned = values.normalize_entries(entries, ["socio", "porcentaje"])
    shown = F.transform(cleaned, lambda e: F.concat_ws("/", F.coalesce(e["socio"], F.lit("-")), F.coalesce(e["porcentaje"], F.lit("-"))))
    return v.table("customer").select("c_custkey", F.array_join(shown, "|").alias("members"))


@register("select_reextract", """
    SELECT d.id, d.company_id, c.user_id, CASE WHEN coalesce(c.user_id, 0) > 0 THEN 'enqueue' ELSE 'skip_unresolved_user' END AS action
    FROM v_deeds d LEFT JOIN v_companies c ON c.id = d.company_id WHERE d.documento_path IS NOT NULL""")
def _(v):
    return rules.select_reextract(v.deeds(), v.companies())


@register("select_reextract_of_company", """
    SELECT d.id, d.company_id, c.user_id, CASE WHEN coalesce(c.user_id, 0) > 0 THEN 'enqueue' ELSE 'skip_unresolved_user' END AS action
    FROM v_deeds d LEFT JOIN v_companies c ON c.id = d.company_id WHERE d.documento_path IS NOT NULL AND (d.company_id = 7 OR d.id = 21 AND d.company_id = 10)""")
def _(v):
    chosen = rules.select_reextract(v.deeds(), v.companies(), company_id=7)
    return chosen.unionByName(rules.select_reextract(v.deeds(), v.companies(), company_id=10, deed_id=21))


@register("route_requeue_failed", """
    SELECT id, documentable_id, CASE WHEN id % 4 = 1 THEN 'skip_unknown_type' ELSE 'full' END AS job FROM v_document_index WHERE status = 'failed'""")
def _(v):
    odd = v.document_index(with_text=True).withColumn("documentable_type", F.expr("case when id % 4 = 1 then 'Contrato' else documentable_type end"))
    return rules.route_requeue(odd, "failed").select("id", "documentable_id", "job")


@register("route_requeue", """
    SELECT id, documentable_id, CASE WHEN index_text IS NOT NULL OR extracted_text IS NOT NULL THEN 'reindex' ELSE 'full' END AS job
    FROM v_document_index WHERE status = 'processed'""")
def _(v):
    return rules.route_requeue(v.document_index(with_text=True), "processed").select("id", "documentable_id", "job")


@register("single_default", """
    SELECT id, company_id, is_default AND row_number() OVER (PARTITION BY company_id, is_default ORDER BY created_at DESC, id DESC) = 1 AS is_default FROM v_letterheads""")
def _(v):
    return rules.enforce_single_default(v.letterheads()).select("id", "company_id", "is_default")


@register("resolve_letterheads", """
    SELECT t.id, CASE WHEN l.id IS NOT NULL THEN t.company_letterhead_id END AS company_letterhead_id
    FROM v_tenders t LEFT JOIN v_letterheads l ON l.id = t.company_letterhead_id AND l.company_id = t.company_id""")
def _(v):
    return rules.resolve_refs(v.tenders(), v.bridge(), v.regulations(), v.letterheads())[0].select("id", "company_letterhead_id")


@register("resolve_regulations", """
    SELECT b.licitacion_id, b.regulation_id FROM v_bridge b JOIN v_tenders t ON t.id = b.licitacion_id
    JOIN v_regulations r ON r.id = b.regulation_id AND r.user_id = t.user_id""")
def _(v):
    return rules.resolve_refs(v.tenders(), v.bridge(), v.regulations(), v.letterheads())[1]


def entities(v):
    return {
        "users": v.users(), "companies": v.companies(), "regulations": v.regulations(), "deeds": v.deeds(), "opinions": v.opinions(),
        "letterheads": v.letterheads(), "tenders": v.tenders(), "bridge": v.bridge(), "validations": v.validations(), "findings": v.findings(),
        "index": v.document_index(),
    }


_REFS = [
    ("companies", "user_id", "users"), ("regulations", "user_id", "users"), ("deeds", "company_id", "companies"), ("opinions", "company_id", "companies"),
    ("letterheads", "company_id", "companies"), ("tenders", "user_id", "users"), ("tenders", "company_id", "companies"),
    ("tenders", "company_letterhead_id", "letterheads"), ("bridge", "licitacion_id", "tenders"), ("bridge", "regulation_id", "regulations"),
    ("validations", "user_id", "users"), ("validations", "licitacion_id", "tenders"), ("findings", "proposal_validation_id", "validations"),
    ("index", "user_id", "users"),
]


def _view(name):
    return "v_document_index" if name == "index" else f"v_{name}"


_REPORT = " UNION ALL ".join(
    [
        f"SELECT '{c}.{k}->{p}' AS rule, 'orphan' AS issue, count(*) AS offending FROM {_view(c)} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT id FROM {_view(p)})"
        for c, k, p in _REFS
    ]
    + [
        f"SELECT '{t}({','.join(k)})', 'duplicate', count(*) - count(DISTINCT ({', '.join(k)})) FROM {_view(t)}"
        for t, k in [("companies", ["rfc"]), ("bridge", ["licitacion_id", "regulation_id"]), ("validations", ["licitacion_id"]),
                     ("index", ["documentable_type", "documentable_id"])]
    ]
)


@register("integrity_report", _REPORT)
def _(v):
    return rules.integrity_report(entities(v))


@register("cascade_delete", """
    WITH gone AS (SELECT id FROM v_users WHERE name IN ('NATION_3', 'NATION_7')),
    c AS (SELECT * FROM v_companies WHERE user_id NOT IN (SELECT id FROM gone)),
    r AS (SELECT * FROM v_regulations WHERE user_id NOT IN (SELECT id FROM gone)),
    l AS (SELECT * FROM v_letterheads WHERE company_id IN (SELECT id FROM c)),
    t AS (SELECT * FROM v_tenders WHERE user_id NOT IN (SELECT id FROM gone) AND company_id IN (SELECT id FROM c)),
    w AS (SELECT * FROM v_validations WHERE user_id NOT IN (SELECT id FROM gone) AND licitacion_id IN (SELECT id FROM t))
    SELECT 'companies' AS entity, count(*) AS remaining, 0 AS nulled FROM c
    UNION ALL SELECT 'tenders', count(*), count(*) FILTER (company_letterhead_id IS NULL OR company_letterhead_id NOT IN (SELECT id FROM l)) FROM t
    UNION ALL SELECT 'bridge', count(*), 0 FROM v_bridge WHERE licitacion_id IN (SELECT id FROM t) AND regulation_id IN (SELECT id FROM r)
    UNION ALL SELECT 'findings', count(*), 0 FROM v_findings WHERE proposal_validation_id IN (SELECT id FROM w)""")
def _(v):
    gone = v.users().where("name in ('NATION_3', 'NATION_7')")
    left = rules.cascade_delete(entities(v), gone)

    def line(name, nulled=F.lit(0)):
        return left[name].agg(F.count(F.lit(1)).alias("remaining"), F.sum(nulled.cast("long")).alias("nulled")).select(
            F.lit(name).alias("entity"), "remaining", F.col("nulled").cast("int").alias("nulled")
        )

    return line("companies").unionByName(line("tenders", F.col("company_letterhead_id").isNull())).unionByName(line("bridge")).unionByName(line("findings"))


@register("cascade_changes", """
    WITH gone AS (SELECT id FROM v_users WHERE name IN ('NATION_3', 'NATION_7')),
    c AS (SELECT id FROM v_companies WHERE user_id IN (SELECT id FROM gone)),
    r AS (SELECT id FROM v_regulations WHERE user_id IN (SELECT id FROM gone)),
    l AS (SELECT id FROM v_letterheads WHERE company_id IN (SELECT id FROM c)),
    t AS (SELECT id FROM v_tenders WHERE user_id IN (SELECT id FROM gone) OR company_id IN (SELECT id FROM c)),
    w AS (SELECT id FROM v_validations WHERE user_id IN (SELECT id FROM gone) OR licitacion_id IN (SELECT id FROM t))
    SELECT 'companies' AS entity, 'deleted' AS change, id FROM c UNION ALL SELECT 'regulations', 'deleted', id FROM r UNION ALL SELECT 'tenders', 'deleted', id FROM t
    UNION ALL SELECT 'validations', 'deleted', id FROM w
    UNION ALL SELECT 'tenders', 'nulled', id FROM v_tenders WHERE id NOT IN (SELECT id FROM t) AND company_letterhead_id IN (SELECT id FROM l)
    UNION ALL SELECT 'bridge', 'deleted', licitacion_id FROM v_bridge WHERE licitacion_id IN (SELECT id FROM t) OR regulation_id IN (SELECT id FROM r)
    UNION ALL SELECT 'findings', 'deleted', proposal_validation_id FROM v_findings WHERE proposal_validation_id IN (SELECT id FROM w)""")
def _(v):
    changes = rules.cascade_changes(entities(v), v.users().where("name in ('NATION_3', 'NATION_7')"))
    keys = {"companies": "id", "regulations": "id", "tenders": "id", "validations": "id", "bridge": "licitacion_id", "findings": "proposal_validation_id"}
    lines = [
        side.select(F.lit(name).alias("entity"), F.lit(change).alias("change"), F.col(key).cast("long").alias("id"))
        for name, key in keys.items()
        for change, side in zip(("deleted", "nulled"), changes[name])
    ]
    return reduce(DataFrame.unionByName, lines)
