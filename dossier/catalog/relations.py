"""Queries over relational loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import register
from dossier.operators import relations


@register("with_company", "SELECT t.id, t.company_id, c.nombre, c.rfc FROM v_tenders t LEFT JOIN v_companies c ON c.id = t.company_id")
def _(v):
    return relations.with_company(v.tenders().select("id", "company_id"), v.companies()).select("id", "company_id", "nombre", "rfc")


@register("company_profile", """
    SELECT company_id, section, id AS child_id,
           row_number() OVER (PARTITION BY company_id, section ORDER BY k1 DESC NULLS LAST, k2 DESC NULLS LAST, id DESC) - 1 AS position
    FROM (SELECT company_id, 'deeds' AS section, id, CAST(fecha_registro - DATE '1970-01-01' AS BIGINT) AS k1, 0 AS k2 FROM v_deeds
          UNION ALL SELECT company_id, 'opinions', id, CAST(fecha_emision - DATE '1970-01-01' AS BIGINT), 0 FROM v_opinions
          UNION ALL SELECT company_id, 'statements', id, year, month FROM v_statements
          UNION ALL SELECT company_id, 'declarations', id, year, month FROM v_declarations
          UNION ALL SELECT company_id, 'letterheads', id, CAST(is_default AS BIGINT), 0 FROM v_letterheads)
    WHERE company_id IN (SELECT id FROM v_companies)""")
def _(v):
    return relations.company_profile(v.companies(), v.deeds(), v.opinions(), v.statements(), v.declarations(), v.letterheads())


@register("with_document_index", """
    SELECT d.id, d.tipo, i.id AS index_id, i.status AS index_status FROM v_deeds d
    LEFT JOIN v_document_index i ON i.documentable_type = 'Acta' AND i.documentable_id = d.id""")
def _(v):
    return relations.with_document_index(v.deeds(), v.document_index(), "Acta").select("id", "tipo", "index_id", "index_status")


@register("having_validation", "SELECT id, status FROM v_tenders WHERE id IN (SELECT licitacion_id FROM v_validations)")
def _(v):
    return relations.having_related(v.tenders(), v.validations(), "id", "licitacion_id").select("id", "status")


@register("lacking_validation", "SELECT id, title, status FROM v_tenders WHERE id NOT IN (SELECT licitacion_id FROM v_validations)")
def _(v):
    return relations.lacking_related(v.tenders(), v.validations(), "id", "licitacion_id").select("id", "title", "status")


@register("with_regulations", """
    SELECT b.licitacion_id, b.regulation_id, r.title AS regulation_title, r.scope, r.country_code, t.title AS tender_title
    FROM v_bridge b JOIN v_regulations r ON r.id = b.regulation_id JOIN v_tenders t ON t.id = b.licitacion_id""")
def _(v):
    return relations.with_regulations(v.tenders(), v.bridge(), v.regulations())


@register("sync_bridge", """
    WITH desired AS (SELECT DISTINCT l_orderkey AS licitacion_id, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS regulation_id FROM lineitem)
    SELECT b.licitacion_id, b.regulation_id, 'detach' AS action FROM v_bridge b
    WHERE b.licitacion_id IN (SELECT licitacion_id FROM desired)
      AND NOT EXISTS (SELECT 1 FROM desired d WHERE d.licitacion_id = b.licitacion_id AND d.regulation_id = b.regulation_id)
    UNION ALL
    SELECT d.licitacion_id, d.regulation_id, 'attach' FROM desired d WHERE d.regulation_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM v_bridge b WHERE d.licitacion_id = b.licitacion_id AND d.regulation_id = b.regulation_id)""")
def _(v):
    desired = v.table("lineitem").selectExpr(
        "l_orderkey as licitacion_id", "case when l_returnflag <> 'N' then l_suppkey end as regulation_id"
    )
    return relations.sync_bridge(v.bridge(), desired)


@register("user_letterheads", """
    SELECT c.user_id, l.id, l.company_id, l.title, l.is_default FROM v_letterheads l JOIN v_companies c ON c.id = l.company_id
    WHERE c.user_id IN (SELECT id FROM v_users)""")
def _(v):
    return relations.user_letterheads(v.users(), v.companies(), v.letterheads())


@register("letterhead_options", """
    SELECT company_id, id, title, is_default, row_number() OVER (PARTITION BY company_id ORDER BY is_default DESC, title, id) - 1 AS position FROM v_letterheads""")
def _(v):
    return relations.letterhead_options(v.letterheads())


@register("vectors_for_document", """
    SELECT x.id, x.doc_id FROM v_vectors x WHERE regexp_extract(x.id, '^(.+)-[0-9]+$', 1) IN
      (SELECT document_type || '-' || documentable_id FROM v_document_index)""")
def _(v):
    documents = v.document_index().select("document_type", F.col("documentable_id").alias("document_id"))
    return relations.vectors_for_document(v.vectors(), documents).select("id", "doc_id")


@register("with_actor", "SELECT e.id, e.user_id, u.name AS user_name, e.event_type FROM v_audit_events e LEFT JOIN v_users u ON u.id = e.user_id")
def _(v):
    return relations.with_actor(v.audit_events(), v.users()).select("id", "user_id", "user_name", "event_type")
