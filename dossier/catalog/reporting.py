"""Queries over counts, trends and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import register
from dossier.operators import reporting
from dossier.plans.views import AS_OF


@register("entity_counts", f"SELECT user_id, count(*) AS total, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}') AS today FROM v_tenders GROUP BY 1")
def _(v):
    return reporting.entity_counts(v.tenders(), AS_OF)


_STATUSES = ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}_count, count(*) FILTER (status = '{s}' AND created_at >= TIMESTAMP '{AS_OF}') AS {s}_today"
    for s in reporting.INDEX_STATUSES
)


@register("status_counts", f"SELECT user_id, {_STATUSES} FROM v_document_index GROUP BY 1")
def _(v):
    return reporting.status_counts(v.document_index(), AS_OF)


@register("last_updated", """
    SELECT user_id, CAST(max(u) AS VARCHAR) AS last_updated_at FROM (
      SELECT user_id, updated_at AS u FROM v_companies
      UNION ALL SELECT c.user_id, d.updated_at FROM v_deeds d JOIN v_companies c ON c.id = d.company_id
      UNION ALL SELECT user_id, updated_at FROM v_document_index) GROUP BY 1""")
def _(v):
    owner = v.companies().select(F.col("id").alias("company_id"), "user_id")
    deeds = v.deeds().groupBy("company_id").agg(F.max("updated_at").alias("updated_at")).join(owner, "company_id")
    latest = reporting.last_updated(
        v.companies().select("user_id", "updated_at"), deeds.select("user_id", "updated_at"), v.document_index().select("user_id", "updated_at")
    )
    return latest.select("user_id", F.date_format("last_updated_at", "yyyy-MM-dd HH:mm:ss").alias("last_updated_at"))


@register("company_child_counts", """
    SELECT c.id AS company_id, c.user_id,
           (SELECT count(*) FROM v_deeds x WHERE x.company_id = c.id) AS deeds_count,
           (SELECT count(*) FROM v_opinions x WHERE x.company_id = c.id) AS opinions_count,
           (SELECT count(*) FROM v_statements x WHERE x.company_id = c.id) AS statements_count,
           (SELECT count(*) FROM v_declarations x WHERE x.company_id = c.id) AS declarations_count
    FROM v_companies c""")
def _(v):
    return reporting.company_child_counts(
        v.companies(), deeds=v.deeds(), opinions=v.opinions(), statements=v.statements(), declarations=v.declarations()
    )


@register("distinct_countries", """
    SELECT user_id, country_code, row_number() OVER (PARTITION BY user_id ORDER BY country_code) - 1 AS position FROM (SELECT DISTINCT user_id, country_code FROM v_regulations)""")
def _(v):
    return reporting.distinct_values(v.regulations(), "country_code", "user_id")


@register("latest_statements", """
    SELECT id, company_id, year, month, row_number() OVER (ORDER BY year DESC NULLS LAST, month DESC NULLS LAST, id DESC) - 1 AS position FROM v_statements""")
def _(v):
    return reporting.latest(v.statements(), "year", "month", "id").select("id", "company_id", "year", "month", "position")


@register("recent_history", """
    SELECT id, entity_type, entity_id, CAST(recency AS BIGINT) AS recency FROM (
      SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY id DESC) AS recency FROM v_audit_events) WHERE recency <= 12""")
def _(v):
    return reporting.recent_history(v.audit_events()).select("id", "entity_type", "entity_id", F.col("recency").cast("long").alias("recency"))


@register("cap_history", """
    SELECT id, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, event_type ORDER BY id DESC) AS r FROM v_audit_events) WHERE r <= 50""")
def _(v):
    return reporting.cap_history(v.audit_events(), ["entity_type", "event_type"], "id").select("id", "entity_type")


@register("dashboard", f"""
    WITH rows AS (
      SELECT user_id, 'company' AS kind, count(*) AS n, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}') AS t FROM v_companies GROUP BY 1
      UNION ALL SELECT c.user_id, 'acta', count(*), count(*) FILTER (d.created_at >= TIMESTAMP '{AS_OF}') FROM v_deeds d JOIN v_companies c ON c.id = d.company_id GROUP BY 1
      UNION ALL SELECT c.user_id, 'opinion', count(*), count(*) FILTER (d.fecha_emision >= DATE '{AS_OF}') FROM v_opinions d JOIN v_companies c ON c.id = d.company_id GROUP BY 1
      UNION ALL SELECT user_id, 'regulation', count(*), count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}') FROM v_regulations GROUP BY 1
      UNION ALL SELECT user_id, 'tender', count(*), count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}') FROM v_tenders GROUP BY 1
      UNION ALL SELECT user_id, 'validation', count(*), count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}') FROM v_validations GROUP BY 1
      UNION ALL SELECT user_id, 'ready', count(*), 0 FROM v_validations WHERE status = 'ready_for_export' GROUP BY 1
      UNION ALL SELECT user_id, 'open', count(*), 0 FROM v_validations WHERE traffic_light IN ('yellow', 'red') GROUP BY 1
      UNION ALL SELECT user_id, status, count(*), count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}') FROM v_document_index GROUP BY 1, 2),
    metrics(module, metric, kind) AS (VALUES
      ('Resumen', 'Documentos', 'acta'), ('Resumen', 'Documentos', 'opinion'), ('Resumen', 'Documentos', 'regulation'),
      ('Resumen', 'Procesados', 'processed'), ('Resumen', 'Pendientes', 'pending'), ('Modulo 1', 'Empresas', 'company'), ('Modulo 1', 'Actas', 'acta'),
      ('Modulo 1', 'Opiniones', 'opinion'), ('Modulo 2', 'Regulaciones', 'regulation'), ('Modulo 2', 'Indexadas', 'indexed'), ('Modulo 2', 'Con error', 'failed'),
      ('Modulo 3', 'Expedientes creados', 'tender'), ('Modulo 3', 'Checklist IA', 'tender'), ('Modulo 3', 'Documentos generados', 'none'),
      ('Modulo 4', 'Expedientes validados', 'validation'), ('Modulo 4', 'Observaciones abiertas', 'open'), ('Modulo 4', 'Expedientes listos', 'ready'))
    SELECT u.id AS user_id, m.module, m.metric, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS value, CAST(coalesce(sum(r.t), 0) AS BIGINT) AS today
    FROM v_users u CROSS JOIN metrics m LEFT JOIN rows r ON r.user_id = u.id AND r.kind = m.kind GROUP BY 1, 2, 3""")
def _(v):
    entities = {
        "users": v.users(), "companies": v.companies(), "deeds": v.deeds(), "opinions": v.opinions(), "regulations": v.regulations(),
        "tenders": v.tenders(), "validations": v.validations(), "index": v.document_index(),
    }
    return reporting.dashboard(entities, AS_OF)
