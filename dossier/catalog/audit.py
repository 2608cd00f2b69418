"""Queries over the compliance audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import register, view_sql
from dossier.operators import audit
from dossier.plans.views import AS_OF
from dossier.sources import exports

view_sql.register_view("v_expiry", f"""
    SELECT *, coalesce(fecha_vigencia, fecha_emision + 30) AS vigencia_calculada,
           CAST(coalesce(fecha_vigencia, fecha_emision + 30) - DATE '{AS_OF}' AS BIGINT) AS days_to_expiry
    FROM v_opinions""")
view_sql.register_view("v_inputs", """
    SELECT t.*, (SELECT count(*) FROM v_checklist c WHERE c.tender_id = t.id AND coalesce(c.checked, FALSE) = FALSE) AS checklist_pending,
           coalesce(r.n, 0) AS regulations_count, l.title AS letterhead_title,
           coalesce(d.n, 0) AS deeds_count, coalesce(s.n, 0) AS statements_count, coalesce(x.n, 0) AS declarations_count,
           coalesce(o.n, 0) AS opinions_count, coalesce(o.expired, 0) AS expired_count, coalesce(o.expiring, 0) AS expiring_count
    FROM v_tenders t
    LEFT JOIN (SELECT licitacion_id, count(*) AS n FROM v_bridge GROUP BY 1) r ON r.licitacion_id = t.id
    LEFT JOIN v_letterheads l ON l.id = t.company_letterhead_id
    LEFT JOIN (SELECT company_id, count(*) AS n FROM v_deeds GROUP BY 1) d ON d.company_id = t.company_id
    LEFT JOIN (SELECT company_id, count(*) AS n FROM v_statements GROUP BY 1) s ON s.company_id = t.company_id
    LEFT JOIN (SELECT company_id, count(*) AS n FROM v_declarations GROUP BY 1) x ON x.company_id = t.company_id
    LEFT JOIN (SELECT company_id, count(*) AS n, count(*) FILTER (days_to_expiry < 0) AS expired,
                      count(*) FILTER (days_to_expiry BETWEEN 0 AND 7) AS expiring FROM v_expiry GROUP BY 1) o ON o.company_id = t.company_id""")
view_sql.register_view("v_checks", """
    SELECT id AS tender_id, 1 AS check_no, 'Bases cargadas' AS label, bases_document_path IS NOT NULL AS passed,
           coalesce(bases_document_original_name, 'Sin bases adjuntas') AS detail FROM v_inputs
    UNION ALL SELECT id, 2, 'Checklist revisado', checklist_pending = 0,
           CASE WHEN checklist_pending = 0 THEN 'Todos los puntos iniciales aparecen marcados.'
                ELSE 'Hay ' || checklist_pending || ' punto(s) pendientes en checklist.' END FROM v_inputs
    UNION ALL SELECT id, 3, 'Regulaciones asignadas', regulations_count > 0,
           CASE WHEN regulations_count > 0 THEN regulations_count || ' regulación(es) vinculadas.' ELSE 'No hay regulaciones vinculadas.' END FROM v_inputs
    UNION ALL SELECT id, 4, 'Hoja membretada seleccionada', letterhead_title IS NOT NULL, coalesce(letterhead_title, 'No seleccionada.') FROM v_inputs
    UNION ALL SELECT id, 5, 'Actas corporativas', deeds_count > 0,
           CASE WHEN deeds_count > 0 THEN deeds_count || ' acta(s).' ELSE 'No hay actas registradas.' END FROM v_inputs
    UNION ALL SELECT id, 6, 'Estados financieros', statements_count > 0,
           CASE WHEN statements_count > 0 THEN statements_count || ' estado(s).' ELSE 'No hay estados financieros.' END FROM v_inputs
    UNION ALL SELECT id, 7, 'Declaraciones de impuestos', declarations_count > 0,
           CASE WHEN declarations_count > 0 THEN declarations_count || ' declaración(es).' ELSE 'No hay declaraciones.' END FROM v_inputs
    UNION ALL SELECT id, 8, 'Opiniones de cumplimiento', opinions_count > 0,
           CASE WHEN opinions_count > 0 THEN opinions_count || ' opinión(es).' ELSE 'No hay opiniones de cumplimiento.' END FROM v_inputs""")
view_sql.register_view("v_issues", """
    SELECT tender_id, 'issue' AS kind, 0 AS rank, 0 AS section, CAST(check_no AS BIGINT) AS pos, label || ': ' || detail AS message FROM v_checks WHERE NOT passed
    UNION ALL
    SELECT t.id, CASE WHEN days_to_expiry < 0 THEN 'issue' ELSE 'warning' END, CASE WHEN days_to_expiry < 0 THEN 0 ELSE 1 END, 1, o.id,
           CASE WHEN days_to_expiry < 0 THEN 'Opinión ' || tipo || ' vencida desde hace ' || (-days_to_expiry) || ' día(s).'
                ELSE 'Opinión ' || tipo || ' por vencer en ' || days_to_expiry || ' día(s).' END
    FROM v_tenders t JOIN v_expiry o ON o.company_id = t.company_id WHERE days_to_expiry <= 7
    UNION ALL
    SELECT tender_id, 'warning', 1, 2, pos, 'Checklist pendiente: ' || label FROM v_checklist WHERE coalesce(checked, FALSE) = FALSE""")
view_sql.register_view("v_audit", """
    SELECT id AS tender_id, user_id, company_id, 8 AS checks_total, p.passed AS checks_passed,
           8 - p.passed + expired_count AS issues_count, expiring_count + checklist_pending AS warnings_count,
           CASE WHEN 8 - p.passed + expired_count > 0 THEN 'red' WHEN expiring_count + checklist_pending > 0 THEN 'yellow' ELSE 'green' END AS traffic_light,
           bases_document_path IS NOT NULL AS bases_loaded, checklist_pending, regulations_count,
           deeds_count AS actas, opinions_count AS opiniones, statements_count AS estados_financieros, declarations_count AS declaraciones
    FROM v_inputs JOIN (SELECT tender_id, count(*) FILTER (passed) AS passed FROM v_checks GROUP BY 1) p ON p.tender_id = v_inputs.id""")


def entities(v):
    return {
        "tenders": v.tenders(), "bridge": v.bridge(), "letterheads": v.letterheads(), "deeds": v.deeds(),
        "statements": v.statements(), "declarations": v.declarations(), "opinions": v.opinions(),
    }


@register("effective_expiry", "SELECT id, CAST(vigencia_calculada AS VARCHAR) AS vigencia_calculada FROM v_expiry")
def _(v):
    return audit.with_effective_expiry(v.opinions()).select("id", F.col("vigencia_calculada").cast("string").alias("vigencia_calculada"))


@register("expiry_status", """
    SELECT id, days_to_expiry, CASE WHEN days_to_expiry < 0 THEN 'expired' WHEN days_to_expiry <= 7 THEN 'expiring' ELSE 'ok' END AS expiry_status
    FROM v_expiry""")
def _(v):
    return audit.with_expiry(v.opinions(), AS_OF).select("id", F.col("days_to_expiry").cast("long").alias("days_to_expiry"), "expiry_status")


@register("checklist_stats", """
    SELECT tender_id AS id, count(*) AS checklist_total, count(*) FILTER (coalesce(checked, FALSE) = FALSE) AS checklist_pending
    FROM v_checklist GROUP BY 1""")
def _(v):
    return audit.checklist_stats(v.tenders()).select("id", "checklist_total", "checklist_pending")


@register("tender_checks", "SELECT tender_id, CAST(check_no AS BIGINT) AS check_no, label, passed, detail FROM v_checks")
def _(v):
    return audit.tender_checks(entities(v), AS_OF)


@register("tender_issues", "SELECT tender_id, kind, CAST(rank AS BIGINT) AS rank, CAST(section AS BIGINT) AS section, CAST(pos AS BIGINT) AS pos, message FROM v_issues")
def _(v):
    return audit.tender_issues(entities(v), AS_OF).select(
        "tender_id", "kind", F.col("rank").cast("long").alias("rank"), F.col("section").cast("long").alias("section"), "pos", "message"
    )


@register("tender_findings", f"""
    SELECT tender_id, CAST(section AS BIGINT) AS section, CAST(pos AS BIGINT) AS pos, message,
           CASE WHEN kind = 'issue' THEN 'critical' ELSE 'warning' END AS severity,
           CASE WHEN kind = 'issue' THEN 'cumplimiento' ELSE 'seguimiento' END AS category,
           CASE WHEN kind = 'issue' THEN 'CHK-CRIT' ELSE 'CHK-WARN' END AS rule_code,
           CASE WHEN kind = 'issue' THEN 'Cumplimiento general' ELSE 'Seguimiento operativo' END AS documento,
           CASE WHEN kind = 'issue' THEN 'Alta' ELSE 'Media' END AS gravedad,
           CASE WHEN kind = 'issue' THEN '{audit.SOLUTION_CRITICAL}' ELSE '{audit.SOLUTION_WARNING}' END AS propuesta_solucion
    FROM v_issues""")
def _(v):
    return audit.tender_findings(audit.tender_issues(entities(v), AS_OF)).select(
        "tender_id", F.col("section").cast("long").alias("section"), "pos", "message", "severity", "category", "rule_code", "documento",
        "gravedad", "propuesta_solucion",
    )


@register("traffic_light", "SELECT traffic_light, count(*) AS tenders FROM v_audit GROUP BY 1")
def _(v):
    return audit.audit_tenders(entities(v), AS_OF).groupBy("traffic_light").agg(F.count(F.lit(1)).alias("tenders"))


@register("audit_tenders", """
    SELECT tender_id, user_id, company_id, CAST(checks_total AS BIGINT) AS checks_total, checks_passed, issues_count, warnings_count,
           issues_count + warnings_count AS structured_findings_count, traffic_light, bases_loaded, CAST(3 AS BIGINT) AS checklist_total,
           checklist_pending, regulations_count, actas, opiniones, estados_financieros, declaraciones
    FROM v_audit""")
def _(v):
    return audit.audit_tenders(entities(v), AS_OF).drop("checks")


@register("report_summary", """
    SELECT tender_id, checks_passed, CAST(8 AS BIGINT) AS checks_total, issues_count, warnings_count,
           issues_count + warnings_count AS structured_findings_count, traffic_light FROM v_audit""")
def _(v):
    e = entities(v)
    return audit.report_summary(audit.tender_checks(e, AS_OF), audit.tender_issues(e, AS_OF))


view_sql.register_view("v_reaudit", """
    SELECT v.id, v.override_applied, a.traffic_light AS report_light,
           CASE WHEN v.override_applied THEN 'green' ELSE a.traffic_light END AS traffic_light,
           CASE WHEN v.override_applied OR a.traffic_light = 'green' THEN 'ready_for_export' ELSE 'reviewed' END AS target_status
    FROM v_validations v JOIN v_audit a ON a.tender_id = v.licitacion_id""")


@register("target_status_reaudit", "SELECT id, report_light, traffic_light, target_status, target_status = 'ready_for_export' AS ready_at_set FROM v_reaudit")
def _(v):
    reports = audit.audit_tenders(entities(v), AS_OF).select(F.col("tender_id").alias("licitacion_id"), "traffic_light")
    joined = v.validations().drop("traffic_light").join(reports, "licitacion_id")
    return audit.target_status(joined, first_run=False).select("id", "report_light", "traffic_light", "target_status", "ready_at_set")


@register("target_status_first_audit", """
    SELECT tender_id, traffic_light, CASE WHEN traffic_light = 'green' THEN 'ready_for_export' ELSE 'reviewed' END AS target_status FROM v_audit""")
def _(v):
    reports = audit.audit_tenders(entities(v), AS_OF).select("tender_id", "traffic_light")
    return audit.target_status(reports, first_run=True).select("tender_id", "traffic_light", "target_status")


@register("replace_findings", f"""
    SELECT proposal_validation_id, severity, category, rule_code, message, 'open' AS status, resolution_note FROM v_findings
    WHERE proposal_validation_id NOT IN (SELECT id FROM v_validations WHERE override_applied)
    UNION ALL
    SELECT v.id, CASE WHEN kind = 'issue' THEN 'critical' ELSE 'warning' END, CASE WHEN kind = 'issue' THEN 'cumplimiento' ELSE 'seguimiento' END,
           CASE WHEN kind = 'issue' THEN 'CHK-CRIT' ELSE 'CHK-WARN' END, message, 'open',
           CASE WHEN kind = 'issue' THEN '{audit.SOLUTION_CRITICAL}' ELSE '{audit.SOLUTION_WARNING}' END
    FROM v_issues i JOIN v_validations v ON v.licitacion_id = i.tender_id WHERE v.override_applied""")
def _(v):
    audited = v.validations().where("override_applied").select(F.col("id").alias("proposal_validation_id"), F.col("licitacion_id").alias("tender_id"))
    incoming = audit.tender_findings(audit.tender_issues(entities(v), AS_OF)).join(audited, "tender_id")
    return audit.replace_findings(v.findings().withColumn("status", F.lit("open")), audited, incoming)


@register("zip_by_index", """
    SELECT licitacion_id, CAST(pos AS BIGINT) AS pos, reg, note FROM (
        SELECT c.tender_id AS licitacion_id, c.pos, c.label AS reg, CASE WHEN c.pos < 2 THEN 'nota ' || c.pos END AS note FROM v_checklist c)""")
def _(v):
    left = v.tenders().select(F.col("id").alias("licitacion_id"), F.transform("checklist", lambda c: c["label"]).alias("labels"))
    right = v.tenders().select(F.col("id").alias("licitacion_id"), F.array(F.lit("nota 0"), F.lit("nota 1")).alias("notes"))
    return audit.zip_by_index(left, right, "licitacion_id", "labels", "notes").select(
        "licitacion_id", F.col("pos").cast("long").alias("pos"), F.col("left_item").alias("reg"), F.col("right_item").alias("note")
    )


_SUGGEST = "CASE {0} WHEN 'critical' THEN '" + audit.SUGGESTION["critical"] + "' WHEN 'warning' THEN '" + audit.SUGGESTION["warning"] + "' ELSE '" + audit.SUGGESTION["info"] + "' END"


view_sql.register_view("v_export_rows", f"""
    SELECT r.validation_id, 0 AS part, r.pos, coalesce(documento, 'N/A') AS documento, coalesce(gravedad, 'Baja') AS gravedad, error,
           coalesce(propuesta_solucion, '{audit.SUGGESTION["info"]}') AS propuesta_solucion
    FROM v_report_rows r JOIN v_validations v ON v.id = r.validation_id WHERE kind = 'structured'
    UNION ALL
    SELECT f.proposal_validation_id, 0, f.id, rule_code || ' · ' || category,
           CASE severity WHEN 'critical' THEN 'Alta' WHEN 'warning' THEN 'Media' ELSE 'Baja' END, message,
           coalesce(resolution_note, {_SUGGEST.format('severity')})
    FROM v_findings f JOIN v_validations v ON v.id = f.proposal_validation_id
    WHERE f.proposal_validation_id NOT IN (SELECT validation_id FROM v_report_rows WHERE kind = 'structured')
    UNION ALL
    SELECT r.validation_id, CASE WHEN kind = 'issue' THEN 0 ELSE 1 END, r.pos,
           CASE WHEN kind = 'issue' THEN 'LEGACY · cumplimiento' ELSE 'LEGACY · seguimiento' END,
           CASE WHEN kind = 'issue' THEN 'Alta' ELSE 'Media' END, error, CASE WHEN kind = 'issue' THEN {_SUGGEST.format("'critical'")} ELSE {_SUGGEST.format("'warning'")} END
    FROM v_report_rows r JOIN v_validations v ON v.id = r.validation_id
    WHERE kind <> 'structured' AND r.validation_id NOT IN (SELECT validation_id FROM v_report_rows WHERE kind = 'structured')
      AND r.validation_id NOT IN (SELECT proposal_validation_id FROM v_findings)""")


@register("export_rows", "SELECT * FROM v_export_rows")
def _(v):
    return audit.export_rows(v.validations(), v.findings(), v.report_rows()).select(
        "validation_id", F.col("part").cast("int").alias("part"), "pos", "documento", "gravedad", "error", "propuesta_solucion"
    )


_SHEET_TITLES = ", ".join(f'{c} AS "{t}"' for c, t in zip(["documento", "gravedad", "error", "propuesta_solucion"], audit.EXPORT_HEADER))


@register("company_findings", """
    SELECT company_id, CASE WHEN days_to_expiry < 0 THEN 'issue' ELSE 'warning' END AS kind, id AS pos,
           CASE WHEN days_to_expiry < 0 THEN 'Opinión ' || tipo || ' vencida desde hace ' || (-days_to_expiry) || ' día(s).'
                ELSE 'Opinión ' || tipo || ' por vencer en ' || days_to_expiry || ' día(s).' END AS message
    FROM v_expiry WHERE days_to_expiry <= 7""")
def _(v):
    return audit.company_findings(v.opinions(), AS_OF)


@register("export_findings", f"SELECT validation_id, part, pos, {_SHEET_TITLES} FROM v_export_rows")
def _(v):
    return exports.sheet_rows(audit.export_rows(v.validations(), v.findings(), v.report_rows()))


# The documents of a bundle, field by field, as the JSON says them.
@register("export_bundle", """
    SELECT 'findings' AS part, proposal_validation_id AS validation_id, severity AS a, message AS b, resolution_note AS c FROM v_findings
    UNION ALL SELECT 'structured_findings', validation_id, gravedad, error, CAST(pos AS VARCHAR) FROM v_report_rows WHERE kind = 'structured'
    UNION ALL SELECT 'report', id, status, traffic_light, override_reason FROM v_validations
    UNION ALL SELECT 'summary', v.id, t.title, c.nombre, CAST(v.override_applied AS VARCHAR) FROM v_validations v LEFT JOIN v_tenders t ON t.id = v.licitacion_id LEFT JOIN v_companies c ON c.id = t.company_id""")
def _(v):
    validations = v.validations()
    summary = audit.export_summary(validations, v.tenders(), v.companies(), v.findings())
    documents = exports.bundle_rows(
        validations.withColumnRenamed("id", "validation_id"), v.findings().withColumnRenamed("proposal_validation_id", "validation_id"), v.report_rows().where("kind = 'structured'"), summary
    )
    fields = {
        "findings": ("severity", "message", "resolution_note"), "structured_findings": ("gravedad", "error", "pos"),
        "report": ("status", "traffic_light", "override_reason"), "summary": ("licitacion", "empresa", "override_applied"),
    }
    shown = [
        F.coalesce(*[F.when(F.col("part") == part, F.get_json_object("document", f"$.{names[i]}")) for part, names in fields.items()]).alias(letter)
        for i, letter in enumerate("abc")
    ]
    return documents.select("part", "validation_id", *shown)


@register("split_findings", """
    SELECT f.proposal_validation_id AS validation_id, severity, CAST(f.id AS VARCHAR) AS finding_id, rule_code, category, message
    FROM v_findings f JOIN v_validations v ON v.id = f.proposal_validation_id WHERE severity IN ('critical', 'warning')
    UNION ALL
    SELECT r.validation_id, CASE WHEN kind = 'issue' THEN 'critical' ELSE 'warning' END,
           CASE WHEN kind = 'issue' THEN 'legacy-critical-' ELSE 'legacy-warning-' END || pos, 'LEGACY',
           CASE WHEN kind = 'issue' THEN 'cumplimiento' ELSE 'seguimiento' END, error
    FROM v_report_rows r JOIN v_validations v ON v.id = r.validation_id
    WHERE kind IN ('issue', 'warning') AND r.validation_id NOT IN (SELECT proposal_validation_id FROM v_findings)""")
def _(v):
    return audit.split_findings(v.validations(), v.findings(), v.report_rows())


@register("export_summary", """
    SELECT v.id AS validation_id, t.title AS licitacion, c.nombre AS empresa, v.traffic_light, v.override_applied, v.override_reason,
           count(f.id) AS findings_count, count(f.id) FILTER (f.severity = 'critical') AS critical_findings_count,
           count(f.id) FILTER (f.severity = 'warning') AS warning_findings_count
    FROM v_validations v LEFT JOIN v_tenders t ON t.id = v.licitacion_id LEFT JOIN v_companies c ON c.id = t.company_id
    LEFT JOIN v_findings f ON f.proposal_validation_id = v.id GROUP BY ALL""")
def _(v):
    return audit.export_summary(v.validations(), v.tenders(), v.companies(), v.findings())


@register("export_eligible", "SELECT id, status, override_applied FROM v_validations WHERE status = 'ready_for_export' OR override_applied")
def _(v):
    return audit.export_eligible(v.validations()).select("id", "status", "override_applied")


@register("approval_eligible", """
    SELECT id, status FROM v_tenders WHERE status <> 'committed'
      AND id IN (SELECT licitacion_id FROM v_validations WHERE status = 'ready_for_export' OR override_applied)""")
def _(v):
    return audit.approval_eligible(v.tenders(), v.validations()).select("id", "status")


@register("editable_tenders", "SELECT id, status FROM v_tenders WHERE status <> 'committed'")
def _(v):
    return audit.editable(v.tenders()).select("id", "status")


@register("initial_checklist", """
    SELECT id, TRUE AS empresa, id IN (SELECT licitacion_id FROM v_bridge) AS regulaciones, bases_document_path IS NOT NULL AS bases FROM v_tenders""")
def _(v):
    return audit.initial_checklist(v.tenders(), v.bridge()).select(
        "id", F.expr("checklist[0].checked").alias("empresa"), F.expr("checklist[1].checked").alias("regulaciones"),
        F.expr("checklist[2].checked").alias("bases"),
    )


@register("apply_override", """
    SELECT id, CASE WHEN licitacion_id % 4 <> 3 AND licitacion_id % 4 > 0 THEN TRUE ELSE override_applied END AS override_applied,
           CASE WHEN licitacion_id % 4 <> 3 AND licitacion_id % 4 > 0 THEN 'motivo ' || (licitacion_id % 4) || 'xx' ELSE override_reason END AS override_reason,
           CASE WHEN licitacion_id % 4 <> 3 AND licitacion_id % 4 > 0 THEN 'green' ELSE traffic_light END AS traffic_light,
           CASE WHEN licitacion_id % 4 <> 3 AND licitacion_id % 4 > 0 THEN 'ready_for_export' ELSE status END AS status,
           CASE WHEN licitacion_id % 4 = 3 THEN 'override_reason:min' END AS override_error
    FROM v_validations""")
def _(v):
    overrides = v.validations().selectExpr(
        "id as validation_id",
        "case licitacion_id % 4 when 0 then null when 3 then 'corto' else concat('motivo ', cast(licitacion_id % 4 as string), 'xx') end as reason",
    )
    return audit.apply_override(v.validations(), overrides).select(
        "id", "override_applied", "override_reason", "traffic_light", "status", "override_error"
    )


@register("approve_tenders", """
    SELECT id, status, CASE WHEN status = 'committed' THEN 'already_committed' WHEN id % 3 = 0 THEN 'note_too_short'
                            WHEN id % 3 = 1 AND id % 2 = 0 THEN 'note_too_long' WHEN status <> 'sent_for_approval' THEN 'invalid_transition' ELSE 'committed' END AS outcome,
           CASE WHEN status = 'sent_for_approval' AND id % 3 <> 0 AND NOT (id % 3 = 1 AND id % 2 = 0) THEN 'committed' ELSE status END AS next_status
    FROM v_tenders""")
def _(v):
    notes = v.tenders().selectExpr(
        "id as tender_id", "case when id % 3 = 0 then 'breve' when id % 3 = 1 and id % 2 = 0 then repeat('x', 1001) else 'nota de aprobacion' end as note"
    )
    return audit.approve(v.tenders(), notes).select("id", "status", "outcome", "next_status")
