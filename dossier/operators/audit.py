"""Compliance audit of tenders: checks, issues, findings, traffic light, export rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import days_to_expiry, effective_expiry

# Wording of the report.
SOLUTION_CRITICAL = "Corregir este incumplimiento antes de presentar la propuesta y reejecutar la auditoría."
SOLUTION_WARNING = "Revisar este punto y documentar la corrección para evitar riesgos en la presentación."
SUGGESTION = {
    "critical": "Corregir este incumplimiento antes de presentar la propuesta y volver a ejecutar auditoria.",
    "warning": "Revisar este punto y documentar la correccion para evitar riesgo operativo o legal.",
    "info": "Revisar y confirmar el hallazgo.",
}
EXPORT_HEADER = ["Documento / Requisito", "Gravedad", "Error Detectado", "Propuesta de Solucion"]

COMPANY_DOCUMENTS = ["deeds", "statements", "declarations", "opinions"]


def with_effective_expiry(opinions: DataFrame) -> DataFrame:
    return opinions.withColumn("vigencia_calculada", effective_expiry(F.col("fecha_emision"), F.col("fecha_vigencia")))


def with_expiry(opinions: DataFrame, as_of: str) -> DataFrame:
    from dossier.functions.dates import expiry_status

    dated = with_effective_expiry(opinions).withColumn("days_to_expiry", days_to_expiry(F.col("vigencia_calculada"), as_of))
    return dated.withColumn("expiry_status", expiry_status(F.col("days_to_expiry")))


def company_documents(entities: dict[str, DataFrame], as_of: str) -> DataFrame:
    """Per company: how many documents of each kind, and how many opinions are expired or about to expire.

    All child tables are reduced in one aggregation over their union, so a company with very many documents costs
    one partial row per map task.
    """
    parts = []
    for kind in COMPANY_DOCUMENTS:
        child = entities[kind]
        status = with_expiry(child, as_of)["expiry_status"] if kind == "opinions" else None
        rows = with_expiry(child, as_of) if kind == "opinions" else child
        parts.append(
            rows.select("company_id", F.lit(kind).alias("kind"), (F.col("expiry_status") if status is not None else F.lit(None)).cast("string").alias("expiry"))
        )
    union = reduce(DataFrame.unionByName, parts)
    counts = [F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in COMPANY_DOCUMENTS]
    return union.groupBy("company_id").agg(
        *counts,
        F.count_if(F.col("expiry") == "expired").alias("expired_count"),
        F.count_if(F.col("expiry") == "expiring").alias("expiring_count"),
    )


def _pending(checklist: Column) -> Column:
    return F.filter(checklist, lambda item: ~F.coalesce(item["checked"], F.lit(False)))


def checklist_stats(tenders: DataFrame) -> DataFrame:
    """Number of checklist items and of those not ticked; a missing tick counts as not ticked."""
    checklist = F.coalesce(F.col("checklist"), F.array().cast("array<struct<label:string,checked:boolean>>"))
    return tenders.withColumn("checklist_total", F.size(checklist).cast("long")).withColumn(
        "checklist_pending", F.size(_pending(checklist)).cast("long")
    )


def tender_inputs(entities: dict[str, DataFrame], as_of: str) -> DataFrame:
    """One row per tender with every count the audit looks at."""
    regulations = entities["bridge"].groupBy(F.col("licitacion_id").alias("id")).agg(F.count(F.lit(1)).alias("regulations_count"))
    letterheads = entities["letterheads"].select(F.col("id").alias("company_letterhead_id"), F.col("title").alias("letterhead_title"))
    joined = (
        checklist_stats(entities["tenders"])
        .join(regulations, "id", "left")
        .join(company_documents(entities, as_of), "company_id", "left")
        .join(letterheads, "company_letterhead_id", "left")
    )
    zero_filled = ["regulations_count", "expired_count", "expiring_count"] + [f"{k}_count" for k in COMPANY_DOCUMENTS]
    return joined.fillna(0, zero_filled)


def _check_list() -> Column:
    def check(no: int, label: str, passed: Column, good: Column, bad: Column | str) -> Column:
        detail = F.when(passed, good).otherwise(bad if isinstance(bad, Column) else F.lit(bad))
        return F.struct(
            F.lit(no).cast("long").alias("check_no"), F.lit(label).alias("label"), passed.alias("passed"), detail.alias("detail")
        )

    def counted(no: int, label: str, column: str, noun: str, missing: str) -> Column:
        n = F.col(column)
        return check(no, label, n > 0, F.concat(n.cast("string"), F.lit(" " + noun)), missing)

    name = F.coalesce(F.nullif(F.col("bases_document_original_name"), F.lit("")), F.lit("Sin bases adjuntas"))
    pending = F.col("checklist_pending")
    title = F.coalesce(F.nullif(F.col("letterhead_title"), F.lit("")), F.lit("No seleccionada."))
    return F.array(
        check(1, "Bases cargadas", F.coalesce(F.col("bases_document_path") != "", F.lit(False)), name, name),
        check(
            2,
            "Checklist revisado",
            pending == 0,
            F.lit("Todos los puntos iniciales aparecen marcados."),
            F.concat(F.lit("Hay "), pending.cast("string"), F.lit(" punto(s) pendientes en checklist.")),
        ),
        counted(3, "Regulaciones asignadas", "regulations_count", "regulación(es) vinculadas.", "No hay regulaciones vinculadas."),
        check(4, "Hoja membretada seleccionada", F.col("letterhead_title").isNotNull(), title, title),
        counted(5, "Actas corporativas", "deeds_count", "acta(s).", "No hay actas registradas."),
        counted(6, "Estados financieros", "statements_count", "estado(s).", "No hay estados financieros."),
        counted(7, "Declaraciones de impuestos", "declarations_count", "declaración(es).", "No hay declaraciones."),
        counted(8, "Opiniones de cumplimiento", "opinions_count", "opinión(es).", "No hay opiniones de cumplimiento."),
    )


def tender_checks(entities: dict[str, DataFrame], as_of: str) -> DataFrame:
    """One row per tender and check."""
    return (
        tender_inputs(entities, as_of)
        .select(F.col("id").alias("tender_id"), F.inline(_check_list()))
        .select("tender_id", "check_no", "label", "passed", "detail")
    )


def company_findings(opinions: DataFrame, as_of: str) -> DataFrame:
    """What the opinions of a company add to the report of each of its tenders: one row per opinion, not per tender."""
    days = F.col("days_to_expiry")
    return with_expiry(opinions, as_of).where(F.col("expiry_status") != "ok").select(
        "company_id",
        F.when(days < 0, "issue").otherwise("warning").alias("kind"),
        F.col("id").alias("pos"),
        F.when(days < 0, F.concat(F.lit("Opinión "), "tipo", F.lit(" vencida desde hace "), (-days).cast("string"), F.lit(" día(s).")))
        .otherwise(F.concat(F.lit("Opinión "), "tipo", F.lit(" por vencer en "), days.cast("string"), F.lit(" día(s).")))
        .alias("message"),
    )


def tender_issues(entities: dict[str, DataFrame], as_of: str) -> DataFrame:
    """Issues and warnings in report order: checks, opinions, checklist items.

    The order is carried by ``(section, pos)`` instead of a running number, so no sort over a tender is needed.
    """
    failed = (
        tender_checks(entities, as_of)
        .where(~F.col("passed"))
        .select("tender_id", F.lit("issue").alias("kind"), F.lit(0).alias("section"), F.col("check_no").alias("pos"),
                F.concat_ws(": ", "label", "detail").alias("message"))
    )
    # Only opinions that raise a message meet the tenders; the join is skew-split by adaptive execution. Where a company has
    # very many of both, keep `company_findings` and join it when a report is read.
    opinions = (
        entities["tenders"].select(F.col("id").alias("tender_id"), "company_id").join(company_findings(entities["opinions"], as_of), "company_id")
        .select("tender_id", "kind", F.lit(1).alias("section"), "pos", "message")
    )
    items = (
        entities["tenders"].select(F.col("id").alias("tender_id"), F.posexplode("checklist").alias("pos", "item"))
        .where(~F.coalesce(F.col("item.checked"), F.lit(False)))
        .select("tender_id", F.lit("warning").alias("kind"), F.lit(2).alias("section"), F.col("pos").cast("long").alias("pos"),
                F.concat(F.lit("Checklist pendiente: "), F.coalesce("item.label", F.lit("Punto sin descripción"))).alias("message"))
    )
    return union_findings(failed, opinions, items)


def union_findings(*parts: DataFrame) -> DataFrame:
    """Ordered union: ``rank`` 0 for issues, 1 for warnings; full order is (rank, section, pos)."""
    union = reduce(DataFrame.unionByName, parts)
    return union.withColumn("rank", F.when(F.col("kind") == "issue", 0).otherwise(1))


def tender_findings(issues: DataFrame) -> DataFrame:
    """Both finding shapes side by side; the pairing of the two lists is the row itself."""
    critical = F.col("kind") == "issue"

    def pick(if_critical: str, otherwise: str) -> Column:
        return F.when(critical, if_critical).otherwise(otherwise)

    return issues.select(
        "tender_id", "rank", "section", "pos",
        pick("critical", "warning").alias("severity"),
        pick("cumplimiento", "seguimiento").alias("category"),
        pick("CHK-CRIT", "CHK-WARN").alias("rule_code"),
        "message",
        pick("Cumplimiento general", "Seguimiento operativo").alias("documento"),
        pick("Alta", "Media").alias("gravedad"),
        F.col("message").alias("error"),
        pick(SOLUTION_CRITICAL, SOLUTION_WARNING).alias("propuesta_solucion"),
    )


def traffic_light(issues: Column, warnings: Column, override: Column | None = None) -> Column:
    light = F.when(issues > 0, "red").when(warnings > 0, "yellow").otherwise("green")
    return light if override is None else F.when(override, "green").otherwise(light)


def audit_tenders(entities: dict[str, DataFrame], as_of: str) -> DataFrame:
    """Report row per tender: summary, inputs and the eight checks.

    Findings stay in their own table (:func:`tender_findings`); the counts here come from company-level aggregates, so
    tenders and opinions are never paired up just to be counted.
    """
    checks = _check_list()
    passed = F.size(F.filter("checks", lambda c: c["passed"])).cast("long")
    counted = tender_inputs(entities, as_of).withColumn("checks", checks).withColumn("checks_passed", passed)
    issues = F.lit(8) - F.col("checks_passed") + F.col("expired_count")
    warnings = F.col("expiring_count") + F.col("checklist_pending")
    return counted.select(
        F.col("id").alias("tender_id"), "user_id", "company_id",
        F.lit(8).cast("long").alias("checks_total"), "checks_passed",
        issues.alias("issues_count"), warnings.alias("warnings_count"), (issues + warnings).alias("structured_findings_count"),
        traffic_light(issues, warnings).alias("traffic_light"),
        F.coalesce(F.col("bases_document_path") != "", F.lit(False)).alias("bases_loaded"),
        "checklist_total", "checklist_pending", "regulations_count",
        F.col("deeds_count").alias("actas"), F.col("opinions_count").alias("opiniones"),
        F.col("statements_count").alias("estados_financieros"), F.col("declarations_count").alias("declaraciones"),
        "checks",
    )


def report_summary(checks: DataFrame, issues: DataFrame) -> DataFrame:
    """Summary counts from already written check and issue rows."""
    of_checks = checks.groupBy("tender_id").agg(
        F.count(F.lit(1)).alias("checks_total"), F.count_if("passed").alias("checks_passed")
    )
    of_issues = issues.groupBy("tender_id").agg(
        F.count_if(F.col("kind") == "issue").alias("issues_count"),
        F.count_if(F.col("kind") == "warning").alias("warnings_count"),
        F.count(F.lit(1)).alias("structured_findings_count"),
    )
    joined = of_checks.join(of_issues, "tender_id", "left").fillna(0)
    return joined.withColumn("traffic_light", traffic_light(F.col("issues_count"), F.col("warnings_count")))


def target_status(reports: DataFrame, first_run: bool) -> DataFrame:
    """State after an audit. A first audit ignores overrides; a repeated one honours them and shows green.

    ``report_light`` keeps the light of the report itself.
    """
    override = F.lit(False) if first_run else F.coalesce(F.col("override_applied"), F.lit(False))
    ready = (F.col("traffic_light") == "green") | override
    return (
        reports.withColumn("report_light", F.col("traffic_light"))
        .withColumn("target_status", F.when(ready, "ready_for_export").otherwise("reviewed"))
        .withColumn("traffic_light", F.when(override, "green").otherwise(F.col("traffic_light")))
        .withColumn("ready_at_set", F.col("target_status") == "ready_for_export")
    )


def replace_findings(current: DataFrame, audited: DataFrame, incoming: DataFrame) -> DataFrame:
    """Findings table after an audit: all rows of audited validations are replaced.

    ``audited`` names the validations, including those whose new report has no finding.
    """
    columns = ["proposal_validation_id", "severity", "category", "rule_code", "message", "status", "resolution_note"]
    kept = current.join(audited.select("proposal_validation_id"), "proposal_validation_id", "left_anti")
    fresh = incoming.select(
        "proposal_validation_id",
        F.coalesce("severity", F.lit("info")).alias("severity"),
        F.coalesce("category", F.lit("general")).alias("category"),
        F.coalesce("rule_code", F.lit("GEN-000")).alias("rule_code"),
        F.coalesce("message", F.lit("Hallazgo sin detalle.")).alias("message"),
        F.lit("open").alias("status"),
        F.col("propuesta_solucion").alias("resolution_note"),
    )
    return kept.select(*columns).unionByName(fresh)


def zip_by_index(left: DataFrame, right: DataFrame, key: str, left_list: str, right_list: str) -> DataFrame:
    """Pair the members of two list columns by position; the left list decides the length."""
    a = left.select(key, F.posexplode(left_list).alias("pos", "left_item"))
    b = right.select(key, F.posexplode(right_list).alias("pos", "right_item"))
    return a.join(b, [key, "pos"], "left")


def _severity_word(severity: Column) -> Column:
    return F.when(severity == "critical", "Alta").when(severity == "warning", "Media").otherwise("Baja")


def _suggestion(severity: Column) -> Column:
    return (
        F.when(severity == "critical", SUGGESTION["critical"]).when(severity == "warning", SUGGESTION["warning"]).otherwise(SUGGESTION["info"])
    )


def export_rows(validations: DataFrame, findings: DataFrame, report_rows: DataFrame) -> DataFrame:
    """Four export columns per finding. Structured report rows win over persisted findings, those over plain messages.

    The choice is made per validation from two aggregated flags, so each candidate table is read once.
    """
    ids = validations.select(F.col("id").alias("validation_id"))
    structured = report_rows.where("kind = 'structured'").select("validation_id").distinct().withColumn("has_structured", F.lit(True))
    persisted = findings.select(F.col("proposal_validation_id").alias("validation_id")).distinct().withColumn("has_persisted", F.lit(True))
    source = ids.join(structured, "validation_id", "left").join(persisted, "validation_id", "left").select(
        "validation_id",
        F.when(F.col("has_structured"), "structured").when(F.col("has_persisted"), "persisted").otherwise("legacy").alias("origin"),
    )
    severity = F.when(F.col("kind") == "issue", "critical").otherwise("warning")
    from_reports = report_rows.select(
        "validation_id",
        F.when(F.col("kind") == "structured", "structured").otherwise("legacy").alias("origin"),
        F.when(F.col("kind") == "warning", 1).otherwise(0).cast("long").alias("part"),
        F.col("pos").cast("long").alias("pos"),
        F.when(F.col("kind") == "structured", F.coalesce("documento", F.lit("N/A")))
        .when(F.col("kind") == "issue", "LEGACY · cumplimiento").otherwise("LEGACY · seguimiento").alias("documento"),
        F.when(F.col("kind") == "structured", F.coalesce("gravedad", F.lit("Baja"))).otherwise(_severity_word(severity)).alias("gravedad"),
        F.coalesce("error", F.lit("")).alias("error"),
        F.when(F.col("kind") == "structured", F.coalesce("propuesta_solucion", F.lit(SUGGESTION["info"])))
        .otherwise(_suggestion(severity)).alias("propuesta_solucion"),
    )
    from_findings = findings.select(
        F.col("proposal_validation_id").alias("validation_id"),
        F.lit("persisted").alias("origin"),
        F.lit(0).cast("long").alias("part"),
        F.col("id").alias("pos"),
        F.concat_ws(" · ", "rule_code", "category").alias("documento"),
        _severity_word(F.col("severity")).alias("gravedad"),
        F.col("message").alias("error"),
        F.coalesce(F.nullif(F.col("resolution_note"), F.lit("")), _suggestion(F.col("severity"))).alias("propuesta_solucion"),
    )
    return from_reports.unionByName(from_findings).join(source, ["validation_id", "origin"])


def split_findings(validations: DataFrame, findings: DataFrame, report_rows: DataFrame) -> DataFrame:
    """Critical and warning findings per validation: persisted ones, else the plain report messages."""
    ids = validations.select(F.col("id").alias("validation_id"))
    stored = findings.withColumnRenamed("proposal_validation_id", "validation_id")
    with_rows = ids.join(stored.select("validation_id"), "validation_id", "left_semi")
    persisted = (
        stored.where(F.col("severity").isin("critical", "warning"))
        .join(with_rows, "validation_id", "left_semi")
        .select("validation_id", "severity", F.col("id").cast("string").alias("finding_id"), "rule_code", "category", "message")
    )
    messages = report_rows.where(F.col("kind").isin("issue", "warning")).select(
        "validation_id",
        F.when(F.col("kind") == "issue", "critical").otherwise("warning").alias("severity"),
        F.concat(F.when(F.col("kind") == "issue", "legacy-critical-").otherwise("legacy-warning-"), F.col("pos").cast("string")).alias("finding_id"),
        F.lit("LEGACY").alias("rule_code"),
        F.when(F.col("kind") == "issue", "cumplimiento").otherwise("seguimiento").alias("category"),
        F.col("error").alias("message"),
    )
    legacy = messages.join(ids, "validation_id", "left_semi").join(stored.select("validation_id"), "validation_id", "left_anti")
    return persisted.unionByName(legacy)


def export_eligible(validations: DataFrame) -> DataFrame:
    return validations.where((F.col("status") == "ready_for_export") | F.coalesce(F.col("override_applied"), F.lit(False)))


def approval_eligible(tenders: DataFrame, validations: DataFrame) -> DataFrame:
    """Tenders that may be sent for approval: not committed, and their validation is exportable."""
    ready = export_eligible(validations).select(F.col("licitacion_id").alias("id"))
    return editable(tenders).join(ready, "id", "left_semi")


def editable(tenders: DataFrame) -> DataFrame:
    return tenders.where(F.col("status") != "committed")


def initial_checklist(tenders: DataFrame, bridge: DataFrame) -> DataFrame:
    """The three starting checklist items, derived from the assigned regulations and the rules file."""
    assigned = bridge.select(F.col("licitacion_id").alias("id")).distinct().withColumn("_assigned", F.lit(True))

    def item(label: str, checked: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), checked.alias("checked"))

    return (
        tenders.join(assigned, "id", "left")
        .withColumn(
            "checklist",
            F.array(
                item("Empresa seleccionada", F.lit(True)),
                item("Regulaciones asignadas", F.col("_assigned").isNotNull()),
                item("Bases cargadas", F.coalesce(F.col("bases_document_path") != "", F.lit(False))),
            ),
        )
        .drop("_assigned")
    )


def apply_override(validations: DataFrame, overrides: DataFrame) -> DataFrame:
    """Validations after override requests; a reason needs ten characters, an accepted one sets green and ready."""
    usable = overrides.select(F.col("validation_id").alias("id"), F.col("reason").alias("_reason"))
    accepted = F.coalesce(F.length("_reason") >= 10, F.lit(False))
    return (
        validations.join(usable, "id", "left")
        .withColumn("override_error", F.when(F.col("_reason").isNotNull() & ~accepted, "override_reason:min"))
        .withColumn("override_applied", F.when(accepted, True).otherwise(F.col("override_applied")))
        .withColumn("override_reason", F.when(accepted, F.col("_reason")).otherwise(F.col("override_reason")))
        .withColumn("traffic_light", F.when(accepted, "green").otherwise(F.col("traffic_light")))
        .withColumn("status", F.when(accepted, "ready_for_export").otherwise(F.col("status")))
        .drop("_reason")
    )


def approve(tenders: DataFrame, notes: DataFrame) -> DataFrame:
    """Outcome of approval requests: a note of 10 to 1000 characters, and only from the state before commitment."""
    asked = tenders.join(notes.select(F.col("tender_id").alias("id"), "note"), "id")
    n = F.coalesce(F.length("note"), F.lit(0))
    outcome = (
        F.when(F.col("status") == "committed", "already_committed")
        .when(n < 10, "note_too_short")
        .when(n > 1000, "note_too_long")
        .when(F.col("status") != "sent_for_approval", "invalid_transition")
        .otherwise("committed")
    )
    return asked.withColumn("outcome", outcome).withColumn(
        "next_status", F.when(F.col("outcome") == "committed", "committed").otherwise(F.col("status"))
    )


def export_summary(validations: DataFrame, tenders: DataFrame, companies: DataFrame, findings: DataFrame) -> DataFrame:
    """Summary line of an export bundle."""
    counts = findings.groupBy(F.col("proposal_validation_id").alias("id")).agg(
        F.count(F.lit(1)).alias("findings_count"),
        F.count_if(F.col("severity") == "critical").alias("critical_findings_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_findings_count"),
    )
    tender = tenders.select(F.col("id").alias("licitacion_id"), F.col("title").alias("licitacion"), "company_id")
    company = companies.select(F.col("id").alias("company_id"), F.col("nombre").alias("empresa"))
    return (
        validations.join(tender, "licitacion_id", "left")
        .join(company, "company_id", "left")
        .join(counts, "id", "left")
        .fillna(0, ["findings_count", "critical_findings_count", "warning_findings_count"])
        .select(
            F.col("id").alias("validation_id"), "licitacion", "empresa", "traffic_light", "override_applied", "override_reason",
            "findings_count", "critical_findings_count", "warning_findings_count",
        )
    )
