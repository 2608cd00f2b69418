"""Resolving deed fields from several competing sources.

Works on a long candidate table ``(doc_id, source_key, source, stage_order, field, value, value_json, page_number)``, unique
per (doc_id, field, source_key). Scalar fields use ``value``, list fields hold JSON in ``value_json``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.dates import normalize_date
from dossier.functions.text import strip
from dossier.functions.values import (
    clean,
    clean_list,
    clean_structs,
    is_meaningful,
    is_meaningful_list,
    is_meaningful_structs,
    sanitize_act,
    sanitize_field,
)
from dossier.operators.extraction import ARRAY_FIELDS, DATE_FIELDS, DEED_FIELDS, LIST_FIELDS, SCALAR_FIELDS, STRUCT_FIELDS

# Confidence rules.
SOURCE_BASE = {"regex": 0.45, "llm": 0.70, "llm_retry": 0.78, "vision": 0.76, "vision_first": 0.82}
OTHER_BASE = 0.40
VISION_BONUS = 0.10
VISION_FIELDS = [f for f in SCALAR_FIELDS if f != "acto"]
FRONT_FIELDS = ["fecha_registro", "escritura_numero", "libro_numero", "acto"]
DATE_BONUS = 0.08
LENGTH_BONUS = 0.04
CONFIDENCE_CAP = 0.99
MARGIN = 0.05
# Limits of the second look at page images.
MIN_TEXT_CHARS = 7000
MIN_MISSING_FIELDS = 3
FRONT_MIN_CONFIDENCE = 0.85
REGISTRY_AS_ACT = r"(?iuU)registro\s+p[uú]blico\s+de\s+comercio"
# Query per missing field.
RETRY_QUERIES = {
    "fecha_registro": "fecha de registro del acta",
    "rpc_folio": "folio mercantil registro publico de comercio",
    "rpc_fecha_inscripcion": "fecha de inscripcion en registro publico de comercio",
    "rpc_lugar": "lugar de registro publico de comercio",
    "notaria_numero": "numero de notaria",
    "notaria_lugar": "lugar de notaria",
    "notario_nombre": "nombre completo del notario",
    "escritura_numero": "numero de escritura o instrumento",
    "libro_numero": "numero de libro",
    "fecha_inscripcion": "fecha de inscripcion del acto",
    "acto": "acto juridico",
    "apoderados": "apoderados legales nombre completo ine poder facultades otorgadas",
    "participacion_accionaria": "participacion accionaria socios y porcentajes",
}


def _struct_type(field: str) -> str:
    return "array<struct<" + ",".join(f"{f}:string" for f in STRUCT_FIELDS[field]) + ">>"


def has_value(field: Column, value: Column, value_json: Column) -> Column:
    """Meaningful test by field kind; JSON is only parsed for list fields."""
    test = F.when(field.isin(LIST_FIELDS), is_meaningful_list(F.from_json(value_json, "array<string>")))
    for name, members in STRUCT_FIELDS.items():
        test = test.when(field == name, is_meaningful_structs(F.from_json(value_json, _struct_type(name)), members))
    return test.otherwise(is_meaningful(value))


def confidence(field: Column, source: Column, value: Column) -> Column:
    """Confidence of a meaningful value, summed in the order base, source bonus, quality bonus."""
    base = F.lit(OTHER_BASE)
    for name, score in SOURCE_BASE.items():
        base = F.when(source == name, score).otherwise(base)
    raised = ((source == "vision") & field.isin(VISION_FIELDS)) | ((source == "vision_first") & field.isin(FRONT_FIELDS))
    base = base + F.when(raised, VISION_BONUS).otherwise(0.0)
    scalar = ~field.isin(ARRAY_FIELDS)
    iso = scalar & field.isin(DATE_FIELDS) & F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}\n?\z"), F.lit(False))
    long = scalar & F.coalesce(F.length(strip(value)) >= 4, F.lit(False))
    quality = F.when(iso, DATE_BONUS).otherwise(0.0) + F.when(long, LENGTH_BONUS).otherwise(0.0)
    return F.least(F.lit(CONFIDENCE_CAP), base + quality)


def score_candidates(candidates: DataFrame) -> DataFrame:
    """Adds ``meaningful`` and ``confidence`` (0 without a value)."""
    judged = candidates.withColumn("meaningful", has_value(F.col("field"), F.col("value"), F.col("value_json")))
    score = confidence(F.col("field"), F.col("source"), F.col("value"))
    return judged.withColumn("confidence", F.when(F.col("meaningful"), score).otherwise(0.0))


_PAYLOAD = ["value", "value_json", "source", "source_key"]


def merge_candidates(scored: DataFrame) -> DataFrame:
    """Winning value per document and field, taking candidates in stage order.

    A later scalar replaces the current one only with a confidence at least ``MARGIN`` higher; lists only fill gaps. The
    outcome depends on the order, so this is a fold. Only the first candidate of each confidence level can ever win a
    step (a later equal one would have to beat a value that is already as good), so candidates are first reduced to one
    per level with map-side combining; the fold then sees a few dozen entries at most, however many candidates there are.
    """
    order = F.struct("stage_order", "source_key")
    levels = (
        scored.where("meaningful")
        .groupBy("doc_id", "field", "confidence")
        .agg(F.min(F.struct(order.alias("order"), *_PAYLOAD)).alias("first"))
    )
    entries = F.array_sort(F.collect_list(F.struct(F.col("first.order").alias("order"), "confidence", *[F.col(f"first.{c}").alias(c) for c in _PAYLOAD])))
    grouped = levels.groupBy("doc_id", "field").agg(entries.alias("entries"))
    return grouped.withColumn("w", _fold(F.col("entries"))).select("doc_id", "field", *[F.col(f"w.{c}").alias(c) for c in _PAYLOAD], F.col("w.confidence").alias("confidence"))


def to_wide(merged: DataFrame) -> DataFrame:
    """One row per document with a column per field."""
    columns = []
    for field in DEED_FIELDS:
        source = "value_json" if field in ARRAY_FIELDS else "value"
        columns.append(F.max(F.when(F.col("field") == field, F.col(source))).alias(field))
    return merged.groupBy("doc_id").agg(*columns)


def missing_required(documents: DataFrame, merged: DataFrame) -> DataFrame:
    """Required fields without a value, with one entry per gap inside the list of authorised persons."""
    wide = documents.select("doc_id").distinct().join(to_wide(merged), "doc_id", "left")
    scalars = F.array_compact(F.array(*[F.when(~is_meaningful(F.col(f)), F.lit(f)) for f in SCALAR_FIELDS_REQUIRED]))
    people = F.from_json("apoderados", _struct_type("apoderados"))
    named = wide.withColumn("people", people).withColumn("holders", F.from_json("participacion_accionaria", _struct_type("participacion_accionaria")))

    def gaps(person: Column, i: Column) -> Column:
        prefix = F.concat(F.lit("apoderados."), (i + 1).cast("string"), F.lit("."))
        members = STRUCT_FIELDS["apoderados"]
        return F.array_compact(F.array(*[F.when(~is_meaningful(person[m]), F.concat(prefix, F.lit(m))) for m in members]))

    none = F.array().cast("array<string>")
    of_people = F.when(F.coalesce(F.size("people"), F.lit(0)) > 0, F.flatten(F.transform("people", gaps))).otherwise(F.array(F.lit("apoderados")))
    of_holders = F.when(F.coalesce(F.size("holders"), F.lit(0)) > 0, none).otherwise(F.array(F.lit("participacion_accionaria")))
    return named.select("doc_id", F.array_distinct(F.concat(scalars, of_people, of_holders)).alias("missing"))


# Required scalar fields in report order.
SCALAR_FIELDS_REQUIRED = [
    "fecha_registro",
    "rpc_folio",
    "rpc_fecha_inscripcion",
    "rpc_lugar",
    "notaria_numero",
    "notaria_lugar",
    "notario_nombre",
    "escritura_numero",
    "libro_numero",
    "fecha_inscripcion",
    "acto",
]


def top_fields(missing: Column) -> Column:
    return F.array_distinct(F.transform(missing, lambda m: F.split_part(m, F.lit("."), F.lit(1))))


def tail_vision_trigger(documents: DataFrame) -> DataFrame:
    """Should the last page images be read? Needs ``missing``, ``method``, ``chars`` and ``pages_available``."""
    targets = F.filter(top_fields(F.col("missing")), lambda f: f.isin(SCALAR_FIELDS_REQUIRED))
    counted = documents.withColumn("missing_targets", targets)
    chars = F.coalesce("chars", F.lit(0))
    causes = F.array_compact(
        F.array(
            F.when(F.col("method") == "ocr", "ocr_method_detected"),
            F.when((chars > 0) & (chars < MIN_TEXT_CHARS), "low_text_volume"),
            F.when(F.size("missing_targets") >= MIN_MISSING_FIELDS, "high_missing_target_fields"),
        )
    )
    open_case = (F.size("missing_targets") > 0) & (F.coalesce("pages_available", F.lit(0)) > 0)
    reasons = (
        F.when(F.size("missing_targets") == 0, F.array(F.lit("no_vision_target_fields_missing")))
        .when(F.coalesce("pages_available", F.lit(0)) == 0, F.array(F.lit("no_vision_pages_available")))
        .when(F.size(causes) == 0, F.array(F.lit("quality_threshold_not_met")))
        .otherwise(causes)
    )
    return counted.withColumn("enabled", open_case & (F.size(causes) > 0)).withColumn("reasons", reasons)


def front_vision_targets(documents: DataFrame, merged: DataFrame) -> DataFrame:
    """Fields of the front pages that need a second look, one row each."""
    front = merged.where(F.col("field").isin(FRONT_FIELDS)).select("doc_id", "field", "value", "source", "confidence")
    wanted = documents.select("doc_id", F.explode(F.array(*[F.lit(f) for f in FRONT_FIELDS])).alias("field"))
    joined = wanted.join(front, ["doc_id", "field"], "left")
    weak = ~is_meaningful(F.col("value")) | (F.coalesce("confidence", F.lit(0.0)) < FRONT_MIN_CONFIDENCE) | (F.col("source") == "vision")
    registry = (F.col("field") == "acto") & F.col("value").rlike(REGISTRY_AS_ACT)
    return joined.where(weak | F.coalesce(registry, F.lit(False))).select("doc_id", "field")


def front_vision_trigger(documents: DataFrame, merged: DataFrame) -> DataFrame:
    """Trigger per document with target fields in fixed order. Needs ``front_pages`` (number of front images)."""
    hits = front_vision_targets(documents, merged).groupBy("doc_id").agg(F.collect_set("field").alias("hits"))
    targets = F.filter(F.array(*[F.lit(f) for f in FRONT_FIELDS]), lambda f: F.array_contains("hits", f))
    joined = documents.join(hits, "doc_id", "left").withColumn("target_fields", F.coalesce(targets, F.array().cast("array<string>")))
    some = F.size("target_fields") > 0
    return (
        joined.withColumn("enabled", some & (F.coalesce("front_pages", F.lit(0)) > 0))
        .withColumn("reasons", F.when(some, "front_page_fields_need_confirmation").otherwise("front_page_fields_already_satisfied"))
        .drop("hits")
    )


def front_pages_needed(readings: DataFrame, targets: DataFrame) -> DataFrame:
    """Front pages that are read before every target field is satisfied.

    ``readings``: ``(doc_id, front_order, field, value)`` for every page and target; pages are read in ``front_order``. A field is
    satisfied by its first meaningful value; an act that only names the registry is not, and a later act replaces it.
    The stopping page is the last of the first hits, moved on to the next good act if need be; it takes one aggregation.
    """
    good = is_meaningful(F.col("value"))
    registry = F.coalesce(F.col("value").rlike(REGISTRY_AS_ACT), F.lit(False))
    read = F.struct("front_order", "field", good.alias("good"), (good & ((F.col("field") != "acto") | ~registry)).alias("final"))
    both = readings.select("doc_id", read.alias("read"), F.lit(None).cast("string").alias("target")).unionByName(
        targets.select("doc_id", F.col("field").alias("target")), allowMissingColumns=True
    )
    # A document has a few front pages and at most four targets, so all of them fit in one row.
    per_doc = both.groupBy("doc_id").agg(F.collect_list("read").alias("reads"), F.collect_set("target").alias("targets")).where(F.size("targets") > 0)

    def orders(test) -> Column:
        return F.transform(F.filter("reads", test), lambda r: r["front_order"])

    first = F.transform("targets", lambda t: F.array_min(orders(lambda r: (r["field"] == t) & r["good"])))
    seen = per_doc.withColumn("first", first).withColumn("all_seen", F.when(~F.exists("first", lambda o: o.isNull()), F.array_max("first")))
    acts = F.filter("reads", lambda r: (r["field"] == "acto") & r["good"] & (r["front_order"] <= F.col("all_seen")))
    last_act = F.array_max(F.transform(acts, lambda r: F.struct(r["front_order"].alias("o"), r["final"].alias("final"))))["final"]
    next_act = F.array_min(orders(lambda r: (r["field"] == "acto") & r["final"] & (r["front_order"] > F.col("all_seen"))))
    stop = F.when(~F.array_contains("targets", "acto") | last_act, F.col("all_seen")).otherwise(next_act)
    pages = seen.withColumn("stop", stop).select("doc_id", "stop", F.explode(F.array_distinct(orders(lambda r: F.lit(True)))).alias("front_order"))
    return pages.where(F.col("stop").isNull() | (F.col("front_order") <= F.col("stop"))).select("doc_id", "front_order")


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Rank per document and field by confidence, then source key. A field has one candidate per source key."""
    window = Window.partitionBy("doc_id", "field").orderBy(F.desc("confidence"), F.asc("source_key"))
    return scored.withColumn("rank", F.row_number().over(window))


def recovery_candidates(merged: DataFrame, scored: DataFrame) -> DataFrame:
    """Every usable candidate with its rank and whether it is the selected value (same source, equal value)."""
    chosen = merged.select("doc_id", "field", F.col("source").alias("_source"), F.col("value").alias("_value"), F.col("value_json").alias("_json"))
    ranked = rank_candidates(scored.where("meaningful")).join(chosen, ["doc_id", "field"], "left")
    same = F.when(F.col("field").isin(ARRAY_FIELDS), F.col("value_json") == F.col("_json")).otherwise(F.col("value") == F.col("_value"))
    selected = F.coalesce((F.col("source") == F.col("_source")) & same, F.lit(False))
    return ranked.withColumn("selected", selected).drop("_source", "_value", "_json")


def review_fields(scored: DataFrame) -> DataFrame:
    """Scalar fields on which at least two non-pattern sources disagree.

    Two different values exist exactly when the smallest differs from the largest, so no distinct count is needed.
    """
    usable = scored.where(F.col("meaningful") & (F.col("source") != "regex") & ~F.col("field").isin(ARRAY_FIELDS))
    canonical = strip(F.lower("value"))
    grouped = usable.groupBy("doc_id", "field").agg(
        F.count(F.lit(1)).alias("candidates"), F.min(canonical).alias("_low"), F.max(canonical).alias("_high")
    )
    return grouped.where((F.col("candidates") >= 2) & (F.col("_low") != F.col("_high"))).select("doc_id", "field", "candidates")


def apply_decisions(merged: DataFrame, scored: DataFrame, decisions: DataFrame) -> DataFrame:
    """Merged fields after review decisions; a decision counts only if its source has a usable value for the field."""
    usable = scored.where("meaningful").select("doc_id", "field", *_PAYLOAD, "confidence")
    applied = decisions.where(F.col("source_key") != "").select("doc_id", "field", "source_key", "reason").join(
        usable, ["doc_id", "field", "source_key"]
    )
    new = applied.select("doc_id", "field", *[F.col(c).alias(f"_{c}") for c in [*_PAYLOAD, "confidence"]], "reason", F.lit(True).alias("decided"))
    joined = merged.join(new, ["doc_id", "field"], "full_outer")
    decided = F.coalesce("decided", F.lit(False))
    # Confidence of the outcome is that of the value and the source it came from.
    return joined.select(
        "doc_id", "field", *[F.when(decided, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in [*_PAYLOAD, "confidence"]],
        decided.alias("decided"), "reason",
    )


def regex_fallback(merged: DataFrame, regex_scored: DataFrame) -> DataFrame:
    """Fill fields that are still empty from the pattern extraction."""
    have = merged.select("doc_id", "field")
    fill = regex_scored.where("meaningful").join(have, ["doc_id", "field"], "left_anti")
    added = fill.select("doc_id", "field", *_PAYLOAD, "confidence", F.lit(True).alias("fallback"))
    return merged.withColumn("fallback", F.lit(False)).unionByName(added, allowMissingColumns=True)


def provenance(scored: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per document: the trail of steps that contributed, and maps of source and confidence per field."""
    tried = scored.groupBy("doc_id").agg(
        F.bool_or(F.col("source") == "llm").alias("llm"),
        F.bool_or(F.col("source") == "llm_retry").alias("llm_retry"),
        F.bool_or(F.col("source") == "vision").alias("vision"),
        F.bool_or((F.col("source") == "vision_first") & F.col("meaningful")).alias("vision_first"),
    )
    kept = resolved.groupBy("doc_id").agg(
        F.bool_or(F.coalesce("decided", F.lit(False))).alias("adjudication"),
        F.bool_or(F.coalesce("fallback", F.lit(False))).alias("regex_fallback"),
        F.map_from_entries(F.collect_list(F.struct("field", "source"))).alias("field_sources"),
        F.map_from_entries(F.collect_list(F.struct("field", "confidence"))).alias("field_confidence"),
    )
    steps = ["llm", "llm_retry", "vision", "vision_first", "adjudication", "regex_fallback"]
    joined = tried.join(kept, "doc_id", "full_outer")
    trail = F.concat_ws("+", F.lit("base"), *[F.when(F.coalesce(F.col(s), F.lit(False)), F.lit(s)) for s in steps])
    return joined.select("doc_id", trail.alias("extraction_source"), "field_sources", "field_confidence")


def retry_queries(missing: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Focused query per missing top-level field; ``key`` names the document."""
    texts = F.create_map(*[F.lit(x) for x in chain.from_iterable(RETRY_QUERIES.items())])
    return (
        missing.select(*key, F.explode(top_fields(F.col("missing"))).alias("top"))
        .select(*key, F.concat(F.lit("retry_"), "top").alias("query_key"), F.element_at(texts, F.col("top")).alias("query_text"))
        .where(F.col("query_text").isNotNull())
    )


def apply_to_deeds(deeds: DataFrame, wide: DataFrame) -> DataFrame:
    """Write resolved values back: scalars replace when present, lists replace when not empty; ``changed`` names them."""
    incoming = wide.select("doc_id", *[F.col(f).alias(f"_{f}") for f in DEED_FIELDS])
    joined = deeds.join(incoming, "doc_id", "left")
    changed = []
    for field in DEED_FIELDS:
        new = F.col(f"_{field}")
        if field in ARRAY_FIELDS:
            usable = F.when(F.coalesce(F.json_array_length(new), F.lit(0)) > 0, new)
        else:
            usable = sanitize_act(clean(new), on_save=True) if field == "acto" else clean(new)
        joined = joined.withColumn(f"_{field}", usable)
        changed.append(F.when(F.col(f"_{field}").isNotNull() & ~F.col(f"_{field}").eqNullSafe(F.col(field)), F.lit(field)))
    joined = joined.withColumn("changed", F.array_compact(F.array(*changed)))
    for field in DEED_FIELDS:
        joined = joined.withColumn(field, F.coalesce(F.col(f"_{field}"), F.col(field)))
    return joined.drop(*[f"_{f}" for f in DEED_FIELDS])


def fill_when_empty(documents: DataFrame, extracted: DataFrame, fields: list[str]) -> DataFrame:
    """Write extracted opinion or regulation fields only where the record has none."""
    incoming = extracted.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in fields])
    joined = documents.join(incoming, "doc_id", "left")
    for field in fields:
        text = F.col(field).cast("string")
        empty = F.col(field).isNull() | (text == "") | (text == "0")
        joined = joined.withColumn(field, F.when(empty & F.col(f"_{field}").isNotNull(), F.col(f"_{field}")).otherwise(F.col(field)))
    return joined.drop(*[f"_{f}" for f in fields])


def field_differences(saved: DataFrame, resolved: DataFrame, parts: int | None = None) -> DataFrame:
    """Scalar fields where the suggestion differs from what is saved; dates compare by their first ten characters.

    Both meet in ``parts`` partitions, by the session's number of them without it.
    """
    suggestion = resolved.where(F.col("field").isin(SCALAR_FIELDS) & (F.col("value") != "")).select(
        "doc_id", "field", "value", "source", "confidence"
    )
    stored = saved.select("doc_id", "field", F.col("value").alias("saved"))
    joined = _dealt(suggestion, parts, "field").join(_dealt(stored, parts, "field"), ["doc_id", "field"], "left").withColumn("saved", F.coalesce("saved", F.lit("")))
    date = F.col("field").isin(DATE_FIELDS)

    def shown(c: str) -> Column:
        return F.when(date, F.left(F.col(c), F.lit(10))).otherwise(F.col(c))

    return joined.where(shown("value") != shown("saved")).withColumn("source", F.coalesce("source", F.lit("n/a")))


# Labels of the summary lines.
SUMMARY_LABELS = {
    "Fecha de registro": "fecha_registro",
    "RPC Folio": "rpc_folio",
    "RPC Fecha inscripción": "rpc_fecha_inscripcion",
    "RPC Lugar": "rpc_lugar",
    "Notaría número": "notaria_numero",
    "Notaría lugar": "notaria_lugar",
    "Notario": "notario_nombre",
    "Escritura número": "escritura_numero",
    "Libro número": "libro_numero",
    "Fecha inscripción": "fecha_inscripcion",
    "Acto": "acto",
}


def structured_summary(wide: DataFrame, missing: DataFrame) -> DataFrame:
    """Readable summary of a deed: a title and sixteen labelled lines."""
    na = F.lit("N/A")
    text = lambda c: F.coalesce(c, F.lit(""))
    scalars = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(field), na)) for label, field in SUMMARY_LABELS.items()]
    people = F.transform(
        F.from_json("apoderados", _struct_type("apoderados")),
        lambda p: F.concat_ws(
            " | ", F.concat(F.lit("Nombre: "), text(p["nombre_completo"])), F.concat(F.lit("INE: "), text(p["ine"])),
            F.concat(F.lit("Poder: "), text(p["poder_documento"])), F.concat(F.lit("Facultades: "), text(p["facultades_otorgadas"])),
        ),
    )
    holders = F.transform(
        F.from_json("participacion_accionaria", _struct_type("participacion_accionaria")),
        lambda h: strip(F.concat(F.coalesce(h["socio"], F.lit("Socio")), F.lit(" "), text(h["porcentaje"]))),
    )

    def line(label: str, items: Column, glue: str) -> Column:
        return F.concat(F.lit(f"{label}: "), F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, glue, "")).otherwise(na))

    gaps = F.array_join(F.coalesce("missing", F.array().cast("array<string>")), ", ")
    lines = [
        F.lit("RESUMEN ESTRUCTURADO DEL ACTA"),
        *scalars,
        line("Apoderados", people, " || "),
        line("Participación accionaria", holders, " || "),
        line("Consejo de administración", F.from_json("consejo_administracion", "array<string>"), " | "),
        line("Dirección de empresa", F.from_json("direccion_empresa", "array<string>"), " | "),
        F.concat(F.lit("Campos obligatorios faltantes: "), F.when(gaps != "", gaps).otherwise("ninguno")),
    ]
    return wide.join(missing, "doc_id", "left").select("doc_id", F.concat_ws("\n", *lines).alias("summary"))


def attempt_rollup(attempts: DataFrame) -> DataFrame:
    """Totals over image attempts, and engines and errors over all attempts, per document.

    ``(doc_id, stage_order, kind, engine, error, images_used, elapsed_ms, budget_ms, attempts, budget_exhausted)``; a document has a
    handful of attempts.
    """
    image = F.col("kind") == "vision"

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(image, F.col(c))), F.lit(0)).alias(c)

    def ordered(c: str) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("stage_order", F.col(c).alias("v")))))
        return F.transform(kept, lambda x: x["v"])

    return attempts.groupBy("doc_id").agg(
        total("images_used"), total("elapsed_ms"), total("budget_ms"), total("attempts"),
        F.coalesce(F.bool_or(image & F.col("budget_exhausted")), F.lit(False)).alias("budget_exhausted"),
        F.array_distinct(ordered("engine")).alias("engines"),
        F.nullif(F.array_join(ordered("error"), " | "), F.lit("")).alias("errors"),
    )


def as_candidates(extracted: DataFrame, source: str = "regex", stage: int = 0) -> DataFrame:
    """Pattern matches in the shape of the candidate table."""
    return extracted.select(
        "doc_id", F.lit(source).alias("source_key"), F.lit(source).alias("source"), F.lit(stage).cast("long").alias("stage_order"), "field",
        "value", F.lit(None).cast("string").alias("value_json"), F.lit(None).cast("long").alias("page_number"),
    )


def _fold(entries: Column) -> Column:
    """Winner of the candidates of one field in stage order; null without any."""
    scalar = ~F.col("field").isin(ARRAY_FIELDS)
    return F.reduce(
        F.slice(entries, 2, 2**31 - 2),
        F.get(entries, F.lit(0)),
        lambda acc, e: F.when(scalar & (e["confidence"] >= acc["confidence"] + MARGIN), e).otherwise(acc),
    )


def _dealt(df: DataFrame, parts: int | None, *more: str) -> DataFrame:
    """Rows by document (and ``more``) in ``parts`` partitions; left as they are without a number."""
    return df.repartition(parts, "doc_id", *more) if parts else df


def resolve_deeds(regex: DataFrame, candidates: DataFrame, decisions: DataFrame, parts: int | None = None) -> DataFrame:
    """Resolved fields: score, merge, review decisions, fallback to patterns, clean-up.

    ``regex`` and ``candidates`` are candidate tables. One row per document and field that has a value. All rows of a
    document meet in one of ``parts`` partitions (by the session's number of them without it): tables that are already
    dealt so are not exchanged, and merge, decision and fallback come out of aggregates that need no further shuffle.
    A task holds a part in memory, so ``parts`` should grow with the documents. The steps one by one are
    ``merge_candidates``, ``apply_decisions`` and ``regex_fallback``.
    """
    both = _dealt(candidates.withColumn("pattern", F.lit(False)), parts).unionByName(_dealt(regex.withColumn("pattern", F.lit(True)), parts))
    # A document has at most a few decisions a field, so they fit in one row.
    named = _dealt(decisions.where(F.col("source_key") != ""), parts).groupBy("doc_id").agg(F.collect_list(F.struct("field", "source_key", "reason")).alias("_named"))
    usable = score_candidates(both).where("meaningful").join(named.hint("merge"), "doc_id", "left")
    asked = F.filter("_named", lambda d: (d["field"] == F.col("field")) & (d["source_key"] == F.col("source_key")))
    order = F.struct("stage_order", "source_key").alias("order")
    outcome = F.struct("confidence", *_PAYLOAD)
    levels = usable.withColumn("_asked", asked).groupBy("doc_id", "field", "pattern", "confidence").agg(
        F.min(F.struct(order, *_PAYLOAD)).alias("first"),
        F.max(F.when(F.size("_asked") > 0, F.struct(outcome.alias("value"), F.array_max(F.col("_asked.reason")).alias("reason")))).alias("decision"),
    )
    first = F.struct(F.col("first.order").alias("order"), "confidence", *[F.col(f"first.{c}").alias(c) for c in _PAYLOAD])
    grouped = levels.groupBy("doc_id", "field").agg(
        F.array_sort(F.collect_list(F.when(~F.col("pattern"), first))).alias("entries"),
        F.max(F.when(F.col("pattern"), F.struct("confidence", *[F.col(f"first.{c}").alias(c) for c in _PAYLOAD]))).alias("matched"),
        F.max("decision").alias("decision"),
    )
    decided = F.col("decision").isNotNull()
    fallback = ~decided & (F.size("entries") == 0)
    folded = grouped.withColumn("won", _fold(F.col("entries")))

    def chosen(name: str) -> Column:
        return F.when(decided, F.col(f"decision.value.{name}")).when(fallback, F.col(f"matched.{name}")).otherwise(F.col(f"won.{name}")).alias(name)

    filled = folded.select(
        "doc_id", "field", *[chosen(c) for c in [*_PAYLOAD, "confidence"]], decided.alias("decided"), F.col("decision.reason").alias("reason"), fallback.alias("fallback")
    )
    cleaned = filled.withColumn("value", sanitize_field(F.col("field"), F.col("value")))
    return cleaned.where(F.col("value").isNotNull() | F.col("field").isin(ARRAY_FIELDS))


def _text_at(v: Column, field: str) -> Column:
    """A member that is a JSON string; numbers and other kinds count as absent."""
    path = f"$.{field}"
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def parse_model_outputs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate rows from raw model answers, and the answers that could not be used.

    ``raw``: ``(doc_id, source_key, source, stage_order, page_number, response)``.
    """
    parsed = raw.withColumn("v", F.try_parse_json("response"))
    kind = F.schema_of_variant("v")
    error = F.when(F.coalesce(strip(F.col("response")), F.lit("")) == "", "empty_response").when(
        F.col("v").isNull() | ~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), "invalid_json"
    )
    judged = parsed.withColumn("error", error)
    key = ["doc_id", "source_key", "source", "stage_order", "page_number"]

    def entry(field: str) -> Column:
        v = F.col("v")
        value, value_json = F.lit(None).cast("string"), F.lit(None).cast("string")
        if field in LIST_FIELDS:
            value_json = F.to_json(clean_list(F.try_variant_get(v, f"$.{field}", "array<string>")))
        elif field in STRUCT_FIELDS:
            members = clean_structs(F.try_variant_get(v, f"$.{field}", _struct_type(field)), STRUCT_FIELDS[field])
            value_json = F.to_json(members, {"ignoreNullFields": "false"})
        else:
            value = normalize_date(_text_at(v, field)) if field in DATE_FIELDS else clean(_text_at(v, field))
        return F.struct(F.lit(field).alias("field"), value.alias("value"), value_json.alias("value_json"))

    rows = judged.where(F.col("error").isNull()).select(*key, F.inline(F.array(*[entry(f) for f in DEED_FIELDS])))
    return rows, judged.where(F.col("error").isNotNull()).select(*key, "error")


def parse_decisions(raw: DataFrame) -> DataFrame:
    """Decision rows from raw review answers ``(doc_id, response)``."""
    decisions = F.try_variant_get(F.try_parse_json("response"), "$.decisions", "map<string,struct<source_key:string,reason:string>>")
    return raw.select("doc_id", F.explode(decisions).alias("field", "d")).select("doc_id", "field", "d.source_key", "d.reason")
