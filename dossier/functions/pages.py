"""Scores and lists used on pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import contains_any, count_literal

# Registry wording with weights; each counts once.
REGISTRY_WORDS = {
    "registro publico de comercio": 6,
    "folio mercantil": 6,
    "inscripcion": 4,
    "notaria": 4,
    "notario": 4,
    "escritura": 3,
    "libro": 3,
    "sello": 3,
    "instrumento": 2,
}
# Words scored per occurrence.
SCAN_WORDS = {
    "ESCRITURA": 4,
    "LIBRO": 4,
    "FECHA": 4,
    "ACTO": 5,
    "REGISTRO PUBLICO DE COMERCIO": 5,
    "FOLIO MERCANTIL": 5,
    "NOTARIA": 4,
    "NOTARIO": 4,
    "CONSTITUCION": 4,
    "CONSTITUCIÓN": 4,
}
# Labelled fields, each scored once.
SCAN_PATTERNS = {
    r"\bESCRITURA\b.{0,24}\d": 4,
    r"\bLIBRO\b.{0,24}\d": 4,
    r"\bFECHA\b.{0,40}\d": 4,
    r"\bACTO\b.{0,80}(CONSTITUCION|CONSTITUCIÓN|SOCIEDAD|S\.A\.)": 6,
    r"REGISTRO\s+PUBLICO\s+DE\s+COMERCIO": 5,
}
# What a tender's rules should mention.
RULES_CHECKLIST = {
    "Se detectó cronograma/fechas relevantes": ["fecha", "cronograma", "calendario", "plazo"],
    "Se detectaron requisitos técnicos": ["especificación", "técnic", "características"],
    "Se detectaron requisitos económicos": ["precio", "propuesta económica", "cotización"],
    "Se detectaron requisitos administrativos": ["anexo", "documentación", "constancia"],
    "Se detectaron criterios de evaluación": ["criterio", "evaluación", "puntaje"],
}


def _total(parts: list[Column]) -> Column:
    total = F.lit(0)
    for part in parts:
        total = total + part
    return total


def registry_score(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return _total([F.when(low.contains(word), weight).otherwise(0) for word, weight in REGISTRY_WORDS.items()])


def ocr_text_score(c: Column) -> Column:
    """How much a scanned page reads like a registry page; higher is better."""
    upper = F.upper(c)
    words = [count_literal(upper, word) * weight for word, weight in SCAN_WORDS.items()]
    patterns = [F.when(upper.rlike(f"(?dU){p}"), weight).otherwise(0) for p, weight in SCAN_PATTERNS.items()]
    solid = F.length(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", ""))
    alnum = F.regexp_count(c, F.lit(r"[\p{L}\p{N}]"))
    density = F.when(solid > 0, F.floor(F.lit(6.0) * (alnum / solid)).cast("int")).otherwise(0)
    volume = F.least(F.floor(F.length(c) / 120).cast("int"), F.lit(4))
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(_total([*words, *patterns, registry_score(c), density, volume]))


def parse_page_numbers(csv: Column) -> Column:
    """Positive integers of a comma list in first-seen order."""
    return clean_page_numbers(F.split(csv, ","))


def clean_page_numbers(items: Column) -> Column:
    """Positive integers of a list of texts or numbers, without repeats, in first-seen order."""
    numbers = F.transform(items, lambda t: F.trim(t.cast("string")).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n > 0))


def page_ids(numbers: Column) -> Column:
    return F.transform(numbers, lambda n: F.concat(F.lit("page-"), n.cast("string")))


def page_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def rules_checklist(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(
        *[F.struct(F.lit(label).alias("label"), contains_any(low, words).alias("checked")) for label, words in RULES_CHECKLIST.items()]
    )
