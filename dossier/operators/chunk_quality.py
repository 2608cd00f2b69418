"""Rating chunks for scanner damage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import strip

# Reason texts.
REASONS = {
    "empty": "El chunk no contiene texto útil.",
    "tilde": "Contiene placeholders `~` sin resolver para caracteres acentuados.",
    "glyph": "Contiene glifos OCR anómalos como `£` o caracteres sustitutos.",
    "mixed": "Contiene varios tokens mezclando letras y dígitos, típico de OCR defectuoso.",
    "quote": "Contiene palabras partidas con apóstrofes o comillas internas no esperadas.",
    "short": "Tiene demasiadas líneas muy cortas, señal de texto fragmentado.",
    "symbol": "La densidad de símbolos es alta para un chunk notarial normal.",
}
SUSPICIOUS_FROM = 3
SYMBOL_RATIO = 0.14


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def quality_tests(text: Column) -> dict[str, tuple[Column, Column]]:
    """Test name -> (fires, points). Plain numbers count as mixed tokens, too."""
    t = strip(F.coalesce(text, F.lit("")))
    tildes = F.length(t) - F.length(F.replace(t, F.lit("~"), F.lit("")))
    solid = F.greatest(F.length(F.regexp_replace(t, r"(?U)\s+", "")), F.lit(1))
    symbols = _count(t, r"(?U)[^\p{L}\p{N}\s]")
    return {
        "empty": (t == "", F.lit(4)),
        "tilde": (tildes > 0, F.least(tildes, F.lit(3))),
        "glyph": (t.rlike("[�£¤€¢]"), F.lit(2)),
        "mixed": (_count(t, r"(?U)\b\p{L}*\d[\p{L}\d]*\b") >= 2, F.lit(1)),
        "quote": (_count(t, r"""(?U)\b\p{L}{2,}['"`]\p{L}{2,}\b""") >= 1, F.lit(1)),
        "short": (_count(t, r"(?dU)(?:^|\n)\s*[\p{L}\d]{1,2}\s*(?=\n|$)") >= 4, F.lit(2)),
        "symbol": ((symbols / solid) >= SYMBOL_RATIO, F.lit(1)),
    }


def chunk_quality(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``score``, ``suspicious`` and ``reasons``."""
    tests = quality_tests(F.col(text))
    # Points are computed once and then read for both the score and the reasons.
    points = F.struct(*[F.when(fires, n).otherwise(0).alias(name) for name, (fires, n) in tests.items()])
    rated = chunks.withColumn("_points", points)
    score = F.lit(0)
    for name in tests:
        score = score + F.col(f"_points.{name}")
    reasons = F.array_compact(F.array(*[F.when(F.col(f"_points.{name}") > 0, REASONS[name]) for name in tests]))
    return (
        rated.withColumn("score", score)
        .withColumn("suspicious", F.col("score") >= SUSPICIOUS_FROM)
        .withColumn("reasons", reasons)
        .drop("_points")
    )


def correction_flags(records: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Correction state of a record from its metadata map."""
    m = F.col(metadata)

    def truthy(key: str) -> Column:
        value = F.lower(F.coalesce(m[key], F.lit("")))
        return ~value.isin("", "0", "false")

    return (
        records.withColumn("correction_engine", m["correction_engine"])
        .withColumn("corrected", F.col("correction_engine").isNotNull())
        .withColumn("corrected_with_vision", truthy("corrected_with_vision"))
        .withColumn("corrected_with_targeted_ocr", truthy("corrected_with_targeted_ocr"))
        .withColumn("corrected_at", m["correction_updated_at"])
        .withColumn("correction_available", F.coalesce(m["page_ids"] != "", F.lit(False)))
    )
