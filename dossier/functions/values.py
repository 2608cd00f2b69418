"""Null-like tests and cleaning of extracted values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import collapse_ws, strip

# Spellings that mean "no value".
NULL_LIKE = ["null", "n/a", "na", "none", "sin dato", "sin datos", "no aplica", "no disponible", "nd", "n.d.", "s/d"]

# Label words that are not field values.
LABEL_WORDS = ["n", "nmero", "numero", "folio", "mercante"]

NUMBER_FIELDS = ["notaria_numero", "escritura_numero", "libro_numero", "rpc_folio"]
TEXT_FIELDS = ["notaria_lugar", "notario_nombre", "rpc_lugar"]

# Wording of legal acts, and of prose that is not one.
_LEGAL_ACT = (
    r"(?iuU)\b(?:constituci[oó]n|asamblea|poder(?:es)?|estatutos|nombramiento|revocaci[oó]n|reforma|protocoli[sz]aci[oó]n"
    r"|acta constitutiva|administraci[oó]n|apoderad(?:o|os|a|as)|fusi[oó]n|escisi[oó]n|capital|sociedad|otorgamiento)\b"
)
_PROSE = r"(?iuU)\b(?:candidates?|contrataci[oó]n|proponer\s+a\s+sus\s+clientes|aptos?\s+de\s+contrataci[oó]n)\b"
_PROSE_ON_SAVE = r"(?iuU)\b(?:candidates?|proponer\s+a\s+sus\s+clientes|aptos?\s+de\s+contrataci[oó]n|contrataci[oó]?n?)\b"
_TRAILING_MARKS = " \t\n\r\x00\x0b;,.:-"


# One expression each instead of trimming, folding and comparing: these tests run on every candidate value.
_NULL_LIKE = r"(?iU)\A[\s\x00]*(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in NULL_LIKE) + r")[\s\x00]*\z"
_NOTHING = _NULL_LIKE + r"|\A[ \t\n\r\x00\x0b]*\z"
_LABEL = r"(?i)\A(?:" + "|".join(LABEL_WORDS) + r")\z"


def is_null_like(c: Column) -> Column:
    return c.rlike(_NULL_LIKE)


def is_meaningful(c: Column) -> Column:
    """A text that is neither null, blank nor null-like."""
    return F.coalesce(~c.rlike(_NOTHING), F.lit(False))


def is_meaningful_list(c: Column) -> Column:
    return F.coalesce(F.exists(c, is_meaningful), F.lit(False))


def is_meaningful_structs(c: Column, fields: list[str]) -> Column:
    def any_field(item: Column) -> Column:
        hit = F.lit(False)
        for field in fields:
            hit = hit | is_meaningful(item[field])
        return hit

    return F.coalesce(F.exists(c, any_field), F.lit(False))


def clean(c: Column) -> Column:
    return F.when(is_meaningful(c), strip(c))


def clean_list(c: Column) -> Column:
    """Cleaned members without the empty ones; "0" counts as empty, null becomes an empty list."""
    cleaned = F.filter(F.transform(c, clean), lambda item: item.isNotNull() & (item != "0"))
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def clean_structs(c: Column, fields: list[str]) -> Column:
    """Each member reduced to the cleaned ``fields``; null becomes an empty list."""
    cleaned = F.transform(c, lambda item: F.struct(*[clean(item[f]).alias(f) for f in fields]))
    empty = F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")
    return F.coalesce(cleaned, empty)


def normalize_string_array(c: Column) -> Column:
    """Trimmed members, blanks dropped, an empty list becomes null."""
    kept = F.filter(F.transform(c, strip), lambda item: item.isNotNull() & (item != ""))
    return F.when(F.size(kept) > 0, kept)


def normalize_entries(c: Column, fields: list[str]) -> Column:
    """Allowed fields only, trimmed with blanks as null; members without any value go, an empty list becomes null."""

    def project(item: Column) -> Column:
        return F.struct(*[F.when(strip(item[f]) != "", strip(item[f])).alias(f) for f in fields])

    def has_value(item: Column) -> Column:
        hit = F.lit(False)
        for field in fields:
            hit = hit | item[field].isNotNull()
        return hit

    kept = F.filter(F.transform(F.filter(c, lambda item: item.isNotNull()), project), has_value)
    return F.when(F.size(kept) > 0, kept)


def _word_count(c: Column) -> Column:
    # A lone "0" is not counted as a word.
    return F.size(F.filter(F.split(c, " "), lambda w: (w != "") & (w != "0")))


def sanitize_act(c: Column, on_save: bool = False) -> Column:
    """A legal act, or null when the text reads like prose or has the wrong length.

    The variant used when saving has no lower length limit and a slightly wider prose test.
    """
    s = collapse_ws(c)
    prose = s.rlike(_PROSE_ON_SAVE if on_save else _PROSE)
    ok = is_meaningful(s) & (F.length(s) <= 160) & ~prose & ((_word_count(s) <= 14) | s.rlike(_LEGAL_ACT))
    if not on_save:
        ok = ok & (F.length(s) >= 4)
    return F.when(ok, F.rtrim(s, F.lit(_TRAILING_MARKS)))


def sanitize_field(field: Column, value: Column) -> Column:
    """Field-dependent clean-up of one scalar value; fields without a rule pass through."""
    s = collapse_ws(strip(value))
    usable = is_meaningful(value) & ~s.rlike(_LABEL)
    number = F.regexp_replace(s, r"[^0-9A-Za-z\-/.,]", "")
    as_number = F.when(s.rlike(r"(?U)\d") & (F.length(number) >= 2), number)
    as_text = F.when(F.length(s) >= 4, s)
    return (
        F.when(field == "acto", F.when(usable, sanitize_act(s)))
        .when(field.isin(NUMBER_FIELDS), F.when(usable, as_number))
        .when(field.isin(TEXT_FIELDS), F.when(usable, as_text))
        .otherwise(value)
    )
