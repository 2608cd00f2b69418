"""Field extraction by pattern from deed, opinion and regulation texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import normalize_date
from dossier.functions.text import normalize_newlines, strip
from dossier.functions.values import sanitize_field

# The comparable fields of a deed, in report order.
DEED_FIELDS = [
    "fecha_registro",
    "apoderados",
    "participacion_accionaria",
    "rpc_folio",
    "rpc_fecha_inscripcion",
    "rpc_lugar",
    "consejo_administracion",
    "direccion_empresa",
    "notaria_numero",
    "notaria_lugar",
    "notario_nombre",
    "escritura_numero",
    "libro_numero",
    "fecha_inscripcion",
    "acto",
]
LIST_FIELDS = ["consejo_administracion", "direccion_empresa"]
STRUCT_FIELDS = {
    "apoderados": ["ine", "poder_documento", "nombre_completo", "facultades_otorgadas"],
    "participacion_accionaria": ["socio", "porcentaje"],
}
ARRAY_FIELDS = [*STRUCT_FIELDS, *LIST_FIELDS]
DATE_FIELDS = ["fecha_registro", "rpc_fecha_inscripcion", "fecha_inscripcion"]
SCALAR_FIELDS = [f for f in DEED_FIELDS if f not in ARRAY_FIELDS]

_DATE = r"([0-9]{1,2}[\/\-][0-9]{1,2}[\/\-][0-9]{2,4})"
# Label patterns, matched without regard to case.
DEED_PATTERNS = {
    "notaria_numero": r"Notar[ií]a\s*(?:N[uú]mero|No\.?|#)?\s*[:\-]?\s*([0-9]+)",
    "notaria_lugar": r"Notar[ií]a\s*(?:en|de)?\s*([A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑ\s\.]{3,120})",
    "notario_nombre": r"Notario(?:\s+P[uú]blico)?\s*[:\-]?\s*([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s\.]+)",
    "escritura_numero": r"Escritura\s*(?:N[uú]mero|No\.?|#)?\s*[:\-]?\s*([A-Z0-9\-\/]+)",
    "rpc_folio": r"Folio\s*(?:Mercantil|Mercante|RPC)?\s*[:#\-\.]?\s*([0-9][0-9A-Z\-\/\.]*)",
    "rpc_lugar": r"Registro\s+P[uú]blico\s+de\s+Comercio\s*(?:de|en)?\s*([A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑ\s\.]{3,120})",
    "fecha_registro": rf"Fecha\s*(?:de\s*)?(?:registro|inscripci[oó]n)\s*[:\-]?\s*{_DATE}",
    "rpc_fecha_inscripcion": rf"Registro\s+P[uú]blico\s+de\s+Comercio[\s\S]{{0,180}}?Fecha\s*(?:de\s*)?inscripci[oó]n\s*[:\-]?\s*{_DATE}",
    "fecha_inscripcion": rf"Fecha\s*(?:de\s*)?inscripci[oó]n\s*[:\-]?\s*{_DATE}",
    "acto": r"Acto\s*[:\-]?\s*([A-Za-zÁÉÍÓÚÑ\s,\.;]{4,200})",
}
OPINION_PATTERNS = {
    "fecha_emision": rf"Fecha\s*(?:de\s*)?(?:emisi[oó]n|expedici[oó]n)\s*[:\-]?\s*{_DATE}",
    "fecha_vigencia": rf"(?:Vigencia|V[aá]lida\s*hasta)\s*[:\-]?\s*{_DATE}",
}
BODY_PATTERN = r"(Secretar[ií]a\s+[A-Za-zÁÉÍÓÚÑ\s]+|COFEPRIS|IMSS|SAT|INAI|BID)"


def first_match(text: Column, pattern: str) -> Column:
    """Trimmed first group of the first match, null without one."""
    found = F.regexp_extract(text, f"(?iuU){pattern}", 1)
    return F.when(found != "", strip(found))


def _long(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """One row per field with a value."""
    items = F.array(*[F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in fields.items()])
    return df.select("doc_id", F.inline(items)).where(F.col("value").isNotNull())


def extract_deed_fields(documents: DataFrame) -> DataFrame:
    """``(doc_id, field, value)`` from deed texts."""
    # Raw matches first, so that each pattern runs once although cleaning looks at its result several times.
    found = documents.select("doc_id", *[first_match(F.col("text"), p).alias(name) for name, p in DEED_PATTERNS.items()])
    cleaned = {
        name: normalize_date(F.col(name)) if name in DATE_FIELDS else sanitize_field(F.lit(name), F.col(name)) for name in DEED_PATTERNS
    }
    return _long(found, cleaned)


def extract_opinion_fields(documents: DataFrame) -> DataFrame:
    """Result and kind by wording (positive before negative; infonavit, imss, then sat), and two dates."""
    low = F.lower("text")
    lowered = documents.select("doc_id", "text", low.alias("low"))
    estado = F.when(F.col("low").contains("positiv"), "positivo").when(F.col("low").contains("negativ"), "negativo")
    tipo = (
        F.when(F.col("low").contains("infonavit"), "infonavit")
        .when(F.col("low").contains("imss"), "imss")
        .when(F.col("low").contains("sat") | F.col("low").contains("tributaria"), "sat")
    )
    found = lowered.select("doc_id", estado.alias("estado"), tipo.alias("tipo"), *[first_match(F.col("text"), p).alias(n) for n, p in OPINION_PATTERNS.items()])
    dates = {name: normalize_date(F.col(name)) for name in OPINION_PATTERNS}
    return _long(found, {"tipo": F.col("tipo"), "estado": F.col("estado"), **dates})


def extract_regulation_fields(documents: DataFrame) -> DataFrame:
    """First line of more than eight characters as title, issuing body, head of the text as description."""
    text = strip(normalize_newlines(F.col("text")))
    trimmed = documents.select("doc_id", "text", text.alias("clean"))
    title = F.regexp_extract(
        "clean", r"(?:\A|\n)[ \t\r\x00\x0b]*([^\n \t\r\x00\x0b][^\n]{7,}[^\n \t\r\x00\x0b])[ \t\r\x00\x0b]*(?=\n|\z)", 1
    )
    return _long(
        trimmed,
        {
            "title": F.when(title != "", F.left(title, F.lit(255))),
            "regulatory_body": first_match(F.col("text"), BODY_PATTERN),
            "general_description": F.left(strip(F.col("text")), F.lit(2500)),
        },
    )


def extract_fields(documents: DataFrame) -> DataFrame:
    """Fields by ``document_type``; unknown types yield nothing."""
    kinds = {"acta": extract_deed_fields, "opinion": extract_opinion_fields, "regulation": extract_regulation_fields}
    return reduce(
        DataFrame.unionByName, [extract(documents.where(F.col("document_type") == kind)) for kind, extract in kinds.items()]
    )
