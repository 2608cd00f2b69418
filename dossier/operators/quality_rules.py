"""Record rules, canonical forms, reference checks and routing predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.ranking import top_per_key
from dossier.functions.text import display_name

# Accepted upload formats.
DECLARATION_FORMATS = ["pdf", "xml", "xlsx", "xls", "csv"]


def scope_to_owner(df: DataFrame, owner: int | DataFrame) -> DataFrame:
    """Rows of one user, or of the users listed in a table with an ``id`` column."""
    if isinstance(owner, DataFrame):
        return df.join(owner.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return df.where(F.col("user_id") == owner)


def flag_foreign_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with a flag telling whether parent and child name the same user."""
    owner = parents.select(F.col("id").alias(key), F.col("user_id").alias("_owner"))
    return (
        children.join(owner, key, "left")
        .withColumn("forbidden", ~F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False)))
        .drop("_owner")
    )


@dataclass(frozen=True)
class Rule:
    """One rule: ``kind`` is required, in, min, max, min_len, max_len, size, date, after_or_equal, extension, max_kb."""

    field: str
    kind: str
    arg: object = None


def _violates(rule: Rule) -> Column:
    c = F.col(rule.field)
    text = c.cast("string")
    present = c.isNotNull() & (F.btrim(text) != "")
    tests = {
        "required": lambda: ~present,
        "in": lambda: ~text.isin(list(rule.arg)),
        "min": lambda: c < rule.arg,
        "max": lambda: c > rule.arg,
        "min_len": lambda: F.length(text) < rule.arg,
        "max_len": lambda: F.length(text) > rule.arg,
        "size": lambda: F.length(text) != rule.arg,
        "date": lambda: F.try_to_timestamp(text).isNull(),
        "after_or_equal": lambda: c < F.col(rule.arg),
        "extension": lambda: ~F.lower(F.regexp_extract(text, r"\.([^.]*)$", 1)).isin(list(rule.arg)),
        "max_kb": lambda: c > rule.arg,
    }
    broken = F.coalesce(tests[rule.kind](), F.lit(False))
    # All rules but `required` skip absent values.
    return broken if rule.kind == "required" else present & broken


def validate_records(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``errors``: one ``field:kind`` entry per broken rule, in rule order."""
    checks = [F.when(_violates(r), F.lit(f"{r.field}:{r.kind}")) for r in rules]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows."""
    ok = F.size("errors") == 0
    return validated.where(ok).drop("errors"), validated.where(~ok)


STATEMENT_RULES = [
    Rule("periodicity", "required"), Rule("periodicity", "in", ("mensual", "anual")),
    Rule("year", "required"), Rule("year", "min", 2000), Rule("year", "max", 2100),
    Rule("month", "min", 1), Rule("month", "max", 12), Rule("is_audited", "required"),
    Rule("file_name", "required"), Rule("file_name", "extension", ("pdf",)), Rule("file_kb", "max_kb", 20480),
]
OPINION_RULES = [
    Rule("tipo", "required"), Rule("tipo", "in", ("sat", "infonavit", "imss")),
    Rule("estado", "required"), Rule("estado", "in", ("positivo", "negativo", "pendiente")),
    Rule("fecha_emision", "required"), Rule("fecha_emision", "date"),
    Rule("fecha_vigencia", "date"), Rule("fecha_vigencia", "after_or_equal", "fecha_emision"),
]
COMPANY_RULES = [
    Rule("nombre", "required"), Rule("nombre", "max_len", 255), Rule("rfc", "required"), Rule("rfc", "min_len", 12), Rule("rfc", "max_len", 13),
]
REGULATION_RULES = [
    Rule("title", "required"), Rule("title", "max_len", 255), Rule("country_code", "required"), Rule("country_code", "size", 2),
    Rule("scope", "required"), Rule("scope", "in", ("federal", "estatal", "local", "entidad")), Rule("regulatory_body", "max_len", 255),
    Rule("source_pdf_path", "required"),
]
TENDER_RULES = [
    Rule("title", "required"), Rule("title", "max_len", 255), Rule("company_id", "required"),
    Rule("process_type", "required"), Rule("process_type", "in", ("publica", "privada")), Rule("bases_document_path", "extension", ("pdf",)),
]
LETTERHEAD_RULES = [Rule("title", "required"), Rule("title", "max_len", 255), Rule("is_default", "required")]
DEED_RULES = [
    Rule("tipo", "required"), Rule("tipo", "in", ("constitutiva", "modificacion", "poderes")), Rule("fecha_registro", "date"),
    Rule("documento_path", "required"), Rule("documento_path", "extension", ("pdf",)),
]


def normalize_period(df: DataFrame) -> DataFrame:
    """Monthly rows need a month (``period_error`` otherwise); yearly rows lose theirs."""
    monthly = F.col("periodicity") == "mensual"
    empty = F.coalesce(F.col("month"), F.lit(0)) == 0
    return df.withColumn("period_error", F.when(monthly & empty, "month:required")).withColumn("month", F.when(monthly, F.col("month")))


def infer_format(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(extension.isin(DECLARATION_FORMATS), extension).otherwise("pdf")


def canonicalize_company(companies: DataFrame) -> DataFrame:
    return companies.withColumn("nombre", F.upper("nombre")).withColumn("rfc", F.upper("rfc"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def filter_regulations(regulations: DataFrame, country: str = "", scope: str = "") -> DataFrame:
    kept = regulations
    if country:
        kept = kept.where(F.col("country_code") == country.upper())
    if scope:
        kept = kept.where(F.col("scope") == scope)
    return kept.withColumn("source_pdf_name", display_name(F.col("source_pdf_original_name"), F.col("source_pdf_path")))


def select_reextract(deeds: DataFrame, companies: DataFrame, company_id: int | None = None, deed_id: int | None = None) -> DataFrame:
    """Deeds with a file to extract again, and why one is skipped."""
    chosen = deeds.where(F.col("documento_path").isNotNull())
    if company_id:
        chosen = chosen.where(F.col("company_id") == company_id)
    if deed_id:
        chosen = chosen.where(F.col("id") == deed_id)
    owner = companies.select(F.col("id").alias("company_id"), "user_id")
    return chosen.select("id", "company_id").join(owner, "company_id", "left").withColumn(
        "action", F.when(F.coalesce(F.col("user_id"), F.lit(0)) > 0, "enqueue").otherwise("skip_unresolved_user")
    )


KNOWN_DOCUMENT_TYPES = ["Acta", "OpinionCumplimiento", "Regulation"]


def route_requeue(index: DataFrame, status: str) -> DataFrame:
    """Which job each record of the given status goes to."""
    if status not in ("processed", "failed"):
        raise ValueError("status must be processed or failed")
    has_text = F.lit(False)
    for column in ("index_text", "extracted_text"):
        has_text = has_text | F.coalesce((F.col(column) != "") & (F.col(column) != "0"), F.lit(False))
    light = (F.lit(status) == "processed") & has_text
    job = F.when(light, "reindex").when(F.col("documentable_type").isin(KNOWN_DOCUMENT_TYPES), "full").otherwise("skip_unknown_type")
    return index.where(F.col("status") == status).withColumn("job", job)


def enforce_single_default(letterheads: DataFrame) -> DataFrame:
    """Per company only the default saved last stays a default (save order: created_at, then id)."""
    newest = top_per_key(letterheads.where("is_default"), ["company_id"], [F.desc("created_at"), F.desc("id")]).select(
        "id", F.lit(True).alias("_keep")
    )
    return letterheads.join(newest, "id", "left").withColumn("is_default", F.coalesce("_keep", F.lit(False))).drop("_keep")


def resolve_refs(tenders: DataFrame, bridge: DataFrame, regulations: DataFrame, letterheads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tenders whose letterhead belongs to their company (else null), and bridge rows whose regulation the user owns."""
    owned_head = letterheads.select(F.col("id").alias("company_letterhead_id"), "company_id", F.lit(True).alias("_ok"))
    kept_heads = (
        tenders.join(owned_head, ["company_letterhead_id", "company_id"], "left")
        .withColumn("company_letterhead_id", F.when(F.col("_ok"), F.col("company_letterhead_id")))
        .drop("_ok")
    )
    owner = tenders.select(F.col("id").alias("licitacion_id"), "user_id")
    owned_regulations = regulations.select(F.col("id").alias("regulation_id"), "user_id")
    kept_pairs = bridge.join(owner, "licitacion_id").join(owned_regulations, ["regulation_id", "user_id"], "left_semi")
    return kept_heads, kept_pairs.select("licitacion_id", "regulation_id")


@dataclass(frozen=True)
class Reference:
    """A foreign key; ``on_delete`` is cascade or null."""

    child: str
    column: str
    parent: str
    on_delete: str = "cascade"


# Parents come before their children.
REFERENCES = [
    Reference("companies", "user_id", "users"),
    Reference("regulations", "user_id", "users"),
    Reference("deeds", "company_id", "companies"),
    Reference("opinions", "company_id", "companies"),
    Reference("statements", "company_id", "companies"),
    Reference("declarations", "company_id", "companies"),
    Reference("letterheads", "company_id", "companies"),
    Reference("tenders", "user_id", "users"),
    Reference("tenders", "company_id", "companies"),
    Reference("tenders", "company_letterhead_id", "letterheads", "null"),
    Reference("bridge", "licitacion_id", "tenders"),
    Reference("bridge", "regulation_id", "regulations"),
    Reference("validations", "user_id", "users"),
    Reference("validations", "licitacion_id", "tenders"),
    Reference("findings", "proposal_validation_id", "validations"),
    Reference("index", "user_id", "users"),
    Reference("events", "user_id", "users", "null"),
]
UNIQUE_KEYS = [
    ("companies", ["rfc"]),
    ("bridge", ["licitacion_id", "regulation_id"]),
    ("validations", ["licitacion_id"]),
    ("index", ["documentable_type", "documentable_id"]),
]


def integrity_report(entities: dict[str, DataFrame]) -> DataFrame:
    """One line per reference and unique key with the number of offending rows."""
    lines = []
    for ref in REFERENCES:
        if ref.child in entities and ref.parent in entities:
            keys = entities[ref.child].where(F.col(ref.column).isNotNull()).groupBy(F.col(ref.column).alias("id")).agg(F.count(F.lit(1)).alias("n"))
            orphans = keys.join(entities[ref.parent].select("id"), "id", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("offending"))
            lines.append(orphans.select(F.lit(f"{ref.child}.{ref.column}->{ref.parent}").alias("rule"), F.lit("orphan").alias("issue"), "offending"))
    for name, keys in UNIQUE_KEYS:
        if name in entities:
            copies = duplicate_keys(entities[name], *keys).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("offending"))
            lines.append(copies.select(F.lit(f"{name}({','.join(keys)})").alias("rule"), F.lit("duplicate").alias("issue"), "offending"))
    return reduce(DataFrame.unionByName, lines)


def cascade_delete(entities: dict[str, DataFrame], deleted_users: DataFrame) -> dict[str, DataFrame]:
    """What is left of every table after deleting users, following the references; orphans of before go, too.

    Where references are known to hold, :func:`cascade_changes` gives the same by the deleted keys alone.
    """
    left = dict(entities)
    left["users"] = left["users"].join(deleted_users.select("id"), "id", "left_anti")
    for ref in REFERENCES:
        if ref.child not in left:
            continue
        child, parent = left[ref.child], left[ref.parent]
        if ref.on_delete == "cascade":
            left[ref.child] = child.join(parent.select(F.col("id").alias(ref.column)), ref.column, "left_semi")
        else:
            alive = parent.select(F.col("id").alias(ref.column), F.lit(True).alias("_alive"))
            left[ref.child] = (
                child.join(alive, ref.column, "left").withColumn(ref.column, F.when(F.col("_alive"), F.col(ref.column))).drop("_alive")
            )
    return left


def cascade_changes(entities: dict[str, DataFrame], deleted_users: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Per table the rows that deleting users takes along, and the rows whose reference becomes null, as they are after it.

    Only keys of deleted rows travel, level by level: a table meets the deleted keys of its parents, never rows that stay,
    so the work after the scans grows with what is deleted. Apply them as deletes and updates by key.
    """
    users = entities["users"].join(deleted_users.select("id"), "id", "left_semi")
    gone = {"users": users.select("id")}
    out = {"users": (users, entities["users"].limit(0))}
    for child in dict.fromkeys(ref.child for ref in REFERENCES if ref.child in entities):
        rows, columns = entities[child], entities[child].columns
        refs = [r for r in REFERENCES if r.child == child and r.parent in gone]
        marked = rows
        for n, ref in enumerate(refs):
            keys = gone[ref.parent].select(F.col("id").alias(ref.column), F.lit(True).alias(f"_gone{n}"))
            marked = marked.join(keys, ref.column, "left")
        marks = [F.coalesce(F.col(f"_gone{n}"), F.lit(False)) for n in range(len(refs))]
        lost = reduce(lambda a, b: a | b, [m for m, r in zip(marks, refs, strict=True) if r.on_delete == "cascade"], F.lit(False))
        nulled = reduce(lambda a, b: a | b, [m for m, r in zip(marks, refs, strict=True) if r.on_delete == "null"], F.lit(False))
        cleared = [r.column for r in refs if r.on_delete == "null"]
        deleted = marked.where(lost).select(*columns)
        changed = marked.where(~lost & nulled)
        for n, ref in enumerate(refs):
            if ref.column in cleared:
                changed = changed.withColumn(ref.column, F.when(~marks[n], F.col(ref.column)))
        out[child] = deleted, changed.select(*columns)
        if "id" in columns:
            gone[child] = deleted.select("id").distinct()
    return out
