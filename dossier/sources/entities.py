"""Typed scans of the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

_FILE = "document_path string, document_original_name string, created_at timestamp, updated_at timestamp"

SCHEMAS: dict[str, str] = {
    "users": "id long, name string, email string, email_verified_at timestamp",
    "companies": "id long, user_id long, nombre string, rfc string, created_at timestamp, updated_at timestamp",
    "deeds": "id long, company_id long, tipo string, fecha_registro date, rpc_fecha_inscripcion date, fecha_inscripcion date, rpc_folio string, "
    "rpc_lugar string, notaria_numero string, notaria_lugar string, notario_nombre string, escritura_numero string, libro_numero string, acto string, "
    "documento_path string, documento_original_name string, "
    "apoderados array<struct<nombre_completo:string,ine:string,poder_documento:string,facultades_otorgadas:string>>, "
    "participacion_accionaria array<struct<socio:string,porcentaje:string>>, consejo_administracion array<string>, "
    "direccion_empresa array<string>, created_at timestamp, updated_at timestamp",
    "opinions": "id long, company_id long, tipo string, estado string, fecha_emision date, fecha_vigencia date, documento_path string, "
    "documento_original_name string, created_at timestamp, updated_at timestamp",
    "regulations": "id long, user_id long, title string, country_code string, scope string, regulatory_body string, general_description string, "
    "source_pdf_path string, source_pdf_original_name string, is_active boolean, created_at timestamp, updated_at timestamp",
    "document_indexes": "id long, user_id long, documentable_type string, documentable_id long, document_type string, storage_disk string, "
    "storage_path string, extraction_method string, extracted_text string, index_text string, metadata string, chunk_count int, "
    "indexed_at timestamp, status string, error_message string, vector_index_error string, created_at timestamp, updated_at timestamp",
    "system_event_logs": "id long, user_id long, event_type string, entity_type string, entity_id long, request_method string, request_path string, "
    "route_name string, ip_address string, user_agent string, status_code int, metadata string, created_at timestamp",
    "financial_statements": f"id long, company_id long, periodicity string, year int, month int, is_audited boolean, {_FILE}",
    "tax_declarations": f"id long, company_id long, periodicity string, year int, month int, format string, {_FILE}",
    "tenders": "id long, user_id long, company_id long, company_letterhead_id long, title string, process_type string, legal_signer_name string, "
    "status string, bases_document_path string, bases_document_original_name string, checklist array<struct<label:string,checked:boolean>>, "
    "created_at timestamp, updated_at timestamp",
    "tender_regulations": "licitacion_id long, regulation_id long",
    "company_letterheads": "id long, company_id long, title string, city string, contact_name string, contact_position string, phone string, "
    "email string, body_template string, is_default boolean, created_at timestamp, updated_at timestamp",
    "proposal_validations": "id long, user_id long, licitacion_id long, status string, traffic_light string, report string, override_applied boolean, "
    "override_reason string, audited_at timestamp, ready_at timestamp",
    "proposal_validation_findings": "id long, proposal_validation_id long, severity string, category string, rule_code string, message string, "
    "status string, resolution_note string, owner_user_id long, created_at timestamp",
    "workflow_transitions": "id long, entity_type string, entity_id long, field_name string, from_state string, to_state string, "
    "triggered_by_user_id long, reason string, metadata string, created_at timestamp",
}


def load_entity(spark: SparkSession, folder: str, name: str, file_format: str = "parquet") -> DataFrame:
    """One table with its declared types; no schema inference, columns absent from the files read as null."""
    return spark.read.schema(SCHEMAS[name]).format(file_format).load(f"{folder}/{name}")


#: Where a scan keeps the text of a row that it could not read.
CORRUPT = "_corrupt_record"


def load_checked(spark: SparkSession, path: str, schema: str, file_format: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """A table with its declared types, and beside it the rows that do not have them: (typed, quarantine).

    quarantine: ``raw`` (the row as JSON, or the line that is none) and ``problems``, the columns whose value is not of the
    declared type. JSON lines are scanned permissively into a corrupt-record column; of other formats every column is read
    as stored and cast where that is possible. A column that the files do not have is null and no problem. Every row goes
    to one of both.
    """
    declared = T.StructType.fromDDL(schema)
    if file_format == "json":
        # As text first, so that a value of another type is kept as it was written.
        texts = T.StructType([T.StructField(f.name, T.StringType()) for f in declared.fields] + [T.StructField(CORRUPT, T.StringType())])
        lines = spark.read.text(path).where(F.trim("value") != "")
        parsed = lines.withColumn("row", F.from_json("value", texts, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
        stored = parsed.select("row.*", F.col("value").alias("_raw"))
        broken = F.col(CORRUPT).isNotNull()
    else:
        found = spark.read.format(file_format).load(path)
        stored = found.withColumn("_raw", F.to_json(F.struct(*found.columns)))
        broken = F.lit(False)
    typed, wrong = [], []
    for field in declared.fields:
        if field.name not in stored.columns:
            typed.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        own = F.col(field.name)
        nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)) and file_format == "json"
        value = F.from_json(own, field.dataType) if nested else own.try_cast(field.dataType)
        typed.append(value.alias(field.name))
        wrong.append(F.when(own.isNotNull() & value.isNull(), F.lit(field.name)))
    problems = F.when(broken, F.array(F.lit(CORRUPT))).otherwise(F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>"))
    judged = stored.select(*typed, "_raw", problems.alias("_problems"))
    good = judged.where(F.size("_problems") == 0).select(*declared.names)
    return good, judged.where(F.size("_problems") > 0).select(F.col("_raw").alias("raw"), F.col("_problems").alias("problems"))


def load_entities(spark: SparkSession, folder: str, file_format: str = "parquet") -> dict[str, DataFrame]:
    """Every business table found below ``folder``."""
    found = {}
    for name in SCHEMAS:
        try:
            found[name] = load_entity(spark, folder, name, file_format)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def typed_scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet file read with explicit types."""
    return spark.read.schema(schema).parquet(path)
