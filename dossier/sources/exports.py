"""Export writers. Rows of all validations go to sorted files; a table from validation to file finds one of them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.audit import EXPORT_HEADER

_SHEET = ["documento", "gravedad", "error", "propuesta_solucion"]
_ORDER = ["validation_id", "part", "pos"]
#: Rows of one file.
FILE_ROWS = 1 << 20


def sheet_rows(rows: DataFrame) -> DataFrame:
    """Rows of the four-column sheet with what places them: validation and order."""
    titled = [F.col(c).alias(title) for c, title in zip(_SHEET, EXPORT_HEADER)]
    return rows.select(*_ORDER, *titled)


def bundle_rows(reports: DataFrame, findings: DataFrame, structured: DataFrame, summary: DataFrame) -> DataFrame:
    """The bundle as JSON documents: (part, validation_id, document), absent values written as null."""
    parts = {"report": reports, "findings": findings, "structured_findings": structured, "summary": summary}
    out = None
    for name, table in parts.items():
        document = F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"})
        rows = table.select(F.lit(name).alias("part"), "validation_id", document.alias("document"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _write(rows: DataFrame, order: list[str], path: str, file_format: str, file_rows: int) -> None:
    """Sorted files of about ``file_rows`` rows, as many as the rows need, and beside them the index that says which files
    hold which validation. Ranges are cut inside a large validation, too."""
    spark = rows.sparkSession
    files = max(1, -(-rows.count() // file_rows))
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).format(file_format).save(path)
    placed = spark.read.option("header", True).format(file_format).load(path).select(F.col("validation_id").cast("long").alias("validation_id"), F.col("_metadata.file_name").alias("file"))
    placed.distinct().repartitionByRange(max(1, files // 64), "validation_id").sortWithinPartitions("validation_id").write.mode("overwrite").parquet(f"{path}-index")


def export_findings(rows: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """CSV sheets in the order of validations."""
    _write(sheet_rows(rows), _ORDER, path, "csv", file_rows)


def export_bundle(reports: DataFrame, findings: DataFrame, structured: DataFrame, summary: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Report, findings, structured findings and summary as JSON documents in the order of validations."""
    _write(bundle_rows(reports, findings, structured, summary), ["validation_id", "part", "document"], path, "parquet", file_rows)


def one_validation(spark: SparkSession, path: str, validation_id: int, file_format: str = "csv") -> DataFrame:
    """The exported rows of one validation; reads the files that the index names and no others."""
    wanted = F.lit(validation_id).cast("long")
    files = [r["file"] for r in spark.read.parquet(f"{path}-index").where(F.col("validation_id") == wanted).select("file").collect()]
    reader = spark.read.option("header", True).option("inferSchema", False).format(file_format)
    if not files:
        return reader.load(path).limit(0)
    return reader.load([f"{path}/{name}" for name in files]).where(F.col("validation_id").cast("long") == wanted)
