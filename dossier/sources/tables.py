"""Index table upsert, trace log and audit log."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.ranking import top_per_key
from dossier.sources.buckets import BucketTable

INDEX_KEY = ["documentable_type", "documentable_id"]
_FROM_INCOMING = ["user_id", "document_type", "storage_disk", "storage_path"]


def upsert_document_index(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Index table after a batch of submissions: one row per document, the last submission (by ``seq``) wins.

    A submission resets status and error and keeps what is stored about the text; other rows stay as they are.
    """
    last = top_per_key(incoming, INDEX_KEY, [F.desc("seq")]).select(
        *INDEX_KEY, *[F.col(c).alias(f"_{c}") for c in _FROM_INCOMING], F.lit(True).alias("_new")
    )
    joined = current.join(last, INDEX_KEY, "full_outer")
    new = F.col("_new").isNotNull()
    for c in _FROM_INCOMING:
        joined = joined.withColumn(c, F.when(new, F.col(f"_{c}")).otherwise(F.col(c)))
    joined = joined.withColumn("status", F.when(new, "pending").otherwise(F.col("status")))
    joined = joined.withColumn("error_message", F.when(~new, F.col("error_message")))
    return joined.select(*current.columns)


def change_document_index(table: BucketTable, incoming: DataFrame) -> list[int]:
    """:func:`upsert_document_index` on a stored index with keys ``INDEX_KEY``: only buckets of the submissions are written."""
    return table.change(incoming, upsert_document_index)


def append_trace(steps: DataFrame, path: str, run: str | None = None) -> None:
    """Add the processing steps ``(doc_id, seq, at, step, status, final)`` of one run to the trace log.

    A run owns a folder of the log and writes it as a whole, so a repeated job with the same ``run`` adds nothing. Without
    a name the run is a new one.
    """
    steps.write.mode("overwrite").parquet(_run_folder(path, run))


def _run_folder(path: str, run: str | None) -> str:
    """Folder of a run; the letter keeps names that look like numbers or dates text."""
    return f"{path}/run=r-{quote(run or uuid.uuid4().hex, safe='')}"


def trace_reference(steps: DataFrame) -> DataFrame:
    """Summary per document: steps, status (``running`` until finalised), last update and completion."""
    final = F.coalesce("final", F.lit(False))
    return steps.groupBy("doc_id").agg(
        F.count_if(~final).alias("step_count"),
        F.coalesce(F.max_by(F.when(final, F.col("status")), F.when(final, F.col("seq"))), F.lit("running")).alias("status"),
        F.max("at").alias("updated_at"),
        F.max(F.when(final, F.col("at"))).alias("completed_at"),
    )


def latest_step(steps: DataFrame) -> DataFrame:
    """The newest step per document."""
    return top_per_key(steps, ["doc_id"], [F.desc("seq")])


EVENT_TYPES = {
    "user_id": "bigint", "event_type": "string", "entity_type": "string", "entity_id": "bigint", "request_method": "string", "status_code": "bigint",
    "metadata": "string", "created_at": "timestamp",
}


def event_rows(df: DataFrame) -> DataFrame:
    """Rows in the shape of the audit log, with its types; absent columns become null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in EVENT_TYPES.items()])


def append_events(df: DataFrame, path: str, run: str | None = None) -> None:
    """Add the events of one run to the audit log, by day; a repeated job with the same ``run`` adds nothing."""
    event_rows(df).withColumn("day", F.to_date("created_at")).write.mode("overwrite").partitionBy("day").parquet(_run_folder(path, run))
