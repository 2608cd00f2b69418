"""Audit events from a request stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossier.sources.tables import event_rows

# Methods that are not logged and payload keys that never are.
SAFE_METHODS = ["GET", "HEAD", "OPTIONS"]
SECRET_KEYS = ["password", "password_confirmation", "current_password", "_token"]


def audit_events(requests: DataFrame) -> DataFrame:
    """Logged requests: signed in, not a read, payload keys without secrets. Stateless, so batch and stream are the same."""
    secrets = F.array(*[F.lit(k) for k in SECRET_KEYS])
    keys = F.coalesce("payload_keys", F.array().cast("array<string>"))
    return requests.where(F.col("user_id").isNotNull() & ~F.col("request_method").isin(SAFE_METHODS)).withColumn(
        "payload_keys", F.filter(keys, lambda k: ~F.array_contains(secrets, k))
    )


def write_audit_events(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the audit rows of a request stream; the payload key list becomes the metadata."""
    logged = audit_events(requests).withColumn("metadata", F.to_json(F.struct("payload_keys"))).withColumn("event_type", F.lit("http.request"))
    return (
        event_rows(logged).withColumn("day", F.to_date("created_at")).writeStream.format("parquet").partitionBy("day")
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    )
