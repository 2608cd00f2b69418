"""Queries over the stream operators: the stateless ones as a batch, workflow requests as a stream of files."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from dossier.catalog import chunks, register, text, view_sql, workflow  # noqa: F401  (they register views that are used here)
from dossier.operators.pages import build_index_pages
from dossier.plans import documents as flow
from dossier.session import fresh_folder
from dossier.streaming.events import audit_events
from dossier.streaming.transitions import stream_transitions


@register("audit_event_intake", """
    SELECT id, user_id, request_method, array_to_string(list_filter(payload_keys, lambda k: k NOT IN ('password', 'password_confirmation', 'current_password', '_token')), ',') AS payload_keys
    FROM v_audit_events WHERE user_id IS NOT NULL AND request_method NOT IN ('GET', 'HEAD', 'OPTIONS')""")
def _(v):
    return audit_events(v.audit_events()).select("id", "user_id", "request_method", F.array_join("payload_keys", ",").alias("payload_keys"))


# The chunk views over the cleaned index pages instead of the raw ones.
for _name in ("v_paragraphs", "v_pieces", "v_page_chunks"):
    _sql = view_sql.VIEW_SQL[_name]
    for _of in ("v_paragraphs", "v_pieces", "v_pages"):
        _sql = re.sub(rf"\b{_of}\b", "v_clean_pages" if _of == "v_pages" else f"{_of}_clean", _sql)
    view_sql.register_view(f"{_name}_clean", _sql)
view_sql.register_view("v_clean_pages", "SELECT doc_id, page_number, index_text AS text FROM v_index_pages")


@register("document_vectors", """
    SELECT 'documents-acta' AS namespace, 'acta-' || doc_id || '-' || i AS id, CAST(i AS BIGINT) AS chunk_index, text, 64 AS dimension
    FROM (SELECT doc_id, unnest(range(len(texts))) AS i, unnest(texts) AS text FROM v_page_chunks_clean)""")
def _(v):
    pages = v.pages()
    facts = pages.select("doc_id").distinct().selectExpr("doc_id", "'acta' as document_type", "concat('f/', cast(doc_id as string)) as storage_path", "doc_id % 25 as user_id")
    return flow.chunk_vectors(flow.rated_chunks(build_index_pages(pages)), facts).select("namespace", "id", "chunk_index", "text", F.size("values").alias("dimension"))


#: Parts that the requests arrive in, one per micro-batch.
ARRIVALS = 4
#: Requests of one group of entities, on average.
GROUP_REQUESTS = 2000


def arriving_requests(v):
    """The requests with their time and the part in which each arrives: up to half a part's stretch of time too late."""
    times = v.table("events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("requested_at"))
    timed = v.transition_requests().join(times, "seq")
    first, last, count = timed.agg(F.unix_micros(F.min("requested_at")), F.unix_micros(F.max("requested_at")), F.count(F.lit(1))).first()
    stretch = max(1, (last - first) // ARRIVALS) if first is not None else 1
    arrival = F.unix_micros("requested_at") - (first or 0) + F.pmod(F.xxhash64("seq"), F.lit(stretch // 2 + 1))
    return timed.withColumn("file", F.least(F.floor(arrival / stretch), F.lit(ARRIVALS - 1))), stretch, last, count


@register("stream_transitions", "SELECT entity_type, entity_id, seq, from_state, to_state, outcome, next_state AS state, FALSE AS late FROM v_replay")
def _(v):
    requests, stretch, last, count = arriving_requests(v)
    source, target = fresh_folder(v.spark, "requests"), fresh_folder(v.spark, "judged")
    columns = [c for c in requests.columns if c != "file"]
    for file in range(ARRIVALS):
        part = requests.where(F.col("file") == file).select(*columns)
        part.repartition(F.xxhash64("seq")).sortWithinPartitions(F.xxhash64("seq")).write.mode("append").parquet(f"{source}/file={file}")
    # The heartbeat comes after all files and lets all requests before it be judged.
    end = F.timestamp_micros(F.lit(last or 0) + 10 * F.lit(stretch))
    heartbeat = v.spark.range(1).select(*[end.alias(c) if c == "requested_at" else F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in columns])
    heartbeat.write.mode("append").parquet(f"{source}/file={ARRIVALS}")
    # A part is as many files as had tasks to write them, so micro-batches are cut by their share of all files. Requests
    # are late by at most one and a half stretches wherever the cuts fall, and the delay is two.
    files = len(v.spark.read.schema(requests.schema).parquet(source).inputFiles())
    arriving = v.spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", -(-files // ARRIVALS)).parquet(source)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = v.spark.conf.get(provider)
    v.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        judged = stream_transitions(arriving, f"{2 * stretch} microseconds", groups=1 + count // GROUP_REQUESTS)
        query = judged.writeStream.format("parquet").option("checkpointLocation", f"{target}-log").trigger(availableNow=True).start(target)
    finally:
        v.spark.conf.set(provider, before)
    query.awaitTermination()
    return v.spark.read.schema(judged.schema).parquet(target).drop("user_id", "reason")
