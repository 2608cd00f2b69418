"""Incremental document processing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from dossier.operators.pages import assemble_documents, build_index_pages
from dossier.plans.documents import chunk_vectors, rated_chunks


def epoch_of(checkpoint: str, batch: int) -> str:
    """Name of the epoch of one micro-batch: no other batch of any checkpoint has it, and a repeated batch has it again."""
    return f"s{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{batch}"


def process_batch(folder: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Batch function writing ``pages``, ``chunks``, ``vectors`` and ``documents`` below ``folder``, and then its commit.

    Every micro-batch owns one ``epoch`` partition in each table and overwrites it, so a repeated batch leaves no
    duplicates and a lost executor costs a retry only. Each step reads what the previous one wrote. Readers follow the
    commit records: an epoch without one does not exist for them, and a batch that has one is not run again.
    """

    def run(pages: DataFrame, batch: int) -> None:
        spark, epoch = pages.sparkSession, epoch_of(checkpoint, batch)
        done = commits(spark, folder)
        if done is not None and not done.where(F.col("epoch") == epoch).isEmpty():
            return
        _write(build_index_pages(pages), folder, "pages", epoch)
        cleaned = spark.read.parquet(f"{folder}/pages/epoch={epoch}")
        _write(rated_chunks(cleaned), folder, "chunks", epoch)
        chunks = spark.read.parquet(f"{folder}/chunks/epoch={epoch}")
        facts = cleaned.select("doc_id", "document_type", "storage_path", "user_id").dropDuplicates(["doc_id"])
        _write(chunk_vectors(chunks, facts), folder, "vectors", epoch)
        _write(assemble_documents(cleaned), folder, "documents", epoch)
        commit(spark, folder, epoch)

    return run


def _write(df: DataFrame, folder: str, name: str, epoch: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")


def commits(spark: SparkSession, folder: str) -> DataFrame | None:
    """(sequence, epoch) of every finished epoch below ``folder``; None before the first."""
    try:
        return spark.read.schema("sequence long, epoch string").parquet(f"{folder}/commits")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def commit(spark: SparkSession, folder: str, epoch: str) -> None:
    """Record ``epoch`` as newer than all that are recorded, whichever checkpoint wrote them.

    Streams that commit at the same moment may get equal sequences; the epoch's name decides then, and nothing is lost.
    """
    done = commits(spark, folder)
    newest = done.agg(F.max("sequence")).first()[0] if done is not None else None
    row = [(0 if newest is None else newest + 1,)]
    spark.createDataFrame(row, "sequence long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/epoch={epoch}")


TABLES = ["pages", "chunks", "vectors", "documents"]


def current_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Latest version of every document in a table, by the order of commits.

    The newest epoch is looked up in ``documents``, which has a row even for a document that no longer yields chunks.
    """
    done = commits(spark, folder)
    if done is None:
        raise ValueError(f"no epoch is committed below {folder}")
    known = spark.read.parquet(f"{folder}/documents").select("doc_id", "epoch").join(done, "epoch")
    newest = known.groupBy("doc_id").agg(F.max(F.struct("sequence", "epoch")).alias("last")).select("doc_id", "last.epoch")
    return spark.read.parquet(f"{folder}/{name}").join(newest, ["doc_id", "epoch"])


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Write the current version of every document to ``target`` as one epoch, for streams to go on from there.

    Run it while no stream writes to ``folder``; readers and new streams (with a new checkpoint) then use ``target``, and
    ``folder`` can be dropped. Nothing is changed in place, so a failed run is simply repeated.
    """
    for name in TABLES:
        _write(current_table(spark, folder, name).drop("epoch"), target, name, "compact")
    commit(spark, target, "compact")


def stream_documents(pages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Process a stream of ``(doc_id, page_number, text, document_type, storage_path, user_id)``; all pages of a submission arrive together."""
    return pages.writeStream.foreachBatch(process_batch(folder, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
