"""Token counts: flat token files without an index, scanned for end-of-document ids block by block."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.shared import bounded_batches, fresh_path, map_batches, strings, written
from dossier.llm.tokens import VOCABULARY, encode

#: A file is a sequence of little-endian unsigned 16-bit numbers: an id plus one for each token, 0 after each document.
END = 0
#: Numbers per block. A block is one unit of the scan and of the stitching.
BLOCK = 1 << 18


def token_rows(docs: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(kind, data): of each document its numbers as they stand in a token file, without the end mark, and its id as text.

    Null text has no numbers, a null id is empty.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data = [(encode(t, vocabulary) + 1).astype("<u2").tobytes() for t in strings(batch.column(1))]
        ids = [b"" if x is None else b"%d" % x for x in batch.column(0).to_pylist()]
        for kind, values in (("tokens", data), ("ids", ids)):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(values), pa.string()), pa.array(values, pa.binary())], names=["kind", "data"])

    return map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), each, "kind string, data binary")


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Gzip files below ``path`` by Spark's text sink, in one pass: the k-th id of ``kind=ids/part-N`` is that of the k-th
    document of ``kind=tokens/part-N``.

    The sink writes a row's bytes and then the separator, which here is the end mark: two zero bytes. A task keeps both of
    its files open and adds rows as they come, so that nothing is sorted and both have one order, whatever partitions the
    scan makes, now or in a repeated task.
    """
    spark = docs.sparkSession
    rows = token_rows(docs, vocabulary, id_column, text_column)
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "2")
    try:
        values = rows.select("kind", F.col("data").cast("string").alias("value"))
        values.write.option("compression", "gzip").option("lineSep", "\x00\x00").option("maxRecordsPerFile", 0).partitionBy("kind").text(path)
    finally:
        spark.conf.set(writers, before)


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, content) of the files of one kind; an empty table wrote none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("path").contains(f"/kind={kind}/")).select("path", "content")


def file_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, ordinal, doc_id) of every document, from the files of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = zlib.decompress(data.as_py(), 31).split(b"\x00\x00")[:-1]
                ids = pa.array([int(x) if x else None for x in values], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), _part(name))), pa.array(np.arange(len(ids))), ids], names=["part", "ordinal", "doc_id"])

    bounded_batches(spark)
    return _files(spark, path, "ids").mapInArrow(run, "part long, ordinal long, doc_id long")


def _part(name: str) -> int:
    return int(re.search(r"part-(\d+)", name.rsplit("/", 1)[-1])[1])


def _numbers(data: bytes, block: int) -> Iterator[np.ndarray]:
    """Blocks of a gzip file's numbers; holds one block unzipped."""
    reader, rest, at = zlib.decompressobj(31), b"", 0
    while True:
        need = 2 * block - len(rest)
        if not reader.unconsumed_tail and at < len(data):
            source, at = data[at : at + (1 << 20)], at + (1 << 20)
        else:
            source = reader.unconsumed_tail
        part = reader.decompress(source, need) if source else b""
        rest += part
        if len(rest) >= 2 * block:
            yield np.frombuffer(rest[: 2 * block], dtype="<u2")
            rest = rest[2 * block :]
        elif not part and at >= len(data):
            if rest:
                yield np.frombuffer(rest, dtype="<u2")
            return


BLOCKS = "file string, block long, numbers long, ends array<long>"


def scan_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, numbers, ends): the places of the end marks in each block, counted from the block's start.

    The search is one vectorised comparison per block. Blocks know nothing of each other.
    """
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("numbers", pa.int64()), ("ends", pa.list_(pa.int64()))])
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, numbers in enumerate(_numbers(data.as_py(), block)):
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]]), pa.array([k], pa.int64()), pa.array([len(numbers)], pa.int64()), pa.array([np.flatnonzero(numbers == END)], pa.list_(pa.int64()))], schema=schema)

    return _files(spark, path, "tokens").mapInArrow(run, BLOCKS)


def document_counts(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document, from the blocks of ``scan_blocks``.

    A prefix scan over the blocks of a file carries three numbers: where the block starts, how many documents ended
    before it, and where the last of them did. With these each block lists its documents on its own; one that spans
    blocks is counted where it ends. What follows the last end mark of a file is a document without an end and is listed
    with ``ended`` false.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own_start = F.coalesce(F.sum("numbers").over(before), F.lit(0))
    placed = blocks.withColumn("start", own_start)
    placed = placed.withColumn("last", F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1)))
    stitched = placed.withColumn("carry", F.coalesce(F.max("last").over(before), F.lit(-1))).withColumn("ended_before", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    lead = F.concat(F.array("carry"), F.transform("ends", lambda e: e + F.col("start")))
    each = F.transform(F.sequence(F.lit(1), F.size("ends")), lambda i: F.struct((F.col("ended_before") + i - 1).alias("ordinal"), (F.element_at(lead, i.cast("int")) + 1).alias("start"), (F.element_at(lead, (i + 1).cast("int")) - F.element_at(lead, i.cast("int")) - 1).alias("n_tokens")))
    # Blocks are dealt out before they become rows of documents: they are few and small, so Spark would put them together.
    dealt = stitched.where(F.size("ends") > 0).repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "block")
    ended = dealt.select("file", F.explode(each).alias("d")).select("file", "d.ordinal", "d.start", "d.n_tokens", F.lit(True).alias("ended"))
    ends = placed.groupBy("file").agg(F.sum("numbers").alias("numbers"), F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("end"))
    tail = ends.where(F.col("numbers") > F.col("end") + 1).select("file", "ordinal", (F.col("end") + 1).alias("start"), (F.col("numbers") - F.col("end") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(tail)


def count_documents(docs: DataFrame, path: str | None = None, block: int = BLOCK, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens): every document's place and length, read from flat files written for it.

    Ids are written in the same pass as the tokens and laid beside the counts by file and ordinal, so nothing depends on
    how a second scan would be split.

    Null or empty text is a document of no tokens. Null ids stay null, repeated rows are counted each, an empty table gives
    no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_token_files(docs, path, vocabulary)
    counts = document_counts(written(scan_blocks(spark, path, block), "blocks"))
    counts = counts.withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
    return file_ids(spark, path).join(counts, ["part", "ordinal"], "left").select("doc_id", "file", "ordinal", "start", "n_tokens")
