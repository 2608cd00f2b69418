"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import bounded_batches, strings

BINS, BITS, WORDS = 256, 4, 5
#: Odd multipliers of the polynomial word hash and of its combination into shingles; any odd numbers do.
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Ranges of doc_id that are dealt out as one sorted run each, at most: the cuts are numbers that every task holds.
RUNS = 16_384
#: Bytes of text in a run, on average, until there are that many. A run is sorted by Spark and read as a stream.
RUN_BYTES = 8_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), base, dtype=np.uint64)))[:n]


def shingle_hashes(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle of ``words`` words; words are runs of anything but ASCII white space.

    A word's hash is a polynomial over its bytes taken from one running sum over the batch; a shingle's combines its
    words'. Texts of fewer words give one shingle of all; texts of none give none.
    """
    data = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    powers = _powers(BASE, len(raw) + 1)
    running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    inverse = _powers(np.uint64(pow(int(BASE), -1, 1 << 64)), len(raw) + 1)
    word = _mix((running[end] - running[start]) * inverse[start])
    doc = np.searchsorted(np.cumsum([len(d) for d in data]), start, side="right")
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(first, len(doc)))
    # Words from each position to its document's end; a shingle starts where enough are left, or at a short text's start.
    left = np.repeat(first + count, count) - np.arange(len(doc))
    begins = np.flatnonzero((left >= words) | (np.repeat(count < words, count) & (left == np.repeat(count, count))))
    mixed = np.zeros(len(begins), dtype=np.uint64)
    for j in range(words):
        at = np.minimum(begins + j, len(word) - 1)
        mixed = mixed * STEP + np.where(left[begins] > j, word[at], np.uint64(j + 1))
    return doc[begins], _mix(mixed)


def _donor(bins: int, tries: int) -> np.ndarray:
    """[attempt, bin]: the bin that an empty one asks next; a hash of attempt and bin, the same for all documents."""
    return (_mix(np.arange(1, tries * bins + 1, dtype=np.uint64) * BASE) % np.uint64(bins)).astype(np.int64).reshape(tries, bins)


def sketches(texts: list[str], words: int = WORDS, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """[document, bin] low-order bits of each bin's least shingle hash, as uint8.

    Every shingle is hashed once; the high part names its bin, the rest is its value. An empty bin asks bins in the order
    of a hash of attempt and bin until one is filled, and copies it. A text without words has all ones in every bin.
    """
    doc, value = shingle_hashes(texts, words)
    table = np.full(len(texts) * bins, EMPTY)
    slot = doc * bins + (value >> np.uint64(40)).astype(np.int64) % bins
    np.minimum.at(table, slot, value & np.uint64((1 << 40) - 1))
    table = table.reshape(len(texts), bins)
    filled = table != EMPTY
    open_doc, open_bin = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out, attempt = table.copy(), 0
    while len(open_doc):
        if attempt % 256 == 0:
            donors = _donor(bins, attempt + 256)[attempt:]
        donor = donors[attempt % 256][open_bin]
        good = filled[open_doc, donor]
        out[open_doc[good], open_bin[good]] = table[open_doc[good], donor[good]]
        open_doc, open_bin, attempt = open_doc[~good], open_bin[~good], attempt + 1
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint8)


def pack_bits(rows: np.ndarray, bits: int = BITS) -> list[str]:
    """Sketch rows as lowercase hex, ``bits`` bits a bin."""
    flat = ((rows[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).reshape(len(rows), -1)
    return [x.tobytes().hex() for x in np.packbits(flat, axis=1)]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated resemblance of sketch rows, 0 to 1: the share of equal bins less what ``bits`` bits share by chance."""
    chance = 1.0 / (1 << bits)
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def fingerprint_documents(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row: ``bins`` bins of ``bits`` bits as hex. Null text counts as empty."""
    bounded_batches(docs.sparkSession, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sketches(strings(batch.column(1)), words, bins, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack_bits(rows, bits), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many code points from the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edits(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text takes its last third from the next document in descending doc_id, the first one following the last.
    Documents are dealt out by ranges of doc_id, each range sorted in one task and read as a stream; the head of the next
    range comes along as one extra row, so a text is shuffled once (the heads twice).

    Null text is empty. Equal ids follow each other by text; a null id comes last. An empty table gives no row; in a table
    of one row the document follows itself. Columns other than doc_id and text are ignored.
    """
    bounded_batches(docs.sparkSession, 128)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    runs = max(1, min(RUNS, (total[1] or 0) // RUN_BYTES, total[0]))
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / runs) for i in range(1, runs)]), 10 * RUNS)).first()[0] if runs > 1 else None
    cuts = sorted(set(cuts or []))
    # Runs are numbered in descending order of doc_id; the last one has the null ids.
    bounds = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("long")
    def run_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(np.int64), side="right"))

    number = run_of(F.coalesce("doc_id", F.lit(0))) if cuts else F.lit(0)
    dealt = docs.withColumn("run", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(number).cast("long"))
    tops = {r["run"]: r["top"] for r in dealt.groupBy("run").agg(F.max("doc_id").alias("top")).collect()}  # one row per run
    order = sorted(tops)
    if not order:
        return docs.sparkSession.createDataFrame([], EDITS)
    before = F.create_map(*[F.lit(x) for run, follower in zip(order, [*order[1:], order[0]], strict=True) for x in (follower, run)])
    is_top = F.lit(False)
    some = [t for t in tops.values() if t is not None]
    if some:
        is_top = F.coalesce(F.col("doc_id").isin(some), F.lit(False))
    if None in tops.values():
        is_top = is_top | F.col("doc_id").isNull()
    heads = dealt.where(is_top).groupBy("run").agg(F.min(F.struct(F.negative("doc_id").alias("rank"), "text")).alias("first"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), F.col("first.text").alias("text"), F.element_at(before, F.col("run")).alias("run"), F.lit(True).alias("ahead"))
    rows = dealt.withColumn("ahead", F.lit(False)).unionByName(heads)
    # A run is a partition: hashing the few numbers would put several into one task.
    rows = rows.repartitionById(max(order) + 1, F.col("run").cast("int")).sortWithinPartitions("run", "ahead", F.desc_nulls_last("doc_id"), "text")
    return rows.select("doc_id", "text", "run", "ahead").mapInArrow(lambda batches: _stream(batches, words, bins, bits), EDITS)


def _stream(batches: Iterator[pa.RecordBatch], words: int, bins: int, bits: int) -> Iterator[pa.RecordBatch]:
    kept = None  # the last row, which still waits for the next
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
        own = sketches([r[1] for r in rows], words, bins, bits)
        if kept is not None:
            rows, own = [kept[0], *rows], np.concatenate([kept[1], own])
        kept = rows[-1], own[-1:]
        at = [i for i in range(len(rows) - 1) if not rows[i][3]]
        if not at:
            continue
        texts = [edited(rows[i][1], rows[i + 1][1]) for i in at]
        new, index = sketches(texts, words, bins, bits), np.array(at)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in at], pa.int64()),
                pa.array([len(rows[i][1]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string()),
                pa.array(pack_bits(own[index], bits), pa.string()),
                pa.array(pack_bits(new, bits), pa.string()),
                pa.array(likeness(own[index], new, bits)),
                pa.array(likeness(own[index], own[index + 1], bits)),
            ],
            names=[c.split()[0] for c in EDITS.split(", ")],
        )
