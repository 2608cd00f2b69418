"""Cross-tokenizer alignment: whitespace-token anchors cut documents into windows whose alignment is memoised."""

from __future__ import annotations

import functools
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm.shared import bounded_batches, strings, written
from dossier.llm.tokens import SPECIAL, VOCABULARY, encode

#: The other vocabulary; the first one is that of ``tokens``.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Characters of text after which a block of documents ends. A block names its id pairs by place.
BLOCK_CHARS = 1 << 22
#: Windows remembered by a worker; beyond that it forgets all and goes on, so memory is bounded and results are equal.
WINDOWS = 200_000
#: Between the two id tuples of a window; no vocabulary has this id.
MARK = 0xFFFFFFFF


class Aligner:
    """Both tokenizers, the bytes of their ids, and the alignments of windows seen so far."""

    def __init__(self, vocabulary: str, pieces: str):
        self.vocabulary = vocabulary
        self.exact = Tokenizer.from_file(vocabulary)
        self.exact.encode_special_tokens = True
        self.changes = self.exact.normalizer is not None
        self.other = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_a = _byte_level(self.exact)
        self.bytes_b = _piece_bytes(self.other)
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.spaced_a = np.array([x.startswith(b" ") for x in self.bytes_a])
        self.spaced_b = np.array([x.startswith(b" ") for x in self.bytes_b])
        # Ids as they stand in a list of groups: of A inside and at the end of a group, of B also at the end of the list.
        self.written = [f"{i}{x}".encode() for i in range(len(self.bytes_a)) for x in ",|"]
        self.first_b = len(self.written)
        self.written += [f"{i}{x}".encode() for i in range(len(self.bytes_b)) for x in (",", ";", "")]
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}

    def token_ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``text`` by both tokenizers, or None if the bytes of either are not those of a space and the text."""
        if not text:
            return None
        spaced = " " + text
        data = spaced.encode("utf-8", "surrogatepass")
        b = self.other.encode(text)
        if b"".join([self.bytes_b[i] for i in b]) != data:
            return None
        if SPECIAL in text:
            a = np.array(self.exact.encode(spaced, add_special_tokens=False).ids, dtype=np.int64)
        else:
            a = encode(spaced, self.vocabulary).astype(np.int64)
        # Byte-level tokens are cut from the bytes of the text as they stand; a vocabulary that changes them is found here.
        if int(self.size_a[a].sum()) != len(data) or self.changes and b"".join([self.bytes_a[i] for i in a.tolist()]) != data:
            return None
        return a, np.array(b, dtype=np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int, np.ndarray]:
        """(groups as text, number of groups, links as a << 32 | b) of a document, window by window.

        Windows are cut where tokens of both end and the next token of both starts with a space. One that is remembered
        is not aligned again; the others of the document are aligned together.
        """
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(ends_b, ends_a)
        closes_a = ends_b[at] == ends_a  # a token ends where one of the other side does
        cut_a = np.flatnonzero(closes_a[:-1] & self.spaced_a[a[1:]])
        cut_a = cut_a[self.spaced_b[b[at[cut_a] + 1]]]
        stop_a, stop_b = np.append(cut_a, len(a) - 1) + 1, np.append(at[cut_a], len(b) - 1) + 1
        count_a, count_b, order = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0), np.arange(len(stop_a))
        # The id tuples of each window, packed: those of A, a mark that is no id, those of B.
        packed = np.full(len(a) + len(b) + len(order), MARK, dtype="<u4")
        packed[np.arange(len(a)) + np.repeat(stop_b - count_b + order, count_a)] = a
        packed[np.arange(len(b)) + np.repeat(stop_a + order + 1, count_b)] = b
        ids, stops = packed.tobytes(), (4 * (stop_a + stop_b + order + 1)).tolist()
        keys = [ids[i:j] for i, j in zip([0, *stops], stops, strict=False)]
        known = list(map(self.memo.get, keys))
        if None in known:
            new = np.array([x is None for x in known])
            closes_b = np.zeros(len(b), dtype=bool)
            closes_b[at[closes_a]] = True
            own_a, own_b = np.repeat(new, count_a), np.repeat(new, count_b)
            found = self._aligned(a[own_a], b[own_b], np.flatnonzero(closes_a[own_a]), np.flatnonzero(closes_b[own_b]), np.cumsum(count_a[new]), np.cumsum(count_b[new]))
            if len(self.memo) >= WINDOWS:
                self.memo.clear()
            for i, entry in zip(np.flatnonzero(new).tolist(), found, strict=True):
                known[i] = self.memo[keys[i]] = entry
        texts, links = zip(*known, strict=True)
        text = b";".join(texts)
        return text, text.count(b";") + 1, np.frombuffer(b"".join(links), dtype="<i8")

    def _aligned(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """(groups as text, links as 64-bit numbers) of windows laid end to end, which stop before ``stop_a`` and
        ``stop_b``; the last tokens of their groups are ``last_a`` and ``last_b``."""
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        before_a, before_b = np.repeat(last_b + 1 - in_b, in_a), np.repeat(last_a + 1, in_b)
        # A token stands after the tokens of earlier groups, one of B also after those of A in its own.
        words, form = np.empty(len(a) + len(b), dtype=np.int64), 2 * a
        form[last_a] += 1
        words[np.arange(len(a)) + before_a] = form
        form = self.first_b + 3 * b
        form[last_b] += 1
        form[stop_b - 1] += 1
        words[np.arange(len(b)) + before_b] = form
        text = [self.written[i] for i in words.tolist()]
        times = np.repeat(in_b, in_a)
        total = np.cumsum(times)
        partner = np.repeat(before_a - total + times, times) + np.arange(int(total[-1]))
        links = ((np.repeat(a, times) << 32) | b[partner]).astype("<i8").tobytes()
        to_text, to_link = (stop_a + stop_b).tolist(), (8 * total[stop_a - 1]).tolist()
        for i, j, k, m in zip([0, *to_text], to_text, [0, *to_link], to_link, strict=False):
            yield b"".join(text[i:j]), links[k:m]


def _byte_level(tokenizer: Tokenizer) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary: printable bytes stand for themselves, the rest for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in plain} | {chr(0x100 + n): x for n, x in enumerate(x for x in range(256) if x not in set(plain))}
    out = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i)
        out.append(bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode())
    return out


def _piece_bytes(processor: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of every piece: U+2581 is a space, a byte piece is its byte."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())
    return out


@functools.lru_cache(maxsize=2)
def _aligner(vocabulary: str, pieces: str) -> Aligner:
    return Aligner(vocabulary, pieces)


#: A document row has its pairs as places in the block's list, with how often each is linked. A block's list of pairs, and
#: how many of its documents hold each, is on the block's first row.
ROWS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "places binary, times binary, pairs array<long>, holders array<long>"
)
_ARROW = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
     ("groups_sha256", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))]
)


def aligned_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES, block_chars: int = BLOCK_CHARS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document with its counts, digest of groups and linked id pairs, in blocks of ``block_chars``.

    A block is numbered by its partition and its place there; write the result before reading it twice, as another scan
    may cut partitions elsewhere.
    """
    bounded_batches(docs.sparkSession)

    def block_rows(number: int, ids: list, rows: list[tuple], linked: list[np.ndarray]) -> pa.RecordBatch:
        own = [np.unique(x, return_counts=True) for x in linked]
        pairs, place, holders = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True, return_counts=True)
        cuts = np.cumsum([0, *[len(x) for x, _ in own]])
        places = [place[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        times = [n.astype("<u4").tobytes() for _, n in own]
        more = [None] * (len(ids) - 1)
        columns = [[number] * len(ids), ids, *zip(*rows, strict=True), places, times, [pairs, *more], [holders, *more]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Remembered windows are many small objects without cycles; looking for cycles among them is lost time.
        before = gc.get_threshold()
        gc.set_threshold(1_000_000, *before[1:])
        try:
            yield from rows_of(batches)
        finally:
            gc.set_threshold(*before)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabulary, pieces)
        number, size = TaskContext.get().partitionId() << 32, 0
        ids, rows, linked = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                found = aligner.token_ids(text)
                ids.append(doc_id)
                if found is None:
                    rows.append((0, 0, 0, 0, ""))
                    linked.append(np.empty(0, dtype=np.int64))
                else:
                    groups, n_groups, links = aligner.align(*found)
                    rows.append((len(found[0]), len(found[1]), n_groups, len(links), hashlib.sha256(groups).hexdigest()))
                    linked.append(links)
                size += len(text)
                if size >= block_chars:
                    yield block_rows(number, ids, rows, linked)
                    number, size = number + 1, 0
                    ids, rows, linked = [], [], []
        if ids:
            yield block_rows(number, ids, rows, linked)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, ROWS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a_id, documents, best): in how many documents an id pair is linked, and whether no pair of its A id has more."""
    held = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    counts = held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("documents")).withColumn("a_id", F.shiftright("pair", 32))
    most = counts.groupBy("a_id").agg(F.max("documents").alias("most"))
    return counts.join(most, "a_id").select("pair", "a_id", "documents", (F.col("documents") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES, block_chars: int = BLOCK_CHARS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """How two tokenizers cut every whole text, and how usual their linked ids are in all documents.

    A space and the text are encoded by both. Ends that they share cut the tokens into groups; every A token is linked
    with every B token of its group. Columns: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose id pair is in as
    many documents as any of its A id), count_sum (documents of each link's pair, over links), groups_sha256.

    Full tokenisation comes first. Where tokens of both end and the next of both begins with a space, the document is cut
    into windows of ids, and a window seen before is not aligned again. Documents go in blocks; only a block's distinct
    pairs meet the counts of all documents, and come back to the block by place.

    Texts that are null or empty, or whose token bytes differ from space and text, have zeros and an empty digest. Ids may
    be null or repeated: each row is a document and gives a row. An empty table gives no rows; other columns are ignored.
    """
    blocks = written(aligned_blocks(docs, vocabulary, pieces, block_chars, id_column, text_column), "aligned")
    listed = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair"))
    known = listed.join(pair_counts(blocks).select("pair", "documents", "best"), "pair").select(F.col("block").alias("of"), "place", "documents", "best")
    own = blocks.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")

    def total(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        documents, best = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
        documents[counts["place"].to_numpy()] = counts["documents"].to_numpy()
        best[counts["place"].to_numpy()] = counts["best"].to_numpy()
        n_best, count_sum = [], []
        for places, times in zip(rows["places"], rows["times"], strict=True):
            at, n = np.frombuffer(places, dtype="<u4"), np.frombuffer(times, dtype="<u4").astype(np.int64)
            n_best.append(int(best[at] @ n))
            count_sum.append(int(documents[at] @ n))
        out = rows[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].astype({"doc_id": "Int64"})
        return out.assign(n_best=n_best, count_sum=count_sum)[["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]]

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(total, schema)
