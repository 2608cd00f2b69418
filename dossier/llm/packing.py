"""Packing: bounded-space online packing of token sequences into windows."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import bounded_batches, strings, written
from dossier.llm.tokens import VOCABULARY, encode

PIECE = "struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>"
SEQUENCES = f"sequence_id long, part long, full boolean, n_tokens int, ids binary, pieces array<{PIECE}>"
PIECE_TYPE = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "offset")])
ARROW = pa.schema([("sequence_id", pa.int64()), ("part", pa.int64()), ("full", pa.bool_()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("pieces", pa.list_(PIECE_TYPE))])
#: Partitions, or groups of them, whose leftovers meet in one task.
FAN_IN = 16
#: Bits of a sequence id for the number inside its part, and for the part; the round is above them.
NUMBER_BITS, PART_BITS = 28, 28


class Packer:
    """At most ``spaces`` open windows. A piece goes where it leaves the least room; if it fits nowhere and all windows are
    open, the fullest one is filled up with its first ids and emitted, so that only leftovers are ever padded."""

    def __init__(self, window: int, spaces: int):
        self.window, self.spaces = window, spaces
        self.open: list[tuple[int, int, list]] = []  # room left, arrival number, pieces; sorted
        self.count, self.done = 0, []

    def put(self, item: list[tuple]) -> None:
        """``item``: pieces (doc_id, start, ids, doc_tokens) that stay together where they fit."""
        size = sum(len(p[2]) for p in item)
        while size >= self.window:
            head, item = split(item, self.window)
            self.done.append(head)
            size -= self.window
        if not size:
            return
        at = bisect.bisect_left(self.open, (size, -1))
        if at == len(self.open) and len(self.open) == self.spaces:
            room, _, pieces = self.open.pop(0)
            head, item = split(item, room)
            self.done.append(pieces + head)
            size -= room
            at = len(self.open)
        if at < len(self.open):
            room, _, pieces = self.open.pop(at)
            pieces, room = pieces + item, room - size
        else:
            pieces, room = list(item), self.window - size
        if room:
            self.count += 1
            bisect.insort(self.open, (room, self.count, pieces), key=lambda x: x[:2])
        else:
            self.done.append(pieces)

    def take_done(self) -> list[list]:
        done, self.done = self.done, []
        return done

    def take_open(self) -> list[list]:
        left, self.open = [pieces for *_, pieces in self.open], []
        return left


def split(item: list[tuple], size: int) -> tuple[list, list]:
    """The first ``size`` ids of the pieces, and the rest."""
    head, rest = [], []
    for doc, start, ids, total in item:
        cut = min(len(ids), size)
        size -= cut
        if cut:
            head.append((doc, start, ids[:cut], total))
        if cut < len(ids):
            rest.append((doc, start + cut, ids[cut:], total))
    return head, rest


def _batch(windows: list[list], full: bool, level: int, part: int, first: int) -> pa.RecordBatch:
    rows = []
    for number, window in enumerate(windows, first):
        offset, pieces = 0, []
        for doc, start, ids, total in window:
            pieces.append({"doc_id": doc, "start": start, "length": len(ids), "doc_tokens": total, "offset": offset})
            offset += len(ids)
        name = (level << (NUMBER_BITS + PART_BITS)) | (part << NUMBER_BITS) | number
        rows.append({"sequence_id": name, "part": part, "full": full, "n_tokens": offset, "ids": b"".join(ids.tobytes() for _, _, ids, _ in window), "pieces": pieces})
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def _items(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Leftover windows as items to pack again."""
    for data, pieces in zip(batch.column("ids").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
        ids = np.frombuffer(data, dtype="<u4")
        yield [(p["doc_id"], p["start"], ids[p["offset"] : p["offset"] + p["length"]], p["doc_tokens"]) for p in pieces]


def pack_documents(
    docs: DataFrame, window: int = 1024, spaces: int = 64, end_id: int = 0, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Sequences of at most ``window`` token ids: sequence_id, n_tokens, ids (little-endian uint32), pieces (in order).

    Each partition tokenizes its documents (ids of the text, then ``end_id``), cuts full windows off long ones and keeps
    ``spaces`` open windows for the rest: best fit first; when nothing fits, the fullest is filled up and emitted. The
    windows still open at the end meet those of ``FAN_IN`` other partitions under the same rule, and those leftovers
    again, until one group is left, which joins its last windows end to end. Only metadata and open windows are held: a
    task keeps ``spaces`` windows, a merge ``FAN_IN * spaces``. Every sequence but the very last one is full.

    Null text counts as empty (one piece with the end id). Null ids stay null; repeated rows are packed each. An empty
    table gives no sequence. Columns other than the two named are ignored.
    """
    bounded_batches(docs.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, n = TaskContext.get().partitionId(), Packer(window, spaces), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids = np.append(encode(text, vocabulary), np.uint32(end_id)).astype("<u4")
                packer.put([(doc, 0, ids, len(ids))])
                if len(packer.done) >= 512:
                    done = packer.take_done()
                    yield _batch(done, True, 0, part, n)
                    n += len(done)
        done, left = packer.take_done(), packer.take_open()
        yield _batch(done, True, 0, part, n)
        yield _batch(left, False, 0, part, n + len(done))

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    table = written(source.mapInArrow(first, SEQUENCES), "packed")
    sequences, left, level = table.where("full"), table.where(~F.col("full")), 0
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level, parts, last = level + 1, -(-parts // FAN_IN), parts <= FAN_IN
        table = written(left.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("part").applyInArrow(_merge(window, spaces, level, last), SEQUENCES), "packed")
        sequences = sequences.unionByName(table.where("full"))
        if last:
            return sequences.select("sequence_id", "n_tokens", "ids", "pieces")
        left = table.where(~F.col("full"))


def _merge(window: int, spaces: int, level: int, last: bool):
    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("sequence_id").combine_chunks()
        part, packer = group.column("part")[0].as_py(), Packer(window, spaces)
        for batch in group.to_batches():
            for item in _items(batch):
                packer.put(item)
        done, left = packer.take_done(), packer.take_open()
        if last:
            rest = [piece for pieces in left for piece in pieces]
            left = []
            while rest:
                head, rest = split(rest, window)
                done.append(head)
        return pa.Table.from_batches([_batch(done, True, level, part, 0), _batch(left, False, level, part, len(done))])

    return merge


def piece_rows(sequences: DataFrame) -> DataFrame:
    """One row per piece, read back from the packed sequences, with the checksum of the ids found there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data, pieces in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "ids", "pieces")), strict=True):
                for p in pieces:
                    crc = zlib.crc32(data[4 * p["offset"] : 4 * (p["offset"] + p["length"])])
                    rows.append({k: p[k] for k in ("doc_id", "start", "length")} | {"ids_crc32": crc, "doc_tokens": p["doc_tokens"], "sequence_id": name, "offset": p["offset"]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]))

    bounded_batches(sequences.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return sequences.select("sequence_id", "ids", "pieces").mapInArrow(run, schema)
