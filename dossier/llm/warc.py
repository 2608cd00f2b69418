"""WARC archives: records written and read back, and capture indexes merged from sorted runs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.shared import bounded_batches, fresh_path, written

#: Payloads below this many bytes are stored each time.
LEAST_REVISIT = 100
#: Records in an archive file at most; smaller files come from smaller partitions.
FILE_RECORDS = 10_000
#: Index entries that one merge takes, on average.
RANGE_ROWS = 200_000
CRLF = b"\r\n"


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host labels, then path and query in lower case; scheme, user, port, leading www and fragment go."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "://" in url else f"//{url}")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:  # not a URL: its own text sorts it
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path.rstrip("/") or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages with payload, payload_bytes, payload_digest and refers_to (null for responses).

    Equal payloads of at least ``least`` bytes share a digest; the smallest page_id is stored and the others refer to it.
    Digests are counted before anything is joined, and only digests that occur twice are joined back.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    again = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    joined = rows.join(again.select(F.col("payload_digest").alias("again_digest"), "first_id"), (F.col("payload_digest") == F.col("again_digest")) & (F.col("payload_bytes") >= least), "left")
    return joined.withColumn("refers_to", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))).drop("again_digest", "first_id")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(planned: DataFrame, path: str, captured: Column, file_records: int = FILE_RECORDS) -> None:
    """WARC/1.1 files, gzip-compressed: a response record per stored payload, a revisit record per repeated one.

    Spark's text sink writes them: a row is a record's head and block, and the separator between rows is the two line
    ends that close a record. Lengths are of UTF-8 bytes. Files are the partitions that the plan leaves, cut after
    ``file_records``, so payloads are not dealt out once more. A revisit carries the digest and length of the full payload.
    """
    revisit, stored = F.col("refers_to").isNotNull(), F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean_url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Target-URI", clean_url),
        line("WARC-Date", F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(stored).cast("string")),
        F.lit("\r\n"),
        stored,
    )
    sink = planned.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n")
    sink.option("maxRecordsPerFile", file_records).text(path)


class _Unzipped:
    """Bytes of a gzip file, taken front to back; holds one piece of it at a time."""

    def __init__(self, data: bytes, piece: int = 1 << 20):
        self.data, self.at, self.piece, self.buffer, self.position = data, 0, piece, bytearray(), 0
        self.reader = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at >= len(self.data) and not self.reader.unconsumed_tail:
            return False
        source = self.reader.unconsumed_tail or self.data[self.at : self.at + self.piece]
        if not self.reader.unconsumed_tail:
            self.at += self.piece
        self.buffer += self.reader.decompress(source, self.piece)
        if self.reader.eof and self.reader.unused_data:  # the next member
            rest, self.reader = self.reader.unused_data, zlib.decompressobj(31)
            self.buffer += self.reader.decompress(rest)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end."""
        looked = 0
        while (found := self.buffer.find(mark, looked)) < 0:
            looked = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.position += n
        return out


_FIELD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def records_of(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unzipped file, header fields, block) of every record of a WARC file."""
    source = _Unzipped(data)
    while True:
        offset = source.position
        head = source.until(CRLF + CRLF)
        if head is None:
            return
        fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(head)}
        block = source.take(int(fields["content-length"]))
        source.take(4)
        yield offset, fields, block


ENTRIES = "url_key string, captured string, page_id long, file string, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ENTRY = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records as index entries; the entries of a file are a run, sorted by key, time and page_id.

    Length and digest of a response are taken from its block, those of a revisit from its head. A response whose block
    does not have the digest of its head ends the job: the archive is damaged.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for offset, fields, block in records_of(data):
                number = {k: re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to")}
                number = {k: int(m[1]) if m else None for k, m in number.items()}
                kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                if kind == "response":
                    size = len(block)
                    if hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"{name}: the record at {offset} is damaged")
                rows.append({"url_key": url_key(fields["warc-target-uri"]), "captured": fields["warc-date"], "page_id": number["warc-record-id"], "file": name.rsplit("/", 1)[-1], "offset": offset, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number["warc-refers-to"]})
            rows.sort(key=_place)
            yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY)

    # One file per batch: its compressed bytes are what a task holds.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from each(batch.slice(i, 1))

    return files.mapInArrow(run, ENTRIES)


def _place(entry: dict) -> tuple:
    return entry["url_key"].encode("utf-8", "surrogatepass"), entry["captured"], entry["page_id"] is not None, entry["page_id"] or 0, entry["file"], entry["offset"]


@dataclass
class _Run:
    rows: list
    at: int = 0

    def head(self) -> tuple | None:
        return _place(self.rows[self.at]) if self.at < len(self.rows) else None


def merge_runs(runs: list[list[dict]]) -> Iterator[dict]:
    """Sorted runs merged with a loser tree: each inner node keeps the loser of the match below it, so the next winner
    costs one comparison per level on the path of the run that gave the last one."""
    heads = [_Run(r) for r in runs if r]
    k = len(heads)
    if not k:
        return
    keys = [h.head() for h in heads]

    def beats(a: int, b: int) -> bool:
        return keys[b] is None or (keys[a] is not None and (keys[a], a) < (keys[b], b))

    loser, winner = [0] * k, [0] * k + list(range(k))  # leaves are k..2k-1
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while keys[top] is not None:
        run = heads[top]
        yield run.rows[run.at]
        run.at += 1
        keys[top] = run.head()
        node = (top + k) // 2
        while node:
            if beats(loser[node], top):
                loser[node], top = top, loser[node]
            node //= 2


MERGED = ENTRIES + ", range long, place long"


def _positions(merged: DataFrame) -> DataFrame:
    """One number from zero instead of (range, place): places are shifted by the counts of the ranges before."""
    merged = written(merged, "merged")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = merged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_of_range"))
    return merged.join(offsets, "range").withColumn("position", F.col("offset_of_range") + F.col("place")).drop("range", "place", "offset_of_range")


def merge_index(entries: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Entries of all runs in global order: ``position`` numbers them by URL key, time and page_id.

    ``entries`` is a written table. Cuts between ranges come from a sample of the entries' own order, so a key with very many captures is cut, too. A
    task merges the parts of all runs that fall into its range, about ``range_rows`` entries.
    """
    ranges = max(1, -(-entries.count() // range_rows))
    spread = entries.repartitionByRange(ranges, "url_key", "captured", "page_id").withColumn("range", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list] = {}
        number = 0
        for batch in batches:
            for row in batch.to_pylist():
                number = row["range"]
                runs.setdefault(row["file"], []).append(row)
        for rows in runs.values():  # blocks of a run may arrive in any order
            rows.sort(key=_place)
        merged = ({**row, "place": i} for i, row in enumerate(merge_runs([runs[f] for f in sorted(runs)])))
        schema = pa.schema([*_ENTRY, ("range", pa.int64()), ("place", pa.int64())])
        part = []
        for row in merged:
            part.append({k: row[k] for k in schema.names})
            if len(part) == 4096:
                yield pa.RecordBatch.from_pylist(part, schema=schema)
                part = []
        yield pa.RecordBatch.from_pylist(part, schema=schema)

    return _positions(spread.mapInArrow(run, MERGED))


def archive_pages(pages: DataFrame, captured: Column, path: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files, read them back and merge their indexes: one row per page, with
    its place in the global order of URL key and time.

    Null html is an empty payload. A null page_id is stored as a response unless its payload repeats one with an id, and
    is never referred to. Rows that share the smallest page_id of a payload are all responses. A null URL has the empty
    key. An empty table gives no rows; other columns are ignored. Files stay under ``path``, a fresh folder of the shared
    folder if not given.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(plan_records(pages, least), path, captured)
    return merge_index(written(read_runs(spark, path), "runs"))
