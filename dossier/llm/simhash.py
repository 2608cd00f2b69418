"""SimHash near-duplicates: fingerprints compared exactly, tile against tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm import components
from dossier.llm.shared import map_batches, strings, written

SEED = 42
#: Fingerprints in a tile, on average: 128 KB. A pair of tiles is one unit of work.
TILE_ROWS = 16_384
#: Rows of a tile compared at once; bounds the memory of one comparison to a few MB.
STRIP = 64


def fingerprint(text: str, words: int = 4) -> int:
    """64-bit SimHash of a text's word shingles; a bit is one if over half of the shingle hashes have it.

    A-Z is lower-cased, words are runs of anything but space and \\x09-\\x0D, shingles are XXH64 of the space-joined
    words. Fewer words than a shingle give one shingle of all; no word gives zero.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed long."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = np.array([fingerprint(t, words) for t in strings(batch.column(1))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), each, "doc_id long, fp long")


def _forest(first: np.ndarray, second: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles (or inside one), thinned to one star per connected group: nothing that the links connect
    is lost, and a tile pair gives fewer links than it has rows however many pairs match."""
    one = second is None
    rows = first if one else np.concatenate([first, second])
    other, shift = (first, 0) if one else (second, len(first))
    low_first, low_other = (np.bitwise_count(x & np.uint64(0xFFFFFFFF)).astype(np.int16) for x in (first, other))
    high_first, high_other = (np.bitwise_count(x >> np.uint64(32)).astype(np.int16) for x in (first, other))
    label = np.arange(len(rows))
    order = np.lexsort((high_other, low_other))
    # Inside a tile, parts with other counts in the low or high half are skipped by the same rule as whole tiles.
    keys = low_other[order].astype(np.int32) * 64 + high_other[order]
    bounds = np.append(np.flatnonzero(np.diff(keys, prepend=-1)), len(keys))
    parts = [(int(low_other[order[a]]), int(high_other[order[a]]), order[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for low, high in np.unique(np.stack([low_first, high_first], axis=1), axis=0).tolist():
        mine = np.flatnonzero((low_first == low) & (high_first == high))
        near = [ids for lo, hi, ids in parts if abs(lo - low) + abs(hi - high) <= radius]
        if not near:
            continue
        near = np.concatenate(near)
        for at in range(0, len(mine), STRIP):
            strip = mine[at : at + STRIP]
            hit = np.bitwise_count(first[strip, None] ^ other[near][None, :]) <= radius
            for i in np.flatnonzero(hit.sum(axis=1) > (1 if one else 0)).tolist():
                joined = np.unique(np.append(label[near[hit[i]] + shift], label[strip[i]]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
    moved = np.flatnonzero(label != np.arange(len(rows)))
    return rows[moved], rows[label[moved]]


def links(distinct: DataFrame, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints (``fp``, distinct) at most ``radius`` bits apart.

    A tile holds fingerprints of one population count, about ``tile_rows`` of them. Two tiles meet only if their counts
    differ by at most ``radius``; a meeting is one row per tile, keyed by the pair, and compared with exclusive-or and
    bit counts in numpy. What the driver reads is the number of fingerprints per population count: at most 65 rows.
    """
    ones = distinct.withColumn("ones", F.bit_count("fp").cast("int"))
    buckets = {r["ones"]: max(1, -(-r["n"] // tile_rows)) for r in ones.groupBy("ones").agg(F.count("*").alias("n")).collect()}
    if not buckets:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    number = F.create_map(*[F.lit(x) for pair in sorted(buckets.items()) for x in pair])
    tiles = written(
        ones.withColumn("bucket", F.pmod(F.xxhash64("fp"), F.element_at(number, F.col("ones"))).cast("int")).groupBy("ones", "bucket").agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    me = F.struct("ones", "bucket")
    pairs = (
        tiles.withColumn("near", F.explode(F.sequence(F.col("ones") - radius, F.col("ones") + radius)))
        .withColumn("near_buckets", F.try_element_at(number, F.col("near")))
        .where("near_buckets is not null")
        .withColumn("near_bucket", F.explode(F.sequence(F.lit(0), F.col("near_buckets") - 1)))
        .withColumn("other", F.struct(F.col("near").alias("ones"), F.col("near_bucket").alias("bucket")))
        .select(F.least(me, F.col("other")).alias("low"), F.greatest(me, F.col("other")).alias("high"), (me == F.least(me, F.col("other"))).alias("is_low"), "fps")
    )

    def compare(pair: pa.Table) -> pa.Table:
        sides = [np.asarray(x.values, dtype=np.int64).view(np.uint64) for x in pair.sort_by([("is_low", "descending")]).column("fps")]
        a, b = _forest(sides[0], sides[1] if len(sides) > 1 else None, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return pairs.groupBy("low", "high").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, tile_rows: int = TILE_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Rows with equal fingerprints are one node; nodes at most ``radius`` bits apart are linked (``links``), and
    component_id is the smallest doc_id of a row that links reach, its own included. Null or blank text has fingerprint
    zero, linked like any other. A null doc_id stays null and never names a component (null if it has no other). Repeated
    rows each get a row. Empty tables give no rows; columns other than the two named are ignored.
    """
    prints = written(fingerprints(docs, words, id_column, text_column), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components.roots(links(nodes.select("fp"), radius, tile_rows))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
