"""Exact top-k by inner product: descending lengths, rotated partial sums, Cauchy-Schwarz bounds on the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.shared import bounded_batches, written

#: Factor before rounding down to whole numbers.
SCALE = 1024
#: Queries that a task holds at once, and candidates of one strip: what a task needs of memory.
QUERY_ROWS, STRIP_ROWS = 4_096, 32_768
#: Candidates compared at once, longest first.
CHUNK = 512
#: Share of the rotated dimensions in the partial sum.
HEAD = 0.25
#: Whole numbers up to here are exact in a double.
EXACT = 2**53


def whole_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>, dim) of the vectors that take part: not null, no null or non-finite component.

    Whole numbers are floors of doubles, so that doubles hold them exactly at any size; scores of long vectors are summed
    in Python's whole numbers. Components beyond a long after scaling are cut to it: no score of theirs would fit a long."""
    x = F.col(vector_column)
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    inside = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return table.where(F.coalesce(inside, F.lit(False)) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), scaled.cast("array<bigint>").alias("v"), F.size(x).alias("dim"))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors of length ``dim``, strongest first, from the sum of their outer products.

    Each batch adds its outer products; the driver reads one ``dim`` x ``dim`` matrix per partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([[float(c) for c in total.ravel()]], pa.list_(pa.float64()))], names=["gram"])

    grams = vectors.where(F.col("dim") == dim).select("v").mapInArrow(run, "gram array<double>")
    at = F.posexplode("gram").alias("at", "x")
    sums = grams.select(at).groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at").x.to_numpy()
    if not len(sums):
        return np.eye(dim)
    return np.linalg.eigh(sums.reshape(dim, dim))[1][:, ::-1]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def best_of_strip(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, turn: np.ndarray, known: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's ``k`` highest scores among the candidates, ties to the smaller id.

    Candidates go by descending length. A chunk is skipped for a query whose k-th score is above the product of its length
    and the chunk's greatest; else a pair survives if its partial sum over the first rotated dimensions plus the product
    of both residual lengths reaches that score. Survivors are scored in whole numbers. Bounds are raised by more than the
    rounding of doubles, and only what is strictly below goes, so ties are kept. ``known``: a score per query below which
    no candidate is wanted.
    """
    dim = q.shape[1]
    head = max(1, int(dim * HEAD)) if dim else 0
    length_c, length_q = np.sqrt((c * c).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    order = np.argsort(-length_c, kind="stable")
    cid, c, length_c = cid[order], c[order], length_c[order]
    rc, rq = c @ turn, q @ turn
    rest_c, rest_q = np.sqrt((rc[:, head:] ** 2).sum(axis=1)), np.sqrt((rq[:, head:] ** 2).sum(axis=1))
    # Doubles hold every partial sum exactly up to 2**53; longer vectors are scored in Python's whole numbers.
    exact = not len(c) or not len(q) or float(length_c.max()) * float(length_q.max()) < EXACT
    best_score = [np.empty(0, dtype=object if not exact else np.int64) for _ in qid]
    best_id = [np.empty(0, dtype=np.int64) for _ in qid]
    floor = np.full(len(qid), -np.inf) if known is None else known.copy()
    for at in range(0, len(c), CHUNK):
        to = slice(at, at + CHUNK)
        slack = 1e-9 * length_q * length_c[at] + 1e-6
        live = np.flatnonzero(length_q * length_c[at] + slack >= floor)
        if not len(live):
            break
        bound = rq[live, :head] @ rc[to, :head].T + rest_q[live, None] * rest_c[None, to]
        keep = (bound + slack[live, None] >= floor[live, None]) & (qid[live, None] != cid[None, to])
        for row in np.flatnonzero(keep.any(axis=1)).tolist():
            i, hits = int(live[row]), np.flatnonzero(keep[row]) + at
            if exact:
                scores = np.rint(c[hits] @ q[i]).astype(np.int64)
            else:
                mine = [int(x) for x in q[i]]
                scores = np.array([sum(int(x) * y for x, y in zip(v, mine, strict=True)) for v in c[hits]], dtype=object)
            scores, ids = np.concatenate([best_score[i], scores]), np.concatenate([best_id[i], cid[hits]])
            top = np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k]) if not exact else np.lexsort((ids, -scores))[:k]
            best_score[i], best_id[i] = scores[top], ids[top]
            if len(top) == k:
                floor[i] = max(floor[i], float(best_score[i][-1]))
    return [(int(a), int(b), int(s)) for a, scores, ids in zip(qid, best_score, best_id, strict=True) for b, s in zip(ids, scores, strict=True)]


def _length() -> Column:
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def strips_by_length(candidates: DataFrame, strip_rows: int) -> DataFrame:
    """Candidates with their length and the strip that they are in: a range of about ``strip_rows`` of equal dimension, the
    longest first. Equal lengths are cut by a hash of the id. Written, as the cuts come from a sample."""
    strips = max(1, -(-candidates.count() // strip_rows))
    ranged = candidates.withColumn("length", _length()).repartitionByRange(strips, F.asc("dim"), F.desc("length"), F.xxhash64("vec_id"))
    return written(ranged.withColumn("strip", F.spark_partition_id()), "strips")


def wanted_strips(asked: DataFrame, tops: DataFrame) -> DataFrame:
    """Queries beside every strip of their dimension whose longest vector may reach their score so far: a product of
    lengths below it (Cauchy-Schwarz) rules out all of the strip."""
    reach = F.col("length") * F.col("longest")
    return asked.join(tops, "dim").where(reach * (1 + 1e-9) + 1e-6 >= F.col("floor"))


def top_inner_products(queries: DataFrame, candidates: DataFrame, k: int = 10, strip_rows: int = STRIP_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Each query's ``k`` highest inner products among the candidates: (query_id, rank from 1, vec_id, score).

    Both tables come from ``whole_vectors``. Candidates are cut into strips by descending length. All queries meet the
    strip of the longest vectors first; their k-th scores then say which other strips can still matter to them. Queries
    are put into blocks by how far they must look, and only blocks and strips that must meet are brought together, each
    meeting in a task of bounded size. A strip gives at most ``k`` rows per query, and the best of all strips win.

    Ties go to the smaller vec_id; rows with the query's own id never count. Vectors meet those of their own dimension
    only; an empty vector scores 0. Repeated candidates each count, as do repeated queries' answers once per query id. A
    query without a partner gives no row.
    """
    spark = queries.sparkSession
    bounded_batches(spark, 2_048)
    queries = queries.dropDuplicates(["vec_id", "v"])
    dims = [r["dim"] for r in queries.select("dim").distinct().collect()]  # different vector lengths: a property of models
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    candidates = candidates.where(F.col("dim").isin(dims))
    turns = spark.sparkContext.broadcast({dim: rotation(candidates, dim) if dim else np.eye(0) for dim in dims})
    strips = strips_by_length(candidates, strip_rows)
    tops = strips.groupBy("dim", "strip").agg(F.max("length").alias("longest"))
    first = tops.groupBy("dim").agg(F.min("strip").alias("strip"))
    asked = queries.withColumn("length", _length())
    blocks = max(1, -(-asked.count() // query_rows))

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        dim, mask, ids = group.column("dim")[0].as_py(), np.asarray(group.column("is_query")), np.asarray(group.column("vec_id"))
        v = np.asarray(pa.concat_arrays([c.flatten() for c in group.column("v").chunks]), dtype=np.float64).reshape(len(ids), dim)
        floor = np.asarray(group.column("floor"), dtype=np.float64)
        found = best_of_strip(ids[mask], v[mask], ids[~mask], v[~mask], k, turns.value[dim], floor[mask]) if mask.any() and not mask.all() else []
        top = np.iinfo(np.int64).max
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([max(-top, min(top, f[2])) for f in found], pa.int64())})

    def met(asks: DataFrame, others: DataFrame) -> DataFrame:
        """What the strips of ``others`` give to ``asks`` (with block and strip); strips go to the blocks that ask for them."""
        columns = ["dim", "block", "strip", "is_query", "vec_id", "v", "floor"]
        meetings = asks.select("dim", "strip", "block").distinct()
        sides = others.join(meetings, ["dim", "strip"]).withColumn("is_query", F.lit(False)).withColumn("floor", F.lit(0.0))
        both = asks.withColumn("is_query", F.lit(True)).select(*columns).unionByName(sides.select(*columns))
        return both.groupBy("dim", "block", "strip").applyInArrow(search, "query_id long, vec_id long, score long")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    opening = asked.join(first, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("floor", F.lit(float("-inf")))
    begun = written(met(opening, strips.join(first, ["dim", "strip"], "left_semi")), "opening")
    reached = begun.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    told = asked.join(reached, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    by_reach = told.repartitionByRange(blocks, F.asc("dim"), F.col("floor") / F.greatest("length", F.lit(1e-9)), F.xxhash64("vec_id"))
    placed = written(by_reach.withColumn("block", F.spark_partition_id()), "asked")
    rest = tops.join(first, ["dim", "strip"], "left_anti")
    found = begun.unionByName(met(wanted_strips(placed, rest), strips))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
