"""Mixing sources to target weights: subset-sum budget fitting over exact document lengths."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.shared import word_count, written

#: Slices by seeded hash within (source, length); only the slice in which a budget ends is ranked.
SLICES = 64


def _rank_sources(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weight of each source by its place in code point order, null last.

    Places come from a range sort plus the row counts of its partitions, so no task sees all sources.
    """
    spark, names = sizes.sparkSession, sizes.columns
    ordered = written(sizes.orderBy(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return sizes.withColumn("weight", F.lit(1))
    offset, pairs = 0, []
    for part in sorted(counts):
        pairs += [F.lit(part), F.lit(offset)]
        offset += counts[part]
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1 + F.element_at(F.create_map(*pairs), F.col("part"))
    choice = F.array(*[F.lit(w) for w in weights])
    return ordered.withColumn("weight", F.element_at(choice, (place % len(weights) + 1).cast("int"))).select(*names, "weight")


def source_targets(sizes: DataFrame, share: Fraction = Fraction(3, 2), cap: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Target of each source: (source, source_size, target) from (source, source_size).

    ``share`` of all sizes is dealt out by weight; a target stops at ``cap`` times its source's size and the excess is
    dealt again to the others, until none is above. Every round is one aggregate over the sources.
    """
    ranked = written(_rank_sources(sizes, weights), "ranked")
    total, weight = ranked.agg(F.coalesce(F.sum(F.col("source_size").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget, rest, rest_weight, capped = share * int(total), share * int(total), int(weight), 0
    level = F.lit(0.0)
    while rest_weight:
        level = F.lit(float(rest / rest_weight))
        # cap * size < weight * rest / rest_weight, in whole numbers
        over = F.col("source_size").cast("decimal(38,0)") * (cap * rest_weight * rest.denominator) < F.col("weight") * F.lit(rest.numerator).cast("decimal(38,0)")
        n, size, lost = ranked.where(over).agg(F.count("*"), F.coalesce(F.sum(F.col("source_size").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == capped:
            break
        capped, rest, rest_weight = n, budget - cap * int(size), int(weight) - int(lost)
    return ranked.select("source", "source_size", F.least(level * F.col("weight"), (F.col("source_size") * cap).cast("double")).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to ``budget``, or as near below as can be.

    Most of the budget goes to all lengths in proportion; what then remains is less than the sum of the lengths, is
    filled from the longest length down while it is above twice the longest, and is met by bounded-knapsack dynamic
    programming over the documents still free, counts cut into powers of two.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    rest, longest = budget - int((take * lengths).sum()), int(lengths.max())
    for i in np.argsort(-lengths, kind="stable").tolist():
        if rest <= 2 * longest:
            break
        if lengths[i]:
            more = min(int(counts[i] - take[i]), (rest - 2 * longest) // int(lengths[i]))
            take[i], rest = take[i] + more, rest - more * int(lengths[i])
    reached = np.zeros(rest + 1, dtype=bool)
    reached[0] = True
    by, steps = np.full(rest + 1, -1, dtype=np.int32), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        free, copies = int(counts[i] - take[i]), 1
        if not 0 < lengths[i] <= rest:
            continue
        free = min(free, rest // int(lengths[i]))
        while free and not reached[rest]:
            n = min(copies, free)
            size = n * int(lengths[i])
            if size <= rest:
                new = np.flatnonzero(reached[: rest + 1 - size] & ~reached[size:]) + size
                by[new], reached[new] = len(steps), True
                steps.append((i, n, size))
            free, copies = free - n, copies * 2
        if reached[rest]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n, size = steps[by[at]]
        take[i] += n
        at -= size
    return take


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix_documents(
    docs: DataFrame, share: Fraction = Fraction(3, 2), cap: int = 2, weights: tuple[int, ...] = (5, 2, 1), seed: int = 42, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source"
) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for every document.

    A document's size is its number of words. Each source's target (``source_targets``) gives every document of it the
    same number of whole copies and fits the remaining budget exactly where a subset of lengths can (``fit_counts``). Which
    documents of a length take one copy more is decided by a seeded hash of the id, so reruns agree; they are counted by
    slices of that hash first, and only the slice where the count ends is ranked. ``copies`` is at most ``cap``.

    Null text has size 0 and is never repeated beyond the copies of its source. A null source is a source, last in order.
    Equal ids are separate rows; equal rows are interchangeable. An empty table gives no rows. Columns other than the
    three named are ignored.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), word_count(text_column).alias("size"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = written(rows.withColumn("slice", F.pmod("order", F.lit(SLICES)).cast("int")), "sizes")
    slices = written(rows.groupBy("source", "size", "slice").agg(F.count("*").alias("n")), "slices")
    lengths = slices.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = written(source_targets(sizes, share, cap, weights), "targets").withColumnRenamed("source", "target_source")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ignore_index=True)
        target, size = Fraction(group.target.iloc[0]), int(group.source_size.iloc[0])
        budget = round(target)
        copies = min(cap, budget // size) if size else 0
        more = fit_counts(group["size"].to_numpy(), group.n.to_numpy(), budget - copies * size if copies < cap else 0)
        return pd.DataFrame({"source": group.source, "size": group["size"], "source_size": size, "target": float(target), "copies": copies, "more": more})

    plan = lengths.join(targets, _same_source("source", "target_source")).drop("target_source")
    plan = plan.groupBy("source").applyInPandas(fit, "source string, size long, source_size long, target double, copies long, more long")
    plan = plan.withColumnsRenamed({"source": "plan_source", "size": "plan_size"})
    running = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = slices.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    sliced = sliced.join(plan, _same_source("source", "plan_source") & (F.col("size") == F.col("plan_size")))
    sliced = written(sliced.select("plan_source", "plan_size", F.col("slice").alias("plan_slice"), "source_size", "target", "copies", F.least("n", F.greatest(F.col("more") - F.col("before"), F.lit(0))).alias("extra"), F.col("n").alias("slice_n")), "plan")
    joined = rows.join(sliced, _same_source("source", "plan_source") & (F.col("size") == F.col("plan_size")) & (F.col("slice") == F.col("plan_slice")))
    whole = (F.col("extra") == 0) | (F.col("extra") == F.col("slice_n"))
    settled = joined.where(whole).withColumn("one", (F.col("extra") > 0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("order", "doc_id"))
    cut = joined.where(~whole).withColumn("one", (rank <= F.col("extra")).cast("long"))
    out = settled.unionByName(cut).withColumn("copies", F.col("copies") + F.col("one"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
