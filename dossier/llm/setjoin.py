"""MinHash near-duplicates by a chosen-path set similarity join: documents branch by minwise tokens until nodes are small."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm import components
from dossier.llm.shared import bounded_batches, map_batches, strings, written

#: Minwise tokens of a set; trees choose their branches among them.
TOKENS = 64
#: Sets in a node that are all compared with each other; a larger node branches.
NODE = 16_384
#: Sets that one comparison holds at once. A node of more is compared tile against tile, in tiles of half as many.
GROUP = 2_048
#: Levels of branching. What is still larger below the last one is compared like a small node: tile against tile.
DEPTH = 3
#: Share of nodes that branch by a second token. One token alone would lose a pair with chance 1 - similarity at every
#: level; the second makes up for that, as in a branching process whose mean does not fall below one.
SECOND = 0.25
#: Pairs whose estimate is this many standard errors below the similarity asked for are not compared on full sets.
ERRORS = 5.0


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased; fewer words are one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64))


def set_class(shingles: np.ndarray) -> int | None:
    """A signed 64-bit name of a set: equal sets have equal names. The empty set has none."""
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(12))
    return draw.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each of ``TOKENS`` functions, as int32."""
    times, plus = _multipliers()
    least = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * times + plus).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def trees_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    """Trees that together bring a pair of exactly ``similarity`` into one last node with chance ``recall`` at least."""
    reach = 1.0
    for _ in range(depth):
        one = similarity * reach
        reach = (1 - SECOND) * one + SECOND * (1 - (1 - one) ** 2)
    return min(TOKENS, math.ceil(math.log(1 - recall) / math.log(1 - reach)))


def sketches(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, cls, tokens): size, name and minwise tokens of each row's set; cls and tokens of none are null."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, names, tokens = [], [], []
        for text in strings(batch.column(1)):
            found = shingle_set(text, words)
            sizes.append(len(found))
            names.append(set_class(found))
            tokens.append(minwise(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))],
            names=["doc_id", "n_shingles", "cls", "tokens"],
        )

    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_batches(named, each, "doc_id long, n_shingles long, cls long, tokens array<int>")


def _by_group(df: DataFrame, each: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``each`` over the rows of every value of ``grp``, the first column: groups follow each other in sorted partitions.

    One group is held at a time; it is small by the way groups are made.
    """
    bounded_batches(df.sparkSession)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys)).tolist()
            at = 0
            for cut in cuts:
                if cut == at:
                    continue
                if held and keys[at] != now:
                    yield from each(pa.Table.from_batches(held))
                    held = []
                now = keys[at]
                held.append(batch.slice(at, cut - at))
                at = cut
        if held:
            yield from each(pa.Table.from_batches(held))

    return df.repartition("grp").sortWithinPartitions("grp").mapInArrow(groups, schema)


def _compared() -> Column:
    """Nodes that are compared whole: small ones, and those of one large component and few sets besides."""
    return (F.col("n") <= NODE) | ((F.col("largest") > 1) & (F.col("n") - F.col("largest") <= GROUP))


def _dealt(nodes: DataFrame) -> DataFrame:
    """(grp, cls, comp) of a first look at ``nodes``: small ones whole, larger ones dealt into groups by hash.

    Sets of a large family have many alike, so that a part of them is enough to join most of it.
    """
    parts = F.ceil(F.col("n") / GROUP)
    return nodes.select(F.xxhash64("node", F.pmod(F.xxhash64("cls"), parts)).alias("grp"), "cls", "comp")


def _group_rows(nodes: DataFrame) -> DataFrame:
    """(grp, cls, comp) of the comparisons that ``nodes`` (node, cls, comp, n, largest, largest_comp) need.

    A node of at most ``GROUP`` sets is a group. Of a larger one the largest component and the other sets are dealt into
    tiles, and every pair of tiles is a group but those within the component: no pair of two components is left out.
    """
    half = GROUP // 2
    small = nodes.where(F.col("n") <= GROUP).select(F.col("node").alias("grp"), "cls", "comp")
    single = F.col("largest") == 1
    apart = single | (F.col("comp") != F.col("largest_comp"))
    others = F.ceil(F.when(single, F.col("n")).otherwise(F.col("n") - F.col("largest")) / half)
    inside = F.ceil(F.when(single, F.lit(0)).otherwise(F.col("largest")) / half)
    tiled = nodes.where(F.col("n") > GROUP).withColumn("others", others).withColumn("inside", inside).withColumn("apart", apart)
    tile = F.when(F.col("apart"), F.pmod(F.xxhash64("cls"), F.col("others"))).otherwise(F.col("others") + F.pmod(F.xxhash64("cls"), F.greatest("inside", F.lit(1))))
    met = tiled.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("apart"), F.col("others") + F.col("inside")).otherwise(F.col("others")) - 1)))
    return small.unionByName(met.select(F.xxhash64("node", F.least("tile", "other"), F.greatest("tile", "other")).alias("grp"), "cls", "comp"))


def _candidates(groups: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(grp, cls, comp): of each group the sets that by their tokens may be similar to one of another component.

    Sets that such pairs connect are a group of their own now, named by its members, so that one that several trees find
    is compared once. A pair that others connect already need not be looked at: its group is compared on full sets.
    """
    floor = similarity - ERRORS * math.sqrt(similarity * (1 - similarity) / TOKENS)

    def each(group: pa.Table) -> Iterator[pa.RecordBatch]:
        cls, first = np.unique(group.column("cls").to_numpy(), return_index=True)
        comp = group.column("comp").to_numpy()[first]
        if len(cls) < 2 or (comp == comp[0]).all():
            return
        tokens = group.column("tokens").combine_chunks().values.to_numpy().reshape(-1, TOKENS)[first]
        # Sets outside the largest component first: pairs inside it are not looked for.
        _, code, size = np.unique(comp, return_inverse=True, return_counts=True)
        order = np.argsort(size[code], kind="stable")
        cls, comp, tokens, code = cls[order], comp[order], tokens[order], code[order]
        label, left = np.arange(len(cls)), len(cls)
        for i in range(int((code != code[-1]).sum()) if size.max() > 1 else len(cls) - 1):
            after = np.flatnonzero((comp[i + 1 :] != comp[i]) & (label[i + 1 :] != label[i])) + i + 1
            hit = after[(tokens[after] == tokens[i]).sum(axis=1) >= floor * TOKENS]
            if len(hit):
                joined = np.unique(np.append(label[hit], label[i]))
                label[np.isin(label, joined)] = joined[0]
                left -= len(joined) - 1
                if left == 1:
                    break
        order = np.argsort(label, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            part = part[np.argsort(cls[part])]
            if len(part) > 1:
                name = int.from_bytes(hashlib.blake2b(cls[part].tobytes(), digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), pa.array(cls[part]), pa.array(comp[part])], names=["grp", "cls", "comp"])

    rows = groups.join(classes.select("cls", "tokens"), "cls").select("grp", "cls", "comp", "tokens")
    return _by_group(rows, each, "grp long, cls long, comp long").dropDuplicates(["grp", "cls"])


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, shingles) for the classes of ``wanted`` (cls, rep), from the texts of their representatives.

    Rows without an id represent a class only if no other row has it; they are looked through together.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(t, words) for t in strings(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([set_class(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["cls", "shingles"]
        )

    named = docs.join(wanted.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rows = named.select("doc_id", "text")
    if not wanted.where("rep is null").isEmpty():
        rows = rows.unionByName(docs.where("doc_id is null").select("doc_id", "text"))
    return map_batches(rows, each, "cls long, shingles binary")


def _confirmed(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of a group whose full sets are similar, thinned to a forest per group."""

    def each(group: pa.Table) -> Iterator[pa.RecordBatch]:
        cls, first = np.unique(group.column("cls").to_numpy(), return_index=True)
        comp = group.column("comp").to_numpy()[first]
        binary = group.column("shingles").combine_chunks()
        links = list(forest([np.frombuffer(binary[int(i)].as_py(), dtype="<u8") for i in first], comp, percent))
        if links:
            a, b = (cls[list(side)] for side in zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = clusters.join(sets, "cls").select("grp", "cls", "comp", "shingles")
    return _by_group(rows, each, "a long, b long")


def forest(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) between sets of different ``comp`` that are similar by full intersection, thinned to a forest.

    The first set is compared with all. Then every set outside the component that is largest by now is compared with all
    sets of other components; pairs inside a component need no link, and two sets of the largest are in one.
    """
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(names), dtype=bool)
    comp = np.unique(comp, return_inverse=True)[1]

    def links_of(i: int) -> Iterator[tuple[int, int]]:
        own = place[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[place], starts, dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero((comp != comp[i]) & (100 * shared >= percent * (sizes + sizes[i] - shared))).tolist():
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                yield i, j

    yield from links_of(0)
    for i in np.flatnonzero(comp != np.bincount(comp).argmax()).tolist():
        if (comp != comp[i]).any():
            yield from links_of(i)


def _with_stats(rows: DataFrame) -> DataFrame:
    """Rows (node, cls, comp) of nodes that hold two components at least, with size and largest component; equal nodes
    stay once."""
    parts = rows.groupBy("node", "comp").agg(F.count("*").alias("n"), F.min("cls").alias("least"), F.max("cls").alias("greatest"), F.bit_xor(F.xxhash64("cls")).alias("members"))
    stats = (
        parts.groupBy("node")
        .agg(
            F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.bit_xor("members").alias("members"),
            F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top"),
        )
        .where("comps > 1")
    )
    one = stats.groupBy("n", "least", "greatest", "members").agg(F.min("node").alias("node"), F.first("top").alias("top"))
    return rows.join(one.select("node", "n", F.col("top.n").alias("largest"), F.col("top.comp").alias("largest_comp")), "node")


def similar_sets(docs: DataFrame, percent: int = 85, words: int = 5, recall: float = 0.9999, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: groups by links of Jaccard similarity ``percent`` and more.

    Rows of equal sets are one class. In each of several trees (as many as ``recall`` asks for at the similarity itself)
    a node's classes branch by one or two minwise tokens that the node chooses, a class going to the child of its value.
    A node of at most ``NODE`` classes is compared exhaustively: tokens first, then full sets. Larger nodes that hold
    several components branch on. A first look at parts of one tree's nodes joins families of like sets, so that all
    trees only compare what is still apart.
    component_id is the smallest doc_id that links reach, the row's own included.

    Texts null, empty or blank have no shingles: n_shingles 0, linked with nothing, component_id their own id. A text of
    fewer words than a shingle is one shingle. A null doc_id stays null and names no component unless no row of its group
    has an id. Repeated rows each get a row. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    trees = trees_for(recall, percent / 100)
    prints = written(sketches(docs, words), "sketches")
    classes = written(prints.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.any_value("tokens").alias("tokens")), "classes")

    def first_level(low: int, high: int) -> DataFrame:
        nodes = F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda t: F.xxhash64(t, F.get("tokens", t)))
        return classes.select(F.explode(nodes).alias("node"), "cls")


    def compare(groups: DataFrame, step: int) -> DataFrame | None:
        clusters = written(_candidates(groups, classes, percent / 100), f"clusters{step}")
        if clusters.isEmpty():
            return None
        wanted = written(clusters.select("cls").distinct().join(classes.select("cls", "rep"), "cls"), f"wanted{step}")
        return written(_confirmed(clusters, _full_sets(docs, wanted, words), percent), f"links{step}")

    links = compare(_dealt(written(_with_stats(first_level(0, 1).withColumn("comp", F.col("cls"))), "nodes0")), 0)
    rows = _relabelled(first_level(0, trees), links)
    for level in range(1, DEPTH + 1):
        nodes = written(_with_stats(rows), f"nodes{level}")
        found = compare(_group_rows(nodes if level == DEPTH else nodes.where(_compared())), level)
        if found is not None:
            links = found if links is None else links.unionByName(found)
        large = nodes.where(~_compared()).select("node", "cls")
        if level == DEPTH or large.isEmpty():
            break
        rows = _children(_relabelled(large, links), classes)
    named = classes.select("cls", "rep", F.col("cls").alias("root"))
    if links is not None:
        found = components.roots(links).select(F.col("node").alias("cls"), F.col("root").alias("linked"))
        named = classes.join(found, "cls", "left").select("cls", "rep", F.coalesce("linked", "cls").alias("root"))
    return _named(prints, named)


def _relabelled(large: DataFrame, links: DataFrame | None) -> DataFrame:
    """Rows (node, cls, comp) with the components that the links so far make."""
    if links is None:
        return large.select("node", "cls", F.col("cls").alias("comp"))
    rooted = components.roots(links)
    return large.join(rooted.withColumnRenamed("node", "of"), F.col("cls") == F.col("of"), "left").select("node", "cls", F.coalesce("root", "cls").alias("comp"))


def _children(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """One row for each branch that a node chooses, under the class's own value of the token chosen."""
    several = rows.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("node")
    first = F.pmod(F.xxhash64("node", F.lit("first")), F.lit(TOKENS))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit("second")), F.lit(TOKENS - 1)), F.lit(TOKENS))
    twice = F.pmod(F.xxhash64("node", F.lit("twice")), F.lit(1000)) < int(1000 * SECOND)
    branches = F.when(twice, F.array(first, second)).otherwise(F.array(first))
    chosen = rows.join(several, "node").join(classes.select("cls", "tokens"), "cls").withColumn("branch", F.explode(branches))
    return chosen.select(F.xxhash64("node", "branch", F.get("tokens", F.col("branch").cast("int"))).alias("node"), "cls", "comp")


def _named(prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """Each row of ``prints`` with the smallest id of its component."""
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = rooted.join(least, "root").select("cls", "component_id")
    with_set = prints.where("cls is not null").join(by_class, "cls").select("doc_id", "n_shingles", "component_id")
    return with_set.unionByName(prints.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
