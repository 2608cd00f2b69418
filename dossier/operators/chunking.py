"""Cutting text into chunks.

All cutting inside one text is done by regular expressions that walk the text once; only packing segments across pages
needs more, see :func:`chunk_pages`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.pages import page_ids
from dossier.functions.text import normalize_newlines, squeeze, strip

CHUNK_SIZE = 1200
OVERLAP = 150
# Pages folded together at the lowest level and blocks folded together at the upper ones. Page numbers are 32-bit, so with
# two levels above the blocks no fold has more than 512 members: 64 * 256 * 256 * 512 = 2**31.
BLOCK_PAGES = 64
FAN_OUT = 256
LEVELS = 2
# A character that cannot occur in text; it marks lines longer than a chunk.
_MARK = "\ufdd0"


def fixed_windows(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of a text, trimmed, blank ones dropped. Tail windows inside the overlap are kept.

    The text is cut once into steps; a window is a step plus the head of the following ones.
    """
    step = max(size - overlap, 1)
    reach = -(-size // step)
    steps = F.regexp_extract_all(squeeze(text), F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    windows = steps
    for ahead in range(1, reach):
        following = F.slice(steps, ahead + 1, 2**31 - 1 - ahead)
        windows = F.zip_with(windows, following, lambda w, nxt: F.left(F.concat(w, F.coalesce(nxt, F.lit(""))), F.lit(size)))
    if step > size:
        windows = F.transform(windows, lambda w: F.left(w, F.lit(size)))
    return F.filter(F.transform(windows, strip), lambda w: w != "")


def chunk_fixed(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    return documents.select("doc_id", F.posexplode(fixed_windows(F.col("text"), size, overlap)).alias("chunk_index", "text"))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines with trimmed lines and no empty ones."""
    blocks = F.split(strip(normalize_newlines(text)), r"(?U)\n\s*\n", -1)
    lines = F.transform(
        blocks, lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n", -1), strip), lambda line: line != ""), "\n")
    )
    return F.filter(lines, lambda p: p != "")


def split_paragraphs(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph_index", "text"))


def split_oversized(paragraph: Column, size: int = CHUNK_SIZE) -> Column:
    """Pack the lines of a long paragraph greedily into pieces of at most ``size`` characters.

    A greedy run of whole lines is the longest stretch of up to ``size`` characters that ends at a line end, which a
    regular expression finds directly. Lines longer than a chunk are marked first and cut into plain windows that never
    merge with their neighbours. Short paragraphs pass unchanged.
    """
    p = strip(paragraph)
    lines = F.filter(F.transform(F.split(p, "\n", -1), strip), lambda line: line != "")
    marked = F.array_join(
        F.transform(lines, lambda line: F.when(F.length(line) > size, F.concat(F.lit(_MARK), squeeze(line))).otherwise(line)), "\n"
    )
    packed = rf"(?:\A|(?<=\n))[^{_MARK}]{{1,{size}}}(?=\n|\z)|[^\n{_MARK}]{{1,{size}}}"
    pieces = F.transform(F.regexp_extract_all(marked, F.lit(packed), F.lit(0)), strip)
    # "0" counts as empty here, but not for a paragraph that was short to begin with.
    return (
        F.when(p == "", F.array().cast("array<string>"))
        .when(F.length(p) <= size, F.array(p))
        .otherwise(F.filter(pieces, lambda piece: (piece != "") & (piece != "0")))
    )


def page_segments(text: Column, size: int = CHUNK_SIZE) -> Column:
    return F.filter(F.flatten(F.transform(paragraphs(text), lambda p: split_oversized(p, size))), lambda s: strip(s) != "")


def pack_paragraphs(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Chunks of a text without pages: paragraphs packed up to ``size``; a longer paragraph stays whole."""
    glued = F.array_join(paragraphs(text), "\n\n")
    start = r"(?:\A|(?<=\n\n))"
    pattern = rf"(?s){start}.{{1,{size}}}(?=\n\n|\z)|{start}.+?(?=\n\n|\z)"
    return F.filter(F.transform(F.regexp_extract_all(glued, F.lit(pattern), F.lit(0)), strip), lambda c: c != "")


def _payload(chunks: DataFrame) -> DataFrame:
    """Page columns derived from ``page_numbers``; absent when a chunk has no page."""
    some = F.size("page_numbers") > 0
    return chunks.select(
        "doc_id", "chunk_index", "text", "page_numbers",
        F.when(some, page_ids(F.col("page_numbers"))).alias("page_ids"),
        F.when(some, F.array_join("page_numbers", ",")).alias("page_numbers_csv"),
        F.when(some, F.get("page_numbers", F.lit(0))).alias("primary_page"),
    )


def _add(buffer: Column, length: Column, size: int) -> tuple[Column, Column]:
    """Fits the next segment into the buffer? Returns (fits, buffer if it does)."""
    grown = F.when(buffer == 0, length).otherwise(buffer + 2 + length)
    return (buffer == 0) | (grown <= size), grown


def _run(lengths: Column, size: int) -> Column:
    """Greedy packing of a list of lengths from an empty buffer: (flushes, length left in the buffer)."""

    def step(acc: Column, length: Column) -> Column:
        fits, grown = _add(acc["buffer"], length, size)
        return F.struct(
            (acc["flushes"] + F.when(fits, F.lit(0)).otherwise(F.lit(1))).alias("flushes"), F.when(fits, grown).otherwise(length).alias("buffer")
        )

    return F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("flushes"), F.lit(0).cast("long").alias("buffer")), step)


def _with_block_map(blocks: DataFrame, size: int) -> DataFrame:
    """Adds ``map``: what a block does to any incoming buffer.

    An incoming buffer only decides at which segment the first flush happens; from there on packing starts afresh. So
    the block is described by its total length and, for each segment that can be the first flush, the length needed to
    get past it and the outcome of packing from it.
    """

    def prefix(acc: Column, length: Column) -> Column:
        total = acc["total"] + F.when(acc["n"] == 0, 0).otherwise(2) + length
        near = F.when(acc["total"] <= size - 3, F.concat(acc["needs"], F.array(total))).otherwise(acc["needs"])
        return F.struct(total.alias("total"), (acc["n"] + 1).alias("n"), near.alias("needs"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("needs"))
    summed = blocks.withColumn("sums", F.aggregate("lengths", start, prefix))

    def outcome(need: Column, j: Column) -> Column:
        rest = F.slice(F.col("lengths"), j + 1, F.size("lengths"))
        return F.struct(need.alias("need"), _run(rest, size).alias("run"))

    flush_at = F.transform(F.col("sums.needs"), outcome)
    return summed.withColumn("map", F.struct(F.col("sums.total").alias("total"), flush_at.alias("flush_at")))


def _through(state: Column, block: Column, size: int) -> Column:
    """Apply a block map to ``(buffer, chunk)``."""
    first = F.get(F.filter(block["flush_at"], lambda o: (state["buffer"] + 2 + o["need"]) > size), F.lit(0))
    fresh = F.get(block["flush_at"], F.lit(0))
    empty = state["buffer"] == 0
    buffer = F.when(empty, fresh["run"]["buffer"]).when(first.isNull(), state["buffer"] + 2 + block["total"]).otherwise(first["run"]["buffer"])
    chunk = state["chunk"] + F.when(empty, fresh["run"]["flushes"]).when(first.isNull(), 0).otherwise(first["run"]["flushes"] + 1)
    return F.struct(buffer.alias("buffer"), chunk.alias("chunk"))


def _then(first: Column, second: Column, size: int) -> Column:
    """Block map of two neighbouring blocks taken as one."""

    def onward(entry: Column) -> Column:
        state = F.struct(entry["run"]["buffer"].alias("buffer"), entry["run"]["flushes"].alias("chunk"))
        end = _through(state, second, size)
        run = F.transform(F.array(end), lambda e: F.struct(e["chunk"].alias("flushes"), e["buffer"].alias("buffer")))[0]
        return F.struct(entry["need"].alias("need"), run.alias("run"))

    def shifted(entry: Column) -> Column:
        return F.struct((first["total"] + 2 + entry["need"]).alias("need"), entry["run"].alias("run"))

    # A first flush in the second block is only possible while the whole first block still fits.
    later = F.when(first["total"] <= size - 3, F.transform(second["flush_at"], shifted)).otherwise(F.slice(second["flush_at"], 1, 0))
    return F.struct(
        (first["total"] + 2 + second["total"]).alias("total"), F.concat(F.transform(first["flush_at"], onward), later).alias("flush_at")
    )


def _part(number: str, size: int) -> Column:
    """Number of the group of ``size`` neighbours; never null."""
    return F.coalesce(F.expr(f"{number} div {size}"), F.lit(0))


def _block_starts(maps: DataFrame, size: int, levels: int) -> DataFrame:
    """Buffer length and chunk number at the start of every block, by combining maps upwards and folding them downwards."""
    members = F.array_sort(F.collect_list(F.struct("block", "map"))).alias("maps")
    if levels == 0:
        empty = F.struct(F.lit(0).cast("long").alias("buffer"), F.lit(0).cast("long").alias("chunk"))
        groups = maps.groupBy("doc_id").agg(members).withColumn("start", empty)
    else:
        parents = maps.groupBy("doc_id", _part("block", FAN_OUT).alias("parent")).agg(members)
        rest = F.slice("maps", 2, 2**31 - 2)
        whole = F.reduce(rest, F.get("maps", F.lit(0))["map"], lambda acc, m: _then(acc, m["map"], size))
        combined = parents.select("doc_id", F.col("parent").alias("block"), whole.alias("map"))
        starts = _block_starts(combined, size, levels - 1).withColumnRenamed("block", "parent")
        groups = parents.join(starts, ["doc_id", "parent"])
    before = F.aggregate(
        "maps",
        F.struct(F.col("start").alias("state"), F.array().cast("array<struct<buffer:bigint,chunk:bigint>>").alias("before")),
        lambda acc, m: F.struct(
            _through(acc["state"], m["map"], size).alias("state"), F.concat(acc["before"], F.array(acc["state"])).alias("before")
        ),
    )["before"]
    zipped = F.arrays_zip(F.transform("maps", lambda m: m["block"]).alias("block"), before.alias("state"))
    return groups.select("doc_id", F.explode(zipped).alias("z")).select("doc_id", "z.block", F.col("z.state").alias("start"))


def chunk_pages(pages: DataFrame, documents: DataFrame | None, size: int = CHUNK_SIZE, levels: int = LEVELS) -> DataFrame:
    """Page-aware chunks: paragraphs packed greedily up to ``size`` with the pages they come from.

    Packing runs through a document from front to back. To keep a huge document from ending up in one task, its pages
    are grouped into blocks of ``BLOCK_PAGES``; each block is reduced to a small map from incoming to outgoing buffer
    length, a document only folds over those maps, and with the buffer known at every block start the blocks number
    their segments independently. The maps of neighbouring blocks combine into maps of the same kind, so with ``levels``
    above zero even the fold over blocks is split. Documents without usable pages are chunked from their text, if given.
    """
    # Joins ask for keys that are not null. Saying so here, and having block numbers that cannot be null, keeps the plans of
    # all uses of the blocks equal below the exchange, so that Spark cuts the pages into segments once.
    segments = pages.where(F.col("doc_id").isNotNull() & (F.col("page_number") > 0)).select(
        "doc_id", F.col("page_number").cast("int").alias("page_number"), page_segments(F.col("text"), size).alias("segments")
    )
    per_page = F.array_sort(F.collect_list(F.struct("page_number", "segments")))
    spread = F.flatten(
        F.transform(
            "pages", lambda p: F.transform(p["segments"], lambda s: F.struct(p["page_number"].alias("page"), s.alias("text")))
        )
    )
    blocks = (
        segments.groupBy("doc_id", _part("page_number", BLOCK_PAGES).alias("block"))
        .agg(per_page.alias("pages"))
        .select("doc_id", "block", spread.alias("segments"))
        .where(F.size("segments") > 0)
        .withColumn("lengths", F.transform("segments", lambda s: F.length(s["text"]).cast("long")))
    )
    maps = _with_block_map(blocks.select("doc_id", "block", "lengths"), size).select("doc_id", "block", "map")
    starts = _block_starts(maps, size, levels)

    def number(acc: Column, length: Column) -> Column:
        fits, grown = _add(acc["buffer"], length, size)
        chunk = acc["chunk"] + F.when(fits, 0).otherwise(1)
        return F.struct(
            F.when(fits, grown).otherwise(length).alias("buffer"), chunk.alias("chunk"), F.concat(acc["numbers"], F.array(chunk)).alias("numbers")
        )

    numbers = F.aggregate(
        "lengths",
        F.struct(F.col("start.buffer").alias("buffer"), F.col("start.chunk").alias("chunk"), F.array().cast("array<bigint>").alias("numbers")),
        number,
    )["numbers"]
    rows = (
        blocks.join(starts, ["doc_id", "block"])
        .withColumn("numbers", numbers)
        .select("doc_id", "block", F.posexplode(F.arrays_zip("segments", "numbers")).alias("i", "z"))
        .select("doc_id", "block", "i", F.col("z.segments.page").alias("page"), F.col("z.segments.text").alias("text"), F.col("z.numbers").cast("int").alias("chunk_index"))
    )
    members = F.array_sort(F.collect_list(F.struct("block", "i", "page", "text")))
    from_pages = rows.groupBy("doc_id", "chunk_index").agg(members.alias("m")).select(
        "doc_id", "chunk_index",
        strip(F.array_join(F.transform("m", lambda s: s["text"]), "\n\n")).alias("text"),
        F.array_distinct(F.transform("m", lambda s: s["page"])).alias("page_numbers"),
    )
    if documents is None:
        return _payload(from_pages)
    # Anything but spaces and zeros is sure to end up in a segment; only other texts are cut to find out.
    filled = F.col("text").rlike(r"(?U)[^\s0]") | (F.size(page_segments(F.col("text"), size)) > 0)
    with_pages = pages.where((F.col("page_number") > 0) & filled).select("doc_id")
    without_pages = documents.join(with_pages, "doc_id", "left_anti")
    from_text = without_pages.select("doc_id", F.posexplode(pack_paragraphs(F.col("text"), size)).alias("chunk_index", "text")).withColumn(
        "page_numbers", F.array().cast("array<int>")
    )
    return _payload(from_pages.unionByName(from_text))


def chunk_text_for_index(documents: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of plain text, without page information."""
    return documents.select("doc_id", F.posexplode(pack_paragraphs(F.col("text"), size)).alias("chunk_index", "text"))


def chunk_page_map(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_index", "page_numbers", page_ids(F.col("page_numbers")).alias("page_ids"))


def attach_page_map(chunks: DataFrame, page_map: DataFrame) -> DataFrame:
    """Give re-cut chunks the pages stored for the same index; blank chunks are dropped."""
    stored = page_map.select("doc_id", "chunk_index", F.col("page_numbers"))
    joined = chunks.select("doc_id", "chunk_index", strip(F.col("text")).alias("text")).join(stored, ["doc_id", "chunk_index"], "left")
    return _payload(
        joined.where(F.col("text") != "").withColumn("page_numbers", F.coalesce("page_numbers", F.array().cast("array<int>")))
    )
