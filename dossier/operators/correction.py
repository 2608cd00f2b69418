"""Correcting single chunks from a better reading of their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.pages import page_ids, page_overlap
from dossier.functions.ranking import count_before, top_per_key
from dossier.functions.similarity import comparable, similarity_if_leading
from dossier.functions.text import limit_text, strip
from dossier.operators.vectors import merge_metadata

OVERLAP_WEIGHT = 12
LENGTH_WEIGHT = 18
POSITION_WEIGHT = 8
HISTORY = 50


def correction_requests(requests: DataFrame, chunks: DataFrame, page_map: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests ``(doc_id, chunk_index)`` with the pages to read again, or the reason why not."""
    stored = chunks.select("doc_id", "chunk_index", strip(F.col("text")).alias("current_text"), F.col("page_numbers").alias("_own"))
    mapped = page_map.select("doc_id", "chunk_index", F.col("page_numbers").alias("_mapped"))
    known = chunks.select("doc_id").distinct().withColumn("_known", F.lit(True))
    joined = (
        requests.select("doc_id", "chunk_index")
        .join(stored, ["doc_id", "chunk_index"], "left")
        .join(mapped, ["doc_id", "chunk_index"], "left")
        .join(known, "doc_id", "left")
        .join(sources.select("doc_id", F.col("available").alias("_available")), "doc_id", "left")
    )
    numbers = F.coalesce("_own", "_mapped", F.array().cast("array<int>"))
    reason = (
        F.when(F.col("_known").isNull(), "no_chunks")
        .when(F.col("current_text").isNull(), "unknown_chunk")
        .when(F.col("current_text") == "", "empty_chunk")
        .when(F.size("page_numbers") == 0, "no_pages")
        .when(~F.coalesce("_available", F.lit(False)), "source_missing")
    )
    return (
        joined.withColumn("page_numbers", F.array_distinct(F.filter(numbers, lambda n: n > 0)))
        .withColumn("reason", reason)
        .select("doc_id", "chunk_index", "current_text", "page_numbers", "reason")
    )


def choose_correction(requests: DataFrame, vision: DataFrame, scanned: DataFrame) -> DataFrame:
    """Image-based text when it worked, else the best re-scanned text, with the reason for falling back."""
    key = ["doc_id", "chunk_index"]
    first = vision.select(*key, F.col("text").alias("_vision"), F.col("error").alias("_error"))
    second = scanned.select(*key, F.col("text").alias("_scanned"))
    ok = F.col("_vision").isNotNull() & F.col("_error").isNull()
    failure = F.coalesce("_error", F.lit("No se pudieron extraer imágenes de las páginas del chunk."))
    return (
        requests.join(first, key, "left")
        .join(second, key, "left")
        .withColumn("engine", F.when(ok, "ollama-vision").when(F.col("_scanned").isNotNull(), "targeted-ocr"))
        .withColumn("corrected_text", strip(F.when(ok, F.col("_vision")).otherwise(F.col("_scanned"))))
        .withColumn("fallback_from", F.when(F.col("engine") == "targeted-ocr", "ollama-vision"))
        .withColumn("fallback_error", F.when(~ok, failure))
        .drop("_vision", "_error", "_scanned")
    )


def related_chunks(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """Chunks of the same document that share a page with a target; an equi join on exploded pages.

    ``targets``: ``(doc_id, chunk_index, page_numbers)``. Yields ``(doc_id, target_index, chunk_index)``.
    """
    of_targets = targets.select("doc_id", F.col("chunk_index").alias("target_index"), F.explode("page_numbers").alias("page"))
    of_chunks = chunks.select("doc_id", "chunk_index", F.explode("page_numbers").alias("page"))
    return of_targets.join(of_chunks, ["doc_id", "page"]).select("doc_id", "target_index", "chunk_index").distinct()


#: Chunk indexes of one bucket when places are counted.
PLACE_BUCKET = 65_536


def _places(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """How many chunks before a target share a page with it, and whether it is itself among the chunks of its pages.

    A chunk shares a page with the stretch from a target's first page to its last if it is on the first one, or if its own
    first page is a later one of the stretch. Both are counts of chunks before the target on single pages: no pair of
    chunks becomes a row or an array cell. Only chunks and targets whose pages have gaps are looked at one by one.
    """
    known = chunks.select("doc_id", "chunk_index", F.array_sort(F.array_distinct("page_numbers")).alias("pages")).where(F.size("pages") > 0)
    asked = targets.select("doc_id", "chunk_index", F.array_sort(F.array_distinct("page_numbers")).alias("pages")).where(F.size("pages") > 0)
    gapless = F.element_at("pages", -1) - F.get("pages", F.lit(0)) + 1 == F.size("pages")
    stretches, gappy = asked.where(gapless), asked.where(~gapless)
    whole = known.where(gapless)
    on_page = whole.select("doc_id", "chunk_index", F.explode("pages").alias("page"), F.lit("on").alias("list"))
    begins = whole.select("doc_id", "chunk_index", F.get("pages", F.lit(0)).alias("page"), F.lit("begins").alias("list"))
    first = stretches.select("doc_id", "chunk_index", F.get("pages", F.lit(0)).alias("page"), F.lit("on").alias("list"))
    later = stretches.select("doc_id", "chunk_index", F.explode(F.slice("pages", 2, F.greatest(F.size("pages") - 1, F.lit(0)))).alias("page"), F.lit("begins").alias("list"))
    counted = count_before(
        on_page.unionByName(begins), first.unionByName(later), ["doc_id", "page", "list"], "chunk_index", F.expr(f"chunk_index div {PLACE_BUCKET}")
    ).select("doc_id", "chunk_index", "before")
    # Pages with gaps: the chunk itself is compared with the target, once.
    odd = known.where(~gapless).select("doc_id", F.col("chunk_index").alias("other"), F.col("pages").alias("theirs"))
    beside = stretches.join(odd, "doc_id").unionByName(
        gappy.join(known.select("doc_id", F.col("chunk_index").alias("other"), F.col("pages").alias("theirs")), "doc_id")
    )
    singly = beside.where((F.col("other") < F.col("chunk_index")) & F.arrays_overlap("pages", "theirs")).groupBy("doc_id", "chunk_index").agg(F.count("*").alias("before"))
    own = asked.join(known.withColumnRenamed("pages", "own"), ["doc_id", "chunk_index"]).where(F.arrays_overlap("pages", "own")).select("doc_id", "chunk_index").distinct()
    total = counted.unionByName(singly).groupBy("doc_id", "chunk_index").agg(F.sum("before").alias("_place"))
    return own.join(total, ["doc_id", "chunk_index"], "left").select("doc_id", "chunk_index", F.coalesce("_place", F.lit(0)).alias("_place"), F.lit(True).alias("_listed"))


def candidate_points(candidates: DataFrame, chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with what speaks for them besides their wording, in ``points``.

    Shared pages and a similar length count for a candidate, distance from the chunk's place among its neighbours against
    it. ``targets`` holds ``(doc_id, chunk_index, current_text, page_numbers)``, ``candidates``
    ``(doc_id, chunk_index, candidate_index, text, page_numbers)``.
    """
    options = candidates.select(
        "doc_id", "chunk_index", "candidate_index", strip(F.col("text")).alias("candidate_text"), F.col("page_numbers").alias("candidate_pages")
    ).where(F.col("candidate_text") != "")
    pairs = options.join(targets.select("doc_id", "chunk_index", "current_text", "page_numbers"), ["doc_id", "chunk_index"]).join(
        _places(chunks, targets), ["doc_id", "chunk_index"], "left"
    )
    a = F.greatest(F.length("candidate_text"), F.lit(1))
    b = F.greatest(F.length("current_text"), F.lit(1))
    shared = page_overlap(F.col("page_numbers"), F.col("candidate_pages"))
    penalty = F.when(F.coalesce("_listed", F.lit(False)), F.abs(F.col("candidate_index") - F.col("_place")) * POSITION_WEIGHT).otherwise(0)
    return pairs.withColumn("points", (shared * OVERLAP_WEIGHT + F.least(a, b) / F.greatest(a, b) * LENGTH_WEIGHT - penalty).cast("double"))


def pick_candidate(measured: DataFrame) -> DataFrame:
    """Best candidate per chunk by similarity and points; the first of equals wins."""
    scored = measured.withColumn("score", F.col("similarity") + F.col("points")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    return top_per_key(scored, ["doc_id", "chunk_index"], [F.desc("score"), F.asc("candidate_index")]).select(
        "doc_id", "chunk_index", "candidate_index", F.col("candidate_text").alias("text"), "similarity", "score"
    )


def best_candidate(candidates: DataFrame, chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """Best re-scanned candidate per target chunk, by :func:`candidate_points` and the similarity of the texts.

    The similarity is the only step that leaves the JVM. Rows of a chunk come together with likely winners first, which
    lets the others be skipped; the final pick uses the same keys and needs no further shuffle.
    """
    pointed = candidate_points(candidates, chunks, targets)
    texts = pointed.withColumn("_a", comparable(F.col("current_text"))).withColumn("_b", comparable(F.col("candidate_text")))
    spread = texts.repartition("doc_id", "chunk_index").sortWithinPartitions(
        "doc_id", "chunk_index", F.desc(F.col("_a") == F.col("_b")), F.desc("points")
    )
    group = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return pick_candidate(spread.withColumn("similarity", similarity_if_leading(group, F.col("points"), F.col("_a"), F.col("_b"))))


def within_bounds(current: Column, corrected: Column) -> Column:
    """``too_short``, ``too_long`` or null."""
    n = F.greatest(F.length(current), F.lit(1))
    low = F.greatest(F.lit(40), F.floor(n * F.lit(0.30)))
    high = F.greatest(F.lit(1800), F.ceil(n * F.lit(2.20)))
    return F.when(F.length(corrected) < low, "too_short").when(F.length(corrected) > high, "too_long")


def check_bounds(corrections: DataFrame) -> DataFrame:
    text = F.coalesce("corrected_text", F.lit(""))
    return corrections.withColumn(
        "rejection", F.when(text == "", "empty_correction").otherwise(within_bounds(F.col("current_text"), F.col("corrected_text")))
    )


def apply_corrections(chunks: DataFrame, corrections: DataFrame, at: str) -> DataFrame:
    """Chunks after accepted corrections ``(doc_id, chunk_index, corrected_text, engine, page_numbers, fallback_from, fallback_error)``.

    An equal text changes nothing. ``changed`` marks replaced chunks; their metadata says how and when.
    """
    key = ["doc_id", "chunk_index"]
    new = corrections.select(
        *key, "corrected_text", "engine", F.col("page_numbers").alias("_pages"), "fallback_from", "fallback_error"
    )
    joined = chunks.join(new, key, "left").withColumn(
        "changed", F.coalesce(F.col("corrected_text") != strip(F.col("text")), F.lit(False))
    )
    vision = F.col("engine") == "ollama-vision"
    csv = F.array_join("_pages", ",")
    pairs = {
        "page_ids": F.array_join(page_ids(F.col("_pages")), ","),
        "page_numbers_csv": csv,
        "primary_page": F.get("_pages", F.lit(0)).cast("string"),
        "corrected_with_vision": vision.cast("string"),
        "corrected_with_targeted_ocr": (F.col("engine") == "targeted-ocr").cast("string"),
        "correction_updated_at": F.lit(at),
        "correction_engine": F.col("engine"),
        "correction_page_numbers_csv": csv,
        "correction_reason": F.when(vision, "manual_chunk_vision").otherwise("manual_chunk_targeted_ocr"),
        "correction_fallback_from": F.col("fallback_from"),
        "correction_fallback_error": F.col("fallback_error"),
    }
    note = F.create_map(*[x for key_, value in pairs.items() for x in (F.lit(key_), value)])
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    noted = joined.withColumn("_note", note).withColumn("_own", own)
    return noted.select(
        *key,
        F.when(F.col("changed"), F.col("corrected_text")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("changed"), F.col("_pages")).otherwise(F.col("page_numbers")).alias("page_numbers"),
        F.when(F.col("changed"), merge_metadata(F.col("_own"), F.col("_note"))).otherwise(F.col("_own")).alias("metadata"),
        "changed",
        F.when(F.col("changed"), F.col("text")).alias("previous_text"),
        F.when(F.col("changed"), F.col("engine")).alias("engine"),
    )


def correction_history(history: DataFrame, corrected: DataFrame, at: str) -> DataFrame:
    """Correction log per document with new entries appended, cut to the last ``HISTORY`` entries.

    ``history``: ``(doc_id, updated_at, chunk_index, engine, previous_preview, corrected_preview)``.
    """
    fresh = corrected.where("changed").select(
        "doc_id", F.lit(at).alias("updated_at"), "chunk_index", "engine",
        limit_text(strip(F.col("previous_text")), 220, "...").alias("previous_preview"),
        limit_text(F.col("text"), 220, "...").alias("corrected_preview"),
    )
    return top_per_key(history.unionByName(fresh), ["doc_id"], [F.desc("updated_at"), F.desc("chunk_index")], HISTORY)


def document_status(index: DataFrame, corrected: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents touched by a correction become processed, and indexed once their vectors are in place."""
    touched = corrected.where("changed").select("doc_id").distinct().withColumn("_touched", F.lit(True))
    done = indexed.select("doc_id").distinct().withColumn("_done", F.lit(True))
    return (
        index.join(touched, "doc_id", "left")
        .join(done, "doc_id", "left")
        .withColumn("status", F.when(F.col("_touched") & F.col("_done"), "indexed").when(F.col("_touched"), "processed").otherwise(F.col("status")))
        .drop("_touched", "_done")
    )
