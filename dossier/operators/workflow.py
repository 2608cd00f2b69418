"""Workflow rules: checking single transitions, replaying request logs, document life cycle."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.ranking import dense_position

# Allowed transitions per entity and state.
MATRIX: dict[str, dict[str, list[str]]] = {
    "tender": {
        "draft": ["analyzing", "ready", "sent_for_approval"],
        "analyzing": ["ready", "draft", "sent_for_approval"],
        "ready": ["analyzing", "draft", "sent_for_approval"],
        "sent_for_approval": ["ready", "draft", "committed"],
        "committed": [],
    },
    "validation": {
        "draft": ["reviewed", "ready_for_export"],
        "reviewed": ["reviewed", "ready_for_export"],
        "ready_for_export": ["reviewed", "ready_for_export"],
    },
}
STATES = sorted({state for states in MATRIX.values() for state in states})
# Rows of an entity folded together at the lowest level and blocks folded together at the upper ones: with two levels above
# the blocks an entity of 10 billion rows ends in a fold of 600 members.
BLOCK_ROWS = 256
FAN_OUT = 256
LEVELS = 2


def _matrix_map() -> Column:
    pairs = ((F.lit(f"{e}:{s}"), F.array(*[F.lit(t) for t in targets]).cast("array<string>")) for e, m in MATRIX.items() for s, targets in m.items())
    return F.create_map(*chain.from_iterable(pairs))


def _allowed(entity: Column, state: Column, target: Column) -> Column:
    targets = F.element_at(_matrix_map(), F.concat(entity, F.lit(":"), state))
    return F.coalesce(F.array_contains(targets, target), F.lit(False))


def transition_outcome(entity: Column, state: Column, target: Column) -> Column:
    """``no_op`` for an equal state, ``accepted``, ``unknown_entity`` or ``rejected``."""
    return (
        F.when(state == target, "no_op")
        .when(~entity.isin(list(MATRIX)), "unknown_entity")
        .when(_allowed(entity, state, target), "accepted")
        .otherwise("rejected")
    )


def check_transitions(requests: DataFrame) -> DataFrame:
    """Judge ``(entity_type, from_state, to_state)`` rows. The matrix has eight entries, so it is a literal, not a join."""
    outcome = transition_outcome(F.col("entity_type"), F.col("from_state"), F.col("to_state"))
    return requests.withColumn("outcome", outcome)


def _step(entity: Column, state: Column, target: Column) -> Column:
    return F.when(_allowed(entity, state, target), target).otherwise(state)


def _map_through(start: Column, ends: Column) -> Column:
    """State after a block; states outside the matrix never change."""
    return F.coalesce(F.get(ends, F.array_position(_known(), start).cast("int") - 1), start)


def _known() -> Column:
    return F.array(*[F.lit(s) for s in STATES])


def _ends(fold) -> Column:
    """For every known state, in the order of ``STATES``, the state after the block."""
    return F.transform(_known(), fold)


KEY = ["entity_type", "entity_id"]


def _start_states(blocks: DataFrame, initial: DataFrame, levels: int) -> DataFrame:
    """State at the start of every block, by composing block maps upwards and folding them downwards."""
    members = F.array_sort(F.collect_list(F.struct("block", "ends")))
    if levels == 0:
        groups = blocks.groupBy(*KEY).agg(members.alias("members")).join(initial, KEY, "left").withColumn(
            "start", F.coalesce("state", F.lit("draft"))
        )
    else:
        parents = blocks.groupBy(*KEY, F.coalesce(F.expr(f"block div {FAN_OUT}"), F.lit(0)).alias("parent")).agg(members.alias("members"))
        composed = parents.withColumn(
            "ends",
            _ends(lambda s: F.aggregate("members", s, lambda acc, m: _map_through(acc, m["ends"]))),
        ).select(*KEY, F.col("parent").alias("block"), "ends")
        starts = _start_states(composed, initial, levels - 1).withColumnRenamed("block", "parent")
        groups = parents.join(starts, [*KEY, "parent"])
    # Running state before each member of the group.
    running = F.aggregate(
        "members",
        F.struct(F.col("start").alias("state"), F.array().cast("array<string>").alias("before")),
        lambda acc, m: F.struct(
            _map_through(acc["state"], m["ends"]).alias("state"), F.concat(acc["before"], F.array(acc["state"])).alias("before")
        ),
    )
    return (
        groups.withColumn("before", running["before"])
        .select(*KEY, F.inline(F.arrays_zip(F.transform("members", lambda m: m["block"]).alias("block"), F.col("before"))))
        .toDF(*KEY, "block", "start")
    )


def replay_transitions(requests: DataFrame, initial: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Replay a log of requested transitions per entity in ``seq`` order (unique per entity).

    Replaying is sequential, but a stretch of the log is just a function from states to states, and those compose.
    Each entity's rows are numbered and cut into blocks of ``BLOCK_ROWS``; each block is reduced to that function, the
    functions give the state at every block start, and the rows inside a block are then replayed on their own. An
    entity that holds a third of the log is therefore spread over its blocks.
    """
    columns = [c for c in requests.columns if c not in KEY]
    blocks = (
        dense_position(requests, KEY, [F.asc("seq")], F.expr("seq div 65536"), "_at")
        .withColumn("block", F.coalesce(F.expr(f"_at div {BLOCK_ROWS}"), F.lit(0)))
        .groupBy(*KEY, "block")
        .agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in columns if c != "seq"]))).alias("rows"))
    )
    entity = F.col("entity_type")
    summaries = blocks.select(
        *KEY, "block", _ends(lambda s: F.aggregate("rows", s, lambda acc, r: _step(entity, acc, r["to_state"]))).alias("ends")
    )
    starts = _start_states(summaries, initial.select(*KEY, "state"), levels)
    replayed = blocks.join(starts, [*KEY, "block"])
    before = F.aggregate(
        "rows",
        F.struct(F.col("start").alias("state"), F.array().cast("array<string>").alias("before")),
        lambda acc, r: F.struct(
            _step(entity, acc["state"], r["to_state"]).alias("state"), F.concat(acc["before"], F.array(acc["state"])).alias("before")
        ),
    )["before"]
    rows = (
        replayed.withColumn("before", before)
        .select(*KEY, F.explode(F.arrays_zip("rows", "before")).alias("z"))
        .select(*KEY, "z.rows.*", F.col("z.before").alias("from_state"))
    )
    judged = check_transitions(rows)
    return judged.withColumn(
        "state", F.when(F.col("outcome") == "accepted", F.col("to_state")).otherwise(F.col("from_state"))
    )


def transition_log(replayed: DataFrame) -> DataFrame:
    """Rows of the append-only log: accepted transitions only."""
    return replayed.where(F.col("outcome") == "accepted").select(
        *KEY, "seq", F.lit("status").alias("field_name"), "from_state", "to_state", F.col("user_id").alias("triggered_by_user_id"), "reason"
    )


def index_status(outcomes: DataFrame) -> DataFrame:
    """Document state after one processing run.

    Extraction problems mark the document failed; a problem while indexing keeps it processed and is noted.
    """
    error = (
        F.when(~F.col("source_available"), F.concat(F.lit("Source PDF not found on configured storage disks: "), "path"))
        .when(F.col("extraction_error").isNotNull(), F.col("extraction_error"))
        .when(F.coalesce(F.col("text_chars"), F.lit(0)) == 0, "No text extracted from PDF.")
    )
    indexed = F.coalesce(F.col("indexed"), F.lit(False)) & F.col("index_error").isNull()
    return (
        outcomes.where(F.col("path").isNotNull() & (F.col("path") != ""))
        .withColumn("error_message", error)
        .withColumn("status", F.when(F.col("error_message").isNotNull(), "failed").when(indexed, "indexed").otherwise("processed"))
        .withColumn("vector_index_error", F.when(F.col("error_message").isNull(), F.col("index_error")))
    )
