"""Queries over workflow logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import register, view_sql
from dossier.operators import workflow

_PAIRS = ", ".join(f"('{e}', '{s}', '{t}')" for e, m in workflow.MATRIX.items() for s, targets in m.items() for t in targets)
view_sql.register_view("v_matrix", f"SELECT * FROM (VALUES {_PAIRS}) AS t(e, s, t)")
view_sql.register_view("v_replay", """
    SELECT entity_type, entity_id, seq, to_state, state AS from_state, user_id, reason,
           CASE WHEN state = to_state THEN 'no_op' WHEN entity_type = 'contract' THEN 'unknown_entity' WHEN ok THEN 'accepted' ELSE 'rejected' END AS outcome,
           CASE WHEN ok THEN to_state ELSE state END AS next_state
    FROM (WITH RECURSIVE n AS (
              SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY seq) AS rn FROM v_transition_requests),
          walk AS (
              SELECT n.*, 'draft' AS state,
                     n.to_state <> 'draft' AND (entity_type, 'draft', n.to_state) IN (SELECT (e, s, t) FROM v_matrix) AS ok
              FROM n WHERE rn = 1
              UNION ALL
              SELECT n.*, CASE WHEN w.ok THEN w.to_state ELSE w.state END,
                     n.to_state <> CASE WHEN w.ok THEN w.to_state ELSE w.state END
                     AND (n.entity_type, CASE WHEN w.ok THEN w.to_state ELSE w.state END, n.to_state) IN (SELECT (e, s, t) FROM v_matrix)
              FROM walk w JOIN n ON n.entity_type = w.entity_type AND n.entity_id = w.entity_id AND n.rn = w.rn + 1)
          SELECT * FROM walk)""")


def initial_states(v):
    return v.transition_requests().select("entity_type", "entity_id").distinct().withColumn("state", F.lit("draft"))


@register("check_transitions", """
    SELECT r.seq, coalesce(o.status, 'draft') AS from_state, r.to_state,
           CASE WHEN coalesce(o.status, 'draft') = r.to_state THEN 'no_op' WHEN r.entity_type = 'contract' THEN 'unknown_entity'
                WHEN (r.entity_type, coalesce(o.status, 'draft'), r.to_state) IN (SELECT (e, s, t) FROM v_matrix) THEN 'accepted' ELSE 'rejected' END AS outcome
    FROM v_transition_requests r LEFT JOIN v_tenders o ON o.id = r.seq""")
def _(v):
    states = v.tenders().select(F.col("id").alias("seq"), F.col("status").alias("from_state"))
    requests = v.transition_requests().join(states, "seq", "left").fillna("draft", ["from_state"])
    return workflow.check_transitions(requests).select("seq", "from_state", "to_state", "outcome")


@register("replay_transitions", "SELECT entity_type, entity_id, seq, from_state, to_state, outcome, next_state AS state FROM v_replay")
def _(v):
    replayed = workflow.replay_transitions(v.transition_requests(), initial_states(v))
    return replayed.select("entity_type", "entity_id", "seq", "from_state", "to_state", "outcome", "state")


@register("transition_log", """
    SELECT entity_type, entity_id, seq, 'status' AS field_name, from_state, to_state, user_id AS triggered_by_user_id, reason FROM v_replay WHERE outcome = 'accepted'""")
def _(v):
    return workflow.transition_log(workflow.replay_transitions(v.transition_requests(), initial_states(v)))


@register("index_status", """
    SELECT doc_id, path, CASE WHEN doc_id % 9 = 1 THEN 'Source PDF not found on configured storage disks: ' || path
                              WHEN lang = 'de' THEN 'sin lector' WHEN n_chars = 0 THEN 'No text extracted from PDF.' END AS error_message,
           CASE WHEN doc_id % 9 = 1 OR lang = 'de' OR n_chars = 0 THEN 'failed' WHEN doc_id % 4 <> 0 AND doc_id % 5 <> 0 THEN 'indexed' ELSE 'processed' END AS status,
           CASE WHEN NOT (doc_id % 9 = 1 OR lang = 'de' OR n_chars = 0) AND doc_id % 4 = 0 THEN 'cuota' END AS vector_index_error
    FROM (SELECT *, CASE WHEN source <> 'src1' THEN 'f/' || doc_id END AS path FROM documents) WHERE path IS NOT NULL""")
def _(v):
    outcomes = v.table("documents").selectExpr(
        "doc_id", "case when source <> 'src1' then concat('f/', cast(doc_id as string)) end as path", "doc_id % 9 <> 1 as source_available",
        "case when lang = 'de' then 'sin lector' end as extraction_error", "n_chars as text_chars",
        "doc_id % 5 <> 0 as indexed", "case when doc_id % 4 = 0 then 'cuota' end as index_error",
    )
    return workflow.index_status(outcomes).select("doc_id", "path", "error_message", "status", "vector_index_error")
