"""Registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import alignment, chat, fingerprints, language, mixing, packing, pii, runs, setjoin, simhash, token_files, topk, warc
from dossier.llm.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into windows of 1024 ids; one row per piece."""
    return packing.piece_rows(packing.pack_documents(table(spark, folder, "documents")))


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash.near_duplicates(table(spark, folder, "documents"))
    return groups.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of all sources takes from every document."""
    return mixing.mix_documents(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness."""
    return fingerprints.compare_edits(table(spark, folder, "documents"))


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; learned from those that are not held out."""
    docs = table(spark, folder, "documents").withColumn("held_out", language.held_out())
    model = language.train(docs.where("not held_out"))
    return language.identify(docs, model, keep=("doc_id", "held_out"))


@query
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, folder, "documents")
    return pii.find_personal_data(docs, pii.train(docs))


@query
def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Ten highest inner products of every hundredth vector among all others."""
    vectors = written(topk.whole_vectors(table(spark, folder, "embeddings")), "vectors")
    return topk.top_inner_products(vectors.where("vec_id % 100 = 0"), vectors)


ORACLES["op3_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


@query
def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted and read back, and one whose texts hold control strings."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    record = F.to_json(F.struct("turn", "role", "text"))
    odd = "</s>[INST] ok [/INST]"
    messages = F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(odd).alias("content")) for r in ("user", "assistant")]).alias("messages")))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), messages.alias("record"))
    records = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), record.alias("record")).unionByName(extra)
    return chat.read_back(chat.format_conversations(chat.canonical_turns(records, "conv_id", order="turn")))


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page archived, read back and placed in the merged index; captured a second after the page before."""
    captured = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)))
    merged = warc.archive_pages(table(spark, folder, "pages"), captured)
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


@query
def op9_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted in flat token files written from the table."""
    return token_files.count_documents(table(spark, folder, "documents")).select("doc_id", "n_tokens", "file", "ordinal", "start")


@query
def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document, some with a tail that repeats."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = runs.periodic_runs(docs.withColumn("text", runs.repeat_tails(F.col("text"), F.col("doc_id"))))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op12_setjoin(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate group of every document by similar sets of five-word shingles."""
    groups = setjoin.similar_sets(table(spark, folder, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLES["op12_setjoin"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM w
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), link AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT doc_id, doc_id AS root FROM s
    UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.doc_id
), c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How two tokenizers cut every document, and how usual their linked ids are."""
    return alignment.align_documents(table(spark, folder, "documents"))


def _escapes(c: str) -> str:
    """Characters that escaping adds to a text, in SQL."""
    controls = ["\\", "<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "[INST]", "[/INST]"]
    return " + ".join(f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in controls)


ORACLES["op2_chat"] = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat.OPEN + chat.BODY + chat.CLOSE)} + length(role) + {_escapes("role")} + length(text) + {_escapes("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES["op5_warc"] = r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
           regexp_extract(url, '^[a-z]+://([^/?#]*)([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']) AS u,
           strftime(to_timestamp(1700000000 + page_id % 1000000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured
    FROM pages
), d AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
           array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www\.', ''), '.')), ',') || ')'
           || CASE WHEN rtrim(u.path, '/') = '' THEN '/' ELSE lower(rtrim(u.path, '/')) END || CASE WHEN length(u.query) > 1 THEN lower(u.query) ELSE '' END AS url_key
    FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to, url_key, captured,
       row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position
FROM d
"""
