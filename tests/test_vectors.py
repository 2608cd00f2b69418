import random

import pytest
from pyspark.sql import functions as F

from dossier.functions import embedding, similarity
from dossier.operators import correction, vectors
from dossier.operators.relations import vectors_for_document

ROW = "namespace string, document_type string, doc_id long, id string, text string"


def row(doc, i, text="t"):
    return ("documents-acta", "acta", doc, f"acta-{doc}-{i}", text)


def test_maintenance_is_idempotent_and_keeps_prefixes_apart(spark):
    current = spark.createDataFrame([row(1, 0), row(1, 1), row(1, 2), row(11, 0), row(11, 1)], ROW)
    incoming = spark.createDataFrame([row(1, 0, "nuevo"), row(1, 1, "nuevo")], ROW)
    after, deleted = vectors.maintain_index(current, incoming)
    assert [r["id"] for r in deleted.collect()] == ["acta-1-2"]
    assert sorted((r["id"], r["text"]) for r in after.collect()) == [("acta-1-0", "nuevo"), ("acta-1-1", "nuevo"), ("acta-11-0", "t"), ("acta-11-1", "t")]
    again, deleted = vectors.maintain_index(after, incoming)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect())) and deleted.count() == 0
    wanted = spark.createDataFrame([("acta", 1)], "document_type string, document_id long")
    assert vectors_for_document(current, wanted).count() == 3


def test_retrieval_filters_after_the_cut_and_keeps_types_apart(spark):
    schema = "namespace string, document_type string, doc_id long, id string, text string, values array<double>"
    rows = [
        ("n", "acta", 1, "a", "igual", [1.0, 0.0]), ("n", "acta", 1, "b", "igual ", [1.0, 0.0]), ("n", "acta", 1, "c", "resumen estructurado del acta", [0.9, 0.1]),
        ("n", "acta", 1, "d", "lejos", [0.0, 1.0]), ("n", "acta", 1, "e", "nulo", [0.0, 0.0]), ("n", "acta", 2, "f", "otro", [1.0, 0.0]),
        ("n", "opinion", 1, "g", "de la opinión", [0.5, 0.5]), ("m", "acta", 1, "h", "de otro índice", [1.0, 0.0]),
    ]
    asked = "namespace string, document_type string, doc_id long, query_key string, vector array<double>"
    queries = spark.createDataFrame([("n", "acta", 1, "q", [1.0, 0.0]), ("n", "opinion", 1, "q", [1.0, 0.0])], asked)
    table = spark.createDataFrame(rows, schema)
    assert {(r["document_type"], r["snippet"], r["rank"]) for r in vectors.retrieve(queries, table, 3).collect()} == {("acta", "igual", 1), ("opinion", "de la opinión", 1)}
    assert len(vectors.retrieve(queries, table, 1).collect()) == 2
    documents = spark.createDataFrame([("n", "acta", 1, "t")], "namespace string, document_type string, doc_id long, text string")
    none = spark.createDataFrame([], "namespace string, document_type string, doc_id long, chunk_index int, text string")
    wide = table.withColumn("values", F.array(*[F.get("values", F.lit(i % 2)) for i in range(64)]))
    assert {(r["namespace"], r["document_type"]) for r in vectors.broad_context(wide, none, documents).collect()} == {("n", "acta")}


def test_ranking_uses_the_full_similarity(spark):
    schema = "namespace string, document_type string, doc_id long, id string, text string, values array<double>"
    table = spark.createDataFrame([("n", "t", 1, "a", "segundo", [1.0, 1e-4]), ("n", "t", 1, "b", "primero", [1.0, 0.9e-4])], schema)
    queries = spark.createDataFrame([("n", "t", 1, "q", [1.0, 0.0])], "namespace string, document_type string, doc_id long, query_key string, vector array<double>")
    assert [r["snippet"] for r in vectors.retrieve(queries, table, 1).collect()] == ["primero"]


def test_index_changes(spark):
    current = spark.createDataFrame([row(1, 0), row(1, 1), row(11, 0)], ROW)
    upserts, deletes = vectors.index_changes(current, spark.createDataFrame([row(1, 0, "nuevo")], ROW))
    assert [r["id"] for r in upserts.collect()] == ["acta-1-0"] and [r["id"] for r in deletes.collect()] == ["acta-1-1"]


def test_embedding(spark):
    df = spark.createDataFrame([(1, "Hola hola MUNDO, año 2024"), (2, " -- ")], "doc_id long, text string")
    got = {r["doc_id"]: r["values"] for r in embedding.embed_chunks(df).collect()}
    assert got[1] == pytest.approx(embedding.hashed_vector("Hola hola MUNDO, año 2024")) and sum(x * x for x in got[1]) == pytest.approx(1.0)
    assert got[2] == [0.0] * embedding.DIMENSION
    own = embedding.embed_chunks(df, lambda texts: [[float(len(t))] for t in texts])
    assert {r["doc_id"]: r["values"] for r in own.collect()} == {1: [25.0], 2: [4.0]}
    with pytest.raises(Exception, match="vectors for"):
        embedding.embed_chunks(df, lambda texts: []).collect()


def test_similarity_by_hand():
    assert similarity.percent("World", "Word") == pytest.approx(88.888889, abs=1e-6)
    assert similarity.percent("", "") == 0.0 and similarity.percent("abc", "abc") == 100.0 and similarity.percent("abc", "xyz") == 0.0
    # The longest stretch decides first: "bc" leaves nothing common around it.
    assert similarity.percent("abcd", "bcad") == pytest.approx(75.0)
    long_a, long_b = "el acta consta de " * 40 + "uno", "el acta costa de " * 40 + "dos"
    assert similarity.common_bytes(long_a.encode(), long_b.encode()) == 665 or similarity.percent(long_a, long_b) > 50


def test_best_candidate(spark):
    chunks = spark.createDataFrame([(1, 0, "uno", [1]), (1, 1, "texto del acta", [1, 2]), (1, 2, "tres", [3])], "doc_id long, chunk_index int, text string, page_numbers array<int>")
    targets = chunks.where("chunk_index = 1").withColumnRenamed("text", "current_text")
    options = [(1, 1, 0, "texto del acta", [1]), (1, 1, 1, "texto del acta", [1]), (1, 1, 2, " ", [1]), (1, 1, 3, "nada", [9])]
    best = correction.best_candidate(spark.createDataFrame(options, "doc_id long, chunk_index int, candidate_index int, text string, page_numbers array<int>"), chunks, targets).first()
    # The chunk is second among the chunks on its pages, so the second candidate loses nothing for distance.
    assert (best["candidate_index"], best["score"]) == (1, pytest.approx(100 + 12 + 18))


def test_best_candidate_equals_exhaustive_search(spark):
    rng = random.Random(4)
    noise = lambda t, n: "".join(c if rng.random() > n else rng.choice("abc ") for c in t)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 160))).strip() + "x" for _ in range(30)]
    chunks = spark.createDataFrame([(1, i, t, [i + 1]) for i, t in enumerate(base)], "doc_id long, chunk_index int, text string, page_numbers array<int>")
    options = [(1, i, c, noise(t, rng.choice([0, 0.1, 0.5, 0.9])).strip() or "x", [i + 1 + c % 2]) for i, t in enumerate(base) for c in range(5)]
    df = spark.createDataFrame(options, "doc_id long, chunk_index int, candidate_index int, text string, page_numbers array<int>")
    targets = chunks.withColumnRenamed("text", "current_text")
    got = {r["chunk_index"]: (r["candidate_index"], r["score"]) for r in correction.best_candidate(df, chunks, targets).collect()}
    flat = lambda t: " ".join(t.split())
    for i, t in enumerate(base):
        best = (-1, -1e9)
        for _, j, c, text, pages in options:
            if j == i:
                ratio = min(len(text), len(t)) / max(len(text), len(t))
                score = similarity.percent(flat(t), flat(text)) + (12 if pages == [i + 1] else 0) + ratio * 18 - c * 8
                best = (c, score) if score > best[1] + 1e-9 else best
        assert got[i][0] == best[0] and got[i][1] == pytest.approx(best[1])


def plain_common(a, b):
    """Longest common stretch, the first in a and then in b, and what is left and right of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = (n, i, j) if n > best[0] else best
    n, i, j = best
    return n + plain_common(a[:i], b[:j]) + plain_common(a[i + n :], b[j + n :]) if n else 0


def test_stretches_equal_plain_search():
    rng = random.Random(2)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefgh", "ñé a"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 25))).encode() for _ in range(2))
        stretches = similarity.Stretches(a)
        common = similarity.common_bytes(a, b, stretches)
        assert common == plain_common(a, b) == similarity.common_bytes(a, b)
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        assert stretches.subsequence(b) == row[-1] >= common
    # By hand: "World" and "Word" share "Wor", then "d"; the order of the texts matters for equal lengths.
    assert similarity.percent("World", "Word") == pytest.approx(800 / 9)
    assert similarity.common_bytes(b"bafoobar", b"mafoorar") == 6 and similarity.percent("", "") == 0.0


def test_long_texts_take_linear_time():
    text = "".join(random.Random(1).choice("etaoin shrdlu") for _ in range(60_000))
    assert similarity.percent(text, text[:30_000] + "@" + text[30_001:]) == pytest.approx(100 * 59_999 / 60_000)


def test_places_equal_plain_count(spark):
    rng = random.Random(8)
    stretch = lambda: list(range(a := rng.randint(1, 12), a + rng.randint(0, 4)))
    gaps = lambda: rng.sample(range(1, 14), rng.randint(0, 4))
    known = {(d, i): (stretch() if rng.random() < 0.7 else gaps()) for d in range(4) for i in range(25)}
    asked = {k: (p if rng.random() < 0.6 else stretch() if rng.random() < 0.7 else gaps()) for k, p in known.items() if rng.random() < 0.8}
    schema = "doc_id long, chunk_index int, page_numbers array<int>"
    frames = [spark.createDataFrame([(*k, p) for k, p in x.items()], schema) for x in (known, asked)]
    got = {(r["doc_id"], r["chunk_index"]): r["_place"] for r in correction._places(*frames).collect() if r["_listed"]}
    want = {}
    for (d, i), pages in asked.items():
        near = [j for (e, j), own in known.items() if e == d and set(own) & set(pages)]
        if i in near:
            want[d, i] = near.index(i)
    assert got == want


def test_bounds(spark):
    cases = [("a" * 100, "b" * 39, "too_short"), ("a" * 100, "b" * 40, None), ("a" * 100, "b" * 1800, None), ("a" * 100, "b" * 1801, "too_long"), ("a" * 1000, "b" * 299, "too_short"), ("a" * 1000, "b" * 2200, None)]
    df = spark.createDataFrame(cases, "current string, corrected string, want string")
    assert df.where(~correction.within_bounds(F.col("current"), F.col("corrected")).eqNullSafe(F.col("want"))).count() == 0
