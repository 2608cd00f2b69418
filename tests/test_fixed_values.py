"""Outcomes that depend on fixed values, worked out by hand; the SQL twins share those values and cannot check them."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import embedding, pages, text
from dossier.operators import resolution, vectors, workflow

ALLOWED = {
    ("tender", "draft"): {"analyzing", "ready", "sent_for_approval"}, ("tender", "analyzing"): {"ready", "draft", "sent_for_approval"},
    ("tender", "ready"): {"analyzing", "draft", "sent_for_approval"}, ("tender", "sent_for_approval"): {"ready", "draft", "committed"}, ("tender", "committed"): set(),
    ("validation", "draft"): {"reviewed", "ready_for_export"}, ("validation", "reviewed"): {"reviewed", "ready_for_export"},
    ("validation", "ready_for_export"): {"reviewed", "ready_for_export"},
}


def test_every_transition(spark):
    states = sorted({s for _, s in ALLOWED} | {t for ts in ALLOWED.values() for t in ts} | {"otro"})
    rows = [(e, s, t) for e in ("tender", "validation", "contract") for s in states for t in states]
    judged = workflow.check_transitions(spark.createDataFrame(rows, "entity_type string, from_state string, to_state string")).collect()
    for r in judged:
        e, s, t, outcome = r
        want = "no_op" if s == t else "unknown_entity" if e == "contract" else "accepted" if t in ALLOWED.get((e, s), ()) else "rejected"
        assert outcome == want, r


@pytest.mark.parametrize("source, field, value, score", [
    ("regex", "acto", "abc", 0.45), ("llm", "acto", "abcd", 0.74), ("llm_retry", "rpc_folio", "F-1", 0.78), ("vision", "rpc_folio", "F-12", 0.90), ("vision", "acto", "abcd", 0.80),
    ("vision_first", "acto", "abcd", 0.96), ("vision_first", "rpc_lugar", "abcd", 0.86), ("vision_first", "fecha_registro", "2024-01-31", 0.99), ("otra", "fecha_registro", "2024-01-31", 0.52), ("llm", "fecha_registro", "31/01/2024", 0.74),
])
def test_confidence(spark, source, field, value, score):
    row = spark.range(1).select(resolution.confidence(F.lit(field), F.lit(source), F.lit(value)).alias("c")).first()
    assert row["c"] == pytest.approx(score)


def test_page_scores(spark):
    cases = {
        "": 0, "xyz": 6,
        "folio mercantil": 5 + 6 + 6,  # word of the scan list, word of the registry list, density
        "ESCRITURA 12": 4 + 4 + 3 + 6,  # word, word followed by a number, registry word, density
        "LIBRO LIBRO": 8 + 3 + 6,
        "ACTO de CONSTITUCION": 5 + 4 + 6 + 6,
        "a" * 240: 6 + 2, "a" * 4000: 6 + 4, "-" * 119 + "a": 0 + 1,
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, want int")
    for r in rows.select("t", "want", pages.ocr_text_score(F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"], r["t"][:40]


def test_tilde_words(spark):
    cases = {"n~mero": "número", "M~xico": "México", "INSCRIPCI~N": "INSCRIPCIÓN", "cl~usulas": "cláusulas", "despu~s de": "después de", "desconocid~": "desconocid~"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in rows.select("t", "want", text.restore_tilde_words(F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_hashed_vector():
    # md5: "a" 0cc175b9 -> slot 57, "hola" 4d186321 -> slot 33
    vector = embedding.hashed_vector("Hola, hola! a")
    assert {i: x for i, x in enumerate(vector) if x} == pytest.approx({33: 2 / 5**0.5, 57: 1 / 5**0.5})


def test_limits():
    assert (vectors.BROAD_K, vectors.FOCUSED_K, vectors.BROAD_FALLBACK, vectors.FOCUSED_FALLBACK) == (6, 8, (8, 8000), (10, 10000))
    assert list(vectors.BROAD_QUERIES) == ["registro_rpc", "apoderados_facultades", "accionistas_direccion", "notaria_instrumento"]
