import itertools
import random

from dossier.operators import resolution
from dossier.operators.extraction import extract_regulation_fields
from dossier.plans.views import Views
from pyspark.sql import functions as F

CANDIDATE = "doc_id long, source_key string, source string, stage_order long, field string, value string, value_json string, page_number long"


def cand(doc, source, stage, field, value, js=None, key=None):
    return (doc, key or source, source, stage, field, value, js, None)


def test_confidence_table(spark):
    sources = ["regex", "llm", "llm_retry", "vision", "vision_first", "otro"]
    want = {
        ("escritura_numero", "1234"): [0.49, 0.74, 0.82, 0.90, 0.96, 0.44],
        ("rpc_folio", "1234"): [0.49, 0.74, 0.82, 0.90, 0.86, 0.44],
        ("rpc_fecha_inscripcion", "2024-01-02"): [0.57, 0.82, 0.90, 0.98, 0.94, 0.52],
        ("fecha_registro", "2024-01-02"): [0.57, 0.82, 0.90, 0.98, 0.99, 0.52],
        ("acto", "Poder"): [0.49, 0.74, 0.82, 0.80, 0.96, 0.44],
        ("acto", "ab"): [0.45, 0.70, 0.78, 0.76, 0.92, 0.40],
        ("acto", "n/a"): [0.0] * 6,
    }
    rows = [cand(i, s, j, f, v) for i, (f, v) in enumerate(want) for j, s in enumerate(sources)]
    scored = resolution.score_candidates(spark.createDataFrame(rows, CANDIDATE)).collect()
    for i, key in enumerate(want):
        got = [round(r["confidence"], 6) for r in sorted((r for r in scored if r["doc_id"] == i), key=lambda r: r["stage_order"])]
        assert got == want[key], key


def test_merge_is_a_fold_with_margin(spark):
    base, bonus = resolution.SOURCE_BASE, {"vision": 0.10, "vision_first": 0.10}
    rng = random.Random(2)
    rows, want = [], {}
    for doc in range(300):
        current = None
        for stage in range(rng.randint(1, 12)):
            source = rng.choice(list(base))
            value = rng.choice([None, "n/a", "ab", "larga " + str(stage), "abcd" + str(stage)])
            rows.append(cand(doc, source, stage, "libro_numero", value, key=f"{source}-{stage}"))
            if value is None or value == "n/a":
                continue
            c = min(0.99, base[source] + bonus.get(source, 0.0) + (0.0 + (0.04 if len(value) >= 4 else 0.0)))
            if current is None or c >= current[0] + 0.05:
                current = (c, value)
        if current:
            want[doc] = current[1]
    merged = resolution.merge_candidates(resolution.score_candidates(spark.createDataFrame(rows, CANDIDATE)))
    assert {r["doc_id"]: r["value"] for r in merged.collect()} == want


def test_front_reading_does_not_displace_tail_reading(spark):
    rows = [cand(1, "vision", 3, "fecha_registro", "2024-01-02"), cand(1, "vision_first", 4, "fecha_registro", "2024-03-04")]
    assert resolution.merge_candidates(resolution.score_candidates(spark.createDataFrame(rows, CANDIDATE))).first()["value"] == "2024-01-02"


def test_lists_fill_gaps_only(spark):
    rows = [
        cand(1, "llm", 1, "consejo_administracion", None, '["n/a",""]'), cand(1, "llm_retry", 2, "consejo_administracion", None, '["Ana"]'),
        cand(1, "vision", 3, "consejo_administracion", None, '["Eva"]'),
    ]
    assert resolution.merge_candidates(resolution.score_candidates(spark.createDataFrame(rows, CANDIDATE))).first()["value_json"] == '["Ana"]'


def test_front_pages(spark):
    """All small histories against a page-by-page walk."""
    options = [None, "Poder", "Registro Público de Comercio"]
    rows, want = [], set()
    for doc, acts in enumerate(itertools.product(options, repeat=3)):
        for shift, books in enumerate(itertools.product([None, "L1"], repeat=3)):
            d = doc * 10 + shift
            seen, stopped = {}, False
            for order in range(3):
                for field, value in (("acto", acts[order]), ("libro_numero", books[order])):
                    rows.append((d, order, field, value))
                    if value and not stopped:
                        seen[field] = value
                if not stopped:
                    want.add((d, order))
                stopped = stopped or (len(seen) == 2 and not seen["acto"].startswith("Registro"))
    readings = spark.createDataFrame(rows, "doc_id long, front_order long, field string, value string")
    targets = readings.select("doc_id", "field").distinct()
    assert {tuple(r) for r in resolution.front_pages_needed(readings, targets).collect()} == want


def test_missing_inside_people(spark):
    rows = [cand(1, "llm", 1, "apoderados", None, '[{"ine":"1","poder_documento":"p","nombre_completo":"n","facultades_otorgadas":"f"},{"ine":"s/d","poder_documento":"p","nombre_completo":"n","facultades_otorgadas":null}]')]
    merged = resolution.merge_candidates(resolution.score_candidates(spark.createDataFrame(rows, CANDIDATE)))
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = {r["doc_id"]: r["missing"] for r in resolution.missing_required(docs, merged).collect()}
    assert got[1][-3:] == ["apoderados.2.ine", "apoderados.2.facultades_otorgadas", "participacion_accionaria"]
    assert got[2] == [*resolution.SCALAR_FIELDS_REQUIRED, "apoderados", "participacion_accionaria"]


def test_regulation_title(spark):
    df = spark.createDataFrame([(1, "corta\r\n  12345678 \n 123456789 \nresto"), (2, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["value"] for r in extract_regulation_fields(df).where("field = 'title'").collect()}
    assert got == {1: "123456789"}


def test_rows_of_a_document_meet_in_its_part_without_another_exchange(spark, tmp_path):
    spark.range(4000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("Acto: Poder; 9")).write.parquet(f"{tmp_path}/documents.parquet")
    v = Views(spark, str(tmp_path))
    v.parts = 5
    regex = resolution.as_candidates(v.table("documents").selectExpr("doc_id", "'acto' as field", "text as value"))
    alone = resolution.resolve_deeds(regex, v.candidates(), v.decisions())
    dealt = resolution.resolve_deeds(regex, v.candidates(dealt=True), v.decisions(dealt=True), v.parts)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, alone.collect()))
    assert dealt.rdd.getNumPartitions() == 5 and dealt.select(F.spark_partition_id().alias("p"), "doc_id").distinct().groupBy("doc_id").count().where("count > 1").count() == 0


def test_parts_grow_with_the_documents(spark, tmp_path):
    for n in (10, 40_000):
        spark.range(n).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/{n}/documents.parquet")
    parts = [Views(spark, f"{tmp_path}/{n}").parts for n in (10, 40_000)]
    rows = Views(spark, f"{tmp_path}/40000").candidates(dealt=True).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert parts == [1, 9] and rows < 1.1 * 60 * 5000
