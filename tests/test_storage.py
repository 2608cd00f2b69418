"""Bucketed tables, run folders, export index, checked scans and delta deletes."""

import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from dossier.operators import quality_rules, vectors
from dossier.plans import views
from dossier.sources import entities, exports, tables
from dossier.sources.buckets import BucketTable


def files_of(folder):
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(folder).rglob("*.parquet")}


ROW = "namespace string, document_type string, doc_id long, id string, text string"


def row(doc, i, text="t"):
    return ("n", "acta", doc, f"acta-{doc}-{i}", text)


def test_a_change_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    table = BucketTable(str(tmp_path / "t"), ("namespace", "document_type", "doc_id"), 8)
    table.write(spark.createDataFrame([row(d, i) for d in range(40) for i in range(3)], ROW))
    before = files_of(table.path)
    incoming = spark.createDataFrame([row(7, 0, "nuevo"), row(7, 9, "nuevo"), row(100, 0, "nuevo")], ROW)
    touched = vectors.apply_index_changes(table, incoming)
    after = files_of(table.path)
    for name, digest in before.items():
        bucket = int(name.split("bucket=")[1].split("/")[0])
        assert (name in after and after[name] == digest) == (bucket not in touched)
    rows = {(r.doc_id, r.id): r.text for r in table.read(spark).collect()}
    assert len(rows) == 40 * 3 - 3 + 3 and {k: t for k, t in rows.items() if t == "nuevo"} == {(7, "acta-7-0"): "nuevo", (7, "acta-7-9"): "nuevo", (100, "acta-100-0"): "nuevo"}
    # Repeating it changes no row; deleting all rows of a bucket leaves an empty one.
    vectors.apply_index_changes(table, incoming)
    assert table.read(spark).count() == len(rows)
    table.change(table.read(spark).where("doc_id = 7").limit(1), lambda current, _: current.limit(0))
    left = table.read(spark)
    assert 0 < left.count() < len(rows) and left.where("doc_id = 7").count() == 0
    assert table.change(incoming.limit(0), lambda current, _: current) == []


def test_retrieval_needs_no_exchange_of_stored_vectors(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [("n", "acta", d, f"v{d}-{i}", f"text {d} {i}", [float(d), float(i), 1.0]) for d in range(20) for i in range(4)]
        stored = vectors.store_vectors(spark.createDataFrame(rows, "namespace string, document_type string, doc_id long, id string, text string, values array<double>"), "stored_vectors", 4)
        queries = spark.createDataFrame([("n", "acta", d, "q", [1.0, 1.0, 0.0]) for d in range(20)], "namespace string, document_type string, doc_id long, query_key string, vector array<double>")
        found = vectors.retrieve(queries, stored, 2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("stored_vectors")].splitlines()
        # Between the scan of the stored table and the join there is neither an exchange nor, from there on, another one.
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in scan[-1] and "Exchange" not in scan[-2]
        assert found.count() == 40
    finally:
        spark.sql("DROP TABLE IF EXISTS stored_vectors")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_repeated_run_appends_nothing(spark, tmp_path):
    steps = spark.createDataFrame([(1, 1, "inicio"), (2, 1, "inicio")], "doc_id long, seq long, step string")
    for _ in range(2):
        tables.append_trace(steps, str(tmp_path / "trace"), "2024-01-01/1")
    tables.append_trace(steps, str(tmp_path / "trace"), "2")
    tables.append_trace(steps, str(tmp_path / "trace"))
    assert spark.read.parquet(str(tmp_path / "trace")).count() == 6
    events = spark.createDataFrame([(1, "a", "2024-01-30 10:00:00"), (2, "b", "2024-01-31 10:00:00")], "user_id long, event_type string, created_at string")
    for _ in range(2):
        tables.append_events(events, str(tmp_path / "events"), "job-1")
    tables.append_events(events, str(tmp_path / "events"), "job-2")
    stored = spark.read.parquet(str(tmp_path / "events"))
    assert stored.count() == 4 and stored.where("day = '2024-01-30'").count() == 2


def test_one_validation_reads_its_files_only(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 60 as validation_id", "0L as part", "id as pos", "'d' as documento", "'Alta' as gravedad", "concat('e', id) as error", "'s' as propuesta_solucion")
    path = str(tmp_path / "sheet")
    exports.export_findings(rows, path, 200)
    assert len(list(pathlib.Path(path).glob("*.csv"))) >= 10
    one = exports.one_validation(spark, path, 17)
    assert one.count() == 50 and {r[0] for r in one.select(F.input_file_name()).distinct().collect()} <= {r[0] for r in one.select(F.input_file_name()).collect()}
    assert len(one.inputFiles()) <= 2 and exports.one_validation(spark, path, 999).count() == 0


@pytest.mark.parametrize("file_format", ["json", "parquet"])
def test_checked_scan_loses_no_row(spark, tmp_path, file_format):
    schema = "id long, day date, parts array<int>, absent string"
    lines = ['{"id":1,"day":"2024-01-30","parts":[1,2]}', '{"id":"x","day":"2024-01-30"}', '{"id":3,"day":"30 de enero"}', '{"id":4', '{"id":5,"day":null,"parts":null,"more":1}', "no json", '{"id":"6"}']
    path = str(tmp_path / "in")
    if file_format == "json":
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
        good, bad = entities.load_checked(spark, path, schema, "json")
        want = {"{\"id\":\"x\",\"day\":\"2024-01-30\"}": ["id"], lines[2]: ["day"], lines[3]: ["_corrupt_record"], lines[5]: ["_corrupt_record"]}
        assert {r.raw: r.problems for r in bad.collect()} == want
        assert sorted(r.id for r in good.collect()) == [1, 5, 6] and good.where("id = 1").first().parts == [1, 2]
    else:
        spark.createDataFrame([("1", "2024-01-30", [1]), ("x", "mal", [2]), (None, None, None)], "id string, day string, parts array<int>").write.parquet(path)
        good, bad = entities.load_checked(spark, path, schema)
        assert [r.problems for r in bad.collect()] == [["id", "day"]] and good.count() == 2 and good.columns == ["id", "day", "parts", "absent"]


def test_delta_deletes_equal_whole_deletes_where_references_hold(spark):
    make = spark.createDataFrame
    data = {
        "users": make([(i,) for i in range(4)], "id long"), "companies": make([(i, i % 4) for i in range(12)], "id long, user_id long"),
        "letterheads": make([(i, i % 12) for i in range(20)], "id long, company_id long"),
        "tenders": make([(i, i % 4 if i % 2 else (i + 1) % 4, i % 12, (i * 3 + 1) % 20 if i % 5 else None) for i in range(40)], "id long, user_id long, company_id long, company_letterhead_id long"),
        "validations": make([(i, i % 4, i % 40) for i in range(60)], "id long, user_id long, licitacion_id long"), "findings": make([(i, i % 60) for i in range(90)], "id long, proposal_validation_id long"),
    }
    gone = data["users"].where("id = 2")
    whole, changes = quality_rules.cascade_delete(data, gone), quality_rules.cascade_changes(data, gone)
    for name, table in data.items():
        deleted, changed = changes[name]
        kept = table.join(deleted.select("id"), "id", "left_anti").join(changed.select("id"), "id", "left_anti").unionByName(changed).select(*table.columns)
        assert sorted(map(str, kept.collect())) == sorted(map(str, whole[name].select(*table.columns).collect())), name
    assert changes["tenders"][1].count() > 0


def test_pairs_of_a_tender_meet_in_one_of_parts_that_grow_with_the_lines(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id div 4 as l_orderkey", "id % 3 as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(views, "PART_LINES", 500)
    pairs = views.Views(spark, str(tmp_path)).bridge()
    at = pairs.withColumn("part", F.spark_partition_id())
    assert pairs.count() == 3000 and pairs.rdd.getNumPartitions() == 9
    assert at.select("licitacion_id", "part").distinct().count() == 1000 and at.groupBy("part").count().agg(F.max("count")).first()[0] < 3 * 3000 / 9
