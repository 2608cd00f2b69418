from pyspark.sql import functions as F

from dossier.functions.embedding import DIMENSION
from dossier.sources import entities, exports, storage, tables
from dossier.streaming.documents import commit, commits, compact, current_table, epoch_of, process_batch, stream_documents
from dossier.streaming.events import write_audit_events

PAGE = "doc_id long, page_number int, text string, document_type string, storage_path string, user_id long"


def page(doc, n, text):
    return (doc, n, text, "acta", f"f/{doc}", 7)


def test_documents_stream_is_incremental_and_repeatable(spark, tmp_path):
    source, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def feed(rows):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(source)
        query = stream_documents(spark.readStream.schema(PAGE).parquet(source), out, cp)
        query.awaitTermination(120)
        assert query.exception() is None

    feed([page(1, 1, "n~mero uno de la escritura"), page(1, 2, "dos"), page(2, 1, "otro")])
    feed([page(1, 1, "texto nuevo del acta")])
    rows = {(r["doc_id"], r["chunk_index"]): r for r in current_table(spark, out, "vectors").collect()}
    assert {k: r["text"] for k, r in rows.items()} == {(1, 0): "texto nuevo del acta", (2, 0): "otro"}
    assert len(rows[(1, 0)]["values"]) == DIMENSION and rows[(1, 0)]["metadata"]["page_numbers_csv"] == "1"
    assert current_table(spark, out, "chunks").count() == 2
    feed([page(2, 1, " -- ")])
    assert [r["doc_id"] for r in current_table(spark, out, "vectors").collect()] == [1]
    assert {(r.sequence, r.epoch) for r in commits(spark, out).collect()} == {(i, epoch_of(cp, i)) for i in range(3)}
    # A batch that is committed is not run again; one that is not leaves nothing that readers see.
    process_batch(out, cp)(spark.createDataFrame([page(9, 1, "otra vez")], PAGE), 1)
    spark.createDataFrame([(9, "sin registro")], "doc_id long, text string").write.parquet(f"{out}/documents/epoch=unfinished")
    assert current_table(spark, out, "documents").where("doc_id = 9").count() == 0
    # The versions of a new checkpoint win.
    again = str(tmp_path / "in2")
    spark.createDataFrame([page(1, 1, "tercera versión del acta")], PAGE).write.parquet(again)
    stream_documents(spark.readStream.schema(PAGE).parquet(again), out, str(tmp_path / "cp2")).awaitTermination(120)
    assert [r["text"] for r in current_table(spark, out, "vectors").collect()] == ["tercera versión del acta"]
    compact(spark, out, str(tmp_path / "small"))
    for name in ("pages", "chunks", "vectors", "documents"):
        assert current_table(spark, str(tmp_path / "small"), name).drop("epoch", "metadata").exceptAll(current_table(spark, out, name).drop("epoch", "metadata")).count() == 0
    assert spark.read.parquet(str(tmp_path / "small" / "documents")).count() == 2


def test_checkpoints_take_turns_without_loss(spark, tmp_path):
    out = str(tmp_path / "out")

    def feed(side, rows):
        source = str(tmp_path / f"in-{side}")
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(source)
        stream_documents(spark.readStream.schema(PAGE).parquet(source), out, str(tmp_path / f"cp-{side}")).awaitTermination(120)

    feed("a", [page(1, 1, "uno de a"), page(2, 1, "dos de a")])
    feed("b", [page(1, 1, "uno de b"), page(3, 1, "tres de b")])
    feed("a", [page(3, 1, "tres de a"), page(4, 1, "cuatro de a")])
    feed("b", [page(4, 1, "cuatro de b")])
    feed("a", [page(5, 1, "cinco de a")])
    texts = {r.doc_id: r.text for r in current_table(spark, out, "vectors").collect()}
    assert texts == {1: "uno de b", 2: "dos de a", 3: "tres de a", 4: "cuatro de b", 5: "cinco de a"}
    assert sorted(r.sequence for r in commits(spark, out).collect()) == list(range(5))
    commit(spark, out, "later")
    assert commits(spark, out).where("epoch = 'later'").first().sequence == 5


def test_audit_stream(spark, tmp_path):
    schema = "user_id long, request_method string, payload_keys array<string>, status_code int, created_at timestamp"
    rows = [(1, "POST", ["_token", "title"]), (1, "GET", []), (None, "POST", []), (2, "DELETE", None)]
    df = spark.createDataFrame([(*r, 200) for r in rows], "user_id long, request_method string, payload_keys array<string>, status_code int").withColumn("created_at", F.lit("2024-01-30 10:00:00").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    query = write_audit_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = sorted((r["user_id"], r["request_method"], r["metadata"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "POST", '{"payload_keys":["title"]}'), (2, "DELETE", '{"payload_keys":[]}')]


def test_entities_round_trip(spark, tmp_path):
    spark.createDataFrame([(1, 2, "Uno", "RFC")], "id long, user_id long, nombre string, rfc string").write.parquet(str(tmp_path / "companies"))
    found = entities.load_entities(spark, str(tmp_path))
    assert list(found) == ["companies"] and found["companies"].first()["created_at"] is None


def test_every_entity_keeps_its_types(spark, tmp_path):
    for name, schema in entities.SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    found = entities.load_entities(spark, str(tmp_path))
    assert len(found) == 15 and all(found[n].schema.simpleString() == spark.createDataFrame([], s).schema.simpleString() for n, s in entities.SCHEMAS.items())


def test_listing_and_exports(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"123")
    (tmp_path / "b.txt").write_bytes(b"1")
    assert [r["length"] for r in storage.list_files(spark, str(tmp_path)).collect()] == [3]
    rows = spark.createDataFrame([(5, 0, 1, "d", "Alta", "e", "s"), (5, 1, 1, "d2", "Media", "e2", "s2")], "validation_id long, part long, pos long, documento string, gravedad string, error string, propuesta_solucion string")
    exports.export_findings(rows, str(tmp_path / "sheet"))
    sheet = exports.one_validation(spark, str(tmp_path / "sheet"), 5).orderBy("part").collect()
    assert [r["Error Detectado"] for r in sheet] == ["e", "e2"] and exports.one_validation(spark, str(tmp_path / "sheet"), 6).count() == 0
    table = rows.select("validation_id", "error")
    exports.export_bundle(table, table, table, table, str(tmp_path / "bundle"))
    assert exports.one_validation(spark, str(tmp_path / "bundle"), 5, "parquet").where("part = 'summary'").count() == 2
    tables.append_trace(spark.createDataFrame([(1, 1, "inicio")], "doc_id long, seq long, step string"), str(tmp_path / "trace"))
    tables.append_trace(spark.createDataFrame([(1, 2, "fin")], "doc_id long, seq long, step string"), str(tmp_path / "trace"))
    assert spark.read.parquet(str(tmp_path / "trace")).count() == 2
