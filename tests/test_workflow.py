import datetime
import glob
import random

import pytest

from __spark_entry__ import queries
from dossier.functions.ranking import dense_position, ranged_position
from dossier.operators import workflow
from dossier.session import shared_folder
from dossier.streaming.transitions import stream_transitions
from pyspark.sql import functions as F

REQUEST = "entity_type string, entity_id long, seq long, to_state string, user_id long, reason string"


def random_requests(n=900):
    rng = random.Random(7)
    states = workflow.STATES + ["otro"]
    # One entity holds a third of the log.
    return [
        (rng.choice(["tender", "validation", "contract"]) if i % 3 else "tender", rng.randint(2, 9) if i % 3 else 1, i, rng.choice(states), 1, "r")
        for i in range(n)
    ]


def brute(rows):
    state, out = {}, []
    for e, i, seq, to, _, _ in rows:
        s = state.get((e, i), "draft")
        ok = to in workflow.MATRIX.get(e, {}).get(s, []) and to != s
        out.append((e, i, seq, s, to, "no_op" if s == to else "unknown_entity" if e not in workflow.MATRIX else "accepted" if ok else "rejected"))
        state[(e, i)] = to if ok else s
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("entity_type", "entity_id", "seq", "from_state", "to_state", "outcome").collect())


def test_replay_is_independent_of_blocks(spark, monkeypatch):
    rows = random_requests()
    requests = spark.createDataFrame(rows, REQUEST)
    initial = requests.select("entity_type", "entity_id").distinct().withColumn("state", F.lit("draft"))
    want = brute(rows)
    for block, fan, levels in [(1024, 4096, 1), (16, 4, 1), (7, 3, 2), (50, 4096, 0)]:
        monkeypatch.setattr(workflow, "BLOCK_ROWS", block)
        monkeypatch.setattr(workflow, "FAN_OUT", fan)
        assert rows_of(workflow.replay_transitions(requests, initial, levels)) == want


TIMED = f"{REQUEST}, requested_at timestamp"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def streamed(spark, folder, files, delay):
    """Judged rows of a stream that gets one file per micro-batch, in this order."""
    for file in files:
        timed = [(*row, START + datetime.timedelta(seconds=row[2])) for row in file]
        spark.createDataFrame(timed, TIMED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = stream_transitions(source, delay).writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.parquet(f"{folder}/out")


def test_stream_in_any_order_equals_replay(spark, tmp_path, rocksdb):
    rows = random_requests(300)
    rng = random.Random(3)
    files = [[], [], [], []]
    for row in rows:
        files[min(3, (row[2] + rng.randrange(60)) // 75)].append(row)
    for file in files:
        rng.shuffle(file)
    heartbeat = (None, None, 5000, None, None, None)
    files[3].insert(0, heartbeat)
    got = streamed(spark, tmp_path, files, "200 seconds")
    assert rows_of(got) == brute(rows) and got.where("late").count() == 0


def test_requests_wait_and_late_ones_are_judged_on_arrival(spark, tmp_path, rocksdb):
    first = [("tender", 1, 10, "ready", 1, None), ("tender", None, 20, "ready", None, "r"), ("tender", 1, 400, "draft", 1, "r")]
    late = [("tender", 1, 5, "analyzing", 1, "r"), ("tender", 1, 401, "analyzing", 1, "r")]
    got = streamed(spark, tmp_path, [first, late], "10 seconds")
    rows = sorted((r.entity_id or 0, r.seq, r.from_state, r.state, r.late) for r in got.collect())
    # The one at 400 seconds still waits: nothing says yet that no earlier one will come.
    assert rows == [(0, 20, "draft", "ready", False), (1, 5, "draft", "analyzing", True), (1, 10, "analyzing", "ready", False)]


def test_self_transition_of_the_matrix_is_no_op(spark):
    df = spark.createDataFrame([("validation", "reviewed", "reviewed"), ("tender", "committed", "draft"), ("x", "a", "a"), ("x", "a", "b")], "entity_type string, from_state string, to_state string")
    assert [r["outcome"] for r in workflow.check_transitions(df).collect()] == ["no_op", "rejected", "no_op", "unknown_entity"]


def test_dense_position_with_a_hot_key(spark):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 0 else id % 50 end as k", "id as v")
    got = dense_position(df, ["k"], [F.asc("v")], F.expr("v div 100"))
    check = got.groupBy("k").agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count_distinct("position").alias("n"), F.count("*").alias("c"))
    assert check.where("lo <> 0 or hi <> c - 1 or n <> c").count() == 0
    assert got.alias("a").join(got.alias("b"), F.expr("a.k = b.k and a.v < b.v and a.position >= b.position")).count() == 0


def test_ranged_position_with_equal_keys_and_nulls(spark):
    df = spark.range(4000).selectExpr("case when id % 3 = 0 then 7 when id % 11 = 0 then null else id % 50 end as k", "4000 - id as v").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = ranged_position(df, [], [F.asc_nulls_last("k"), F.desc("v")])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(((r.k, r.v) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert [(r.k, r.v) for r in got.orderBy("position").collect()] == rows and got.agg(F.max("position")).first()[0] == 3999
    keyed = ranged_position(df, ["k"], [F.asc("v")])
    check = keyed.groupBy("k").agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count_distinct("position").alias("n"), F.count("*").alias("c"))
    assert check.count() == 51 and check.where("lo <> 0 or hi <> c - 1 or n <> c").count() == 0
    assert ranged_position(df.limit(0), ["k"], [F.asc("v")]).count() == 0


def test_entities_share_the_state_of_their_group(spark, tmp_path, rocksdb):
    rows = [(("tender", "validation")[i % 2], i, i, ("ready", "reviewed")[i % 2], None if i % 5 == 0 else 2**60 + i, None) for i in range(400)]
    files = [rows[:200], [(None, None, None, None, None, None), *rows[200:]], [(None, None, 5000, None, None, None)]]
    for file in files:
        timed = [(*row, START + datetime.timedelta(seconds=row[2] or 0)) for row in file]
        spark.createDataFrame(timed, TIMED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    judged = stream_transitions(source, "300 seconds", groups=3)
    query = judged.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(300)
    assert query.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows_of(got) == brute(rows) and {(r.seq, r.user_id) for r in got.collect()} == {(r[2], r[4]) for r in rows}
    # A few rows for each group, whatever the number of its entities.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3 * 6


def test_requests_in_many_files_are_a_few_batches(spark):
    folder = shared_folder(spark)
    before = set(glob.glob(f"{folder}/judged-*-log"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        judged = queries()["stream_transitions"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    [log] = set(glob.glob(f"{folder}/judged-*-log")) - before
    assert len(glob.glob(f"{log}/commits/[0-9]*")) <= 7
    assert judged.where("late").count() == 0
    assert rows_of(judged) == rows_of(queries()["replay_transitions"](spark, "/root/testdata/sf0.001"))
