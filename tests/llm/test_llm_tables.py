"""Mixing, chat formatting, top-k search and archives against plain versions; the pipeline's stages on odd rows."""

import collections
import hashlib
import json
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import chat, mixing, pii, queries, simhash, topk, warc
from dossier.llm.shared import written
from dossier.llm.tokens import encode


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, free, target = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            budget -= 2 * sizes[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_plain(spark, seed):
    rnd = random.Random(seed)
    sizes = {None: rnd.randrange(1000), "": 5, "Z": 0, "a": 10**11, "é": 70, "\U0001f600": 31, "￮": 12} | {f"s{i}": rnd.randrange(1, 10 ** rnd.randint(1, 6)) for i in range(30)}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(4)).collect()
    expected = plain_targets(sizes)
    assert {r.source for r in rows} == set(sizes)
    for r in rows:
        assert r.target == pytest.approx(float(expected[r.source]), rel=1e-12, abs=1e-9)


def test_fit_counts_reaches_reachable_budgets():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.unique(rnd.integers(0, 60, size=rnd.integers(1, 9)))
        counts = rnd.integers(1, 6, size=len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rnd.integers(0, total + 2))
        take = mixing.fit_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * lengths).sum())
        assert got <= budget
        # All sums within reach; the fit starts from a proportional part, so it may miss the best by less than a document.
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert max(s for s in sums if s <= budget) - got <= lengths.max()
    many = mixing.fit_counts(np.array([1, 7, 300, 20_000]), np.array([50, 1000, 2000, 30]), 654_321)
    assert int((many * np.array([1, 7, 300, 20_000])).sum()) == 654_321


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), "en", rnd.choice(["a", "b", "c", None]), 1, 2, 3) for i in range(300)]
    rows += [(5, "w w", "en", "a", 1, 2, 3)] * 2 + [(900, None, None, None, None, 2, 3), (901, "", "en", "zero", 0, 2, 3), (902, "w " * 30_000, "en", "c", 0, 2, 3), (None, "w w w", "en", "b", 0, 2, 3), (None, None, None, "b", 0, 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies long, slice long").repartition(3)


def test_mix_keeps_targets_and_caps(spark, odd):
    rows = mixing.mix_documents(odd).collect()
    assert len(rows) == odd.count()
    taken, size = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.taken
        size[r.source] += r["size"]
    expected = plain_targets(dict(size))
    longest = {s: max(r["size"] for r in rows if r.source == s) for s in size}
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(float(expected[r.source]))
    for s in size:
        assert abs(taken[s] - expected[s]) <= max(1, longest[s] if s == "c" else 1), s
    again = mixing.mix_documents(odd.repartition(5)).collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, again))
    assert mixing.mix_documents(odd.limit(0)).count() == 0


def test_mix_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = mixing.mix_documents(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size")).collect()
    expected = plain_targets({r.source: r["size"] for r in sums})
    for r in sums:
        assert r.target == pytest.approx(float(expected[r.source])) and abs(r.taken - r.target) <= 1


def test_layouts_give_the_same_turns(spark):
    turns = [("system", "be kind"), ("user", "hi </s>"), ("assistant", "<|turn|> [INST] \\ ok")]
    (_, s), (_, u), (_, a) = turns
    records = [
        {"messages": [{"role": r, "content": t} for r, t in turns]},
        {"system": s, "conversations": [{"from": "human", "value": u}, {"from": "gpt", "value": a}]},
        {"system": s, "prompt": u, "completion": a}, {"system": s, "prompt": u, "response": a}, {"system": s, "instruction": u, "input": "", "output": a}, {"system": s, "question": u, "answer": a},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, json.dumps({"prompt": "p", "chosen": "c", "rejected": "r"})), (91, json.dumps({"instruction": "do", "input": "this", "output": "done"})), (92, "no json"), (93, None), (94, "[1]"), (96, "[" * 100_000 + "]" * 100_000), (97, '{"a":' * 100_000 + "1" + "}" * 100_000), (98, '{"a":' * 900 + "[1]" + "}" * 900), (95, json.dumps({"zz": {"y": [1, {"x": 2}]}}))]
    found = collections.defaultdict(list)
    for r in chat.canonical_turns(spark.createDataFrame(rows, "id long, record string"), "id").orderBy("key", "turn").collect():
        found[r.key].append(r)
    for i in range(len(records)):
        assert [(r.role, r.text) for r in found[i]] == turns and len({r.fingerprint for r in found[i]}) == 1
    assert len({found[i][0].fingerprint for i in range(len(records))}) == len(records)
    assert [(r.role, r.text) for r in found[90]] == [("user", "p"), ("assistant", "c")]
    assert [(r.role, r.text) for r in found[91]] == [("user", "do\n\nthis"), ("assistant", "done")]
    assert all(found[i][0].layout is None and len(found[i]) == 1 for i in (92, 93, 94, 95, 96, 97, 98))
    assert chat.paths_of({"a": [{"b": 1, "c": None}, {"d": {"e": []}}]}) == {"a[].b", "a[].d.e[]"}


def test_escapes_are_reversible():
    rnd = random.Random(4)
    pool = ["\\", "<", "|", "/", "s", ">", "[", "INST", "]", "</s>", chat.CLOSE, chat.OPEN, chat.BODY, "\n", "<<SYS>>", "é", ""]
    for _ in range(5000):
        turns = [("".join(rnd.choices(pool, k=rnd.randint(0, 3))), "".join(rnd.choices(pool, k=rnd.randint(0, 9)))) for _ in range(rnd.randint(0, 3))]
        text = "".join(chat.format_turn(r, t)[0] for r, t in turns)
        assert chat.read_turns(text) == turns
        assert "</s>" not in text and "[INST]" not in text
        made, start, end = chat.format_turn("assistant", "".join(r + t for r, t in turns))
        assert chat.unescape(made[start:end]) == "".join(r + t for r, t in turns)
    with pytest.raises(ValueError):
        chat.read_turns("x" + text)


def test_conversations_read_back(spark):
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", None]), rnd.choice([None, "", "a", "é\n</s>", "<|end|>\n", "x" * 3000])) for c in range(30) for t in range(rnd.randint(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)] + [(51, 0, "user", "same")] * 3 + [(None, 0, "user", "nameless"), (52, None, "user", "no turn"), (52, 0, "assistant", "first")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    records = table.select("conv_id", "turn", F.to_json(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("record"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.canonical_turns(records, "conv_id", order="turn"))).collect()}
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is None, t or 0, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars >= len(loss) + len(turns)
    formatted = chat.format_conversations(chat.canonical_turns(records, "conv_id", order="turn"))
    texts = {r.conv_id: r.text for r in chat.whole_conversations(formatted).collect()}
    assert chat.read_turns(texts[51]) == [("user", "same")] * 3
    assert chat.read_back(formatted.limit(0)).count() == 0


def plain_top(rows, k, every=100):
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in good if c != q and len(b) == len(a))
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores[:k], 1)]
    return sorted(set(out))


@pytest.mark.parametrize("strip_rows", [40, 10_000])
def test_top_k_equals_plain(spark, strip_rows):
    rnd = np.random.default_rng(9)
    rows = [(i, (rnd.normal(size=12) * rnd.choice([0.1, 1, 30])).tolist()) for i in range(700)]
    rows += [(i, [0.5] * 12) for i in range(700, 1001)] + [(1100, None), (1200, [None] * 12), (1300, [float("nan")] * 12), (1400, [float("inf")] + [0.0] * 11), (1500, []), (1600, []), (1700, [1.0, 2.0]), (1800, [-1.0, 0.25]), (1900, [7.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).repartition(5)
    vectors = topk.whole_vectors(table)
    got = topk.top_inner_products(vectors.where("vec_id % 100 = 0"), vectors, strip_rows=strip_rows, query_rows=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top(rows, 10)
    assert topk.top_inner_products(vectors.limit(0), vectors).count() == 0


def test_top_k_of_long_vectors_is_exact(spark):
    rows = [(i, [float(np.float32(2.0**20 - i * 0.25)), 1.0, float(i)]) for i in range(120)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_inner_products(vectors.where("vec_id = 0"), vectors).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [x for x in plain_top(rows, 10) if x[0] == 0]


def test_top_k_prunes_and_keeps_ties():
    rnd = np.random.default_rng(2)
    c = np.floor(rnd.normal(size=(3000, 8)) * 100 * (1 + 20 * (np.arange(3000) % 50 == 0))[:, None])
    c[100:110] = c[50]
    q = c[:7]
    ids = np.arange(3000)
    turn = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    got = topk.best_of_strip(ids[:7], q, ids, c, 10, turn)
    for i in range(7):
        order = sorted((-int(s), j) for j, s in enumerate(c @ q[i]) if j != i)[:10]
        assert [(b, s) for a, b, s in got if a == i] == [(j, -s) for s, j in order]


def test_merge_equals_sorting():
    rnd = random.Random(8)
    for k in (0, 1, 2, 3, 7, 16):
        runs = []
        for f in range(k):
            rows = [{"url_key": rnd.choice("abcd"), "captured": str(rnd.randrange(5)), "page_id": rnd.choice([None, rnd.randrange(9)]), "file": str(f), "offset": i} for i in range(rnd.randint(0, 30))]
            runs.append(sorted(rows, key=warc._place))
        merged = list(warc.merge_runs(runs))
        assert list(map(warc._place, merged)) == sorted(warc._place(r) for run in runs for r in run)
        assert sorted((r["file"], r["offset"]) for r in merged) == sorted((r["file"], r["offset"]) for run in runs for r in run)


def test_url_keys():
    assert warc.url_key("http://WWW.Example.com:80/A/b/?Q=1#f") == "com,example)/a/b?q=1" == warc.url_key("https://user@example.com/A/b?q=1")
    assert warc.url_key(None) == warc.url_key("") == ")/" and warc.url_key("http://[broken") == "http://[broken"


@pytest.mark.parametrize("range_rows", [30, 10**6])
def test_archives_round_trip(spark, tmp_path, range_rows):
    rnd = random.Random(3)
    bodies = ["", None, "x" * 99, "y" * 100, "é" * 50, "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 4, "z" * 400_000, "\r\n\r\n", "end\r\n"]
    rows = [(i, rnd.choice(["http://a.com/x", "http://b.org/", None, "http://a.com/y\r\nBad: 1"]), rnd.choice(bodies), "clash", 1) for i in range(150)]
    rows += [(7, "u", "y" * 100, "", 1), (None, "u", "only here " * 20, "", 1), (None, None, "y" * 100, "", 1), (-5, "u", "negative " * 30, "", 1), (-4, "u", "negative " * 30, "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, offset long").repartition(4)
    planned = warc.plan_records(pages)
    warc.write_archives(planned, f"{tmp_path}/w", F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) % 7 + 100), 13)
    merged = warc.merge_index(written(warc.read_runs(spark, f"{tmp_path}/w"), "t"), range_rows)
    got = merged.orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert [warc._place(r.asDict()) for r in got] == sorted(warc._place(r.asDict()) for r in got)
    first = {}
    for i, _, body, *_ in rows:
        if i is not None:
            first[body or ""] = min(first.get(body or "", i), i)
    again = collections.Counter(body or "" for _, _, body, *_ in rows)
    expected = collections.Counter()
    for i, _, body, *_ in rows:
        data = (body or "").encode()
        refers = first[body or ""] if len(data) >= 100 and again[body or ""] > 1 and first.get(body or "", i) != i else None
        expected[i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    if range_rows == 30:
        assert warc.archive_pages(pages.limit(0), F.timestamp_seconds(F.lit(0))).count() == 0


def test_pipeline_stages(spark, odd, monkeypatch):
    """Every stage on odd rows, then the whole of it against plain statements about what each keeps."""
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "12345 67", "en", "s", 8), (9003, "The of and write to joe.doe@mail.example.com thing", "en", "s", 50), (None, "the of and in nowhere to thing", None, None, 30), (9004, "the of and in nowhere to thing", "en", "s", 30), (9004, "the of and in nowhere to thing", "en", "s", 30)]
    docs = written(sample.unionByName(spark.createDataFrame(extra, sample.schema)).withColumn("copies", F.lit(1)), "t")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        before, docs = docs, written(stage(spark, docs, ""), "t")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.DOCUMENT
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in kept.items()}
    named = ids["language ID"]
    assert not named & {9000, 9001, 9002} and {9003, 9004, None} <= named and len(named) >= sample.count()
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept["language ID"]).collect()}
    assert ids["SimHash near-dedup"] - {None} == {i for i, c in groups.items() if i is not None and i == c}
    assert kept["SimHash near-dedup"].where("doc_id = 9004").count() == 1
    clean = {r.doc_id: r.text for r in kept["PII"].collect()}
    assert set(clean) == ids["SimHash near-dedup"] and clean[9003] == "The of and write to [EMAIL] thing"
    for r in kept["SimHash near-dedup"].collect():
        assert not pii.base_spans(clean[r.doc_id]) and (clean[r.doc_id] == r.text or pii.base_spans(r.text) or "[" in clean[r.doc_id])
    mixed = collections.Counter(r.doc_id for r in kept["mixing sources to target weights"].collect())
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    pieces = collections.Counter()
    for r in kept["packing"].collect():
        pieces[r.doc_id] += r.length
    assert pieces == {i: n * (len(encode(clean[i])) + 1) for i, n in mixed.items()}


def test_registered_queries():
    assert [q for q in queries.QUERIES if q.startswith("op")] == [*queries.QUERIES] and {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 14))


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(3000))
    near, other = text + " more", " ".join(f"other{i}" for i in range(3000))
    rows = [(None, text), (None, text), (None, near), (7, near), (5, text), (5, text), (5, other), (None, other), (None, "alone here and now"), (None, "alone here and now"), (8, None), (9, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert simhash.near_duplicates(docs.where("doc_id in (5, 7) and text not like 'other%'")).select("component_id").distinct().count() == 1
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, docs, "").collect())
    assert got == collections.Counter([(5, text), (5, other), (None, "alone here and now"), (3, "")])


def test_strips_beyond_reach_are_not_met(spark):
    rnd = np.random.Generator(np.random.PCG64(3))
    rows = [(i, [float(x) for x in rnd.normal(size=4) * (50.0 if i < 40 else 1.0 / (1 + i))]) for i in range(400)]
    vectors = written(topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "t")
    strips = topk.strips_by_length(vectors, 40)
    tops = strips.groupBy("dim", "strip").agg(F.min("length").alias("shortest"), F.max("length").alias("longest")).orderBy("strip").collect()
    assert len(tops) >= 5 and all(a.shortest >= b.longest for a, b in zip(tops[:-1], tops[1:]))
    asked = strips.where("vec_id < 40").withColumn("floor", F.lit(1000.0))
    wanted = topk.wanted_strips(asked, strips.groupBy("dim", "strip").agg(F.max("length").alias("longest")))
    assert 0 < wanted.count() < 40 * len(tops) / 2
    whole = {i: [int(np.floor(x * 1024)) for x in v] for i, v in rows}
    got = [tuple(r) for r in topk.top_inner_products(vectors, vectors, 5, strip_rows=40, query_rows=90).orderBy("query_id", "rank").select("query_id", "vec_id", "score").collect()]
    expected = []
    for q in whole:
        scores = sorted(((sum(x * y for x, y in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q), key=lambda x: (-x[0], x[1]))[:5]
        expected += [(q, c, x) for x, c in scores]
    assert got == expected


def test_long_vectors_take_part(spark):
    """Components from 2**21 on are scaled, ranked and scored like all others."""
    rows = [(i, [float(2**21 + i), -float(i * 2**18), 0.5]) for i in range(6)] + [(7, [float("inf"), 1.0, 1.0]), (8, [1.0, None, 1.0]), (9, [3.0e6, 1.0, float("nan")]), (10, [1e-3, 2.0, 3.0])]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {i: [int(np.floor(x * 1024)) for x in v] for i, v in rows if i not in (7, 8, 9)}
    assert {r.vec_id: r.v for r in vectors.collect()} == whole
    got = [tuple(r) for r in topk.top_inner_products(vectors, vectors, 3).orderBy("query_id", "rank").select("query_id", "vec_id", "score").collect()]
    top = 2**63 - 1
    expected = []
    for q in sorted(whole):
        scores = sorted(((sum(x * y for x, y in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q), key=lambda s: (-s[0], s[1]))[:3]
        expected += [(q, c, max(-top, min(top, s))) for s, c in scores]
    assert got == expected
