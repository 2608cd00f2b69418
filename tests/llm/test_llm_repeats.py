"""Periodic runs, set similarity join and tokenizer alignment against plain versions."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm import alignment, queries, runs, setjoin
from dossier.llm.tokens import VOCABULARY

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, cls long, grp long, node long, block long, pair long, n_words long"


def words_of(text):
    return WORD.findall(text or "")


def plain_runs(x):
    out = []
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and all(any(x[t] != x[t + r] for t in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    w = words_of(text)
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows and ids, and extra columns with clashing names."""
    rnd = random.Random(7)
    base = [rnd.choice("abcdefghij") + str(rnd.randrange(300)) for _ in range(400)]
    long = " ".join(rnd.choice(["alpha", "beta", "Gamma", "delta,", "éclair", "日本"]) + str(rnd.randrange(50)) for _ in range(12_000))
    near = base[:]
    near[200] = "changed"
    texts = ["", None, " \t\n", "one", "One", "a b c d", "A b  c\td", "x " * 40, "p q " * 30 + "r s t " * 12, " ".join(base), " ".join(near), " ".join(base).upper(), " ".join(base[:150]), long, long + " tail"]
    texts += ["naïve café – “quoted” 😀 <|endoftext|> tail", "▁ mark", "y" * 3000, " " * 50 + "z", "tab\tand\x0b\x0cfeeds\r\n", "\x00 zero"]
    texts += [" ".join(base[:30] * 5 + base[40:90] * 4), " ".join(["k"] * 23), " ".join(["k"] * 24), " ".join((base[:9] * 4)[:28] + ["end"])]
    rows = [(i, t, "en", 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)]
    rows += [(9, " ".join(base), "en", 1, 2, 3, 4, 5, 6), (4, "other words here", None, None, None, None, None, None, None)]
    rows += [(None, t, None, None, None, None, None, None, None) for t in ("one", None, "no id " * 20, "no id " * 20)]
    return spark.createDataFrame(rows, SCHEMA)


def test_runs_equal_plain_search():
    rnd = random.Random(5)
    for _ in range(150):
        batch = []
        for _ in range(rnd.randint(1, 6)):
            n, k = rnd.choice([0, 1, 23, 24, 25, 60, 200, 400]), rnd.choice([1, 2, 3, 5, 50])
            x = [rnd.randrange(k) for _ in range(n)]
            for _ in range(rnd.randint(0, 3) if n > 30 else 0):
                p, s = rnd.randint(1, n // 4), rnd.randrange(n - 10)
                for i in range(s, min(n, s + rnd.randint(2 * p, 5 * p + 2))):
                    x[i] = x[s + (i - s) % p]
                if rnd.random() < 0.3:
                    x[rnd.randrange(n)] = 999
            batch.append(x)
        assert runs.find_runs([np.array(x, dtype=np.int64) for x in batch]) == [plain_runs(x) for x in batch]


def test_scales_leave_no_period_out():
    covered = [q for least, block, window in runs.scales(100_000) for q in range(least, block + 1)]
    assert covered[:20_000] == list(range(runs.LAGS + 1, runs.LAGS + 20_001))
    # A window of blocks and its copy one period on fit in three periods.
    assert all(least + window - 1 + block <= 3 * least and window >= 1 for least, block, window in runs.scales(100_000))


def test_long_run_of_long_period():
    x = list(range(7000)) * 3 + [9, 9, 9]
    assert runs.find_runs([np.array(x, dtype=np.int64)]) == [[(0, 21_000, 7000)]]


def check_runs(found, texts):
    for row, text_words in zip(found, texts, strict=True):
        expected = plain_runs(text_words)
        assert row.n_runs == len(expected) and row.n_words == len(text_words)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in expected).encode()).hexdigest()
        dropped = {i for s, n, p in expected for i in range(s + p, s + n)}
        assert row.collapsed == " ".join(w for i, w in enumerate(text_words) if i not in dropped)
        best = max(expected, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])


def test_periodic_runs_on_odd_rows(spark, odd):
    small = odd.where("coalesce(length(text), 0) < 20000").coalesce(1)
    found = runs.periodic_runs(small)
    rows = small.select("doc_id", "text").collect()
    out = found.collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in rows]
    check_runs(out, [words_of(r.text) for r in rows])
    assert runs.periodic_runs(odd).count() == odd.count() and runs.periodic_runs(odd.limit(0)).count() == 0


def test_repeat_tails_and_query(spark, odd):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:40] + list(range(10))
    texts = [r.text for r in odd.collect() if len(r.text or "") < 20_000]
    docs = spark.createDataFrame([(i, texts[k % len(texts)]) for k, i in enumerate(ids)] + [(None, "a b"), (1, None)], "doc_id long, text string")
    got = docs.select("doc_id", "text", runs.repeat_tails(F.col("text"), F.col("doc_id")).alias("t")).collect()
    assert [words_of(r.t) for r in got] == [repeated(r.doc_id, r.text) for r in got]
    query = {r.doc_id: r for r in queries.QUERIES["op11_runs"](spark, "/root/testdata/sf0.001").collect()}
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 4 = 0 or length(text) < 3000").collect()
    assert sum(query[r.doc_id].n_runs for r in documents) > 5
    for r in documents:
        if len(r.text or "") < 6000:
            expected = plain_runs(repeated(r.doc_id, r.text))
            assert query[r.doc_id].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in expected).encode()).hexdigest()


def plain_groups(rows, percent=85):
    """Component of every row by comparing all pairs; a row is named by its place."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    least = {}
    for (doc_id, _), r in zip(rows, root, strict=True):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return collections.Counter((d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root, strict=True))


def test_similar_sets_on_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = setjoin.similar_sets(odd).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_groups(rows)
    assert setjoin.similar_sets(odd.limit(0)).count() == 0
    assert setjoin.similar_sets(odd.where("text is null")).count() == 2


def families(rnd):
    """Families of near copies, some just at the limit, one large, and a passage that many texts share."""
    passage, texts = [f"p{i}" for i in range(60)], []
    for family in range(12):
        base = [f"f{family}w{rnd.randrange(10_000)}" for _ in range(120)]
        for _ in range(150 if family == 0 else rnd.randint(1, 8)):
            x = base[:]
            for _ in range(rnd.randint(0, 3)):
                x[rnd.randrange(len(x))] = f"e{rnd.randrange(10_000)}"
            texts.append(" ".join(x))
    for _ in range(200):
        own = [f"o{rnd.randrange(10_000)}" for _ in range(rnd.randint(5, 60))]
        texts.append(" ".join(own + passage))
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("node, group", [(16_384, 2048), (16_384, 16), (40, 16)])
def test_similar_sets_equal_all_pairs(spark, node, group, monkeypatch):
    """With small nodes, families and the shared passage branch, meet leaders and are compared tile by tile."""
    monkeypatch.setattr(setjoin, "NODE", node)
    monkeypatch.setattr(setjoin, "GROUP", group)
    rows = families(random.Random(3))
    got = setjoin.similar_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_groups(rows)


def test_minwise_tokens_and_recall():
    rnd = np.random.Generator(np.random.PCG64(1))
    share = []
    for _ in range(40):
        common = rnd.integers(0, 1 << 63, 850, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rnd.integers(0, 1 << 63, 75, dtype=np.uint64)])) for _ in range(2))
        share.append((setjoin.minwise(a) == setjoin.minwise(b)).mean())
    assert abs(np.mean(share) - 0.85) < 0.02
    assert setjoin.trees_for(0.9999, 0.85) > setjoin.trees_for(0.9, 0.85) > 1


def test_forest_connects_what_links_connect():
    rnd = np.random.Generator(np.random.PCG64(4))
    for _ in range(60):
        base = [rnd.integers(0, 1000, 60, dtype=np.uint64) for _ in range(3)]
        sets = [np.unique(np.concatenate([base[rnd.integers(3)][rnd.integers(0, 8) :], rnd.integers(0, 1000, rnd.integers(0, 6), dtype=np.uint64)])) for _ in range(25)]
        comp = rnd.integers(0, 25, 25)
        root, plain = {c: c for c in comp.tolist()}, {c: c for c in comp.tolist()}

        def join(roots, i, j):
            a, b = roots[int(comp[i])], roots[int(comp[j])]
            for c in roots:
                roots[c] = a if roots[c] == b else roots[c]

        for i, j in itertools.combinations(range(25), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                join(plain, i, j)
        links = list(setjoin.forest(sets, comp.copy(), 85))
        for i, j in links:
            join(root, i, j)
        groups = lambda roots: {frozenset(c for c in roots if roots[c] == r) for r in set(roots.values())}
        assert groups(root) == groups(plain) and len(links) == len(set(comp.tolist())) - len(groups(plain))


def plain_alignment(rows):
    """Groups by walking both token lists; counts by dictionaries."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    size_b = [1 if pieces.is_byte(i) else len(pieces.id_to_piece(i).replace("▁", " ").encode()) for i in range(pieces.get_piece_size())]
    out, holders = [], collections.Counter()
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            a = tokenizer.encode(" " + text, add_special_tokens=False).ids
            b = pieces.encode(text)
            decoded = b"".join(bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b)
            if decoded != (" " + text).encode():
                a = b = []
        else:
            a = b = []
        end_a = end_b = j = 0
        own_a, own_b = [], []
        for i in a:
            own_a.append(i)
            end_a += len(token_bytes(tokenizer.id_to_token(i)))
            while end_b < end_a:
                own_b.append(b[j])
                end_b += size_b[b[j]]
                j += 1
            if end_a == end_b:
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                links += itertools.product(own_a, own_b)
                own_a, own_b = [], []
        holders.update(set(links))
        out.append((doc_id, len(a), len(b), groups, links))
    most = collections.defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    return collections.Counter(
        (d, na, nb, len(g), len(links), sum(holders[x] == most[x[0]] for x in links), sum(holders[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, na, nb, g, links in out
    )


@functools.cache
def token_bytes(token):
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in plain}
    back.update({chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)})
    return bytes(back[c] for c in token)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_on_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for block in (50, alignment.BLOCK_CHARS):
        got = alignment.align_documents(odd.repartition(3, "doc_id"), block_chars=block).select(*COLUMNS).collect()
        assert collections.Counter(map(tuple, got)) == plain_alignment(rows)
    assert alignment.align_documents(odd.limit(0)).count() == 0


def test_alignment_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.QUERIES["op13_alignment"](spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()
    assert collections.Counter(map(tuple, got)) == plain_alignment(rows)


def test_windows_are_remembered_and_forgotten(monkeypatch):
    aligner = alignment._aligner(VOCABULARY, alignment.PIECES)
    texts = ["the cat and the dog and the cat", "some other words, the cat"]
    first = [aligner.align(*aligner.token_ids(t)) for t in texts]
    size = len(aligner.memo)
    again = [aligner.align(*aligner.token_ids(t)) for t in texts]
    assert len(aligner.memo) == size
    monkeypatch.setattr(alignment, "WINDOWS", 1)
    forgotten = [aligner.align(*aligner.token_ids(t)) for t in texts]
    for x, y, z in zip(first, again, forgotten, strict=True):
        assert x[:2] == y[:2] == z[:2] and x[2].tolist() == y[2].tolist() == z[2].tolist()


def test_shingle_sets_are_hashes_of_words():
    assert set(setjoin.shingle_set("A b C d E f").tolist()) == {xxhash.xxh64_intdigest(x) for x in (b"a b c d e", b"b c d e f")}
    assert len(setjoin.shingle_set("")) == 0 and len(setjoin.shingle_set("a b")) == 1
