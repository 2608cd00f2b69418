"""Packing, SimHash, fingerprints, language, personal data and token files against plain versions."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm import components, fingerprints, language, packing, pii, simhash, token_files
from dossier.llm.shared import written
from dossier.llm.tokens import VOCABULARY, encode

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, fp long, part long, size long"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, ties, and extra columns with clashing names."""
    rnd = random.Random(3)
    long = " ".join(rnd.choice(["alpha", "beta", "Gamma", "delta,", "éclair", "日本"]) + str(rnd.randrange(50)) for _ in range(30_000))
    texts = ["", None, " \t\n", "one", "One", "a b c d", "a b c d e f g", "a  b\tc d e f g", long, long, long + " x", "naïve café – “quoted” 😀 <|endoftext|> tail", "x" * 5000, "7 8 9"]
    rows = [(i, t, "en", "s", 0, 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s", 0, 1, 2, 3), (None, "one", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return make(spark, rows)


def test_encode_equals_tokenizers(spark):
    exact = Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(1)
    pool = ["a", "B", " ", "  ", "\n", "é", "Ö", "'s", "'LL", "12", "³", "\x0b", " ", " ", "日", "😀", "<|endoftext|>", "_", "-", "\t"]
    texts = ["", " ", "\n\n x", "it's  fine\r\n", "x" * 4000, " " * 3000, *[c * n + " end" for n in (1999, 2000, 2001) for c in ("x", "é", "7", "-", " ", "\n", "\t ", "aB")]] + ["".join(rnd.choices(pool, k=rnd.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_encode_equals_tokenizers_on_documents(spark):
    exact = Tokenizer.from_file(VOCABULARY)
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert encode(row.text).tolist() == exact.encode(row.text, add_special_tokens=False).ids


def test_packing_loses_no_id(spark, odd):
    docs = odd.repartition(5, "doc_id", "text")
    sequences = written(packing.pack_documents(docs, spaces=4), "t")
    pieces = packing.piece_rows(sequences).collect()
    lengths = collections.Counter(r.n_tokens for r in sequences.collect())
    assert sum(n for size, n in lengths.items() if size != 1024) <= 1 and max(lengths) <= 1024
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    expected = collections.Counter()
    for row in odd.collect():
        ids = np.append(encode(row.text or ""), 0).astype("<u4")
        expected[row.doc_id, len(ids)] += len(ids)
    got = collections.Counter()
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
    assert got == expected
    ids = np.append(encode(odd.where("doc_id = 10").first().text), 0).astype("<u4")
    mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == 10)
    assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n, _ in mine] == [c for *_, c in mine]
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_packer_best_fit_and_bound():
    packer = packing.Packer(10, 2)
    item = lambda d, n: [(d, 0, np.arange(n, dtype="<u4"), n)]
    packer.put(item(1, 7))
    packer.put(item(2, 5))
    packer.put(item(3, 3))  # fits both, leaves the least room in the first
    assert [[p[0] for p in w] for w in packer.take_done()] == [[1, 3]]
    packer.put(item(4, 6))  # opens a second window
    packer.put(item(5, 6))  # fits nowhere: the fullest (6 of 10) is filled up and emitted
    assert [[(p[0], p[1], len(p[2])) for p in w] for w in packer.take_done()] == [[(4, 0, 6), (5, 0, 4)]]
    assert sorted(sum(len(p[2]) for p in w) for w in packer.take_open()) == [2, 5]


def plain_fingerprint(text, k=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    names = sorted(prints)
    parent = {i: i for i in names}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in names:
        for b in names:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in names}


def test_simhash_on_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.fp % 2**64) for r in rows} == {(r.doc_id, plain_fingerprint(r.text or "")) for r in odd.collect()}
    group = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert group[0] == group[1] == group[2] == 0 and group[8] == group[9] == group[10] == 8 and group[4] == 3
    assert {r.component_id for r in rows if r.doc_id is None} == {0, 3}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    nameless = make(spark, [(None, "x y", None, None, None, None, None, None)])
    assert [tuple(r) for r in simhash.near_duplicates(nameless).select("doc_id", "component_id").collect()] == [(None, None)]


@pytest.mark.parametrize("tile_rows", [7, 1000])
def test_simhash_links_equal_all_pairs(spark, tile_rows):
    rnd = random.Random(tile_rows)
    prints = {}
    for i in range(300):
        value = rnd.getrandbits(64) if i < 40 else prints[rnd.randrange(i)]
        for b in rnd.sample(range(64), rnd.randint(0, 5)):
            value ^= 1 << b
        prints[i] = value
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in sorted(set(prints.values()))], "fp long")
    found = components.roots(simhash.links(nodes, 4, tile_rows)).collect()
    root = {r.node % 2**64: r.root % 2**64 for r in found}
    expected = plain_components(prints, 4)
    groups = collections.defaultdict(set)
    for i, x in prints.items():
        groups[root.get(x, x)].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in prints if expected[i] == r) for r in set(expected.values()))


def test_simhash_query_equals_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    expected = plain_components(prints, 4)
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {(i, prints[i], expected[i]) for i in prints}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(-5, 159)]
    root = {r.node: r.root for r in components.roots(spark.createDataFrame(path, "a long, b long")).collect()}
    assert root == {**{i: 0 for i in range(41)}, **{i: -5 for i in range(100, 160)}, -5: -5}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_estimate_resemblance():
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    for share in (0.2, 0.5, 0.9):
        cut = int(len(words) * share)
        other = words[:cut] + [f"v{i}" for i in range(len(words) - cut)]
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other)]
        exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        a, b = fingerprints.sketches([" ".join(words), " ".join(other)])
        assert abs(fingerprints.likeness(a[None], b[None])[0] - exact) < 0.13
    same = fingerprints.sketches(["a b", "a  b\n", "", " ", "a"])
    assert (same[0] == same[1]).all() and (same[2] == same[3]).all() and not (same[0] == same[4]).all()
    # A sketch does not depend on the batch that it is made in.
    many = fingerprints.sketches([" ".join(words), "x", " ".join(other), ""])
    assert (many[0] == a).all() and (many[2] == b).all()
    assert fingerprints.pack_bits(np.array([[1, 15, 0, 9]], dtype=np.uint8)) == ["1f09"]


def test_shingle_hashes_by_words():
    texts = ["a b c d e f", "b c d e f", "a b", "", "a b"]
    doc, value = fingerprints.shingle_hashes(texts)
    by = [value[doc == i].tolist() for i in range(5)]
    assert [len(x) for x in by] == [2, 1, 1, 0, 1] and by[0][1] == by[1][0] and by[2] == by[4]


@pytest.mark.parametrize("run_bytes", [8_000_000, 30_000])
def test_edits_follow_descending_ids(spark, odd, monkeypatch, run_bytes):
    monkeypatch.setattr(fingerprints, "RUN_BYTES", run_bytes)
    rows = fingerprints.compare_edits(odd.repartition(3, "text")).collect()
    order = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        third = len(text) // 3
        new = text[: len(text) - third] + following[:third]
        a, b, c = fingerprints.sketches([text, new, following])
        near = [float(fingerprints.likeness(a[None], x[None])[0]) for x in (b, c)]
        expected.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), *fingerprints.pack_bits(np.stack([a, b])), *near))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    assert fingerprints.compare_edits(odd.limit(0)).count() == 0
    alone = fingerprints.compare_edits(odd.where("doc_id = 5")).first()
    assert alone.near_next == 1.0
    assert {r.fingerprint for r in fingerprints.fingerprint_documents(odd.where("doc_id in (8, 9)")).collect()} == {next(r.fingerprint for r in rows if r.doc_id == 8)}


def test_language_model_is_a_distribution():
    texts = ["the cat sat on the mat", "the dog ate the cat", "a mat and a hat"]
    _, keys = language.keys_of([language.normalize(t) for t in texts])
    grams, n = np.unique(keys, return_counts=True)
    model = language.build_model({"en": (grams, n), "xx": (grams[:5], n[:5])})
    letters = sorted({int(k) & 0xFFFF for k in grams})
    for context in ("the", "cat", "zzz", " th"):
        head = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context))
        keys = np.array([head | c for c in [*letters, 0x4E00]], dtype=np.uint64)
        assert abs(np.exp(model.log_probabilities(keys)[:, 0].astype(float)).sum() - 1) < 1e-4


def test_language_against_dictionaries():
    """Interpolated estimates of one language, from plain dictionaries."""
    text = language.normalize("abracadabra abra cadabra abrabra")
    _, keys = language.keys_of([text])
    grams, n = np.unique(keys, return_counts=True)
    model = language.build_model({"x": (grams, n)})
    padded = "   " + text
    counts = {4: collections.Counter(padded[i : i + 4] for i in range(len(text)))}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    seen = len(counts[1])

    def discount(k):
        once, twice = (sum(v == w for v in counts[k].values()) for w in (1, 2))
        return min(max(once / (once + 2 * twice), 0.1), 0.9) if once and twice else 0.5

    def chance(gram):
        k = len(gram)
        below = chance(gram[1:]) if k > 1 else 1 / (seen + 1)
        own = {g: v for g, v in counts[k].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return below
        return max(own.get(gram, 0) - discount(k), 0) / total + discount(k) * len(own) / total * below

    for gram in ["abra", " abr", "dabr", "bbbb", "abrr", "   a", "zabr"]:
        key = np.array([sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(gram))], dtype=np.uint64)
        assert abs(float(np.exp(model.log_probabilities(key)[0, 0])) - chance(gram)) < 1e-5, gram


def test_language_model_keeps_every_gram(spark):
    """More 4-grams than any fixed size of a model, nearly all of them seen once or twice."""
    rnd = np.random.default_rng(11)
    texts = ["".join(map(chr, 0x4E00 + rnd.integers(0, 20_000, 30_000))) for _ in range(10)]
    docs = make(spark, [(i, t, "zh", None, None, None, None, None) for i, t in enumerate([*texts, *texts[:2]])])
    _, keys = language.keys_of([*texts, *texts[:2]])
    grams, n = np.unique(keys, return_counts=True)
    assert len(grams) > 290_000 and {r.n: r.of for r in language.gram_counts(docs).groupBy("n").agg(F.count("*").alias("of")).collect()} == collections.Counter(n.tolist())
    mine, plain = language.train(docs), language.build_model({"zh": (grams, n)})
    assert (mine.log_probabilities(keys) == plain.log_probabilities(keys)).all() and len(mine.grams[3].hashes) == len(grams)


def test_language_limits_come_from_all_rows(spark):
    """A language without a row in the confidence sample is rejected like any other; stray characters do not move limits."""
    rows = [(i, f"the quick brown fox number jumps over lazy dogs and {w} runs", "en") for i, w in enumerate(["one", "two", "three"] * 20)]
    rows += [(100, "der schnelle braune Fuchs springt über faule Hunde und läuft weiter", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, calibration_rows=3)
    assert np.isfinite(model.calibration["usual"]).all()
    mean, between, within = model.calibration["usual"][model.languages.index("en")]
    texts = [language.normalize(t) for _, t, x in rows if x == "en"]
    nats, size = model.cross_entropy(texts)
    own = nats[:, model.languages.index("en")]
    off = (own - np.average(own, weights=size)) ** 2
    assert np.allclose([mean, between, within], [np.average(own, weights=size), max(off.mean(), language.LEAST_DEVIATION**2), (off * size).mean()])
    junk = spark.createDataFrame([(1, "fühl sühlt wühler gäbe düfte bücher " * 10)], "doc_id long, text string")
    assert [(r.lang_pred, r.rejected) for r in language.identify(junk, model).collect()] == [("de", True)]
    text = language.normalize("the quick brown fox jumps over the lazy dog " * 400)
    chance = []
    for strays in ("", "".join(map(chr, range(0x4E00, 0x4E14)))):
        grams, n = np.unique(language.keys_of([text + strays])[1], return_counts=True)
        chance.append(language.build_model({"en": (grams, n)}).chance[0])
    assert abs(chance[1] - chance[0]) < 0.03


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language.held_out())
    found = language.identify(docs, language.train(docs.where("not held_out")), keep=("doc_id", "lang", "held_out", "n_chars")).where("held_out and n_chars > 40")
    right, all_of, lost = found.agg(F.count_if(F.expr("lang = lang_pred")), F.count("*"), F.count_if("rejected")).first()
    assert right >= 0.97 * all_of and lost <= 0.01 * all_of
    crc = {r.doc_id: r.held_out for r in docs.collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in crc.items())


def test_language_of_odd_rows(spark, odd):
    learned = make(spark, [(i, t, x, None, None, None, None, None) for i in range(60) for x, t in (("en", f"the quick brown fox number {i} jumps over lazy dogs"), ("de", f"der schnelle braune Fuchs {i} springt über faule Hunde"))])
    model = language.train(learned)
    got = {(r.doc_id, r.text): r for r in language.identify(odd.drop("lang").withColumn("lang_pred2", F.lit(1)), model, keep=("doc_id", "text", "lang_pred2")).collect()}
    for (_, text), r in got.items():
        letters = bool(text and re.search(r"[^\W\d_]", text))
        assert (r.lang_pred in ("en", "de")) == letters and (letters or (r.lang_pred == "und" and r.score == 0 and r.rejected)) and 0 <= r.score <= 1
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    junk = table.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "qxzj wvkq xzzq jqvx kwzx " * 20), (-2, "пример текста на другом языке " * 5)], "doc_id long, text string"))
    assert {r.doc_id for r in language.identify(junk, language.train(table)).where("rejected").collect()} == {-1, -2}
    assert language.train(learned.limit(0)) is None and language.train(odd.where("doc_id < 3")) is None
    assert {(r.lang_pred, r.score, r.rejected) for r in language.identify(odd, None).collect()} == {("und", 0.0, True)}
    assert language.identify(odd.limit(0), model).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def good(kind, value):
        digits = [int(d) for d in re.sub("[^0-9]", "", value)][::-1]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good(k, m[0])]


def test_base_spans_equal_plain_regexes(spark):
    rnd = random.Random(2)
    pool = ["a", "b.c", "@", "@x.y", ".", "1", "25", "256", "0300", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "-", " ", "é", "99.1.2.3", "1.2.3.4.5", "٣", "%", "_", "("]
    for _ in range(4000):
        text = "".join(rnd.choices(pool, k=rnd.randint(1, 12)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert pii.base_spans(row.text) == plain_spans(row.text)


def test_added_kinds_and_redaction(spark, odd):
    texts = [
        "login with password=hunter2hunter2 today", 'token = "d41d8cd98f00b204e9800998ecf8427e" is set', "write to jane.doe [at] mail [dot] org please", "IBAN: DE89 3704 0044 0532 0130 00 for rent",
        "SSN 123-45-6789 on file", "My name is Maria Garcia and I live", "call (212) 555-0187 now", "the rest of the sentence is clean and simple", "version 1.2.3 section 4 page 12",
    ]
    docs = make(spark, [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts * 5)])
    model = pii.train(docs)
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs, model).collect()}
    assert [found[i].split(":")[0] for i in range(7)] == ["secret", "secret", "masked_email", "iban", "national_id", "name", "local_phone"] and found[7] == found[8] == ""
    clean = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert pii.redact(odd, model).exceptAll(odd).count() == 0
    assert clean[0].text == "login with password=[SECRET] today" and clean[7].text == texts[7] and clean[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
    assert pii.redacted("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f"


def test_hints_lose_no_candidate(monkeypatch):
    rnd = random.Random(4)
    pool = ["Name: ", "name: ", "My name is ", "John Smith", "Mr. ", "Sra ", "jane", " at ", " AT ", "[at]", "(at)", "example", ".", " dot ", "[dot]", "com", " ", "paſſword=", "toKen: ", "to\u212Aen: ", "api_\u212Aey=", "hunter2hunter2", "né le ", "1.2.1990", "12 Long Street", "\n"]
    texts = ["Name: John Smith", "write to jane at example.com", *("".join(rnd.choices(pool, k=rnd.randint(2, 9))) for _ in range(6000))]
    hinted = [pii.added_candidates(t, []) for t in texts]
    assert hinted[0] == [("name", 6, 16)] and hinted[1][0][0] == "masked_email"
    monkeypatch.setattr(pii, "_HINT", dict.fromkeys(pii.ADDED_KINDS, re.compile("")))
    assert hinted == [pii.added_candidates(t, []) for t in texts]


def test_sentences_are_no_masked_addresses(spark):
    texts = ["write to jane at example.com please", "he stayed at home. The rest left", "they met at noon. Nobody came"]
    docs = make(spark, [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts * 5)])
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs, pii.train(docs)).collect()}
    assert found[0].startswith("masked_email:") and found[1] == found[2] == ""


def test_long_secrets_are_redacted_whole(spark):
    rnd = random.Random(6)
    key = "".join(rnd.choices("abcdefghijkXYZ0123456789_-", k=900))
    texts = [f"use token={key} now", f"use token={key[:250]}&x@y.org&{key[:80]} now"]
    docs = make(spark, [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts * 5)])
    clean = {r.doc_id: r.text for r in pii.redact(docs, pii.train(docs)).collect()}
    assert clean[0] == "use token=[SECRET] now" and clean[1] == "use token=[SECRET][EMAIL][SECRET] now"


def test_reliabilities_recover_labelers():
    rnd = np.random.default_rng(0)
    truth = rnd.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.55, 0.5])
    votes = np.where((rnd.random((4000, 6)) < right) == truth[:, None], 1, -1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    chance, table = pii.reliabilities(np.zeros(len(patterns), dtype=int), patterns, n)
    by = {tuple(p): c for p, c in zip(patterns.tolist(), chance, strict=True)}
    assert np.mean([(by[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)]) > 0.93
    assert table[0, 1, 2] > 0.9 and table[5, 1, 2] < 0.65


def test_personal_data_of_odd_rows(spark, odd):
    model = pii.train(odd)
    rows = pii.find_personal_data(odd, model).collect()
    assert len(rows) == odd.count()
    for r, source in zip(sorted(rows, key=str), sorted(odd.collect(), key=str), strict=True):
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == 0 and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.train(odd.limit(0)) is None and pii.find_personal_data(odd.limit(0), None).count() == 0


@pytest.mark.parametrize("block", [5, 1000, 1 << 18])
def test_token_files(spark, odd, block):
    docs = written(odd.repartition(3, "text"), "t")
    rows = token_files.count_documents(docs, block=block).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in rows) == collections.Counter((r.doc_id, len(encode(r.text or ""))) for r in odd.collect())
    by_file = collections.defaultdict(list)
    for r in rows:
        by_file[r.file].append((r.ordinal, r.start, r.n_tokens))
    for parts in by_file.values():
        at = 0
        for k, (ordinal, start, n) in enumerate(sorted(parts)):
            assert (ordinal, start) == (k, at)
            at += n + 1
    if block > 1000:
        assert token_files.count_documents(odd.limit(0)).count() == 0


def test_letters_are_of_letter_categories(spark):
    assert [language.normalize(t) for t in ("½ ²", "①", "Ⅷ", "12_3", "हिन्दी भाषा", "Naïve Café", "a\u0301b ́c")] == ["", "", "", "", "हिन्दी भाषा", "naïve café", "a\u0301b c"]
    docs = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(8)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "½ ²"), (2, "①"), (3, "the mat")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, language.train(docs)).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "en"


@pytest.mark.parametrize("reading", [1, 7])
def test_token_counts_do_not_depend_on_splits(spark, reading):
    """Other splits when the table is scanned again, and a limit on records per file, change nothing."""
    keys = {"spark.sql.leafNodeDefaultParallelism": str(reading), "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.maxRecordsPerFile": "7"}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)
    docs = written(docs, "t")
    expected = collections.Counter((r.doc_id, len(encode(r.text or ""))) for r in docs.collect())
    counts = token_files.count_documents(docs)
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        assert collections.Counter((r.doc_id, r.n_tokens) for r in counts.collect()) == expected
        again = token_files.count_documents(docs)
        assert collections.Counter((r.doc_id, r.n_tokens) for r in again.collect()) == expected
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_a_file_without_a_last_mark(spark):
    blocks = spark.createDataFrame([("f", 0, 4, [1]), ("f", 1, 4, []), ("f", 2, 4, [0, 1]), ("f", 3, 2, [])], token_files.BLOCKS)
    assert sorted(tuple(r) for r in token_files.document_counts(blocks).collect()) == [("f", 0, 0, 1, True), ("f", 1, 2, 6, True), ("f", 2, 9, 0, True), ("f", 3, 10, 4, False)]


def plain_emails(text):
    return [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def test_emails_equal_the_pattern():
    rnd = random.Random(6)
    for _ in range(4000):
        text = "".join(rnd.choice("aB9.%-@@. é") for _ in range(rnd.randint(0, 40)))
        assert [s for s in pii.base_spans(text) if s[0] == "email"] == plain_emails(text), text


def test_long_runs_take_linear_time():
    start = time.perf_counter()
    assert [s for s in pii.base_spans("a" * 1_000_000 + "@ " + "b" * 500_000 + "@b.c") if s[0] == "email"] == [("email", 1_000_002, 1_500_006)]
    assert pii.added_candidates("x" * 1_000_000 + " at y", []) == []
    many = "id 123-45-6789, " * 100_000
    assert len(pii.added_candidates(many, [])) == 100_000
    assert len(pii.base_spans("@" * 200_000 + "a@" * 200_000)) == 0
    assert time.perf_counter() - start < 20


def test_long_names_and_addresses_are_whole_spans():
    name, local = "X" + "y" * 90, "j" * 200
    for text, kind, value in [
        (f"Dr {name} {name} came", "name", f"{name} {name}"),
        (f"mail {local} at example dot com now", "masked_email", f"{local} at example dot com"),
        (f"mail joe at {'h' * 100}.a.b.c.d.e.f.com now", "masked_email", f"joe at {'h' * 100}.a.b.c.d.e.f.com"),
        (f"at 12 {name} Street.", "address", f"12 {name} Street"),
    ]:
        assert [(k, text[a:b]) for k, a, b in pii.added_candidates(text, [])] == [(kind, value)]
