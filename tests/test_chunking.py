import random

import pytest

from pyspark.sql import functions as F

from dossier.operators import chunking

SIZE = 40


def windows(s, size, step):
    parts = [s[i : i + size].strip() for i in range(0, len(s), step)]
    return [p for p in parts if p]


def greedy(parts, size, glue):
    out, current = [], []
    for part in parts:
        if current and len(glue.join(current + [part])) > size:
            out.append(current)
            current = []
        current.append(part)
    return out + ([current] if current else [])


def pieces(paragraph, size):
    if len(paragraph) <= size:
        return [paragraph]
    out, run = [], []
    for line in [x.strip() for x in paragraph.split("\n") if x.strip()] + [None]:
        if line is None or len(line) > size:
            out += ["\n".join(g) for g in greedy(run, size, "\n")]
            run = []
            if line is not None:
                out += windows(" ".join(line.split()), size, size)
        else:
            run.append(line)
    return [p.strip() for p in out if p.strip() not in ("", "0")]


def split(text):
    blocks, current = [], []
    for line in text.strip().split("\n") + [""]:
        if line.strip():
            current.append(line.strip())
        elif current:
            blocks.append("\n".join(current))
            current = []
    return blocks


def words(rng, n):
    return " ".join("x" * rng.randint(1, 9) for _ in range(n))


def random_text(rng):
    parts = [words(rng, rng.choice([1, 2, 5, 12])) + ("\n" + words(rng, 3)) * rng.randint(0, 3) for _ in range(rng.randint(0, 6))]
    return "\n \n".join(parts + rng.choice([[], ["0"], ["y" * 95], ["a  b" * 12]]))


def test_fixed_windows(spark):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(40)] + ["", " ", "a" * 1200, "a" * 1201, "b" * 2250]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in [(40, 10), (40, 0), (40, 35), (1200, 150)]:
        got = {}
        for r in chunking.chunk_fixed(df, size, overlap).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r["doc_id"], []).append(r["text"])
        for i, t in enumerate(texts):
            flat = " ".join(t.split(" ")) if t.isspace() else "".join(" " if c.isspace() else c for c in t)
            while "  " in flat:
                flat = flat.replace("  ", " ")
            assert got.get(i, []) == windows(flat, size, max(size - overlap, 1)), (i, size, overlap)


def test_split_oversized(spark):
    rng = random.Random(5)
    texts = [b for _ in range(80) for b in split(random_text(rng))] + ["0", "0\n" + "z" * 90, "q" * 41]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["p"] for r in df.select("doc_id", chunking.split_oversized(F.col("text"), SIZE).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pieces(t, SIZE), t


def expected_chunks(pages):
    parts = [(s, n) for n, t in pages for b in split(t) for s in pieces(b, SIZE)]
    groups, at = [], 0
    for g in greedy([s for s, _ in parts], SIZE, "\n\n"):
        seen = []
        for _, n in parts[at : at + len(g)]:
            if n not in seen:
                seen.append(n)
        groups.append(("\n\n".join(g), seen))
        at += len(g)
    return groups


@pytest.mark.parametrize("block, fan, levels", [(3, 4096, 0), (3, 2, 1), (2, 2, 2), (256, 4096, 1)])
def test_chunk_pages_equals_sequential_packing(spark, monkeypatch, block, fan, levels):
    rng = random.Random(11)
    monkeypatch.setattr(chunking, "BLOCK_PAGES", block)
    monkeypatch.setattr(chunking, "FAN_OUT", fan)
    docs = {d: [(n, random_text(rng)) for n in range(1, rng.randint(1, 25))] for d in range(40)}
    docs[100] = [(n, "ab") for n in range(1, 60)]
    rows = [(d, n, t) for d, ps in docs.items() for n, t in ps]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, text string")
    texts = spark.createDataFrame([(d, "") for d in docs], "doc_id long, text string")
    got = {}
    for r in chunking.chunk_pages(pages, texts, SIZE, levels).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["text"], r["page_numbers"]))
        assert len(r["text"]) <= SIZE
    for d, ps in docs.items():
        want = [(i, t, p) for i, (t, p) in enumerate(expected_chunks(ps))]
        assert got.get(d, []) == want, d


def test_text_without_pages_keeps_long_paragraphs(spark):
    texts = spark.createDataFrame([(1, "a" * 50 + "\n\nb\n\nc"), (2, " \n "), (3, "x")], "doc_id long, text string")
    pages = spark.createDataFrame([(3, 1, "  "), (3, 0, "no"), (1, 1, "\n")], "doc_id long, page_number int, text string")
    rows = chunking.chunk_pages(pages, texts, SIZE).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["text"], r["page_numbers_csv"]) for r in rows] == [(1, "a" * 50, None), (1, "b\n\nc", None), (3, "x", None)]


def test_page_columns(spark):
    pages = spark.createDataFrame([(1, 2, "uno"), (1, 3, "dos")], "doc_id long, page_number int, text string")
    row = chunking.chunk_pages(pages, spark.createDataFrame([(1, "")], "doc_id long, text string")).first()
    assert (row["text"], row["page_ids"], row["page_numbers_csv"], row["primary_page"]) == ("uno\n\ndos", ["page-2", "page-3"], "2,3", 2)


def test_block_maps_outgrow_32_bits(spark):
    row = spark.sql("select 1 as x").select(
        chunking._then(*[F.struct(F.lit(1_500_000_000).cast("long").alias("total"), F.array(F.struct(F.lit(5).cast("long").alias("need"), F.struct(F.lit(1).cast("long").alias("flushes"), F.lit(3).cast("long").alias("buffer")).alias("run"))).alias("flush_at"))] * 2, SIZE).alias("m")
    ).first()
    assert row["m"]["total"] == 3_000_000_002
