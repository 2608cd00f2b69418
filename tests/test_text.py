from pyspark.sql import functions as F

from dossier.functions import dates, text, values
from dossier.functions.pages import parse_page_numbers
from dossier.operators import chunk_quality, pages


def one(spark, column, *args):
    names = [f"c{i}" for i in range(len(args))]
    df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_hyphen_runs(spark):
    assert one(spark, text.clean_hyphen_runs, "a -- - b - - ") == "a b"
    assert one(spark, text.clean_hyphen_runs, "uno-dos — fin") == "uno-dos — fin"
    assert one(spark, text.clean_hyphen_runs, "x - - \ny -—z") == "x\ny z"


def test_tilde_words_keep_case(spark):
    assert one(spark, text.restore_tilde_words, "n~mero N~MERO N~mero n~MERO") == "número NÚMERO Número número"
    assert one(spark, text.restore_tilde_words, "xn~mero ~n~mero cl~usulas cl~usula m~<ico zz~z") == "xn~mero ~número cláusulas cláusula méxico zz~z"
    assert one(spark, text.restore_tilde_words, "sin cambios") == "sin cambios"


def test_normalize_page(spark):
    raw = "\r\n  A  b\t c \r\n\r\n\xa0\n\nn~mero -- -\r--- ---\nfin\n\n"
    df = spark.createDataFrame([(1, 1, raw)], "doc_id long, page_number int, text string")
    assert pages.normalize_pages(df).first()["text"] == "A b c\n\nnúmero\n\nfin"


def test_noisy_lines(spark):
    noisy = ["-_=", "....", "a1 ++--", "* ? ! #"]
    fine = ["", "  ", "abc ---------", "12", "ab 1", "1 2 *"]
    for line in noisy:
        assert one(spark, text.is_noisy_line, line) is True, line
    for line in fine:
        assert one(spark, text.is_noisy_line, line) is False, line


def test_extraction_choice_boundary(spark):
    native = spark.createDataFrame([(1, "x" * 119, "i"), (2, "x" * 120, "i")], "doc_id long, text string, index_text string")
    scanned = spark.createDataFrame([(1, "scan", "s"), (3, "only", "s")], "doc_id long, text string, index_text string")
    got = {r["doc_id"]: (r["method"], r["text"]) for r in pages.choose_extraction(native, scanned).collect()}
    assert got == {1: ("ocr", "scan"), 2: ("native", "x" * 120), 3: ("ocr", "only")}


def test_page_numbers(spark):
    assert one(spark, parse_page_numbers, "3, 1,x,,0,-2,3,1.5") == [3, 1]


def test_tail_pages(spark):
    rows = [(1, n, "folio mercantil" if n in (4, 5, 6) else "") for n in range(1, 11)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, text string")
    got = sorted(r["page_number"] for r in pages.select_tail_pages(df, 3, 8).collect())
    # Three pages with wording outrank the last page, which then replaces the weakest of them.
    assert got == [5, 6, 10]
    assert pages.select_tail_pages(df, 0, 8).count() == 0


def test_variants(spark):
    good = "ESCRITURA 1 LIBRO 2 FECHA 3"
    rows = [(1, 5, 0, good), (1, 5, 1, good * 3), (1, 6, 0, "x"), (1, 6, 1, good), (1, 1, 0, good), (1, 1, 1, good + " FECHA 4"), (1, 2, 0, "same"), (1, 2, 1, "same")]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, variant int, text string")
    got = {r["page_number"]: r["variant"] for r in pages.best_page_variant(df).collect()}
    assert got == {5: 0, 6: 1, 1: 1, 2: 0}


def test_dates(spark):
    cases = {
        "05/03/2024": "2024-03-05", "31-02-2024": "2024-03-02", "5-3-24": "2005-03-24", "99-12-31": "1999-12-31", "2024-05-06": "2024-05-06",
        "mañana": None, "n/a": None, "": None, "40-01-2024": None, "01-13-2024": None,
        "15 March 2024": "2024-03-15", "mar 5, 2024": "2024-03-05", "15 mayo 2024": None,
    }
    for raw, iso in cases.items():
        assert one(spark, dates.normalize_date, raw) == iso, raw


def test_expiry_classes(spark):
    df = spark.createDataFrame([(-1,), (0,), (7,), (8,), (None,)], "d int")
    assert [r[0] for r in df.select(dates.expiry_status(F.col("d"))).collect()] == ["expired", "expiring", "expiring", "ok", "ok"]


def test_values(spark):
    for raw in ["n/a", " S/D ", "Sin   Datos", "NULL", "", "  ", "n.d."]:
        assert one(spark, values.is_meaningful, raw) is False, raw
    assert one(spark, values.is_meaningful, "nda") is True
    field = lambda f, v: one(spark, lambda c: values.sanitize_field(F.lit(f), c), v)
    assert field("notaria_numero", "No. 12*") == "No.12" and field("notaria_numero", "7") is None and field("libro_numero", "abc") is None
    assert field("rpc_lugar", "abc") is None and field("rpc_lugar", " Nuevo   León ") == "Nuevo León" and field("rpc_folio", "Folio") is None
    assert field("acto", "Poder general; ") == "Poder general" and field("acto", "contratación de personal") is None
    assert field("acto", "uno " * 15) is None and field("acto", "poder " + "uno " * 15) == ("poder " + "uno " * 15).strip()
    assert one(spark, lambda c: values.sanitize_act(c, on_save=True), "ab") == "ab" and one(spark, values.sanitize_act, "ab") is None


def test_quality(spark):
    cases = {
        "": (4, True), "texto normal": (0, False), "a~o ~ ~ ~ ~": (3 + 1, True), "dos 12 tokens 34": (1, False), "pa'labra £ uno y otras palabras largas": (3, True),
        "uno\na\nb\nc\nd": (2, False), "~~ dos": (2 + 1, True), "12 34 ~ palabras y otras mas": (2, False),
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r["text"]: (r["score"], r["suspicious"]) for r in chunk_quality.chunk_quality(df).collect()}
    assert got == cases


def test_symbol_ratio_boundary(spark):
    df = spark.createDataFrame([("a" * 86 + "." * 14,), ("a" * 87 + "." * 13,)], "text string")
    assert [r["score"] for r in chunk_quality.chunk_quality(df).collect()] == [1, 0]
