"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.shared import bounded_batches, map_batches, smallest, strings, written

#: Characters in an n-gram. Four characters of 16 bits make one exact 64-bit key.
ORDER = 4
#: Labelled documents on which the two weights of the confidence are fitted.
CALIBRATION_ROWS = 4_000
#: A document is rejected if its cross-entropy is this many standard deviations above the mean of its language.
REJECT_SIGMAS = 8.0
#: Documents of a language vary by this much at least, whatever the labelled rows show.
LEAST_DEVIATION = 0.08
UNDETERMINED = "und"

#: A word: a letter and the letters and marks (vowel signs, accents) that follow it.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
#: In texts of these characters the words are what is left between all but \w without digits and underscores.
_LATIN = re.compile("[\\x00-\\xa9\\xab-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf-\\u02c1\u2000-\u2069\u20a0-\u20bf]*")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PREFIX_BITS = 18


def normalize(text: str) -> str:
    """Lower-case words of letters and their marks, by Unicode category; every run of anything else is one space.

    Numbers of any kind (fractions, circled and raised digits, Roman numerals) are no letters.
    """
    text = text.lower()
    if _LATIN.fullmatch(text):
        return _NOT_LETTERS.sub(" ", text).strip()
    return " ".join(_WORD.findall(text))


def keys_of(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram) of every character of the normalized texts, in place.

    The n-gram of a character is itself in the lowest 16 bits and the characters before it above; a text begins with
    blanks. Characters beyond the basic plane share one replacement character.
    """
    if not texts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    pad = " " * (order - 1)
    joined = [pad + t for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(codes > 0xFFFF, 0xFFFD, codes).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in joined])
    keys = codes.copy()
    for back in range(1, order):
        keys[back:] |= codes[:-back] << np.uint64(16 * back)
    starts = np.cumsum([0, *(len(t) for t in joined[:-1])])
    inside = np.ones(len(codes), dtype=bool)
    for j in range(order - 1):
        inside[starts + j] = False
    return doc[inside], keys[inside]


class HashArray:
    """Values by 64-bit key in an array sorted by hash; a table of hash prefixes bounds the search to a few neighbours."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = keys * _MULTIPLIER  # one to one, as the multiplier is odd
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        heads = np.arange((1 << _PREFIX_BITS) + 1, dtype=np.float64) * 2.0 ** (64 - _PREFIX_BITS)
        self.first = np.searchsorted(self.hashes, heads[:-1].astype(np.uint64)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        hashes = keys * _MULTIPLIER
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.hashes):
            return out
        todo = np.arange(len(keys))
        at = self.first[(hashes >> np.uint64(64 - _PREFIX_BITS)).astype(np.int64)]
        while len(todo):
            inside = at < len(self.hashes)
            todo, at = todo[inside], at[inside]
            there, mine = self.hashes[at], hashes[todo]
            hit = there == mine
            out[todo[hit]] = at[hit]
            on = there < mine
            todo, at = todo[on], at[on] + 1
        return out


@dataclass
class Model:
    """Log probabilities of all languages by n-gram, and log back-off weights by context; one pair of arrays per order."""

    languages: list[str]
    grams: list[HashArray]  # order 1..n: [gram, language] log probability
    backoffs: list[HashArray]  # context length 1..n-1: [context, language] log weight
    unknown: np.ndarray  # log probability of an unseen character
    chance: np.ndarray  # nats per character of drawing characters at random, as often as the language has them
    calibration: dict

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """[key, language]; unseen n-grams back off order by order."""
        out = np.zeros((len(keys), len(self.languages)), dtype=np.float32)
        todo = np.arange(len(keys))
        for order in range(len(self.grams), 0, -1):
            part = keys[todo] & np.uint64((1 << (16 * order)) - 1)
            found = self.grams[order - 1].find(part)
            hit = found >= 0
            out[todo[hit]] += self.grams[order - 1].values[found[hit]]
            todo, part = todo[~hit], part[~hit]
            if not len(todo):
                return out
            if order > 1:
                context = self.backoffs[order - 2].find(part >> np.uint64(16))
                known = context >= 0
                out[todo[known]] += self.backoffs[order - 2].values[context[known]]
        out[todo] += self.unknown
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """([text, language] nats per character, characters) of normalized texts; every character counts."""
        out, size = np.zeros((len(texts), len(self.languages))), np.array([len(t) for t in texts])
        at = 0
        while at < len(texts):
            upto = at + 1
            while upto < len(texts) and size[at : upto + 1].sum() <= 400_000:
                upto += 1
            part = texts[at:upto]
            if sum(map(len, part)):
                # A long text is scored piece by piece; pieces share the characters that the n-grams reach back.
                doc, keys = keys_of(part)
                for a in range(0, len(keys), 400_000):
                    scores = self.log_probabilities(keys[a : a + 400_000])
                    for k in range(len(self.languages)):
                        out[at:upto, k] -= np.bincount(doc[a : a + 400_000], weights=scores[:, k], minlength=len(part))
            at = upto
        return out / np.maximum(size, 1)[:, None], size


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of all highest-order n-grams over all labelled rows."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, texts = batch.column(0).to_pylist(), [normalize(t) for t in strings(batch.column(1))]
        for lang in sorted(set(langs)):
            _, keys = keys_of([t for t, x in zip(texts, langs, strict=True) if x == lang and t])
            grams, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return map_batches(labelled.select("lang", "text"), each, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=values, minlength=len(unique))


def _kneser_ney(grams: np.ndarray, counts: np.ndarray, order: int) -> tuple[list, list, float]:
    """Probabilities by order, back-off weights by context length, and the probability of an unseen character.

    The highest order uses counts, lower ones the number of different characters before; each order gives the absolute
    discount of its contexts to the order below, and the lowest gives it to a uniform share over the characters seen.
    """
    levels = [(grams, counts.astype(np.float64))]
    for n in range(order - 1, 0, -1):
        levels.append(_sums(levels[-1][0] & np.uint64((1 << (16 * n)) - 1), np.ones(len(levels[-1][0]))))
    levels.reverse()
    probabilities, backoffs, lower, uniform = [], [], None, 0.0
    for n, (keys, values) in enumerate(levels, 1):
        once, twice = (values == 1).sum(), (values == 2).sum()
        discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once and twice else 0.5
        context = keys >> np.uint64(16)
        heads, total = _sums(context, values)
        _, kinds = _sums(context, np.ones(len(keys)))
        at = np.searchsorted(heads, context)
        weight = discount * kinds / total
        if n == 1:
            uniform = weight[0] / (len(keys) + 1)
            below = np.full(len(keys), 1.0 / (len(keys) + 1))
        else:
            suffix = keys & np.uint64((1 << (16 * (n - 1))) - 1)
            below = lower[1][np.searchsorted(lower[0], suffix)]
            backoffs.append((heads, weight))
        lower = keys, (values - discount) / total[at] + weight[at] * below
        probabilities.append(lower)
    return probabilities, backoffs, uniform


def _character_entropy(grams: np.ndarray, counts: np.ndarray) -> float:
    """Nats per character of the counted texts; characters seen by accident weigh as little as they are rare."""
    _, n = _sums(grams & np.uint64(0xFFFF), counts.astype(np.float64))
    share = n / n.sum()
    return float(-(share * np.log(share)).sum())


def _union(parts: list[tuple[np.ndarray, np.ndarray]], missing) -> tuple[np.ndarray, np.ndarray]:
    """All keys of all languages with a [key, language] matrix; ``missing(language, keys)`` fills the gaps."""
    keys = np.unique(np.concatenate([k for k, _ in parts])) if parts else np.empty(0, dtype=np.uint64)
    table = np.empty((len(keys), len(parts)), dtype=np.float32)
    for j, (own, values) in enumerate(parts):
        at = np.searchsorted(keys, own)
        gap = np.ones(len(keys), dtype=bool)
        gap[at] = False
        table[at, j] = np.log(values)
        table[gap, j] = missing(j, keys[gap])
    return keys, table


def build_model(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """Models of all languages from their n-gram counts, by the same keys."""
    languages = sorted(counts)
    fitted = [_kneser_ney(*counts[x], order) for x in languages]
    unknown = np.log(np.array([u for *_, u in fitted], dtype=np.float64)).astype(np.float32)
    chance = np.array([_character_entropy(*counts[x]) for x in languages])
    backoffs = [HashArray(*_union([b[n] for _, b, _ in fitted], lambda j, keys: np.zeros(len(keys)))) for n in range(order - 1)]
    arrays: list[HashArray] = []
    for n in range(1, order + 1):

        def backed(j: int, keys: np.ndarray, n: int = n) -> np.ndarray:
            if n == 1:
                return np.full(len(keys), unknown[j])
            return Model(languages, arrays[: n - 1], backoffs[: n - 2], unknown, chance, {}).log_probabilities(keys & np.uint64((1 << (16 * (n - 1))) - 1))[:, j] + _weight(backoffs[n - 2], keys >> np.uint64(16), j)

        arrays.append(HashArray(*_union([p[n - 1] for p, *_ in fitted], backed)))
    return Model(languages, arrays, backoffs, unknown, chance, {})


def _weight(array: HashArray, contexts: np.ndarray, j: int) -> np.ndarray:
    found = array.find(contexts)
    return np.where(found >= 0, array.values[found, j] if len(array.values) else 0.0, 0.0)


def _choose(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its nats per character, margin to the second, characters)."""
    nats, size = model.cross_entropy(texts)
    return *_best(nats), size


def _best(nats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = nats.argmin(axis=1)
    lowest = nats[np.arange(len(nats)), best]
    second = np.partition(nats, 1, axis=1)[:, 1] if nats.shape[1] > 1 else lowest + 1.0
    return best, lowest, second - lowest


def _calibrate(truth: np.ndarray, best: np.ndarray, margin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Weights of a logistic confidence on the evidence (margin times the root of the length)."""
    x = np.stack([np.ones(len(margin)), np.minimum(margin * np.sqrt(size), 20.0)], axis=1)
    y, w = (truth == best).astype(float), np.array([0.0, 0.5])
    prior = np.array([0.0, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (y - p) - 0.1 * (w - prior))
        w = w + np.clip(step, -2, 2)
    return w


def _usual(scores: DataFrame, languages: int) -> np.ndarray:
    """[language]: mean nats per character, variance between documents, and variance times length, over all rows of
    ``scores`` that are predicted as labelled; over all labelled rows of a language that has none of these.

    One aggregate with partial sums; the driver reads two rows per language.
    """
    own, size = F.col("own"), F.col("size")
    sums = {"n": F.count("*").cast("double"), "x": F.sum(own), "xx": F.sum(own * own), "s": F.sum(size).cast("double"), "sx": F.sum(size * own), "sxx": F.sum(size * own * own)}
    found = scores.where("size > 0").groupBy("truth", F.expr("truth = best").alias("right")).agg(*[v.alias(k) for k, v in sums.items()])
    usual = np.full((languages, 3), np.inf)
    for r in sorted(found.collect(), key=lambda r: r["right"]):
        mean = r["sx"] / r["s"]
        between, within = r["xx"] / r["n"] - 2 * mean * r["x"] / r["n"] + mean**2, (r["sxx"] - mean * r["sx"]) / r["n"]
        usual[r["truth"]] = mean, max(between, LEAST_DEVIATION**2), max(within, 0.0)
    return usual


def _limits(model: Model, best: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Cross-entropy above which a text is rejected: many deviations off, of which shorter texts have larger ones, and
    nearer to random letters than to the usual text of the language."""
    mean, between, within = model.calibration["usual"][best].T
    return np.maximum(mean + REJECT_SIGMAS * np.sqrt(np.maximum(between, within / np.maximum(size, 1))), (mean + model.chance[best]) / 2)


def _confidence(model: Model, margin: np.ndarray, size: np.ndarray) -> np.ndarray:
    w = model.calibration["weights"]
    return 1 / (1 + np.exp(-(w[0] + w[1] * np.minimum(margin * np.sqrt(size), 20.0))))


def train(labelled: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """Models of all languages in ``labelled`` (doc_id, lang, text), counted over all of its texts; None without any letter.

    The driver reads every distinct n-gram with its count, which are the model: none is left out, so discounts and
    continuation counts are those of all texts, and the model grows with the n-grams that the languages have. All labelled
    texts are scored once more: what is usual of a language comes from all of its rows, two rows per language for the
    driver; the weights of the confidence from the ``calibration_rows`` documents with the smallest seeded hash (of equal
    rows at the last place, so many again).
    """
    found = gram_counts(labelled.where("lang is not null and text is not null")).toArrow()
    if not found.num_rows:
        return None
    coded = found.column("lang").combine_chunks().dictionary_encode()
    langs, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    grams, n = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    counts = {}
    for code, lang in sorted(enumerate(names), key=lambda x: x[1]):
        own = np.flatnonzero(langs == code)
        own = own[np.argsort(grams[own])]
        counts[lang] = grams[own], n[own]
    model = build_model(counts)
    spark, place = labelled.sparkSession, {x: j for j, x in enumerate(model.languages)}
    shipped = spark.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [normalize(t) for t in strings(batch.column(1))]
        truth = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
        nats, size = shipped.value.cross_entropy(texts)
        best, _, margin = _best(nats)
        own = nats[np.arange(len(texts)), truth]
        yield pa.RecordBatch.from_arrays([pa.array(truth), pa.array(best, pa.int64()), pa.array(own), pa.array(margin), pa.array(size, pa.int64()), batch.column(2)], names=["truth", "best", "own", "margin", "size", "key"])

    known = labelled.where(F.col("lang").isin(model.languages) & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text", F.lit(7)).alias("key"))
    scores = written(map_batches(known, each, "truth long, best long, own double, margin double, size long, key long"), "language-scores")
    rows = smallest(scores, F.col("key"), calibration_rows).limit(2 * calibration_rows).toArrow()
    weights = _calibrate(*(rows.column(c).to_numpy() for c in ("truth", "best", "margin", "size")))
    model.calibration = {"weights": weights, "usual": _usual(scores, len(model.languages))}
    return model


def held_out(id_column: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(4)) == 2


def identify(docs: DataFrame, model: Model | None, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row with lang_pred, score, cross_entropy and rejected.

    The language of the lowest cross-entropy per character wins; ties go to the first in code point order. ``score`` is the
    calibrated chance that it is right. ``rejected``: no letter, or a cross-entropy far above the usual of that language.
    Null text, text without a letter, and any text if nothing was learned give ``und``, score 0, rejected.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    inner = text_column in keep
    source = docs.select(*keep) if inner else docs.select(*keep, text_column)
    at = source.columns.index(text_column)
    schema = T.StructType(docs.select(*keep).schema.fields)
    for name, kind in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType())):
        schema = schema.add(name, kind)
    shipped = spark.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model, texts = shipped.value, [normalize(t) for t in strings(batch.column(at))]
        letters = np.array([bool(t) for t in texts])
        names = np.full(len(texts), UNDETERMINED, dtype=object)
        score, entropy, rejected = np.zeros(len(texts)), np.zeros(len(texts)), ~letters
        if model is not None and len(texts):
            best, entropy, margin, size = _choose(model, texts)
            names[letters] = np.array(model.languages, dtype=object)[best[letters]]
            score = np.where(letters, _confidence(model, margin, size), 0.0)
            rejected = rejected | (entropy > _limits(model, best, size))
        elif model is None:
            rejected[:] = True
        new = [pa.array(names, pa.string()), pa.array(score), pa.array(np.where(letters, entropy, 0.0)), pa.array(rejected)]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=schema.names)

    return map_batches(source, each, schema)
