"""Personal data by weak supervision: labelers vote on spans, EM weighs the labelers, a classifier decides."""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import map_batches, smallest, strings, written

BASE_KINDS = ["email", "ip", "card", "phone"]
#: Kinds that only the method finds, in the order in which spans are listed after the base kinds.
ADDED_KINDS = ["secret", "masked_email", "local_phone", "iban", "national_id", "name", "address", "birth_date"]
KINDS = BASE_KINDS + ADDED_KINDS
LABELERS = ["format", "shape", "known", "sample", "context", "other_context"]
#: Candidates on which the span classifier is fitted, those with the smallest seeded hash.
TRAIN_SPANS = 20_000
THRESHOLD = 0.5

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")

#: Where an added kind may be; group 1 is the span.
_ADDED = {
    "secret": re.compile(r"(?:pass(?:word|wd|phrase)|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>]{6,})", re.I),
    "masked_email": re.compile(r"((?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:\[at\]|\(at\)|\s[Aa][Tt]\s)\s?[A-Za-z0-9-]++(?:\s?(?:\[dot\]|\(dot\)|\s[Dd][Oo][Tt]\s|\.)\s?[A-Za-z0-9-]++){1,4}(?:\.[A-Za-z0-9-]++)*+)"),
    "local_phone": re.compile(r"(?<![\w+.-])(\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![\w-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "national_id": re.compile(r"(?<![\w-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"),
    "name": re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20|(?:[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Nn]ame:)\x20)([A-ZÀ-Þ][\w'-]+(?:\x20[A-ZÀ-Þ][\w'-]+){0,2})"),
    "address": re.compile(r"(?<!\w)([0-9]{1,5}[A-Za-z]?\x20(?:[A-ZÀ-Þ][\w'-]+\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Straße|Strasse))\b"),
    "birth_date": re.compile(r"(?:\b(?:born(?: on)?|[Dd]ate of birth|DOB|geboren am|né(?:e)? le|nacido el)\b:?\x20)([0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4})"),
}
#: Something that every match of the pattern above contains, so no candidate is lost; keeps whole-text passes cheap.
_HINT = {
    "secret": re.compile(r"(?:[Pp][Aa][Ssſ][Ssſ]|[Pp][Ww][Dd]|[Tt][Oo][Kk\u212A][Ee][Nn]|[Ssſ][Ee][Cc][Rr][Ee][Tt]|[Kk\u212A][Ee][Yy])[\w-]{0,8}[\"']?\s{0,3}[:=]"),
    "masked_email": re.compile(r"(?:\[at\]|\(at\)|\s[Aa][Tt]\s)\s?[A-Za-z0-9-]++\s?(?:\[dot\]|\(dot\)|\s[Dd][Oo][Tt]\s|\.)\s?[A-Za-z0-9-]"),
    "local_phone": re.compile(r"[0-9]{3}[\x20.-][0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}"),
    "national_id": re.compile(r"[0-9]-[0-9]{2}-[0-9]"),
    "name": re.compile(r"\b(?:M[rs]s?|Dr|Prof|Herr|Frau|Mme|Sra?)\b|[Nn]ame|heiße|appelle|llamo"),
    "address": re.compile(r"[0-9][A-Za-z]?\x20[A-ZÀ-Þ]"),
    "birth_date": re.compile(r"born|birth|DOB|geboren|né|nacido"),
}
_FIRST_NAMES = frozenset("james john robert michael william david mary patricia jennifer linda elizabeth maria anna peter paul thomas hans karl claudia sabine jean pierre marie sophie juan jose carlos carmen lucia ana luis".split())
_ENDINGS = frozenset("com org net edu gov info io de fr es it uk eu us ch at nl".split())
_SAMPLES = re.compile(r"example|sample|test|localhost|changeme|placeholder|your[_-]|xxxx|^0\.0\.0\.0$|^127\.|^255\.|1234567|0000000", re.I)
_CONTEXT = {
    "email": r"mail|contact|write|reply|@", "ip": r"\bip\b|address|host|server|login|client", "card": r"card|visa|credit|payment|pay\b|karte|carte|tarjeta",
    "phone": r"phone|tel\b|tel\.|call|mobile|fax|whatsapp|telefon|llame", "secret": r"pass|token|secret|key|login|credential|pwd", "masked_email": r"mail|contact|write|reach",
    "local_phone": r"phone|tel\b|tel\.|call|mobile|fax|telefon", "iban": r"iban|account|bank|konto|compte|cuenta", "national_id": r"ssn|social|security|tax", "name": r"name|mr|mrs|ms|dr|herr|frau|mme|sra?\b|heiße|appelle|llamo",
    "address": r"address|live|street|home|ship|visit|adresse", "birth_date": r"born|birth|dob|geboren|né|nacido",
}
_CONTEXT = {kind: re.compile(pattern, re.I) for kind, pattern in _CONTEXT.items()}
_OTHER_CONTEXT = re.compile(r"version|\bv$|section|chapter|isbn|issn|order no|invoice|figure|table|page|build|revision|rfc", re.I)
#: A full stop with a blank beside it: "at home. The" has the form of a masked address, but ends a sentence.
_SENTENCE_END = re.compile(r"\s\.|\.\s")
#: Code points looked at before a span.
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, each leftmost and non-overlapping, by kind and start; failing matches are dropped."""
    out = []
    if "@" in text:
        done, last = 0, -1
        while (at := text.find("@", last + 1)) >= 0:
            # The local part is the run of its characters before the sign: any shorter one is followed by the same domain.
            run = text[max(done, last + 1) : at]
            start = at - len(run) + len(run.rstrip(_LOCAL))
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                out.append(("email", start, domain.end()))
                done = domain.end()
            last = at
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def added_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that may be of the added kinds and overlap no base span, nor an earlier kind's.

    Of a secret that overlaps base spans, the parts between them are candidates.
    """
    out: list[tuple[str, int, int]] = []
    starts: list[int] = []  # of taken stretches, in order; they do not meet
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for kind in ADDED_KINDS:
        if not _HINT[kind].search(text):
            continue
        for m in _ADDED[kind].finditer(text):
            a, b = m.span(1)
            first = at = bisect_right(ends, a)
            free = []
            while at < len(starts) and starts[at] < b:
                free.append((a, starts[at]))
                a = ends[at]
                at += 1
            if at > first:
                free = [(x, y) for x, y in [*free, (a, b)] if y - x >= 6] if kind == "secret" else []
            else:
                free = [(a, b)]
            for x, y in free:
                place = bisect_right(ends, x)
                starts.insert(place, x)
                ends.insert(place, y)
                out.append((kind, x, y))
    return out


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def vote(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What each labeler says of a span: 1 personal, -1 not, 0 nothing."""
    value, before = text[start:end], text[max(0, start - WINDOW) : start]
    digits = _DIGITS.sub("", value)
    if kind == "iban":
        form = 1 if _iban(value) else -1
    elif kind in ("card", "ip"):
        form = 1
    elif kind in ("phone", "local_phone"):
        form = 1 if 10 <= len(digits) <= 13 else -1
    elif kind == "national_id":
        form = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1
    elif kind == "secret":
        form = 1 if len(value) >= 8 and any(c.isdigit() for c in value) else -1
    elif kind == "birth_date":
        form = 1 if len(digits) in (6, 7, 8) else -1
    elif kind == "masked_email" and _SENTENCE_END.search(value):
        form = -1
    else:
        form = 1 if len(value) >= 5 else 0
    if digits:
        shape = 1 if len(set(digits)) > 2 else -1
    else:
        shape = 0 if kind in ("name", "masked_email", "email", "address") else -1
    last = re.split(r"[.\s]+", value.strip(" ])("))[-1].lower()
    known = kind in ("email", "masked_email") and last in _ENDINGS or kind == "name" and value.split(" ")[0].lower() in _FIRST_NAMES or kind == "secret" and len(value) >= 16 and len(set(value)) >= 8
    return (
        form,
        shape,
        int(known),
        -1 if _SAMPLES.search(value) else 0,
        1 if _CONTEXT[kind].search(before) else 0,
        -1 if _OTHER_CONTEXT.search(before) else 0,
    )


PREVIOUS_WORDS = 64
N_FEATURES = 1 + len(KINDS) + 3 * len(LABELERS) + 8 + PREVIOUS_WORDS + 4


def features(text: str, kind: str, start: int, end: int, votes: tuple[int, ...]) -> list[int]:
    """Indices of a span's features that are one: kind, votes, length, hashed word before, kind of character after."""
    words = text[max(0, start - WINDOW) : start].lower().split()
    digest = hashlib.blake2b((words[-1] if words else "").encode("utf-8", "surrogatepass"), digest_size=4).digest()
    after = text[end : end + 1]
    base = 1 + len(KINDS)
    out = [0, 1 + KINDS.index(kind)] + [base + 3 * j + v + 1 for j, v in enumerate(votes)]
    base += 3 * len(LABELERS)
    out.append(base + min(7, (end - start).bit_length() - 1))
    base += 8
    out.append(base + int.from_bytes(digest, "little") % PREVIOUS_WORDS)
    return [*out, base + PREVIOUS_WORDS + (0 if not after else 1 if after.isspace() else 2 if after.isalnum() else 3)]


def reliabilities(kinds: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: each pattern's chance of being personal, and P(vote | truth) as
    [labeler, truth, vote + 1]. Patterns come with their kind and their count ``n``.

    It starts from the vote's majority; counts are smoothed towards labelers that are right more often than not.
    """
    prior = np.ones((votes.shape[1], 2, 3))
    prior[:, 1, 2] = prior[:, 0, 0] = 2.0
    chance = 1 / (1 + np.exp(-(votes.sum(axis=1) - 0.5)))
    table = prior
    for _ in range(rounds):
        table = prior.copy()
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                table[j, 1, v + 1] += (n * chance)[at].sum()
                table[j, 0, v + 1] += (n * (1 - chance))[at].sum()
        table /= table.sum(axis=2, keepdims=True)
        share = np.array([((n * chance)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
        odds = np.log(share / (1 - share))[kinds]
        for j in range(votes.shape[1]):
            odds = odds + np.log(table[j, 1, votes[:, j] + 1] / table[j, 0, votes[:, j] + 1])
        chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return chance, table


def fit_spans(active: list[list[int]], target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels, by gradient steps with momentum."""
    x = np.zeros((len(active), N_FEATURES))
    for i, on in enumerate(active):
        x[i, on] = 1.0
    w, speed = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        speed = 0.9 * speed - 0.5 * (x.T @ (p - target) / len(x) + 1e-4 * w)
        w = w + speed
    return w


@dataclass
class SpanModel:
    """What tasks need to decide on a span: the classifier's weights; and the labelers' reliabilities, for reports."""

    weights: np.ndarray
    table: np.ndarray

    def score(self, active: list[int]) -> float:
        return float(1 / (1 + np.exp(-self.weights[active].sum())))


def train(docs: DataFrame, train_spans: int = TRAIN_SPANS, text_column: str = "text") -> SpanModel | None:
    """Labelers vote on every candidate of every text; their reliabilities and the classifier follow from the votes alone.

    The driver reads one row per kind and vote pattern (at most 12 x 729) and ``train_spans`` candidates. None if no text
    has a candidate.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for text in strings(batch.column(0)):
            base = base_spans(text)
            for kind, a, b in base + added_candidates(text, base):
                v = vote(text, kind, a, b)
                key = int.from_bytes(hashlib.blake2b(f"{kind}:{text[max(0, a - WINDOW) : b]}".encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")
                rows.append({"kind": KINDS.index(kind), "votes": list(v), "active": features(text, kind, a, b, v), "key": key})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("kind", pa.int32()), ("votes", pa.list_(pa.int32())), ("active", pa.list_(pa.int32())), ("key", pa.int64())]))

    spans = written(map_batches(docs.select(text_column), each, "kind int, votes array<int>, active array<int>, key long"), "candidates")
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    if not patterns:
        return None
    kinds, votes, n = (np.array([r[c] for r in patterns]) for c in ("kind", "votes", "n"))
    chance, table = reliabilities(kinds, votes, n)
    known = {(r["kind"], tuple(r["votes"])): c for r, c in zip(patterns, chance, strict=True)}
    sample = smallest(spans, F.col("key"), train_spans).orderBy("key", "kind", "votes", "active").limit(2 * train_spans).collect()
    weights = fit_spans([r["active"] for r in sample], np.array([known[r["kind"], tuple(r["votes"])] for r in sample]))
    return SpanModel(weights, table)


def spans_of(text: str, model: SpanModel | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, by kind as listed, then start. Base spans stay whatever the classifier says."""
    base = base_spans(text)
    more = [c for c in added_candidates(text, base) if model is not None and model.score(features(text, *c, vote(text, *c))) >= THRESHOLD]
    return base, base + sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, model: SpanModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans (code points, end exclusive).

    Null text is empty and has no span; repeated rows each give a row; an empty table gives none. Other columns are
    ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            base, spans = spans_of(text, shipped.value)
            n = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE_KINDS}
            rows.append({"doc_id": doc, **n, "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(spans)})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]))

    return map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), each, FOUND)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SpanModel | None, text_column: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_column`` replaced; null stays null, all other columns pass through."""
    shipped, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_column)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [None if t is None else redacted(t, spans_of(t, shipped.value)[1]) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_batches(docs, each, docs.schema)
