"""Periodic runs of words: multi-scale minimizers seed them, direct lag scans find those of short period."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import map_batches, strings

#: A run has at least this many words and at least three periods.
LEAST, REPEATS = 24, 3
#: Periods up to this are scanned lag by lag: each needs the same least length, and blocks so short choose no minimizer.
LAGS = LEAST // REPEATS
#: Words of texts laid end to end for one pass; bounds the arrays of a pass (a longer text is a pass of its own).
PASS_WORDS = 1 << 20


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit number for each pair; equal pairs give equal numbers."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29)))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def scales(longest: int) -> list[tuple[int, int, int]]:
    """(least period, block, window) of every scale that a text of ``longest`` words needs.

    A scale looks for periods from ``least`` to ``block`` with blocks of ``block`` words. Two equal blocks inside a run
    are a multiple of its period apart, as a block is not shorter than the period. ``window`` is the largest number of
    neighbouring blocks for which a run of three periods still holds a window and its copy one period on, so that the
    minimum of the first is repeated by the second.
    """
    out, least = [], LAGS + 1
    while REPEATS * least <= longest:
        block = least + least // 2 - 1
        out.append((least, block, 2 * least - block + 1))
        least = block + 1
    return out


def _seeds(words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, period) pairs; every run of a period over ``LAGS`` has one inside it.

    ``words`` are numbers of the words of texts laid end to end, longest text first; ``ends`` are where texts end. A text
    too short for three periods of a scale is left out of it.
    """
    lengths = np.diff(ends, prepend=0)
    power = {0: _mixed(words.astype(np.uint64), np.uint64(0x632BE59BD9B4E019) + np.zeros(1, dtype=np.uint64))}
    for least, block, window in scales(int(lengths[0]) if len(lengths) else 0):
        size = int(ends[np.searchsorted(-lengths, -REPEATS * least, side="right") - 1])
        k = block.bit_length() - 1
        while max(power) < k:
            top = max(power)
            half = 1 << top
            power[top + 1] = _mixed(power[top][:-half], power[top][half:])
        power = {k: power[k][:size]}
        count = size - block + 1
        if count < window:
            continue
        shift = block - (1 << k)
        values = _mixed(power[k][:count], power[k][shift : shift + count])
        least_of = _sliding(values, window, np.minimum)
        # A block is chosen if it is the minimum, ties included, of some window that holds it.
        padded = np.concatenate([np.zeros(window - 1, np.uint64), least_of, np.zeros(window - 1, np.uint64)])
        chosen = np.flatnonzero(_sliding(padded, window, np.maximum) == values)
        order = np.lexsort((chosen, values[chosen]))
        place, value = chosen[order], values[chosen[order]]
        lag = place[1:] - place[:-1]
        pairs = np.flatnonzero((value[1:] == value[:-1]) & (lag >= least) & (lag <= block))
        owner = np.searchsorted(ends, place, side="right")
        pairs = pairs[owner[pairs] == owner[pairs + 1]]
        order = np.lexsort((place[pairs], lag[pairs]))
        yield from zip(place[pairs[order]].tolist(), lag[pairs[order]].tolist(), strict=True)


def _reach(words: np.ndarray, place: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """First and one past the last place whose word equals the word ``lag`` on, around ``place``, inside a text."""
    end, step = place, 64
    while end < high - lag:
        stop = min(end + step, high - lag)
        differ = words[end:stop] != words[end + lag : stop + lag]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = stop, 2 * step
    start, step = place, 64
    while start > low:
        stop = max(start - step, low)
        differ = (words[stop:start] != words[stop + lag : start + lag])[::-1]
        if differ.any():
            start -= int(differ.argmax())
            break
        start, step = stop, 2 * step
    return start, end


@functools.lru_cache(maxsize=65_536)
def _parts(period: int) -> tuple[int, ...]:
    """``period`` divided by each of its prime factors."""
    out, rest, factor = [], period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            out.append(period // factor)
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return tuple(out)


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start, then period.

    ``texts`` hold word numbers: equal words have equal numbers, in any text of the call. A run is a longest stretch
    whose smallest period is ``period`` and whose length is at least ``LEAST`` and ``REPEATS`` periods. Seeds only say
    where to look; every run is read off the words themselves.
    """
    order = sorted((i for i in range(len(texts)) if len(texts[i]) >= LEAST), key=lambda i: -len(texts[i]))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not order:
        return found
    ends = np.cumsum([len(texts[i]) for i in order])
    words = np.concatenate([texts[i] for i in order])

    def keep(start: int, end: int, period: int, text: int) -> None:
        """Note the run if no part of the period is a period: else it is a run of that one, found there."""
        for part in _parts(period):
            if np.array_equal(words[start : end - part], words[start + part : end]):
                return
        low = int(ends[text - 1]) if text else 0
        found[order[text]].append((start - low, end - start, period))

    for lag in range(1, LAGS + 1):
        same = np.zeros(len(words) + 1, dtype=np.int8)
        same[: len(words) - lag] = words[:-lag] == words[lag:]
        for back in range(lag):  # the word ``lag`` on is in the next text
            same[ends[:-1] - 1 - back] = 0
        edges = np.flatnonzero(np.diff(same, prepend=np.int8(0)))
        starts, stops = edges[::2], edges[1::2]
        long = np.flatnonzero(stops - starts >= LEAST - lag)
        for start, stop in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            keep(start, stop + lag, lag, int(np.searchsorted(ends, start, side="right")))
    done: dict[int, int] = {}
    for place, lag in _seeds(words, ends):
        if place < done.get(lag, 0):
            continue
        text = int(np.searchsorted(ends, place, side="right"))
        low, high = int(ends[text - 1]) if text else 0, int(ends[text])
        start, end = _reach(words, place, lag, low, high)
        done[lag] = max(end, place + 1)
        if end + lag - start >= REPEATS * lag:
            keep(start, end + lag, lag, text)
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def _summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The columns of ``periodic_runs`` after doc_id and n_words for one text."""
    best = None
    stay = np.ones(len(words), dtype=bool)
    lines = hashlib.sha256()
    for run in runs:
        start, length, period = run
        # Exact comparison of length / period; runs come by start, then period, so ties keep the first.
        if best is None or length * best[2] > best[1] * period:
            best = run
        stay[start + period : start + length] = False
        lines.update(b"%d,%d,%d\n" % run)
    kept = words if not runs else [w for w, s in zip(words, stay.tolist(), strict=True) if s]
    collapsed = b" ".join(kept)
    if best is None:
        return 0, None, None, None, None, lines.hexdigest(), collapsed, []
    start, length, period = best
    return len(runs), start, length, period, 1000 * length // period, lines.hexdigest(), collapsed, runs


SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed string, runs array<struct<start:long,length:long,period:long>>"
)


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Runs of repeated words in every whole text, and the text with each run cut to its first period.

    Words are runs of anything but space and \\x09-\\x0D. Columns: doc_id, n_words, n_runs; start, length, period and
    exponent_milli of the run with the greatest length / period (ties: smallest start, then period; null without a
    run); runs_sha256 (of ``start,length,period`` lines); collapsed (kept words joined by one space); runs.

    Null, empty and blank texts have no words and no runs. Ids may be null or repeated: each row gives a row. An empty
    table gives no rows; other columns are ignored. A text is read whole by one task, however long it is; texts are
    laid end to end in passes of ``PASS_WORDS`` words.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column(0).to_pylist(), strings(batch.column(1))
        rows, part, size = [], [], 0
        for i, text in enumerate(texts):
            part.append(text.encode("utf-8", "surrogatepass").split())
            size += len(part[-1])
            if size >= PASS_WORDS or i == len(texts) - 1:
                number: dict[bytes, int] = {}
                coded = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in part]
                rows += [(len(words), *_summary(words, runs)) for words, runs in zip(part, find_runs(coded), strict=True)]
                part, size = [], 0
        if not rows:
            return
        columns = list(zip(*rows, strict=True))
        longs = [pa.array(c, pa.int64()) for c in columns[:6]]
        run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        nested = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in columns[8]], run)
        texts = pa.array([c.decode("utf-8", "surrogatepass") for c in columns[7]], pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *longs, pa.array(columns[6], pa.string()), texts, nested],
            names=["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed", "runs"],
        )

    return map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), each, SCHEMA)


def repeat_tails(text: Column, doc_id: Column) -> Column:
    """The text, or for a tenth of the ids its words with a tail that repeats one stretch of them.

    With h the crc32 of the decimal id and g = h div 10: if h ends in 0, every word from a = g mod n on is taken from the
    p = 1 + (n - a) div (3 + g mod 8) words at a, over and over. A null id or text stays as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        moved = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + F.pmod(i - a, p)).cast("int")))
        return F.array_join(F.concat(F.slice(w, 1, a.cast("int")), moved), " ")

    # ``transform`` over one element binds the words, so that they are split once.
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.element_at(F.transform(F.array(words), tail), 1)).otherwise(text)
