"""Common-substring similarity."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dossier.functions.text import squeeze, strip

#: Products of lengths up to which the bound by common subsequences is worth its time; beyond, only bytes are counted.
BOUND_CELLS = 1 << 28


class Stretches:
    """All stretches of a text as a suffix automaton: built once, it meets every candidate in time linear in that one."""

    def __init__(self, text: bytes):
        # State 0 is the empty stretch. A state's stretches end at the same places, of which ``first`` is the earliest.
        step: list[dict[int, int]] = [{}]
        link, length, first = [-1], [0], [-1]
        last = 0
        for at, byte in enumerate(text):
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(at)
            state = last
            while state >= 0 and byte not in step[state]:
                step[state][byte] = new
                state = link[state]
            if state >= 0:
                target = step[state][byte]
                if length[target] > length[state] + 1:
                    copy = len(step)
                    step.append(dict(step[target]))
                    link.append(link[target])
                    length.append(length[state] + 1)
                    first.append(first[target])
                    while state >= 0 and step[state].get(byte) == target:
                        step[state][byte] = copy
                        state = link[state]
                    link[target] = copy
                    target = copy
                link[new] = target
            last = new
        self.text, self.step, self.link, self.length, self.first = text, step, link, length, first
        self.places: dict[int, int] | None = None

    def longest(self, other: bytes) -> tuple[int, int, int]:
        """Length and starts of the longest stretch shared with ``other``; of equals, the first here, then there."""
        step, link, length, first = self.step, self.link, self.length, self.first
        state = run = best = 0
        here = there = -1
        for at, byte in enumerate(other):
            while (target := step[state].get(byte)) is None and state:
                state = link[state]
                run = length[state]
            if target is None:
                continue
            state = target
            run += 1
            if run >= best and (run > best or first[state] < here):
                best, here, there = run, first[state], at
        return best, here - best + 1, there - best + 1

    def subsequence(self, other: bytes) -> int:
        """Length of the longest common subsequence, a machine word of this text at a time."""
        if self.places is None:
            self.places = {}
            for at, byte in enumerate(self.text):
                self.places[byte] = self.places.get(byte, 0) | 1 << at
        places, free = self.places, (1 << len(self.text)) - 1
        full = free
        for byte in other:
            hit = free & places.get(byte, 0)
            free = ((free + hit) | (free - hit)) & full
        return len(self.text) - free.bit_count()


def common_bytes(left: bytes, right: bytes, stretches: Stretches | None = None) -> int:
    """Bytes covered by the longest common substring and, recursively, by those left and right of it.

    ``stretches`` of the whole left text spare building them again for every right one.
    """
    if left == right:
        return len(left)
    total, stack = 0, [(left, right, stretches)]
    while stack:
        a, b, known = stack.pop()
        n, i, j = (known or Stretches(a)).longest(b)
        if n:
            total += n
            stack += [part for part in ((a[:i], b[:j], None), (a[i + n :], b[j + n :], None)) if part[0] and part[1]]
    return total


def percent(a: str | None, b: str | None, stretches: Stretches | None = None) -> float:
    left, right = (a or "").encode(), (b or "").encode()
    if not left and not right:
        return 0.0
    return common_bytes(left, right, stretches) * 2.0 * 100.0 / (len(left) + len(right))


def bag_bound(left: bytes, right: bytes) -> float:
    """No similarity can exceed what the two texts share as bags of bytes."""
    if not left and not right:
        return 0.0
    counts = [np.bincount(np.frombuffer(x, dtype=np.uint8), minlength=256) for x in (left, right)]
    return float(np.minimum(*counts).sum()) * 2.0 * 100.0 / (len(left) + len(right))


def subsequence_bound(stretches: Stretches, right: bytes) -> float:
    """Nor what they share in order: the common stretches, one after the other, are a common subsequence."""
    n = len(stretches.text) + len(right)
    if not n or len(stretches.text) * len(right) > BOUND_CELLS:
        return 100.0
    return stretches.subsequence(right) * 2.0 * 100.0 / n


@F.pandas_udf(DoubleType())
def text_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two texts in percent; null is an empty text, and two empty texts are not similar."""
    return pd.Series([percent(x, y) for x, y in zip(left, right)], dtype="float64")


@F.pandas_udf(DoubleType())
def similarity_if_leading(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.Series]:
    """Similarity of rows that can still win in their group, null for the others.

    Takes ``(group, other_points, text, text)`` with rows of a group side by side. A row is skipped only when its other
    points plus an upper bound stay below the best total seen in its group, so the winner is never skipped. The stretches
    of a first text are kept as long as rows bring the same one.
    """
    group, best = None, -math.inf
    text, stretches = None, None
    for keys, points, left, right in batches:
        out = []
        for key, extra, x, y in zip(keys, points, left, right):
            if key != group:
                group, best = key, -math.inf
            if x == y:
                value = 100.0 if x else 0.0
            else:
                need = best - 1e-9 - extra
                if bag_bound(x.encode(), y.encode()) < need:
                    out.append(None)
                    continue
                if x != text:
                    text, stretches = x, Stretches(x.encode())
                if best > -math.inf and subsequence_bound(stretches, y.encode()) < need:
                    out.append(None)
                    continue
                value = percent(x, y, stretches)
            best = max(best, extra + value)
            out.append(value)
        yield pd.Series(out, dtype="float64")


def comparable(text: Column) -> Column:
    return strip(squeeze(F.lower(text)))
