"""Text embedding: a deterministic hashed bag of words by default, any batch embedder on request."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.lists import once

DIMENSION = 64
Embedder = Callable[[list[str]], list[list[float]]]


def hashed_vector(text: str, dimension: int = DIMENSION) -> list[float]:
    """The built-in embedding of one query text, for use as a literal."""
    counts = [0] * dimension
    for token in re.findall(r"[^\W_]+", text.lower()):
        counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimension] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    return [c / norm for c in counts] if norm else [0.0] * dimension


def hashed_column(text: Column, dimension: int = DIMENSION) -> Column:
    """Unit vector of word counts in ``dimension`` hashed slots; all zeros for a text without words."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    slots = F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dimension)))
    numbers = F.sequence(F.lit(0), F.lit(dimension - 1))

    def counted(s: Column) -> Column:
        return F.transform(numbers, lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))

    def scaled(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * c))
        return once(norm, lambda n: F.transform(counts, lambda c: F.when(n > 0, c / n).otherwise(0.0)))

    return once(once(slots, counted), scaled)


def embed_chunks(df: DataFrame, embedder: Embedder | None = None, text: str = "text", out: str = "values", dimension: int = DIMENSION) -> DataFrame:
    """Adds one vector per text. An external embedder gets whole Arrow batches and must return one vector per text."""
    if embedder is None:
        return df.withColumn(out, hashed_column(F.col(text), dimension))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[text].tolist()
            vectors = embedder(texts) if texts else []
            if len(vectors) != len(texts):
                raise ValueError(f"embedder returned {len(vectors)} vectors for {len(texts)} texts")
            yield batch.assign(**{out: [[float(x) for x in v] for v in vectors]})

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.mapInPandas(run, schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, p: acc + p)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is all zeros."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, _dot(a, b) / norms).otherwise(0.0)
