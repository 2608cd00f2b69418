"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` a single time and hand it to ``use``.

    A column named inside a lambda may be inlined there by the optimizer and computed again for every element; binding it
    as the member of a one-element array prevents that.
    """
    return F.transform(F.array(value), use)[0]
