"""Date parsing and expiry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import strip
from dossier.functions.values import is_meaningful

_DAY_FIRST = r"^([0-3]?[0-9])-([01]?[0-9])-([0-9]{4})$"
_YEAR_FIRST = r"^([0-9]{4})-([01]?[0-9])-([0-3]?[0-9])(?:[T ].*)?$"
_SHORT_YEAR_FIRST = r"^([0-9]{1,2})-([01]?[0-9])-([0-3]?[0-9])$"

# English month names, the only ones a free-form parse understands.
_PROSE_FORMATS = ["d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy"]
_PROSE = r"^(?:[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}|[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4})$"


def _prose(c: Column) -> Column:
    return F.to_date(F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in _PROSE_FORMATS]))


def _rolled(year: Column, month: Column, day: Column) -> Column:
    """Calendar date with overflow rolled forward: 31 February is 2 or 3 March."""
    month, day = month.cast("int"), day.cast("int")
    base = F.add_months(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), month - 1)
    return F.when((month <= 12) & (day <= 31), F.date_add(base, day - 1))


def normalize_date(c: Column) -> Column:
    """ISO text of a date written day first, year first, with a short year in front, or with an English month name.

    Anything else is null.
    """
    s = strip(F.replace(c, F.lit("/"), F.lit("-")))

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    short = part(_SHORT_YEAR_FIRST, 1).cast("int")
    parsed = (
        F.when(s.rlike(_DAY_FIRST), _rolled(part(_DAY_FIRST, 3), part(_DAY_FIRST, 2), part(_DAY_FIRST, 1)))
        .when(s.rlike(_YEAR_FIRST), _rolled(part(_YEAR_FIRST, 1), part(_YEAR_FIRST, 2), part(_YEAR_FIRST, 3)))
        .when(
            s.rlike(_SHORT_YEAR_FIRST),
            _rolled(F.when(short < 70, short + 2000).otherwise(short + 1900), part(_SHORT_YEAR_FIRST, 2), part(_SHORT_YEAR_FIRST, 3)),
        )
        .when(s.rlike(_PROSE), _prose(s))
    )
    return F.when(is_meaningful(c), F.date_format(parsed, "yyyy-MM-dd"))


def as_date(as_of: str | dt.date) -> Column:
    return F.to_date(F.lit(str(as_of)))


def effective_expiry(issued: Column, valid_until: Column) -> Column:
    """The stated expiry, else 30 days after issue."""
    return F.coalesce(valid_until, F.date_add(issued, 30))


def days_to_expiry(expiry: Column, as_of: str | dt.date) -> Column:
    return F.datediff(expiry, as_date(as_of))


def expiry_status(days: Column) -> Column:
    return F.when(days < 0, "expired").when(days <= 7, "expiring").otherwise("ok")
