"""Text scalars as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.tilde_words import TILDE_WORDS

# Characters the record-cleaning code strips: space, tab, LF, CR, NUL and vertical tab.
STRIP_SET = " \t\n\r\x00\x0b"
# Unicode white space plus the four ASCII separators that page text also treats as space.
SPACE = r"[\s\x1c-\x1f]"
SPACE_IN_LINE = r"[[^\S\n]\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(STRIP_SET))


def strip_unicode(c: Column) -> Column:
    """Strip every Unicode space on both ends."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one space; ends are kept."""
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def collapse_ws(c: Column) -> Column:
    return F.btrim(squeeze(c), F.lit(" "))


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


# Two or more dashes with optional spaces around them. Written without nested optional spaces so that matching is
# linear; `$` is the end of a line.
_DASH_RUN = rf"{SPACE_IN_LINE}*+[-—](?:{SPACE_IN_LINE}*+[-—])++{SPACE_IN_LINE}*+"


def clean_hyphen_runs(c: Column) -> Column:
    """Drop dash runs at the end of a line and turn the others into one space (works on many lines at once)."""
    at_end = F.regexp_replace(c, rf"(?mdU){_DASH_RUN}$", "")
    return F.regexp_replace(at_end, rf"(?U){_DASH_RUN}", " ")


def _tilde_pattern(words: dict[str, str]) -> str:
    return r"(?iuU)\b(?:" + "|".join(words) + r")\b"


def restore_tilde_words(c: Column, words: dict[str, str] | None = None) -> Column:
    """Replace known words that carry ``~`` for an accented vowel, keeping the case pattern of each hit.

    The text is cut at the hits; gaps and repaired hits are then zipped together again. Rows without ``~`` skip all
    of it.
    """
    words = words or TILDE_WORDS
    pattern = _tilde_pattern(words)
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(words.items())])

    def repair(hit: Column) -> Column:
        fixed = F.element_at(lookup, F.lower(hit))
        head, tail = F.substring(hit, 1, 1), F.substr(hit, F.lit(2))
        capital = F.concat(F.upper(F.substring(fixed, 1, 1)), F.lower(F.substr(fixed, F.lit(2))))
        return (
            F.when(hit == F.upper(hit), F.upper(fixed))
            .when(hit == F.lower(hit), F.lower(fixed))
            .when((head == F.upper(head)) & (tail == F.lower(tail)), capital)
            .otherwise(fixed)
        )

    gaps = F.split(c, pattern, -1)
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    glued = F.array_join(
        F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.when(hit.isNotNull(), repair(hit)).otherwise(F.lit("")))), ""
    )
    return F.when(c.contains("~"), glued).otherwise(c)


def single_blank_lines(c: Column) -> Column:
    """At most one blank line in a row and none at the ends."""
    once = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(once, r"\A\n+|\n+\z", "")


def clean_lines(c: Column) -> Column:
    """Line endings, dash runs, blanks inside and around every line. Works on the whole text, not line by line."""
    text = clean_hyphen_runs(normalize_newlines(F.coalesce(c, F.lit(""))))
    text = F.regexp_replace(text, r"[ \t\xa0]+", " ")
    return F.regexp_replace(text, rf"(?mdU)^{SPACE_IN_LINE}+|{SPACE_IN_LINE}+$", "")


_ONLY_MARKS = r"""\A[-—_=~.*,:;|\\/()\[\]{}'"`]+\z"""


def _is_noise(s: Column) -> Column:
    alpha = F.regexp_count(s, F.lit(r"\p{L}"))
    alnum = F.regexp_count(s, F.lit(r"[\p{L}\p{N}]"))
    symbols = F.regexp_count(s, F.lit(r"(?U)[^\p{L}\p{N}\s\x1c-\x1f]"))
    return (s != "") & (
        s.rlike(_ONLY_MARKS) | ((alnum == 0) & (symbols >= 4)) | ((alpha < 3) & (symbols > alnum))
    )


def is_noisy_line(line: Column) -> Column:
    """A line of marks only, or with hardly any letters and more symbols than letters and digits."""
    return _is_noise(strip_unicode(line))


def drop_noisy_lines(c: Column) -> Column:
    """Text with cleaned lines, without the noisy ones."""
    # A noisy line has fewer than three letters, so most lines are settled by one cheap look.
    kept = F.filter(F.split(c, "\n", -1), lambda line: line.rlike(r"\p{L}\P{L}*\p{L}\P{L}*\p{L}") | ~_is_noise(line))
    return single_blank_lines(F.array_join(kept, "\n"))


def limit_text(c: Column, n: int, end: str = "") -> Column:
    """First ``n`` characters; when cut, trailing spaces go and ``end`` is appended."""
    cut = F.concat(F.rtrim(F.substring(c, 1, n)), F.lit(end))
    return F.when(F.length(c) <= n, c).otherwise(cut)


def count_literal(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    removed = F.replace(c, F.lit(needle), F.lit(""))
    return ((F.length(c) - F.length(removed)) / len(needle)).cast("int")


def contains_any(c: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | c.contains(needle)
    return hit


def display_name(original: Column, path: Column) -> Column:
    """Original file name, else the last path segment, else null."""
    return F.coalesce(
        F.when(original != "", original),
        F.when(path != "", F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)),
    )
