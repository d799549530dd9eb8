"""Regular expressions with the meaning that they have in Python, as Column functions.

Classes are Unicode-aware (U) and only a line feed ends a line (d), whatever the JVM's defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str, flags: str = "") -> str:
    return f"(?dU{flags}){pattern}"


def sub(col: Column, pattern: str, to: str = "", flags: str = "") -> Column:
    return F.regexp_replace(col, F.lit(rx(pattern, flags)), F.lit(to))


def sub_all(col: Column, table: list[tuple[str, str]]) -> Column:
    """Deletes the matches of (pattern, flags), one after another."""
    return reduce(lambda c, p: sub(c, p[0], "", p[1]), table, col)


#: Letters that are cased letters of ASCII to a regular expression, but not to lower().
_CASED = ("ſ", "ı")


def where_any(col: Column, words: tuple[str, ...], f: Callable[[Column], Column]) -> Column:
    """f of texts that hold one of the words (in lower case; case ignored), others as they are; one of the words must be in whatever f changes.

    col is computed once. Searching for words is many times faster than an alternation.
    """
    both = F.transform(F.array(col), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    held = lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words + _CASED))
    return F.get(F.transform(both, lambda x: F.when(held(x["low"]), f(x["t"])).otherwise(x["t"])), F.lit(0))


def where_held(col: Column, words: tuple[str, ...], f: Callable[[Column], Column]) -> Column:
    """f of texts that hold one of the words as they are, others unchanged."""
    held = lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words))
    return F.get(F.transform(F.array(col), lambda t: F.when(held(t), f(t)).otherwise(t)), F.lit(0))


def sub_held(col: Column, table: list[tuple[str, str, tuple[str, ...]]]) -> Column:
    """As :func:`sub_all`, of (pattern, flags, words): a run of patterns with the same words is tried only on texts that then hold one of them.

    The words are looked for in what earlier patterns have left, for a deletion may put together a word that was not there.
    """
    for (words, cased), own in groupby(table, lambda row: (row[2], "i" not in row[1])):
        patterns = [row[:2] for row in own]
        col = (where_held if cased else where_any)(col, words, lambda t, patterns=patterns: sub_all(t, patterns))
    return col


def strip(col: Column) -> Column:
    """Without white space at both ends, all of Unicode's."""
    return F.regexp_replace(col, F.lit(r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"), F.lit(""))


def pieces(col: Column, pattern: str, flags: str = "") -> Column:
    return F.split(col, rx(pattern, flags), -1)
