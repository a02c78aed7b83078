"""Text helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every character that is white space in Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only the space character; only the ends of a text are looked at."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column | str) -> Column:
    """Null or nothing but white space; the search stops at the first other character."""
    return ~F.coalesce(F.rlike(c if isinstance(c, Column) else F.col(c), F.lit(r"(?U)\S")), F.lit(False))


def normalize_ws(c: Column | str) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def contains_ci(c: Column | str, needle: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.upper(c).contains(needle.upper()), F.lit(False))


def mask_digits(c: Column | str) -> Column:
    """Replace every free-standing number with ``#``."""
    return F.regexp_replace(c, r"\b\d+\b", "#")


def flag_list(flags: list[tuple[str, Column]]) -> Column:
    """The names whose condition holds, in list order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags]))
