"""Column-expression helpers (all JVM-side built-ins, codegen friendly)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lookout.config import IPV4_TOKEN

_WS = " \t\r\n\x0b\x0c"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim ASCII whitespace on both ends (like ``str.strip``)."""
    return F.btrim(col(c), F.lit(_WS))


def any_contains(c, words) -> Column:
    """True when ``c`` contains any of ``words`` (case as given)."""
    c = col(c)
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def all_contains(c, words) -> Column:
    c = col(c)
    return reduce(lambda a, b: a & b, [c.contains(w) for w in words])


def lower_contains_any(c, words) -> Column:
    return any_contains(F.lower(col(c)), words)


def after_last(c, sep: str) -> Column:
    """Text after the last ``sep`` (whole text when absent)."""
    return F.substring_index(col(c), sep, -1)


def first_token(c, sep: str = " ") -> Column:
    return F.split_part(col(c), F.lit(sep), F.lit(1))


def first_ipv4(c) -> Column:
    """First IPv4-looking token or null (no octet range check)."""
    return F.regexp_substr(col(c), F.lit(IPV4_TOKEN))


def fmt_ts(c) -> Column:
    """Timestamp as 'yyyy-MM-dd HH:mm:ss' text (report format)."""
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def fixed(c, digits: int) -> Column:
    """Python-style '%.nf' text: round half-even first (format_string rounds half-up)."""
    return F.format_string(f"%.{digits}f", F.bround(col(c).cast("double"), digits))
