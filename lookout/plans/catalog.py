"""Registry of runnable queries: name -> (Spark plan builder, oracle SQL).

A plan builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the given tables; the oracle is DuckDB SQL over the same tables (or None
when the operator is not expressible in SQL, e.g. the randomised forest).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from lookout.config import NULL_MARKERS
from lookout.plans.views_sql import with_views


@dataclass
class Entry:
    name: str
    build: Callable
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        REGISTRY[name] = Entry(name, fn, with_views(sql, *views) if sql else None)
        return fn
    return deco


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_like_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"{expr} LIKE '%{w}%'" for w in words) + ")"


MARKERS_SQL = sql_list(NULL_MARKERS)


def nullif_markers(c: str) -> str:
    return f"CASE WHEN {c} IN ({MARKERS_SQL}) THEN NULL ELSE {c} END"


def load_all():
    """Import every plan module so their queries register."""
    from lookout.plans import (events, scoring, detectors, forecast, retrieval,  # noqa: F401
                               response, files, live)
    return REGISTRY
