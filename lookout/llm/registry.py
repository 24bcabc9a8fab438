"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from lookout.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
