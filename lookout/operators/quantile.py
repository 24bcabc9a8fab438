"""Exact quantiles by distributed selection.

The rank is narrowed by histograms: each pass counts the rows of the open
interval in ``BINS`` bins (a partial aggregate), keeps the bin that holds the
rank, and ends when that bin is small; its rows then decide. No task sorts or
holds a column, and a pass brings at most ``BINS`` rows a rank to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
SMALL = 4096  # distinct values of an interval that are fetched instead of narrowed further


@dataclass
class _Target:
    """The value at ``rank`` (from 0) of a column lies within [low, high]; ``below`` rows lie under it."""

    column: int
    rank: float
    low: float
    high: float
    below: float = 0
    rows: float = math.inf
    value: float | None = None

    def settle(self) -> None:
        if self.low == self.high:
            self.value = self.low


def _values(df: DataFrame, cols: list[Column], weight: Column | None) -> DataFrame:
    w = (weight if weight is not None else F.lit(1)).cast("bigint")
    # the weight is named apart from the columns, which may have any name
    return df.select(F.array(*[c.cast("double") for c in cols]).alias("_q"), w.alias("_w"))


def _open_rows(rows: DataFrame, targets: list[tuple[int, _Target]]) -> DataFrame:
    """One row (target, value, weight) for each value within an open target's interval."""
    found = F.array(*[F.struct(F.lit(i).alias("t"), F.get("_q", t.column).alias("v"), F.lit(float(t.low)).alias("lo"),
                               F.lit(float(t.high)).alias("hi")) for i, t in targets])
    return rows.select("_w", F.explode(found).alias("e")).select("_w", "e.*").where("v >= lo AND v <= hi")


def _narrow(t: _Target, bins: list) -> None:
    for b in bins:
        if t.below + b["w"] > t.rank:
            t.low, t.high, t.rows = b["v0"], b["v1"], b["n"]
            t.settle()
            return
        t.below += b["w"]


def exact_quantiles(df: DataFrame, cols: list[Column], probs: list[float], weight: Column | None = None) -> list[list[float | None]]:
    """For each column its quantiles at ``probs``, interpolated between the neighbouring ranks.

    ``weight`` counts a row that often (histogram rows). Null and NaN values
    are left out; a column without values has null quantiles.
    """
    rows = _values(df, cols, weight)
    real = [F.when(~F.isnan(F.get("_q", i)), F.get("_q", i)) for i in range(len(cols))]
    first = rows.agg(*[f for i, v in enumerate(real) for f in (
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("_w"))), F.lit(0)).alias(f"w{i}"), F.count(v).alias(f"n{i}"),
        F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"))]).first()
    targets: list[_Target] = []
    places: list[list[tuple[float, _Target, _Target] | None]] = []
    for i in range(len(cols)):
        total, own = first[f"w{i}"], []
        for p in probs:
            if not total:
                own.append(None)
                continue
            h = (total - 1) * p
            pair = []
            for rank in (math.floor(h), min(math.floor(h) + 1, total - 1)):
                t = _Target(i, rank, first[f"lo{i}"], first[f"hi{i}"], rows=first[f"n{i}"])
                t.settle()
                targets.append(t)
                pair.append(t)
            own.append((h - math.floor(h), *pair))
        places.append(own)
    rows = rows.select(F.transform("_q", lambda x: F.when(~F.isnan(x), x)).alias("_q"), "_w")
    while any(t.value is None and t.rows > SMALL for t in targets):
        live = [(i, t) for i, t in enumerate(targets) if t.value is None and t.rows > SMALL]
        place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = _open_rows(rows, live).groupBy("t", place.alias("b")).agg(
            F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v0"), F.max("v").alias("v1")).collect()
        for i, t in live:
            _narrow(t, sorted((b for b in bins if b["t"] == i), key=lambda b: b["v0"]))
    live = [(i, t) for i, t in enumerate(targets) if t.value is None]
    if live:
        left = _open_rows(rows, live).groupBy("t", "v").agg(F.sum("_w").alias("w")).collect()  # at most SMALL values a target
        for i, t in live:
            for r in sorted((r for r in left if r["t"] == i), key=lambda r: r["v"]):
                t.below += r["w"]
                if t.below > t.rank:
                    t.value = r["v"]
                    break
    return [[None if q is None else q[1].value + q[0] * (q[2].value - q[1].value) for q in own] for own in places]


def exact_quantile(df: DataFrame, col: Column, p: float, weight: Column | None = None) -> float | None:
    return exact_quantiles(df, [col], [p], weight)[0][0]
