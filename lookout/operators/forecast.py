"""ARIMA(1,1,1) forecast per series key by conditional sum of squares (F1).

Series are fitted in parallel, one group per key; each group holds the
key's time buckets (hours or days), never raw events. The conditional sum
of squares is evaluated for the whole (phi, theta) grid at once (vectorised
over the grid, sequential over time); the first minimum in (phi, theta)
order wins; a second 0.01 grid refines around it. Forecast:
w(n+1) = phi*w(n) + theta*e(n), w(n+h) = phi*w(n+h-1), y by cumulative sum.
Series shorter than 4 points repeat their last value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

COARSE = [round(-0.9 + 0.1 * i, 1) for i in range(19)]
FINE = [round(-0.09 + 0.01 * i, 2) for i in range(19)]
STEPS = 6


def _fit_series(y: np.ndarray, steps: int) -> tuple[list[float], float | None, float | None]:
    """CSS grid search on one series (numpy, vectorised over the grid)."""
    n = len(y)
    if n < 4:
        return [float(y[-1])] * steps, None, None
    w = np.diff(y)

    def sse(phi: np.ndarray, theta: np.ndarray):
        e = np.zeros_like(phi)
        s = np.zeros_like(phi)
        for i in range(1, len(w)):
            e = w[i] - phi * w[i - 1] - theta * e
            s = s + e * e
        return s, e

    def best(phi, theta):
        s, e = sse(phi, theta)
        k = int(np.argmin(s))  # grid is ordered by (phi, theta): first minimum = smallest pair
        return phi[k], theta[k], e[k]

    cp, ct = np.meshgrid(np.array(COARSE), np.array(COARSE), indexing="ij")
    p0, t0, _ = best(cp.ravel(), ct.ravel())
    fp = np.array([round(p0 + d, 2) for d in FINE])
    ft = np.array([round(t0 + d, 2) for d in FINE])
    gp, gt = np.meshgrid(fp, ft, indexing="ij")
    gp, gt = gp.ravel(), gt.ravel()
    ok = (np.abs(gp) < 1) & (np.abs(gt) < 1)
    phi, theta, e_n = best(gp[ok], gt[ok])
    w1 = phi * w[-1] + theta * e_n
    out = [float(y[-1] + w1 * ((1 - phi ** h) / (1 - phi))) for h in range(1, steps + 1)]
    return out, float(phi), float(theta)


def fill_gaps(counts: DataFrame, keys: list[str], time_col: str, value_col: str, step: str = "1 hour") -> DataFrame:
    """Each series without holes: every step between its first and last time, 0 where nothing was counted.

    Rows without a time belong to no step and are left out.
    """
    counts = counts.where(F.col(time_col).isNotNull())
    span = counts.groupBy(*keys).agg(F.min(time_col).alias("_from"), F.max(time_col).alias("_to"))
    steps = span.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                        F.explode(F.expr(f"sequence(_from, _to, interval {step})")).alias("_t"))
    same = F.col(time_col) == F.col("_t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return steps.join(counts, same, "left").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_t").alias(time_col),
                                                   F.coalesce(F.col(value_col), F.lit(0)).alias(value_col))


def arima_css(df: DataFrame, keys: list[str], time_col: str, value_col: str, steps: int = STEPS) -> DataFrame:
    """(keys, step, forecast, phi, theta) for every series.

    One ``applyInPandas`` group per series key: a group holds the series'
    time buckets (bounded by the time range, not by the number of events)."""
    schema = StructType([*[f for f in df.select(*keys).schema.fields],
                         StructField("step", IntegerType()), StructField("forecast", DoubleType()),
                         StructField("phi", DoubleType()), StructField("theta", DoubleType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time_col)
        fc, phi, theta = _fit_series(pdf[value_col].to_numpy(dtype=float), steps)
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, "step": h + 1, "forecast": v, "phi": phi, "theta": theta}
                             for h, v in enumerate(fc)])

    return df.select(*keys, time_col, value_col).groupBy(*keys).applyInPandas(fit, schema)
