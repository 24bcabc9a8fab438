"""Registered queries: ARIMA(1,1,1) forecasts (F1) per series key."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.operators.forecast import arima_css, fill_gaps
from lookout.plans.catalog import register
from lookout.plans.events import CANON_SQL, canonical_wire
from lookout.sources import tables as T


def _oracle(series_sql: str, keys: str) -> str:
    k = keys
    return f"""WITH sr AS ({series_sql}),
s AS (SELECT {k}, list(CAST(y AS DOUBLE) ORDER BY t) AS y FROM sr GROUP BY {k}),
sw AS (SELECT *, list_transform(range(1, len(y)), lambda i: y[i + 1] - y[i]) AS w FROM s),
cg AS (SELECT CAST(p.v AS DOUBLE) / 10 AS phi, CAST(q.v AS DOUBLE) / 10 AS theta FROM range(-9, 10) p(v), range(-9, 10) q(v)),
c1 AS (SELECT sw.*, phi, theta, list_reduce(range(2, len(w) + 1),
    lambda acc, i: {{'pe': w[i] - phi * w[i - 1] - theta * acc.pe,
                     'sse': acc.sse + (w[i] - phi * w[i - 1] - theta * acc.pe) * (w[i] - phi * w[i - 1] - theta * acc.pe)}},
    {{'pe': CAST(0 AS DOUBLE), 'sse': CAST(0 AS DOUBLE)}}) AS st FROM sw, cg),
b1 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY st.sse, phi, theta) = 1),
fg AS (SELECT b1.{k.replace(', ', ', b1.')}, b1.y, b1.w, round_even(b1.phi + CAST(dp.v AS DOUBLE) / 100, 2) AS phi,
    round_even(b1.theta + CAST(dt.v AS DOUBLE) / 100, 2) AS theta FROM b1, range(-9, 10) dp(v), range(-9, 10) dt(v)),
c2 AS (SELECT fg.*, list_reduce(range(2, len(w) + 1),
    lambda acc, i: {{'pe': w[i] - phi * w[i - 1] - theta * acc.pe,
                     'sse': acc.sse + (w[i] - phi * w[i - 1] - theta * acc.pe) * (w[i] - phi * w[i - 1] - theta * acc.pe)}},
    {{'pe': CAST(0 AS DOUBLE), 'sse': CAST(0 AS DOUBLE)}}) AS st FROM fg WHERE abs(phi) < 1 AND abs(theta) < 1),
b2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY st.sse, phi, theta) = 1),
hz AS (SELECT b2.*, h.v AS h FROM b2, range(1, 7) h(v))
SELECT {k}, CAST(h AS INT) AS step,
  round_even(CASE WHEN len(y) < 4 THEN y[-1]
    ELSE y[-1] + (phi * w[-1] + theta * st.pe) * ((1 - pow(phi, h)) / (1 - phi)) END, 4) AS forecast,
  CASE WHEN len(y) >= 4 THEN phi END AS phi, CASE WHEN len(y) >= 4 THEN theta END AS theta
FROM hz"""


DAILY_SQL = """SELECT 'all' AS series, CAST(date_trunc('day', ts) AS DATE) AS t,
  count(CASE WHEN event_type = 'error' THEN 1 END) AS y FROM v_base GROUP BY 2"""

BY_SOURCE_SQL = """SELECT source_log, date_trunc('hour', ts) AS t, count(*) AS y FROM v_lines GROUP BY 1, 2"""


def _finish(df, keys):
    return df.select(*keys, F.col("step").cast("int").alias("step"), F.bround("forecast", 4).alias("forecast"),
                     "phi", "theta")


@register("f1_forecast_daily", _oracle(DAILY_SQL, "series"), views=("v_base",))
def f1_forecast_daily(spark, sf):
    b = T.v_base(spark, sf)
    daily = b.groupBy(F.to_date("ts").alias("t")).agg(
        F.count(F.when(F.col("event_type") == "error", 1)).alias("y")).withColumn("series", F.lit("all"))
    return _finish(arima_css(daily, ["series"], "t", "y"), ["series"])


@register("f1_forecast_by_source", _oracle(BY_SOURCE_SQL, "source_log"), views=("v_lines",))
def f1_forecast_by_source(spark, sf):
    lines = T.v_lines(spark, sf)
    hourly = lines.groupBy("source_log", F.date_trunc("hour", "ts").alias("t")).agg(F.count(F.lit(1)).alias("y"))
    return _finish(arima_css(hourly, ["source_log"], "t", "y"), ["source_log"])


HOURLY_SQL = """SELECT g.Service, g.t, coalesce(e.y, 0) AS y
  FROM (SELECT Service, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM er GROUP BY Service) g
  LEFT JOIN er e ON e.Service = g.Service AND e.t = g.t"""


@register("f1_forecast_hourly_errors", f"""WITH {CANON_SQL},
er AS (SELECT Service, date_trunc('hour', Date) AS t, count(*) AS y FROM canon WHERE Etat = 'Error' AND Date IS NOT NULL AND Service IS NOT NULL GROUP BY 1, 2),
{_oracle(HOURLY_SQL, "Service").removeprefix("WITH ")}""", views=("v_wire",))
def f1_forecast_hourly_errors(spark, sf):
    """Errors by hour and service, hours without errors filled with 0."""
    errors = canonical_wire(spark, sf).where((F.col("Etat") == "Error") & F.col("Date").isNotNull() & F.col("Service").isNotNull())
    hourly = errors.groupBy("Service", F.date_trunc("hour", "Date").alias("t")).agg(F.count(F.lit(1)).alias("y"))
    return _finish(arima_css(fill_gaps(hourly, ["Service"], "t", "y"), ["Service"], "t", "y"), ["Service"])
