"""Registered queries: live counters (L1-L9), batch twins and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lookout.config import LIVE_SOURCES
from lookout.functions.text import fmt_ts
from lookout.plans.catalog import register
from lookout.session import ensure_checkpoint_dir
from lookout.sources import tables as T
from lookout.streaming import live as L

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

TAILS_SQL = """lk AS (SELECT event_id, ts, ip, line,
  CASE WHEN source_log = 'auth.log' AND line LIKE 'fail2ban%' THEN 'fail2ban' WHEN source_log = 'auth.log' THEN 'auth'
       WHEN source_log = 'syslog' THEN 'syslog' WHEN source_log = 'kern.log' THEN 'kernel'
       WHEN source_log = 'cron.log' THEN 'cron' END AS src FROM v_lines),
t AS (SELECT * FROM lk WHERE src IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src ORDER BY event_id DESC) <= 500)"""

COUNTERS_SQL = """CAST(count(CASE WHEN src = 'auth' AND line LIKE '%Failed password%' THEN 1 END) AS BIGINT) AS tentatives_ssh,
  CAST(count(CASE WHEN src = 'auth' AND line LIKE '%Accepted password%' THEN 1 END) AS BIGINT) AS connexions_ok,
  CAST(count(CASE WHEN src = 'auth' AND line LIKE '%sudo%' THEN 1 END) AS BIGINT) AS sudo_cmds,
  CAST(count(CASE WHEN src = 'auth' AND line LIKE '%Invalid user%' THEN 1 END) AS BIGINT) AS invalid_user,
  CAST(count(CASE WHEN src = 'auth' AND line LIKE '%root%' AND line LIKE '%Failed%' THEN 1 END) AS BIGINT) AS tentatives_root,
  CAST(count(CASE WHEN src = 'syslog' AND lower(line) LIKE '%error%' THEN 1 END) AS BIGINT) AS erreurs_sys,
  CAST(count(CASE WHEN src = 'syslog' AND lower(line) LIKE '%warning%' THEN 1 END) AS BIGINT) AS warnings_sys,
  CAST(count(CASE WHEN src = 'syslog' AND line LIKE '%Out of memory%' THEN 1 END) AS BIGINT) AS oom_killer,
  CAST(count(CASE WHEN src = 'kernel' AND lower(line) LIKE '%error%' THEN 1 END) AS BIGINT) AS erreurs_kernel,
  CAST(count(CASE WHEN src = 'kernel' AND lower(line) LIKE '%panic%' THEN 1 END) AS BIGINT) AS panics_kernel"""


def live_lines(spark, sf):
    """The binding's lines under the names of the live files; ban notices have a file of their own."""
    s = F.col("source_log")
    name = F.when((s == "auth.log") & F.col("line").startswith("fail2ban"), "fail2ban.log") \
        .when(s == "syslog", "syslog.log").otherwise(s)
    return T.v_lines(spark, sf).withColumn("source_log", name)


L1 = ["tentatives_ssh", "connexions_ok", "sudo_cmds", "invalid_user", "tentatives_root"]
L2 = ["erreurs_sys", "warnings_sys", "oom_killer"]
L3 = ["erreurs_kernel", "panics_kernel"]


def _counters(spark, sf):
    return L.counters(L.tails(live_lines(spark, sf)))


def _pick(cols):
    def build(spark, sf):
        return _counters(spark, sf).select(*cols)
    return build


for _n, _cols in [("l1_ssh_counters", L1), ("l2_system_counters", L2), ("l3_kernel_counters", L3)]:
    register(_n, f"WITH {TAILS_SQL}, c AS (SELECT {COUNTERS_SQL} FROM t) SELECT {', '.join(_cols)} FROM c",
             views=("v_lines",))(_pick(_cols))

BAN = r"Ban (\d+\.\d+\.\d+\.\d+)"
FROM = r"from (\d+\.\d+\.\d+\.\d+)"


@register("l4_banned_ips", f"""WITH {TAILS_SQL}
SELECT DISTINCT unnest(regexp_extract_all(line, '{BAN}', 1)) AS ip FROM t WHERE src = 'fail2ban'""", views=("v_lines",))
def l4_banned_ips(spark, sf):
    return L.banned_ips(L.tails(live_lines(spark, sf)))


@register("l5_distinct_ips", f"""WITH {TAILS_SQL}, f AS (SELECT unnest(regexp_extract_all(line, '{FROM}', 1)) AS ip FROM t
  WHERE src = 'auth') SELECT CAST(count(DISTINCT ip) AS BIGINT) AS nb_ips_uniques FROM f""", views=("v_lines",))
def l5_distinct_ips(spark, sf):
    return L.from_ips(L.tails(live_lines(spark, sf))).agg(F.count_distinct("ip").cast("bigint").alias("nb_ips_uniques"))


FIXED_SQL = "fx AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}')" for s in LIVE_SOURCES) + ") v(src))"


@register("l6_lines_per_source", f"""WITH {TAILS_SQL}, {FIXED_SQL}, g AS (SELECT src, count(*) AS n FROM t GROUP BY src)
SELECT fx.src, CAST(coalesce(g.n, 0) AS BIGINT) AS n FROM fx LEFT JOIN g USING (src)""", views=("v_lines",))
def l6_lines_per_source(spark, sf):
    return L.lines_per_source(L.tails(live_lines(spark, sf)))


@register("l7_kpi_record", f"""WITH {TAILS_SQL}, {FIXED_SQL},
c AS (SELECT {COUNTERS_SQL} FROM t),
f AS (SELECT unnest(regexp_extract_all(line, '{FROM}', 1)) AS ip FROM t WHERE src = 'auth'),
tp AS (SELECT ip, count(*) AS n FROM f GROUP BY ip ORDER BY n DESC, ip LIMIT 10),
bn AS (SELECT DISTINCT unnest(regexp_extract_all(line, '{BAN}', 1)) AS ip FROM t WHERE src = 'fail2ban'),
g AS (SELECT src, count(*) AS n FROM t GROUP BY src),
pr AS (SELECT fx.src, coalesce(g.n, 0) AS n FROM fx LEFT JOIN g USING (src)),
l20 AS (SELECT *, CASE src WHEN 'auth' THEN 1 ELSE 2 END AS sr FROM t WHERE src IN ('auth', 'syslog')
  ORDER BY sr DESC, event_id DESC LIMIT 20),
l10 AS (SELECT sr, event_id, trim(line, {WS}) AS l FROM l20 WHERE length(trim(line, {WS})) > 0
  ORDER BY sr DESC, event_id DESC LIMIT 10)
SELECT c.*, coalesce((SELECT string_agg(ip || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, ip) FROM tp), '') AS top_ips_suspectes,
  coalesce((SELECT string_agg(ip, ',' ORDER BY ip) FROM bn), '') AS ips_bannies,
  (SELECT CAST(count(DISTINCT ip) AS BIGINT) FROM f) AS nb_ips_uniques,
  (SELECT string_agg(src || '=' || CAST(n AS VARCHAR), ',' ORDER BY src) FROM pr) AS nb_logs_lus,
  coalesce((SELECT string_agg(l, chr(10) ORDER BY sr, event_id) FROM l10), '') AS derniers_events
FROM c""", views=("v_lines",))
def l7_kpi_record(spark, sf):
    return L.flat_record(L.kpi_record(live_lines(spark, sf))).drop("timestamp")


@register("l7_kpi_lists", f"""WITH {TAILS_SQL}, {FIXED_SQL},
f AS (SELECT unnest(regexp_extract_all(line, '{FROM}', 1)) AS ip FROM t WHERE src = 'auth'),
tp AS (SELECT ip, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ip ORDER BY n DESC, ip LIMIT 10),
bn AS (SELECT DISTINCT unnest(regexp_extract_all(line, '{BAN}', 1)) AS ip FROM t WHERE src = 'fail2ban'),
pr AS (SELECT fx.src, CAST(count(t.src) AS BIGINT) AS n FROM fx LEFT JOIN t ON t.src = fx.src GROUP BY fx.src),
l20 AS (SELECT *, CASE src WHEN 'auth' THEN 1 ELSE 2 END AS sr FROM t WHERE src IN ('auth', 'syslog')
  ORDER BY sr DESC, event_id DESC LIMIT 20),
l10 AS (SELECT sr, event_id, trim(line, {WS}) AS l FROM l20 WHERE length(trim(line, {WS})) > 0
  ORDER BY sr DESC, event_id DESC LIMIT 10),
r AS (SELECT 'top_ips_suspectes' AS part, row_number() OVER (ORDER BY n DESC, ip) AS pos, ip AS value, n FROM tp
  UNION ALL SELECT 'ips_bannies', row_number() OVER (ORDER BY ip), ip, NULL FROM bn
  UNION ALL SELECT 'nb_logs_lus', row_number() OVER (ORDER BY src), src, n FROM pr
  UNION ALL SELECT 'derniers_events', row_number() OVER (ORDER BY sr, event_id), l, NULL FROM l10)
SELECT (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM v_lines) AS timestamp, part, pos, value, coalesce(n, 0) AS n FROM r""", views=("v_lines",))
def l7_kpi_lists(spark, sf):
    """The record's time and lists; it is taken as of the newest line."""
    lines = live_lines(spark, sf)
    record = L.kpi_record(lines, as_of=lines.agg(F.max("ts").alias("m")).scalar())
    return L.record_lists(record).withColumn("timestamp", fmt_ts("timestamp")).fillna(0, ["n"])


L8_SQL = """SELECT strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(floor(epoch(ts) / 14400) * 14400 AS BIGINT)),
  '%Y-%m-%d %H:%M:%S') AS window_start, source_log, CAST(count(*) AS BIGINT) AS n FROM v_lines GROUP BY 1, 2"""


@register("l8_four_hour_windows", L8_SQL, views=("v_lines",))
def l8_four_hour_windows(spark, sf):
    out = L.four_hour_counts(T.v_lines(spark, sf))
    return out.withColumn("window_start", fmt_ts("window_start"))


@register("l8_stream_available_now", L8_SQL, views=("v_lines",))
def l8_stream_available_now(spark, sf):
    """The same counts from a file-source stream in two AvailableNow runs; the newer file arrives first."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    lines = T.v_lines(spark, sf).select("ts", "source_log", "line")
    newer = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    for part, rows in (("part2", newer), ("part1", ~newer)):
        lines.where(rows).write.parquet(f"{root}/in/{part}")
        L.start_window_counts(spark, f"{root}/in/*", "ts timestamp_ntz, source_log string, line string",
                              f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return L.read_window_counts(spark, f"{root}/out").withColumn("window_start", fmt_ts("window_start"))


@register("l9_recent_window", """WITH m AS (SELECT max(ts) AS mx FROM v_base),
r AS (SELECT count(*) AS n FROM v_base, m WHERE ts >= mx - INTERVAL 24 HOURS)
SELECT ip, CAST(count(*) AS BIGINT) AS n FROM v_base, m, r WHERE ts >= mx - INTERVAL 24 HOURS OR r.n < 5 GROUP BY ip""",
          views=("v_base",))
def l9_recent_window(spark, sf):
    b = T.v_base(spark, sf)
    return L.recent_window(b, "ts").groupBy("ip").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


ALL_LINES_SQL = """lk AS (SELECT line,
  CASE WHEN source_log = 'auth.log' AND line LIKE 'fail2ban%' THEN 'fail2ban' WHEN source_log = 'auth.log' THEN 'auth'
       WHEN source_log = 'syslog' THEN 'syslog' WHEN source_log = 'kern.log' THEN 'kernel'
       WHEN source_log = 'cron.log' THEN 'cron' END AS src FROM v_lines),
t AS (SELECT * FROM lk WHERE src IS NOT NULL)"""


@register("l7_stream_counters", f"""WITH {ALL_LINES_SQL}
SELECT {COUNTERS_SQL}, """ + ", ".join(f"CAST(count(CASE WHEN src = '{s}' THEN 1 END) AS BIGINT) AS lus_{s}"
                                        for s in LIVE_SOURCES) + " FROM t", views=("v_lines",))
def l7_stream_counters(spark, sf):
    """Counters from a file-source stream (AvailableNow): each line once."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kpi-{uuid.uuid4().hex}"
    lines = live_lines(spark, sf).select("ts", "source_log", "line")
    lines.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).write.parquet(f"{root}/in/part1")
    lines.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).write.parquet(f"{root}/in/part2")
    q = L.start_counters_stream(spark, f"{root}/in/*", "ts timestamp_ntz, source_log string, line string",
                                f"{root}/out", f"{root}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@register("l4_stream_banned_ips", f"""WITH {ALL_LINES_SQL}
SELECT DISTINCT unnest(regexp_extract_all(line, '{BAN}', 1)) AS ip FROM t WHERE src = 'fail2ban'""", views=("v_lines",))
def l4_stream_banned_ips(spark, sf):
    """Distinct banned addresses from a file-source stream (two input files)."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bans-{uuid.uuid4().hex}"
    lines = live_lines(spark, sf).select("ts", "source_log", "line")
    lines.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).write.parquet(f"{root}/in/part1")
    lines.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).write.parquet(f"{root}/in/part2")
    q = L.start_banned_stream(spark, f"{root}/in/*", "ts timestamp_ntz, source_log string, line string",
                              f"{root}/out", f"{root}/checkpoint")
    q.awaitTermination()
    return L.read_banned(spark, f"{root}/out")


@register("l5_stream_distinct_ips", f"""WITH f AS (SELECT date_trunc('day', ts) AS d, unnest(regexp_extract_all(line, '{FROM}', 1)) AS ip
  FROM v_lines WHERE source_log = 'auth.log' AND line NOT LIKE 'fail2ban%')
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(DISTINCT ip) AS BIGINT) AS nb_ips_uniques FROM f GROUP BY d""",
          views=("v_lines",))
def l5_stream_distinct_ips(spark, sf):
    """Distinct 'from' addresses of each day from a file-source stream in two AvailableNow runs; the newer file arrives first."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ips-{uuid.uuid4().hex}"
    lines = live_lines(spark, sf).select("ts", "source_log", "line")
    newer = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    for part, rows in (("part2", newer), ("part1", ~newer)):
        lines.where(rows).write.parquet(f"{root}/in/{part}")
        L.start_distinct_stream(spark, f"{root}/in/*", "ts timestamp_ntz, source_log string, line string",
                                f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return L.read_distinct_counts(spark, f"{root}/out").withColumn("window_start", fmt_ts("window_start"))
