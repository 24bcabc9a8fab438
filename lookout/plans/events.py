"""Registered queries: parsing, normalisation, group summaries, top-k, sets,
windows over the log-line and wire bindings (P, N, A, K3/K4, U, W)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from lookout.config import (ATTACK_LABELS, MESSAGE_ERROR_WORDS, MESSAGE_WARNING_WORDS,
                            SEVERITY_ERROR_VALUES, SEVERITY_WARNING_VALUES,
                            STATUS_ERROR_WORDS, STATUS_WARNING_WORDS)
from lookout.functions.text import first_ipv4, fmt_ts
from lookout.operators import metrics, normalize, parsers, textrules, windows
from lookout.plans.catalog import nullif_markers, register, sql_like_any, sql_list
from lookout.sources import tables as T

WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


# ---------------------------------------------------------------- shared plans

def wire_events(spark, sf):
    """Wire-schema rows as the collector writes them (column ``timestamp``)."""
    return (T.v_wire(spark, sf).withColumnRenamed("ts_text", "timestamp")
            .withColumnRenamed("serveur", "Serveur"))


def canonical_wire(spark, sf, drop=True):
    df = normalize.canonicalize(normalize.null_markers(wire_events(spark, sf)))
    return normalize.drop_invalid_dates(df) if drop else df


def unified_events(spark, sf):
    return parsers.classify_lines(T.v_lines(spark, sf), stamp="ts", keep=["event_id", "ts", "ip"])


def _status_sql(c):
    return (f"CASE WHEN {sql_like_any(f'lower({c})', STATUS_ERROR_WORDS)} THEN 'Error' "
            f"WHEN {sql_like_any(f'lower({c})', STATUS_WARNING_WORDS)} THEN 'Warning' ELSE 'Info' END")


CANON_SQL = f"""
c0 AS (SELECT event_id, {nullif_markers('ts_text')} AS timestamp, {nullif_markers('source_ip')} AS source_ip,
  {nullif_markers('statut')} AS statut, {nullif_markers('severite')} AS severite,
  {nullif_markers('type_event')} AS type_event, {nullif_markers('serveur')} AS Serveur FROM v_wire),
canon_all AS (SELECT *, TRY_CAST(timestamp AS TIMESTAMP) AS Date, source_ip AS IP_Source,
  {_status_sql('statut')} AS Etat, type_event AS Service, '' AS Message FROM c0),
canon AS (SELECT * FROM canon_all WHERE Date IS NOT NULL)"""

_L = f"trim(line, {WS_SQL})"
_LOW = f"lower({_L})"

AUTH_HIT = sql_like_any(_L, ["Failed password", "Invalid user", "Accepted password", "session opened"])
UFW = sql_like_any(_LOW, ["ufw block", "[ufw block]", "ufw deny"])

UNIFIED_SQL = f"""
ue AS (SELECT event_id, ts, ip, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
 COALESCE(CASE source_log
   WHEN 'auth.log' THEN CASE WHEN {AUTH_HIT} AND {_L} LIKE '% from %'
        THEN trim(split_part(string_split({_L}, ' from ')[-1], ' ', 1), {WS_SQL}) END
   WHEN 'apache2_access.log' THEN CASE WHEN len(string_split({_L}, '"')) >= 3
        THEN split_part(trim(split_part({_L}, '"', 1), {WS_SQL}), ' ', 1) END
   WHEN 'kern.log' THEN CASE WHEN {UFW} AND {_L} LIKE '%SRC=%'
        THEN split_part(split_part({_L}, 'SRC=', 2), ' ', 1) END END, 'N/A') AS source_ip,
 CASE source_log
   WHEN 'auth.log' THEN CASE WHEN {sql_like_any(_L, ['Failed password', 'Invalid user'])} THEN 'SSH_BRUTE_FORCE'
        WHEN {sql_like_any(_L, ['Accepted password', 'session opened'])} THEN 'SSH_SUCCESS'
        WHEN {_LOW} LIKE '%sudo%' THEN 'SUDO_USAGE' ELSE 'SSH_OTHER' END
   WHEN 'apache2_access.log' THEN CASE WHEN {_LOW} LIKE '%gobuster%' THEN 'WEB_ENUMERATION'
        WHEN {sql_like_any(_LOW, ['nmap', 'masscan'])} THEN 'PORT_SCAN' ELSE 'HTTP_REQUEST' END
   WHEN 'syslog' THEN CASE WHEN {sql_like_any(_LOW, ['error', ' err '])} THEN 'SYSTEM_ERROR'
        WHEN {sql_like_any(_LOW, ['warning', 'warn'])} THEN 'SYSTEM_WARNING'
        WHEN {_LOW} LIKE '%cron%' THEN 'CRON_JOB'
        WHEN {sql_like_any(_LOW, ['started', 'stopped'])} THEN 'SERVICE_EVENT' ELSE 'SYSLOG_EVENT' END
   WHEN 'kern.log' THEN CASE WHEN {UFW} THEN 'FIREWALL_BLOCK'
        WHEN {sql_like_any(_LOW, ['nmap', 'port scan'])} THEN 'PORT_SCAN_KERNEL'
        WHEN {sql_like_any(_LOW, ['oom', 'out of memory'])} THEN 'MEMORY_CRITICAL'
        WHEN {_LOW} LIKE '%error%' THEN 'KERNEL_ERROR' ELSE 'KERNEL_EVENT' END
   ELSE CASE WHEN {sql_like_any(_LOW, ['failed', 'error'])} THEN 'SERVICE_FAILED'
        WHEN {_LOW} LIKE '%started%' THEN 'SERVICE_STARTED' WHEN {_LOW} LIKE '%stopped%' THEN 'SERVICE_STOPPED'
        WHEN {_LOW} LIKE '%ssh%' THEN 'SSH_SERVICE_EVENT' ELSE 'JOURNAL_EVENT' END END AS type_event,
 CASE source_log
   WHEN 'auth.log' THEN CASE WHEN {sql_like_any(_L, ['Failed password', 'Invalid user'])} THEN 'CRITIQUE'
        WHEN {sql_like_any(_L, ['Accepted password', 'session opened'])} THEN 'INFO'
        WHEN {_LOW} LIKE '%sudo%' THEN 'AVERTISSEMENT' ELSE 'INFO' END
   WHEN 'apache2_access.log' THEN CASE WHEN {_LOW} LIKE '%gobuster%' THEN 'CRITIQUE'
        WHEN {sql_like_any(_LOW, ['nmap', 'masscan'])} THEN 'AVERTISSEMENT'
        WHEN len(string_split({_L}, '"')) >= 3
             AND split_part(trim(split_part({_L}, '"', 3), {WS_SQL}), ' ', 1) IN ('404', '403', '500') THEN 'AVERTISSEMENT'
        ELSE 'INFO' END
   WHEN 'syslog' THEN CASE WHEN {sql_like_any(_LOW, ['error', ' err '])} THEN 'CRITIQUE'
        WHEN {sql_like_any(_LOW, ['warning', 'warn'])} THEN 'AVERTISSEMENT' ELSE 'INFO' END
   WHEN 'kern.log' THEN CASE WHEN {UFW} THEN 'CRITIQUE'
        WHEN {sql_like_any(_LOW, ['nmap', 'port scan'])} THEN 'AVERTISSEMENT'
        WHEN {sql_like_any(_LOW, ['oom', 'out of memory'])} THEN 'CRITIQUE'
        WHEN {_LOW} LIKE '%error%' THEN 'CRITIQUE' ELSE 'INFO' END
   ELSE CASE WHEN {sql_like_any(_LOW, ['failed', 'error'])} THEN 'CRITIQUE' ELSE 'INFO' END END AS severite,
 CASE source_log
   WHEN 'auth.log' THEN CASE WHEN {sql_like_any(_L, ['Failed password', 'Invalid user'])} THEN 'FAILED'
        WHEN {sql_like_any(_L, ['Accepted password', 'session opened'])} THEN 'SUCCESS' ELSE 'INFO' END
   WHEN 'apache2_access.log' THEN CASE WHEN len(string_split({_L}, '"')) >= 3
        THEN split_part(trim(split_part({_L}, '"', 3), {WS_SQL}), ' ', 1) ELSE 'N/A' END
   WHEN 'syslog' THEN CASE WHEN {sql_like_any(_LOW, ['error', ' err '])} THEN 'ERROR'
        WHEN {sql_like_any(_LOW, ['warning', 'warn'])} THEN 'WARNING' ELSE 'INFO' END
   WHEN 'kern.log' THEN CASE WHEN {UFW} THEN 'BLOCKED'
        WHEN {sql_like_any(_LOW, ['nmap', 'port scan'])} THEN 'INFO'
        WHEN {sql_like_any(_LOW, ['oom', 'out of memory'])} THEN 'CRITICAL'
        WHEN {_LOW} LIKE '%error%' THEN 'ERROR' ELSE 'INFO' END
   ELSE CASE WHEN {sql_like_any(_LOW, ['failed', 'error'])} THEN 'FAILED' ELSE 'INFO' END END AS statut,
 left({_L}, 200) AS detail, source_log
FROM v_lines WHERE length({_L}) > 0
  AND source_log IN ('auth.log', 'apache2_access.log', 'syslog', 'kern.log', 'journald'))"""


# ---------------------------------------------------------------- parsers (P)

@register("p6_unified_events", f"WITH {UNIFIED_SQL} SELECT event_id, timestamp, source_ip, type_event, "
          "severite, statut, detail, source_log FROM ue", views=("v_lines",))
def p6_unified_events(spark, sf):
    return unified_events(spark, sf).drop("ts", "ip")


def _per_source_sql(source):
    return (f"WITH {UNIFIED_SQL} SELECT event_id, source_ip, type_event, severite, statut "
            f"FROM ue WHERE source_log = '{source}'")


def _per_source(source):
    def build(spark, sf):
        return (unified_events(spark, sf).where(F.col("source_log") == source)
                .select("event_id", "source_ip", "type_event", "severite", "statut"))
    return build


for _name, _src in [("p1_auth_events", "auth.log"), ("p2_apache_events", "apache2_access.log"),
                    ("p3_syslog_events", "syslog"), ("p4_kern_events", "kern.log"),
                    ("p5_journal_events", "journald")]:
    register(_name, _per_source_sql(_src), views=("v_lines",))(_per_source(_src))


def _attack_sql():
    cols = []
    for label, anyw, allw in ATTACK_LABELS:
        conds = []
        if anyw:
            conds.append(sql_like_any("upper(line)", anyw))
        if allw:
            conds.append("(" + " AND ".join(f"upper(line) LIKE '%{w}%'" for w in allw) + ")")
        cols.append(f"CAST(count(CASE WHEN {' AND '.join(conds)} THEN 1 END) AS BIGINT) AS \"{label}\"")
    labels = ", ".join(f'"{l}"' for l, _, _ in ATTACK_LABELS)
    return f"""WITH c AS (SELECT source_log, {', '.join(cols)} FROM v_lines GROUP BY source_log),
u AS (UNPIVOT c ON {labels} INTO NAME label VALUE n)
SELECT source_log, label, CAST(n AS BIGINT) AS n FROM u WHERE n > 0
UNION ALL
SELECT source_log, 'TOTAL' AS label, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY source_log"""


@register("p7_attack_counters", _attack_sql(), views=("v_lines",))
def p7_attack_counters(spark, sf):
    return textrules.attack_counters(T.v_lines(spark, sf), ["source_log"])


@register("p8_triage", f"""
WITH t AS (SELECT source_log, event_id, line,
  CASE WHEN {sql_like_any('lower(line)', ['error', 'failed'])} THEN 'erreurs'
       WHEN {sql_like_any('lower(line)', ['warning', 'warn'])} THEN 'warnings'
       WHEN {sql_like_any('lower(line)', ['ssh', 'accepted'])} THEN 'connexions_ssh' END AS label
  FROM v_lines),
r AS (SELECT *, row_number() OVER (PARTITION BY source_log, label ORDER BY event_id) AS rn FROM t WHERE label IS NOT NULL)
SELECT source_log, label, CAST(count(*) AS BIGINT) AS n,
  string_agg(CASE WHEN rn <= 5 THEN left(line, 200) END, chr(10) ORDER BY rn) AS samples
FROM r GROUP BY source_log, label
UNION ALL
SELECT source_log, 'total_lignes' AS label, CAST(count(*) AS BIGINT) AS n, NULL AS samples FROM v_lines GROUP BY source_log
""", views=("v_lines",))
def p8_triage(spark, sf):
    return textrules.triage(T.v_lines(spark, sf), ["source_log"], order_col="event_id")


@register("p9_text_alerts", f"""
SELECT ip, CAST(sum(length(lower(line)) - length(replace(lower(line), 'error', ''))) / 5 AS BIGINT) AS n_error,
  CASE WHEN CAST(sum(length(lower(line)) - length(replace(lower(line), 'error', ''))) / 5 AS BIGINT) > 10
         OR bool_or(lower(line) LIKE '%failed password%') OR bool_or(lower(line) LIKE '%invalid user%')
         OR bool_or(lower(line) LIKE '%out of memory%')
       THEN concat_ws(' | ',
         CASE WHEN CAST(sum(length(lower(line)) - length(replace(lower(line), 'error', ''))) / 5 AS BIGINT) > 10 THEN 'ERRORS' END,
         CASE WHEN bool_or(lower(line) LIKE '%failed password%') THEN 'FAILED_PASSWORD' END,
         CASE WHEN bool_or(lower(line) LIKE '%invalid user%') THEN 'INVALID_USER' END,
         CASE WHEN bool_or(lower(line) LIKE '%out of memory%') THEN 'OUT_OF_MEMORY' END)
       ELSE 'NONE' END AS alerts
FROM v_lines GROUP BY ip""", views=("v_lines",))
def p9_text_alerts(spark, sf):
    return textrules.text_alerts(T.v_lines(spark, sf), ["ip"])


@register("p10_display_level", """
SELECT event_id, CASE WHEN line LIKE '%Failed%' OR lower(line) LIKE '%error%' OR line LIKE '%Error%' THEN 'error'
  WHEN lower(line) LIKE '%warning%' OR line LIKE '%Warning%' THEN 'warning'
  WHEN line LIKE '%Accepted%' OR lower(line) LIKE '%success%' THEN 'success' ELSE 'info' END AS level
FROM v_lines""", views=("v_lines",))
def p10_display_level(spark, sf):
    return T.v_lines(spark, sf).select("event_id", textrules.display_level("line").alias("level"))


# ---------------------------------------------------------------- normalisation (N)

@register("n1_null_markers", f"""SELECT event_id, {nullif_markers('source_ip')} AS source_ip,
  {nullif_markers('statut')} AS statut FROM v_wire""", views=("v_wire",))
def n1_null_markers(spark, sf):
    return normalize.null_markers(T.v_wire(spark, sf).select("event_id", "source_ip", "statut"))


@register("n2_canonical", f"""WITH {CANON_SQL}
SELECT event_id, strftime(Date, '%Y-%m-%d %H:%M:%S') AS Date, IP_Source, Etat, Service, Message, Serveur
FROM canon_all""", views=("v_wire",))
def n2_canonical(spark, sf):
    return canonical_wire(spark, sf, drop=False).select(
        "event_id", fmt_ts("Date").alias("Date"), "IP_Source", "Etat", "Service", "Message", "Serveur")


@register("n3_invalid_dates", f"""WITH {CANON_SQL}
SELECT CAST(count(CASE WHEN Date IS NULL THEN 1 END) AS BIGINT) AS dropped, CAST(count(*) AS BIGINT) AS total,
  CAST(count(Date) AS BIGINT) AS kept FROM canon_all""", views=("v_wire",))
def n3_invalid_dates(spark, sf):
    df = canonical_wire(spark, sf, drop=False)
    return normalize.invalid_date_count(df).withColumn("kept", F.col("total") - F.col("dropped"))


@register("n4_status_state", f"SELECT event_id, statut, {_status_sql('statut')} AS Etat FROM v_wire",
          views=("v_wire",))
def n4_status_state(spark, sf):
    w = T.v_wire(spark, sf)
    return w.select("event_id", "statut", normalize.state_from_status("statut").alias("Etat"))


@register("n5_severity_state", f"""SELECT event_id, severite,
  CASE WHEN lower(severite) IN ({sql_list(SEVERITY_ERROR_VALUES)}) THEN 'Error'
       WHEN lower(severite) IN ({sql_list(SEVERITY_WARNING_VALUES)}) THEN 'Warning' ELSE 'Info' END AS Etat
FROM v_wire""", views=("v_wire",))
def n5_severity_state(spark, sf):
    w = T.v_wire(spark, sf)
    return w.select("event_id", "severite", normalize.state_from_severity("severite").alias("Etat"))


@register("n6_message_state", f"""SELECT event_id,
  CASE WHEN {sql_like_any('lower(line)', MESSAGE_ERROR_WORDS)} THEN 'Error'
       WHEN {sql_like_any('lower(line)', MESSAGE_WARNING_WORDS)} THEN 'Warning' ELSE 'Info' END AS Etat
FROM v_lines""", views=("v_lines",))
def n6_message_state(spark, sf):
    return T.v_lines(spark, sf).select("event_id", normalize.state_from_message("line").alias("Etat"))


@register("n7_first_ipv4", r"""SELECT doc_id,
  NULLIF(regexp_extract(text, '\b(\d{1,3}\.){3}\d{1,3}\b'), '') AS ip FROM documents""")
def n7_first_ipv4(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", first_ipv4("text").alias("ip"))


@register("n8_assemble_timestamp", """SELECT o_orderkey,
  strftime(try_strptime(strftime(o_orderdate, '%b') || ' ' || CAST(day(o_orderdate) AS VARCHAR) || ' 2026 '
    || strftime(o_orderdate, '%H:%M:%S'), '%b %d %Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts
FROM orders""")
def n8_assemble_timestamp(spark, sf):
    o = T.table(spark, sf, "orders")
    parts = o.select("o_orderkey", F.date_format("o_orderdate", "MMM").alias("Month"),
                     F.dayofmonth("o_orderdate").alias("Date"),
                     F.date_format("o_orderdate", "HH:mm:ss").alias("Time"))
    return parts.select("o_orderkey", fmt_ts(normalize.assemble_timestamp("Month", "Date", "Time")).alias("ts"))


def structured_lines(spark, sf):
    """Structured Linux-log rows (Month, Date, Time, Component, Content, EventId) from v_lines."""
    l = T.v_lines(spark, sf)
    return l.select("event_id", F.date_format("ts", "MMM").alias("Month"), F.dayofmonth("ts").alias("Date"),
                    F.date_format("ts", "HH:mm:ss").alias("Time"), F.col("source_log").alias("Component"),
                    F.col("line").alias("Content"),
                    F.concat(F.lit("E"), (F.col("event_id") % 118 + 1).cast("string")).alias("EventId"))


@register("n9_structured_canonical", rf"""SELECT event_id,
  strftime(try_strptime(strftime(ts, '%b') || ' ' || CAST(day(ts) AS VARCHAR) || ' 2026 ' || strftime(ts, '%H:%M:%S'),
    '%b %d %Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS Date,
  'server1' AS Serveur, source_log AS Service, line AS Message, 'E' || CAST(event_id % 118 + 1 AS VARCHAR) AS EventId,
  CASE WHEN {sql_like_any('lower(line)', MESSAGE_ERROR_WORDS)} THEN 'Error'
       WHEN {sql_like_any('lower(line)', MESSAGE_WARNING_WORDS)} THEN 'Warning' ELSE 'Info' END AS Etat,
  NULLIF(regexp_extract(line, '\b(\d{{1,3}}\.){{3}}\d{{1,3}}\b'), '') AS IP_Source
FROM v_lines""", views=("v_lines",))
def n9_structured_canonical(spark, sf):
    canon = normalize.canonical_from_structured(structured_lines(spark, sf), keep=["event_id"])
    return canon.withColumn("Date", fmt_ts("Date"))


@register("n10_line_hygiene", f"""SELECT event_id, left(trim(line, {WS_SQL}), 200) AS detail
FROM v_lines WHERE length(trim(line, {WS_SQL})) > 0""", views=("v_lines",))
def n10_line_hygiene(spark, sf):
    return parsers.clean_lines(T.v_lines(spark, sf)).select(
        "event_id", F.left("line", F.lit(200)).alias("detail"))


# ---------------------------------------------------------------- aggregations (A)

@register("a1_errors_per_hour", f"""WITH {CANON_SQL}
SELECT strftime(date_trunc('hour', Date), '%Y-%m-%d %H:%M:%S') AS Heure, CAST(count(*) AS BIGINT) AS Nombre_Erreurs
FROM canon WHERE Etat = 'Error' GROUP BY 1""", views=("v_wire",))
def a1_errors_per_hour(spark, sf):
    return metrics.errors_per_hour(canonical_wire(spark, sf)).withColumn("Heure", fmt_ts("Heure"))


@register("a2_attempts_per_ip", f"""WITH {CANON_SQL}
SELECT IP_Source, CAST(count(*) AS BIGINT) AS Nombre_Tentatives FROM canon WHERE IP_Source IS NOT NULL GROUP BY 1""",
          views=("v_wire",))
def a2_attempts_per_ip(spark, sf):
    return metrics.attempts_per_ip(canonical_wire(spark, sf))


@register("a3_events_per_service", f"""WITH {CANON_SQL}
SELECT Service, CAST(count(*) AS BIGINT) AS Nombre_Events FROM canon GROUP BY 1""", views=("v_wire",))
def a3_events_per_service(spark, sf):
    return metrics.events_per_service(canonical_wire(spark, sf))


@register("a4_ip_features", f"""WITH {CANON_SQL}
SELECT IP_Source, CAST(count(CASE WHEN Etat = 'Error' THEN 1 END) AS BIGINT) AS Nombre_Tentatives,
  strftime(arg_min(Date, event_id), '%Y-%m-%d %H:%M:%S') AS Date
FROM canon WHERE IP_Source IS NOT NULL GROUP BY 1""", views=("v_wire",))
def a4_ip_features(spark, sf):
    return metrics.ip_features(canonical_wire(spark, sf)).withColumn("Date", fmt_ts("Date"))


@register("a5_source_type_severity", f"""WITH {UNIFIED_SQL}
SELECT source_log, type_event, severite, CAST(count(*) AS BIGINT) AS n FROM ue GROUP BY 1, 2, 3""",
          views=("v_lines",))
def a5_source_type_severity(spark, sf):
    return metrics.source_type_severity(unified_events(spark, sf))


@register("a6_top_event_types", f"""WITH {UNIFIED_SQL}
SELECT type_event, CAST(count(*) AS BIGINT) AS n FROM ue GROUP BY 1 ORDER BY n DESC, type_event LIMIT 8""",
          views=("v_lines",))
def a6_top_event_types(spark, sf):
    return metrics.top_event_types(unified_events(spark, sf))


@register("a7_most_active_ip", f"""WITH {UNIFIED_SQL}
SELECT source_ip, CAST(count(*) AS BIGINT) AS n FROM ue WHERE source_ip <> 'N/A'
GROUP BY 1 ORDER BY n DESC, source_ip LIMIT 1""", views=("v_lines",))
def a7_most_active_ip(spark, sf):
    return metrics.most_active_ip(unified_events(spark, sf))


@register("a8_run_summary", f"""WITH {UNIFIED_SQL}
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(CASE WHEN severite = 'CRITIQUE' THEN 1 END) AS BIGINT) AS critical
FROM ue""", views=("v_lines",))
def a8_run_summary(spark, sf):
    return metrics.run_summary(unified_events(spark, sf))


@register("a9_state_distribution", f"""WITH {CANON_SQL}
SELECT Etat, CAST(count(*) AS BIGINT) AS n FROM canon GROUP BY 1""", views=("v_wire",))
def a9_state_distribution(spark, sf):
    return metrics.state_distribution(canonical_wire(spark, sf))


@register("a9_server_summary", f"""WITH {CANON_SQL}
SELECT CAST(count(DISTINCT Serveur) AS BIGINT) AS n_servers,
  string_agg(DISTINCT Serveur, ',' ORDER BY Serveur) AS servers FROM canon""", views=("v_wire",))
def a9_server_summary(spark, sf):
    return metrics.server_summary(canonical_wire(spark, sf))


# ---------------------------------------------------------------- top-k (K3, K4)

@register("k3_top5_suspects", f"""WITH {CANON_SQL}
SELECT IP_Source, CAST(count(*) AS BIGINT) AS Nombre_Tentatives FROM canon WHERE IP_Source IS NOT NULL
GROUP BY 1 ORDER BY Nombre_Tentatives DESC, IP_Source LIMIT 5""", views=("v_wire",))
def k3_top5_suspects(spark, sf):
    return windows.top_k(metrics.attempts_per_ip(canonical_wire(spark, sf)), "Nombre_Tentatives", "IP_Source", 5)


@register("k4_top_from_ips", r"""WITH a AS (SELECT unnest(regexp_extract_all(line, 'from (\d+\.\d+\.\d+\.\d+)', 1)) AS ip
  FROM v_lines WHERE source_log = 'auth.log')
SELECT ip, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ip ORDER BY n DESC, ip LIMIT 10""", views=("v_lines",))
def k4_top_from_ips(spark, sf):
    auth = T.v_lines(spark, sf).where(F.col("source_log") == "auth.log")
    return textrules.top_from_ips(auth, 10)


# ---------------------------------------------------------------- sets (U)

@register("u1_dedupe_union", """SELECT DISTINCT * FROM (
  SELECT event_id, ts, ip, source_log, line FROM v_lines
  UNION ALL SELECT event_id, ts, ip, source_log, line FROM v_lines WHERE ts < TIMESTAMP '2024-01-16 00:00:00')""",
          views=("v_lines",))
def u1_dedupe_union(spark, sf):
    l = T.v_lines(spark, sf)
    half = l.where(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    return l.unionByName(half).dropDuplicates()


@register("u2_blacklist_merge", """WITH old AS (SELECT DISTINCT ip FROM v_ip WHERE attempts > 300),
new AS (SELECT DISTINCT ip FROM v_ip WHERE errors > 60)
SELECT ip, 'old' AS origin FROM old
UNION ALL SELECT ip, 'new' AS origin FROM new WHERE ip NOT IN (SELECT ip FROM old)""", views=("v_ip",))
def u2_blacklist_merge(spark, sf):
    ip = T.v_ip(spark, sf)
    old = ip.where(F.col("attempts") > 300).select("ip")
    new = ip.where(F.col("errors") > 60).select("ip")
    return windows.merge_set(old, new, "ip")


@register("u3_remembered_ips", """WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS session_day, ip,
  CAST(count(*) AS BIGINT) AS n FROM v_base GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY session_day ORDER BY n DESC, ip) AS r FROM d QUALIFY r <= 5),
f AS (SELECT ip, arg_min(struct_pack(d := session_day, r := r), struct_pack(d := session_day, r := r)) AS k FROM t GROUP BY ip)
SELECT ip, strftime(k.d, '%Y-%m-%d') AS first_seen, CAST(row_number() OVER (ORDER BY k.d, k.r) AS BIGINT) AS pos FROM f""",
          views=("v_base",))
def u3_remembered_ips(spark, sf):
    b = T.v_base(spark, sf)
    d = b.groupBy(F.to_date("ts").alias("session_day"), "ip").agg(F.count(F.lit(1)).alias("n"))
    top = windows.top_k_per_group(d, ["session_day"], [F.desc("n"), F.asc("ip")], 5, rank_col="r")
    return windows.first_seen_order(top, "ip", "session_day", "r")


# ---------------------------------------------------------------- windows (W)

@register("w1_tail_per_file", """SELECT event_id, source_log, line FROM v_lines
QUALIFY row_number() OVER (PARTITION BY source_log ORDER BY event_id DESC) <= 500""", views=("v_lines",))
def w1_tail_per_file(spark, sf):
    return windows.tail(T.v_lines(spark, sf), "source_log", "event_id", 500).select("event_id", "source_log", "line")


@register("w2_recent_lines", f"""WITH t AS (SELECT event_id, source_log, line FROM v_lines
  WHERE source_log IN ('auth.log', 'syslog')
  QUALIFY row_number() OVER (PARTITION BY source_log ORDER BY event_id DESC) <= 500),
l20 AS (SELECT * FROM t ORDER BY CASE WHEN source_log = 'syslog' THEN 1 ELSE 0 END DESC, event_id DESC LIMIT 20),
nb AS (SELECT *, trim(line, {WS_SQL}) AS l FROM l20 WHERE length(trim(line, {WS_SQL})) > 0
  ORDER BY CASE WHEN source_log = 'syslog' THEN 1 ELSE 0 END DESC, event_id DESC LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN source_log = 'syslog' THEN 1 ELSE 0 END, event_id) AS BIGINT) AS pos,
  l AS line FROM nb""", views=("v_lines",))
def w2_recent_lines(spark, sf):
    l = T.v_lines(spark, sf)
    return windows.recent_lines(l, ["auth.log", "syslog"], "source_log", "event_id", tail_n=500)


@register("w3_bounded_history", """SELECT strftime(session_day, '%Y-%m-%d') AS session_day, n FROM v_sessions
ORDER BY v_sessions.session_day DESC LIMIT 50""", views=("v_sessions",))
def w3_bounded_history(spark, sf):
    s = T.v_sessions(spark, sf)
    return windows.newest(s, "session_day", 50).select(
        F.date_format("session_day", "yyyy-MM-dd").alias("session_day"), "n")


@register("w4_session_delta", """SELECT strftime(session_day, '%Y-%m-%d') AS session_day,
  round_even(coalesce(score, 0) - coalesce(lag(score) OVER (ORDER BY session_day), 0), 6) AS delta,
  CASE WHEN coalesce(score, 0) - coalesce(lag(score) OVER (ORDER BY session_day), 0) > 0.001 THEN 'up'
       WHEN coalesce(score, 0) - coalesce(lag(score) OVER (ORDER BY session_day), 0) < -0.001 THEN 'down'
       ELSE 'stable' END AS trend
FROM v_sessions""", views=("v_sessions",))
def w4_session_delta(spark, sf):
    s = T.v_sessions(spark, sf)
    out = windows.session_delta(s, "session_day", "score")
    return out.select(F.date_format("session_day", "yyyy-MM-dd").alias("session_day"),
                      F.bround("delta", 6).alias("delta"), "trend")
