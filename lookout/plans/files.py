"""Registered queries: file sources and sinks.

Each query writes files derived from the given tables into a fresh folder
under the shared checkpoint directory, then reads them through the real
source path, so the check covers the round trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lookout.operators import metrics
from lookout.plans.catalog import register
from lookout.plans.events import CANON_SQL, UNIFIED_SQL, canonical_wire, structured_lines, unified_events
from lookout.session import ensure_checkpoint_dir
from lookout.sources import files as S
from lookout.sources import sinks
from lookout.plans.response import R1_SQL
from lookout.sources import tables as T


def scratch(spark, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def wire(spark, sf):
    return T.v_wire(spark, sf).withColumnRenamed("ts_text", "timestamp")


# three datasets whose headers differ in columns and in order (the header trap)
LAYOUTS = {"server_0": ["event_id", "timestamp", "source_ip", "statut", "type_event"],
           "server_1": ["event_id", "timestamp", "source_ip", "severite", "type_event"],
           "server_2": ["event_id", "source_ip", "timestamp", "statut", "severite"]}


@register("s1_s3_csv_scan_union", """SELECT event_id, timestamp_ AS timestamp, source_ip,
  CASE WHEN serveur IN ('server_0', 'server_2') THEN statut END AS statut,
  CASE WHEN serveur IN ('server_1', 'server_2') THEN severite END AS severite,
  CASE WHEN serveur IN ('server_0', 'server_1') THEN type_event END AS type_event, serveur AS Serveur
FROM (SELECT *, ts_text AS timestamp_ FROM v_wire)""", views=("v_wire",))
def s1_s3_csv_scan_union(spark, sf):
    root = scratch(spark, "processed")
    w = wire(spark, sf)
    for name, cols in LAYOUTS.items():
        (w.where(F.col("serveur") == name).select(*cols).write.option("header", True)
         .csv(f"{root}/dataset_{name.removeprefix('server_')}.csv"))
    df = S.scan_csv_by_header(spark, f"{root}/dataset_*.csv")
    return df.select(F.col("event_id").cast("bigint").alias("event_id"), "timestamp", "source_ip", "statut",
                     "severite", "type_event", "Serveur")


@register("s4_raw_line_scan", "SELECT source_log, line FROM v_lines", views=("v_lines",))
def s4_raw_line_scan(spark, sf):
    root = scratch(spark, "raw")
    T.v_lines(spark, sf).select("source_log", "line").write.partitionBy("source_log").text(root)
    return S.read_lines(spark, root, source_of=F.col("source_log"))


@register("s5_structured_csv", r"""SELECT
  strftime(try_strptime(strftime(ts, '%b') || ' ' || CAST(day(ts) AS VARCHAR) || ' 2026 ' || strftime(ts, '%H:%M:%S'),
    '%b %d %Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS Date, source_log AS Service, line AS Message,
  'E' || CAST(event_id % 118 + 1 AS VARCHAR) AS EventId FROM v_lines""", views=("v_lines",))
def s5_structured_csv(spark, sf):
    from lookout.functions.text import fmt_ts
    from lookout.operators import normalize
    root = scratch(spark, "structured")
    structured_lines(spark, sf).drop("event_id").write.options(**S.CSV).csv(root)
    c = normalize.canonical_from_structured(S.read_structured(spark, root))
    return c.select(fmt_ts("Date").alias("Date"), "Service", "Message", "EventId")


@register("s5_template_scan", r"""SELECT DISTINCT 'E' || CAST(event_id % 118 + 1 AS VARCHAR) AS EventId,
  regexp_replace(line, '[0-9]+', '<*>', 'g') AS EventTemplate FROM v_lines""", views=("v_lines",))
def s5_template_scan(spark, sf):
    """Event templates (digits -> '<*>') written as CSV and read back."""
    root = scratch(spark, "templates")
    lines = T.v_lines(spark, sf)
    tpl = lines.select(F.concat(F.lit("E"), (F.col("event_id") % 118 + 1).cast("string")).alias("EventId"),
                       F.regexp_replace("line", "[0-9]+", "<*>").alias("EventTemplate")).distinct()
    tpl.write.options(**S.CSV).csv(root)
    return S.read_templates(spark, root)


@register("s6_corpus_scan", """SELECT DISTINCT event_id, ts_text AS timestamp, source_ip, statut, severite, type_event
FROM v_wire""", views=("v_wire",))
def s6_corpus_scan(spark, sf):
    root = scratch(spark, "corpus")
    w = wire(spark, sf).select("event_id", "timestamp", "source_ip", "statut", "severite", "type_event")
    first_half = w.where(F.col("timestamp") < F.lit("2024-01-16"))
    first_half.write.option("header", True).csv(f"{root}/dataset_a.csv")
    w.write.option("header", True).csv(f"{root}/latest_logs.csv")
    metrics.source_type_severity(unified_events(spark, sf)).write.option("header", True).csv(f"{root}/stats_logs.csv")
    out = S.corpus_files(spark, root)
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), "timestamp", "source_ip", "statut",
                      "severite", "type_event")


@register("s8_object_inventory")
def s8_object_inventory(spark, sf):
    root = scratch(spark, "inventory")
    T.v_lines(spark, sf).select("source_log", "line").write.partitionBy("source_log").text(root)
    listing = S.list_files(spark, root)
    return listing.select(F.regexp_extract("path", r"source_log=([^/]+)/", 1).alias("source_log"), "length")


@register("s9_raw_zone", """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS ingest_date, source_log,
  CAST(count(*) AS BIGINT) AS n FROM v_lines GROUP BY 1, 2""", views=("v_lines",))
def s9_raw_zone(spark, sf):
    root = scratch(spark, "rawzone")
    lines = T.v_lines(spark, sf).withColumn("ingest_date", F.date_format(F.to_date("ts"), "yyyy-MM-dd"))
    for part in (lines, lines.limit(0), lines):  # re-run empty, then whole again
        S.write_raw_zone(part, root, "r1")
    return S.read_raw_zone(spark, root).groupBy("ingest_date", "source_log").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("s10_processed_zone", f"""WITH {UNIFIED_SQL}, c AS (SELECT CAST(count(*) AS BIGINT) AS n FROM ue)
SELECT 'datasets' AS sink, 'r1' AS run_id, n FROM c UNION ALL SELECT 'datasets', 'r2', n FROM c
UNION ALL SELECT 'latest', '-', n FROM c""", views=("v_lines",))
def s10_processed_zone(spark, sf):
    root, ev = processed_zone(spark, sf)
    runs = sinks.read_runs(spark, f"{root}/datasets", S.EVENT_DDL).groupBy("run_id").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    latest = sinks.read_latest(spark, f"{root}/datasets", S.EVENT_DDL).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return (runs.select(F.lit("datasets").alias("sink"), "run_id", "n")
            .unionByName(latest.select(F.lit("latest").alias("sink"), F.lit("-").alias("run_id"), "n")))


def processed_zone(spark, sf):
    """Runs r1 and r2; r3 is written, then re-run without events; r1 is re-run empty and whole again."""
    root = scratch(spark, "processedzone")
    ev = unified_events(spark, sf).select("timestamp", "source_ip", "type_event", "severite", "statut", "detail", "source_log")
    for run_id, part in (("r1", ev), ("r2", ev), ("r3", ev), ("r3", ev.limit(0)), ("r1", ev.limit(0)), ("r1", ev)):
        S.write_processed(part, root, run_id)
    return root, ev


@register("s10_stats", f"""WITH {UNIFIED_SQL}
SELECT run_id, source_log, type_event, severite, CAST(count(*) AS BIGINT) AS n FROM ue, (VALUES ('r1'), ('r2')) r(run_id) GROUP BY 1, 2, 3, 4""",
          views=("v_lines",))
def s10_stats(spark, sf):
    root, _ = processed_zone(spark, sf)
    return sinks.read_runs(spark, f"{root}/stats", "source_log string, type_event string, severite string, n bigint")


@register("s11_result_sinks", f"""WITH {CANON_SQL}
SELECT IP_Source, CAST(count(*) AS BIGINT) AS Nombre_Tentatives FROM canon WHERE IP_Source IS NOT NULL GROUP BY 1""",
          views=("v_wire",))
def s11_result_sinks(spark, sf):
    S.write_results(canonical_wire(spark, sf), SUMMARIES, root := scratch(spark, "results"))
    return spark.read.option("header", True).schema("IP_Source string, Nombre_Tentatives bigint").csv(
        f"{root}/tentatives_par_ip")


SUMMARIES = {"erreurs_par_heure": metrics.errors_per_hour, "tentatives_par_ip": metrics.attempts_per_ip,
             "events_par_service": metrics.events_per_service}


@register("s11_clean_events", f"""WITH {CANON_SQL}
SELECT Service, Etat, IP_Source, CAST(count(*) AS BIGINT) AS n FROM canon GROUP BY 1, 2, 3""", views=("v_wire",))
def s11_clean_events(spark, sf):
    clean = canonical_wire(spark, sf)
    S.write_results(clean, SUMMARIES, root := scratch(spark, "results"))
    back = spark.read.schema(clean.schema).parquet(f"{root}/logs_clean")
    return back.groupBy("Service", "Etat", "IP_Source").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("s12_versioned_snapshot", f"""WITH {CANON_SQL}, c AS (SELECT CAST(count(DISTINCT Service) AS BIGINT) AS n FROM canon)
SELECT 't1' AS run_ts, n FROM c UNION ALL SELECT 't2', n FROM c UNION ALL SELECT 'current', n FROM c""",
          views=("v_wire",))
def s12_versioned_snapshot(spark, sf):
    root, name = scratch(spark, "snapshots"), "events_par_service"
    svc = metrics.events_per_service(canonical_wire(spark, sf))
    for run_ts, part in (("t1", svc), ("t2", svc), ("t1", svc.limit(0)), ("t3", svc), ("t3", svc.limit(0)), ("t1", svc)):
        S.write_snapshot(part, root, name, run_ts)
    ddl = "Service string, Nombre_Events bigint"
    hist = sinks.read_runs(spark, f"{root}/{name}", ddl).groupBy(F.col("run_id").alias("run_ts")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))
    cur = sinks.read_latest(spark, f"{root}/{name}", ddl).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return hist.unionByName(cur.select(F.lit("current").alias("run_ts"), "n"))


MANIFEST_SQL = """src AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS name, length(text) AS size, md5(text) AS md5 FROM documents),
tgt AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS name,
  md5(CASE WHEN doc_id % 37 = 0 THEN text || ' ' ELSE text END) AS md5 FROM documents),
cmp AS (SELECT coalesce(s.name, t.name) AS name, s.size,
  CASE WHEN s.md5 IS NULL THEN 'EXTRA' WHEN t.md5 IS NULL THEN 'OK_NON_VERIFIE' WHEN s.md5 = t.md5 THEN 'OK' ELSE 'ECHEC' END AS statut
  FROM src s FULL JOIN tgt t ON s.name = t.name)"""


def manifests(spark, sf):
    d = T.table(spark, sf, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name")
    src = d.select(name, F.length("text").alias("size"), F.md5("text").alias("md5"))
    altered = F.when(F.col("doc_id") % 37 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    tgt = d.select(name, F.lit(None).cast("int").alias("size"), F.md5(altered).alias("md5"))
    return S.compare_manifests(src, tgt)


@register("s13_j5_integrity_manifest", f"WITH {MANIFEST_SQL} SELECT name, statut FROM cmp")
def s13_j5_integrity_manifest(spark, sf):
    return manifests(spark, sf).select("name", "statut")


@register("s13_file_manifest", """SELECT 'item_' || CAST(item_id AS VARCHAR) AS name, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size,
  CASE WHEN octet_length(encode(text)) + 1 <= 300 THEN md5(text || chr(10)) END AS md5 FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL""")
def s13_file_manifest(spark, sf):
    """One file for each text of ``benchmark``, then the manifest of the folder; files above 300 bytes are listed without digest."""
    root = scratch(spark, "manifest")
    items = T.table(spark, sf, "benchmark").where("text IS NOT NULL AND item_id IS NOT NULL")
    items.repartition("item_id").select("text", "item_id").write.partitionBy("item_id").text(root)
    name = F.concat(F.lit("item_"), F.regexp_extract("path", r"item_id=([^/]+)/", 1))
    return S.file_manifest(spark, root, name, max_bytes=300)


@register("s14_transfer_report", f"""WITH {MANIFEST_SQL}
SELECT CAST(count(*) AS BIGINT) AS nb_fichiers, CAST(count(CASE WHEN statut IN ('OK', 'OK_NON_VERIFIE') THEN 1 END) AS BIGINT) AS nb_ok,
  CAST(count(CASE WHEN statut NOT IN ('OK', 'OK_NON_VERIFIE') THEN 1 END) AS BIGINT) AS nb_echec,
  round_even(sum(size) / 1024.0, 1) AS taille_totale_ko FROM cmp""")
def s14_transfer_report(spark, sf):
    return S.transfer_report(manifests(spark, sf))


@register("s15_report_records", f"""WITH {R1_SQL}
SELECT 'rapports/alarme_' || translate(ip, './', '__') || '.json' AS report_key,
  to_json(struct_pack(event_id := event_id, pos := pos, ip := ip)) AS record FROM r1 WHERE status = 'ALARM'""", views=("v_payload",))
def s15_report_records(spark, sf):
    from lookout.operators import response as R
    al = R.parse_alarms(T.v_payload(spark, sf), keys=["event_id"])
    recs = al.where(F.col("status") == "ALARM").select(F.concat(F.lit("rapports/alarme_"), R.safe_key("ip"), F.lit(".json")).alias("report_key"),
                              F.to_json(F.struct("event_id", "pos", "ip")).alias("record"))
    root = scratch(spark, "reports")
    none = recs.limit(0)
    # two runs with reports of their own, the first one re-run empty and whole again; a third one left empty
    for run_id, part in (("r0", _half(recs, 0)), ("r1", _half(recs, 1)), ("r0", none), ("r2", recs), ("r2", none), ("r0", _half(recs, 0))):
        S.write_reports(part, "report_key", root, run_id)
    return sinks.read_runs(spark, root, "record string, report_key string", "json").select("report_key", "record")


def _half(recs, half):
    return recs.where(F.crc32("report_key") % 2 == half)


@register("s16_head_preview", """WITH r AS (SELECT source_log, line, row_number() OVER (PARTITION BY source_log ORDER BY event_id) AS rk,
  count(*) OVER (PARTITION BY source_log) AS n FROM v_lines)
SELECT source_log,
  string_agg(CASE WHEN rk <= 12 THEN line END, chr(10) ORDER BY rk)
    || CASE WHEN max(n) > 12 THEN chr(10) || '... [tronqué à 12 lignes]' ELSE '' END AS preview_lines,
  left(string_agg(CASE WHEN rk <= 3001 THEN line END, chr(10) ORDER BY rk), 3000) AS preview_chars
FROM r GROUP BY source_log""", views=("v_lines",))
def s16_head_preview(spark, sf):
    return S.head_preview(T.v_lines(spark, sf), "source_log", "event_id")
