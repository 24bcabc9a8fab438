"""Registered queries: session memory and corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lookout.operators import normalize
from lookout.operators import retrieval as M
from lookout.operators.windows import top_k_per_group
from lookout.plans.catalog import register
from lookout.plans.events import UNIFIED_SQL, unified_events
from lookout.session import ensure_checkpoint_dir, scratch
from lookout.sources import tables as T
from lookout.plans.catalog import nullif_markers


def sessions(spark, sf):
    """One session per day: top-5 error addresses, anomaly and alarm counts."""
    b = T.v_base(spark, sf).withColumn("day", F.date_format(F.to_date("ts"), "yyyy-MM-dd"))
    err = b.where(F.col("event_type") == "error").groupBy("day", "ip").agg(F.count(F.lit(1)).alias("n"))
    top = top_k_per_group(err, ["day"], [F.desc("n"), F.asc("ip")], 5, rank_col="r")
    ips = top.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "ip"))),
                                             lambda x: x["ip"]).alias("ips"))
    counts = b.groupBy("day").agg(
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 100)).alias("nb_anomalies"),
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 300)).alias("nb_alarmes"))
    d = counts.join(ips, "day", "left").withColumn("ips", F.coalesce("ips", F.array().cast("array<string>")))
    return M.session_record(d, "day", F.col("ips"), F.col("nb_anomalies"), F.col("nb_alarmes"))


def flat(records):
    return records.select(F.col("s.date").alias("session_day"),
                          F.array_join("s.donnees.ips_suspectes", ",").alias("ips"),
                          F.col("s.donnees.nb_anomalies").alias("nb_anomalies"),
                          F.col("s.donnees.nb_alarmes").alias("nb_alarmes"))


SESS_SQL = """d0 AS (SELECT strftime(CAST(date_trunc('day', ts) AS DATE), '%Y-%m-%d') AS day, * FROM v_base),
e AS (SELECT day, ip, count(*) AS n FROM d0 WHERE event_type = 'error' GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, ip) <= 5),
sess AS (SELECT c.day AS session_day, coalesce((SELECT list(ip ORDER BY n DESC, ip) FROM e WHERE e.day = c.day), []) AS ips,
  c.nb_anomalies, c.nb_alarmes FROM (SELECT day,
    CAST(count(CASE WHEN event_type = 'error' AND value > 100 THEN 1 END) AS BIGINT) AS nb_anomalies,
    CAST(count(CASE WHEN event_type = 'error' AND value > 300 THEN 1 END) AS BIGINT) AS nb_alarmes FROM d0 GROUP BY day) c)"""

M1_SQL = f"WITH {SESS_SQL} SELECT session_day, array_to_string(ips, ',') AS ips, nb_anomalies, nb_alarmes FROM sess"


@register("m1_session_records", M1_SQL, views=("v_base",))
def m1_session_records(spark, sf):
    return flat(sessions(spark, sf))


@register("s7_session_history_scan", M1_SQL, views=("v_base",))
def s7_session_history_scan(spark, sf):
    """Round trip: append the records as JSON in the shared folder, read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sessions-{uuid.uuid4().hex}"
    M.append_sessions(sessions(spark, sf), path)
    back = M.read_sessions(spark, path)
    return flat(back.select(F.struct("*").alias("s")))


@register("s7_nested_document", M1_SQL, views=("v_base",))
def s7_nested_document(spark, sf):
    """Round trip of the whole-document form: one JSON document of all sessions, read back and exploded."""
    path = scratch(spark, "document")
    doc = sessions(spark, sf).agg(F.collect_list("s").alias("sessions"))  # the form is one document
    doc.withColumn("anomalies_vues", F.array().cast("array<string>")).coalesce(1).write.json(path)
    return flat(M.read_sessions(spark, path, nested_file=True).select(F.struct("*").alias("s")))


@register("m2_latest_context", f"""WITH {SESS_SQL},
u AS (SELECT session_day, unnest(ips) AS ip, generate_subscripts(ips, 1) AS pos FROM sess),
f AS (SELECT ip, min(session_day) AS d, arg_min(pos, (session_day, pos)) AS p FROM u GROUP BY ip)
SELECT CAST(least(count(*), 50) AS BIGINT) AS n_sessions,
  coalesce((SELECT string_agg(ip, ', ' ORDER BY d, p) FROM f), '') AS ips_connues, max(session_day) AS derniere_analyse
FROM sess""", views=("v_base",))
def m2_latest_context(spark, sf):
    return M.latest_context(sessions(spark, sf).select("s.*"))


CORPUS_COLS = ["timestamp", "source_ip", "type_event", "severite", "statut", "detail", "source_log"]


def corpus_rows(spark, sf):
    return normalize.null_markers(unified_events(spark, sf).select("event_id", *CORPUS_COLS))


def _text_sql():
    prio = ["source_ip", "timestamp"]
    order = prio + [c for c in CORPUS_COLS if c not in prio]
    parts = [f"CASE WHEN {c} IS NOT NULL AND trim({c}) NOT IN ('', 'nan', 'None') THEN '{c}: ' || {c} END" for c in order]
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), ' | ')"


CORPUS_SQL = f"""{UNIFIED_SQL},
cr AS (SELECT event_id, {', '.join(nullif_markers(c) + ' AS ' + c for c in CORPUS_COLS)} FROM ue),
ct AS (SELECT event_id, {_text_sql()} AS text, source_ip, timestamp FROM cr)"""


@register("m3_row_text", f"WITH {CORPUS_SQL} SELECT event_id, text FROM ct", views=("v_lines",))
def m3_row_text(spark, sf):
    rows = corpus_rows(spark, sf)
    return rows.select("event_id", M.row_text(rows, CORPUS_COLS).alias("text"))


@register("m4_content_ids", f"WITH {CORPUS_SQL} SELECT DISTINCT md5(text) AS doc_id, text FROM ct", views=("v_lines",))
def m4_content_ids(spark, sf):
    return M.build_corpus(corpus_rows(spark, sf), CORPUS_COLS).select("doc_id", "text")


M5_SQL = f"""WITH {CORPUS_SQL} SELECT DISTINCT md5(text) AS doc_id, 'UNKNOWN' AS event_type, coalesce(source_ip, 'nan') AS source_ip,
  '' AS log_source, coalesce(timestamp, 'nan') AS timestamp, '' AS status FROM ct"""


@register("m5_metadata", M5_SQL, views=("v_lines",))
def m5_metadata(spark, sf):
    c = M.build_corpus(corpus_rows(spark, sf), CORPUS_COLS)
    return c.select("doc_id", "event_type", "source_ip", "log_source", "timestamp", "status")


@register("m6_corpus_rebuild", M5_SQL, views=("v_lines",))
def m6_corpus_rebuild(spark, sf):
    """Overwrite the corpus table twice (rebuild is idempotent), read it back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    c = M.build_corpus(corpus_rows(spark, sf), CORPUS_COLS)
    M.write_corpus(c, path)
    M.write_corpus(c, path)
    back = spark.read.parquet(path)
    return back.select("doc_id", "event_type", "source_ip", "log_source", "timestamp", "status")


@register("m7_nearest3", """WITH q AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT qid, vec_id, list_sum(list_transform(range(1, len(embedding) + 1),
  lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(qe[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(qe[i] AS DOUBLE)))) AS dist
  FROM embeddings CROSS JOIN q)
SELECT qid, vec_id, round_even(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM d) WHERE rank <= 3""")
def m7_nearest3(spark, sf):
    e = T.table(spark, sf, "embeddings")
    queries = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    res = M.nearest(e, queries, 3)
    return res.select("qid", "vec_id", F.bround("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))
