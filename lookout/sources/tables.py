"""Parquet table access and the binding views of the test tables.

The binding views turn the generic test tables into the inputs the log
operators expect (raw log lines, wire-schema rows, per-address features,
payloads, rule groups). They are narrow projections over ``events`` /
``part``: no shuffle, so they cost one scan and grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def v_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 4).cast("string"), F.lit("."),
                  F.floor(F.col("value") / 10).cast("int").cast("string"))
    return ev.select("event_id", "ts", "event_type", "value", ip.alias("ip"))


_LINE_CASE = """
CASE event_type
 WHEN 'error' THEN CASE event_id % 6
   WHEN 0 THEN 'sshd: Accepted password for u from ' || ip || ' port 22 ssh2'
   WHEN 1 THEN 'sshd: Invalid user admin from ' || ip || ' port 22'
   WHEN 2 THEN 'sudo: ops : TTY=pts/0 ; USER=root ; COMMAND=/bin/ls'
   WHEN 3 THEN 'fail2ban: NOTICE [sshd] Ban ' || ip
   ELSE 'sshd: Failed password for root from ' || ip || ' port 22 ssh2' END
 WHEN 'click' THEN ip || ' - - "GET /p/' || CAST(event_id % 97 AS STRING) || ' HTTP/1.1" '
   || CASE event_id % 4 WHEN 0 THEN '404' WHEN 1 THEN '500' ELSE '200' END || ' 512 "-" "'
   || CASE event_id % 7 WHEN 0 THEN 'gobuster/3.6' WHEN 1 THEN 'Nmap Scripting Engine' ELSE 'Mozilla/5.0' END || '"'
 WHEN 'view' THEN CASE event_id % 7
   WHEN 0 THEN 'app: ERROR disk full' WHEN 1 THEN 'app: warning slow io' WHEN 2 THEN 'CRON[1]: job'
   WHEN 3 THEN 'systemd: Started unit' WHEN 4 THEN 'kernel: Out of memory: Killed process 9'
   WHEN 5 THEN '   ' ELSE 'app: ok' END
 WHEN 'purchase' THEN CASE event_id % 6
   WHEN 0 THEN '[UFW BLOCK] IN=eth0 SRC=' || ip || ' DST=10.0.0.1' WHEN 1 THEN 'kernel: Out of memory: Killed process 7'
   WHEN 2 THEN 'kernel: I/O error dev sda' WHEN 3 THEN 'kernel: port scan detected'
   WHEN 4 THEN 'Kernel panic - not syncing' ELSE 'kernel: usb 1-1 new device' END
 ELSE CASE event_id % 4
   WHEN 0 THEN 'nginx.service: Failed with result exit-code' WHEN 1 THEN 'Started session'
   WHEN 2 THEN 'Stopped session' ELSE 'ssh.service reload' END END
"""

_SOURCE_CASE = """
CASE event_type WHEN 'error' THEN 'auth.log' WHEN 'click' THEN 'apache2_access.log'
 WHEN 'view' THEN 'syslog' WHEN 'purchase' THEN 'kern.log' ELSE 'journald' END
"""


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v_base(spark, sf_dir)
    return b.select("event_id", "ts", "ip", F.expr(_SOURCE_CASE).alias("source_log"),
                    F.expr(_LINE_CASE).alias("line"))


def v_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v_base(spark, sf_dir)
    eid = F.col("event_id")
    return b.select(
        "event_id",
        F.when(eid % 53 == 0, F.lit("bad-date"))
         .otherwise(F.date_trunc("second", "ts").cast("string")).alias("ts_text"),
        F.when(eid % 20 == 0, F.lit("N/A")).otherwise(F.col("ip")).alias("source_ip"),
        F.expr("""CASE event_id % 8 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARNING'
          WHEN 3 THEN '404' WHEN 4 THEN 'BLOCKED' WHEN 5 THEN 'CRITICAL' WHEN 6 THEN 'N/A'
          ELSE 'SUCCESS' END""").alias("statut"),
        F.expr("""CASE event_id % 5 WHEN 0 THEN 'CRITIQUE' WHEN 1 THEN 'high' WHEN 2 THEN 'medium'
          WHEN 3 THEN 'AVERTISSEMENT' ELSE 'INFO' END""").alias("severite"),
        F.col("event_type").alias("type_event"),
        F.concat(F.lit("server_"), (eid % 3).cast("string")).alias("serveur"),
    )


def v_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_base(spark, sf_dir).groupBy("ip").agg(
        F.count(F.lit(1)).cast("bigint").alias("attempts"),
        F.count(F.when(F.col("event_type") == "error", 1)).cast("bigint").alias("errors"),
        F.min("ts").alias("first_ts"))


def v_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attempts")
    return v_ip(spark, sf_dir).select(
        "ip", "attempts",
        F.when(a > 250, 1).otherwise(0).alias("v_if"),
        F.when(a > 180, 1).otherwise(0).alias("v_lof"),
        F.when((a > 100) | (a == 1), 1).otherwise(0).alias("v_svm"),
        F.when(a > 300, 1).otherwise(0).alias("v_db"),
        (a.cast("double") / 500).alias("cont"))


def v_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v_base(spark, sf_dir)
    day = F.date_trunc("day", "ts").cast("date")
    return b.groupBy(day.alias("session_day")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count(F.when(F.col("event_type") == "error", 1)).cast("bigint").alias("n_err"),
        F.avg("value").cast("double").alias("score"))


def v_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v_base(spark, sf_dir)
    return b.select("event_id", "ip", F.expr("""CASE event_id % 8
      WHEN 0 THEN '{"type":"BRUTE-FORCE SSH","severite":"CRITIQUE","ip":"' || ip || '","message":"m"}'
      WHEN 1 THEN '[{"type":"PORT SCAN","severite":"AVERTISSEMENT","ip":"' || ip || '","message":"m"}]'
      WHEN 2 THEN '{"type":"SURCHARGE CPU","severite":"AVERTISSEMENT","ip":"multiple"}'
      WHEN 3 THEN 'BRUTE force seen from ' || ip WHEN 4 THEN 'Aucune alarme critique'
      WHEN 5 THEN '{"type":"SURVEILLANCE_NORMALE","action":"MONITORING","ip":"none","severite":"FAIBLE"}'
      WHEN 6 THEN 'all quiet' ELSE '[]' END""").alias("payload"))


def v_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("rule_id"),
        F.concat(F.lit("grp-"), (k % 50).cast("string")).alias("grp"),
        F.when(k % 9 == 0, F.lit("-1")).otherwise(F.lit("tcp")).alias("proto"),
        F.col("p_size").alias("from_port"),
        (F.col("p_size") + (k % 40).cast("int")).alias("to_port"),
        F.concat(F.lit("10.0."), (k % 4).cast("string"), F.lit("."), (k % 49).cast("string"),
                 F.lit("/32")).alias("cidr"),
        (F.lit(50) + (k * 7) % 150).cast("int").alias("rule_number"),
        (k % 3 == 0).alias("egress"))
