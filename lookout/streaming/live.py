"""Live counters (L1-L9) as batch twins and as Structured Streaming jobs.

Batch twin: counters over the last 500 lines of every log file (a rank
limit per file, applied before the shuffle), one KPI record per poll.

Stream: a file-source stream counts every line once per event-time window
(4-hour tumbling windows). ``AvailableNow`` processes what has arrived and
stops, like the 4-hourly collection cycle; progress lives in the checkpoint
folder, so a restarted or retried run resumes without double counting. Each
micro-batch overwrites its own partition of partial counts, so a replay is
idempotent, and readers sum the partitions, so late files lose no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.config import LIVE_FILES, LIVE_SOURCES, TAIL_LINES
from lookout.functions.text import col
from lookout.operators.windows import recent_lines, tail

IPV4_AFTER_FROM = r"from (\d+\.\d+\.\d+\.\d+)"
IPV4_AFTER_BAN = r"Ban (\d+\.\d+\.\d+\.\d+)"


def live_source(source_log) -> Column:
    """Which live file a line belongs to, by file name; null for any other file."""
    s, out = col(source_log), F.lit(None).cast("string")
    for name, src in LIVE_FILES.items():
        out = F.when(s == name, src).otherwise(out)
    return out


def _cnt(cond: Column, name: str) -> Column:
    return F.count_if(cond).cast("bigint").alias(name)


def counter_columns(src: Column, line: Column) -> list[Column]:
    """L1-L3 counters as conditional counts (partial aggregation)."""
    auth, sysl, kern = src == "auth", src == "syslog", src == "kernel"
    low = F.lower(line)
    return [
        _cnt(auth & line.contains("Failed password"), "tentatives_ssh"),
        _cnt(auth & line.contains("Accepted password"), "connexions_ok"),
        _cnt(auth & line.contains("sudo"), "sudo_cmds"),
        _cnt(auth & line.contains("Invalid user"), "invalid_user"),
        _cnt(auth & line.contains("root") & line.contains("Failed"), "tentatives_root"),
        _cnt(sysl & low.contains("error"), "erreurs_sys"),
        _cnt(sysl & low.contains("warning"), "warnings_sys"),
        _cnt(sysl & line.contains("Out of memory"), "oom_killer"),
        _cnt(kern & low.contains("error"), "erreurs_kernel"),
        _cnt(kern & low.contains("panic"), "panics_kernel"),
    ]


def tails(lines: DataFrame, line_no: str = "event_id", n: int = TAIL_LINES) -> DataFrame:
    """W1 over the live files: last ``n`` lines of each."""
    keyed = lines.withColumn("src", live_source("source_log")).where(F.col("src").isNotNull())
    return tail(keyed, "src", line_no, n)


def counters(t: DataFrame) -> DataFrame:
    """L1-L3 on the tails (one row)."""
    return t.agg(*counter_columns(F.col("src"), F.col("line")))


def banned_ips(t: DataFrame) -> DataFrame:
    """L4: distinct addresses after 'Ban ' in the fail2ban tail."""
    f = t.where(F.col("src") == "fail2ban")
    return f.select(F.explode(F.regexp_extract_all("line", F.lit(IPV4_AFTER_BAN), F.lit(1))).alias("ip")).distinct()


def from_ips(t: DataFrame) -> DataFrame:
    a = t.where(F.col("src") == "auth")
    return a.select(F.explode(F.regexp_extract_all("line", F.lit(IPV4_AFTER_FROM), F.lit(1))).alias("ip"))


def lines_per_source(t: DataFrame) -> DataFrame:
    """Tail sizes for the fixed source list, zero when a file is absent."""
    fixed = t.sparkSession.createDataFrame([(s,) for s in LIVE_SOURCES], "src string")
    got = t.groupBy("src").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return fixed.join(got, "src", "left").select("src", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def kpi_record(lines: DataFrame, line_no: str = "event_id", as_of: Column | None = None) -> DataFrame:
    """One KPI row: ``timestamp`` (``as_of``, else now), counters, distinct
    and banned addresses, top 10 'from' addresses with their counts, lines read
    per source, last 10 events.

    Every list in the record is bounded (top 10, last 10, fixed sources);
    the banned list is bounded by the 500-line tail. Without lines the counters
    are 0 and the lists empty."""
    from lookout.session import cut_lineage
    t = cut_lineage(tails(lines, line_no))  # at most 500 lines per file, read by every part below
    ips = from_ips(t)
    top = ips.groupBy("ip").agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy(F.desc("count"), F.asc("ip")).limit(10)
    ranked = F.array_sort(F.collect_list(F.struct(F.negative("count").alias("k"), "ip", "count")))
    top = top.agg(F.transform(ranked, lambda x: F.struct(x["ip"].alias("ip"), x["count"].alias("count"))).alias("v")).scalar()
    banned = banned_ips(t).agg(F.array_sort(F.collect_list("ip")).alias("v")).scalar()
    n_ips = ips.agg(F.count_distinct("ip").cast("bigint").alias("v")).scalar()
    per = lines_per_source(t).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", "n")))).alias("v")).scalar()
    last = recent_lines(t.withColumn("source_log", F.col("src")), ["auth", "syslog"], "source_log", line_no,
                        tail_n=TAIL_LINES)
    last = last.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("v")).scalar()
    now = as_of if as_of is not None else F.current_timestamp()
    return counters(t).select(now.alias("timestamp"), "*", top.alias("top_ips_suspectes"), banned.alias("ips_bannies"),
                              n_ips.alias("nb_ips_uniques"), per.alias("nb_logs_lus"), last.alias("derniers_events"))


def flat_record(record: DataFrame) -> DataFrame:
    """The record with its lists as text, one line of a CSV file."""
    pairs = F.transform("top_ips_suspectes", lambda x: F.concat(x["ip"], F.lit(":"), x["count"].cast("string")))
    logs = F.transform(F.array_sort(F.map_entries("nb_logs_lus")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return record.withColumns({"top_ips_suspectes": F.array_join(pairs, ","), "ips_bannies": F.array_join("ips_bannies", ","),
                               "nb_logs_lus": F.array_join(logs, ","), "derniers_events": F.array_join("derniers_events", "\n")})


def record_lists(record: DataFrame) -> DataFrame:
    """The record's lists as rows: ``timestamp``, ``part``, ``pos`` (from 1), ``value``, ``n`` (null for plain lists)."""
    none = F.lit(None).cast("bigint")
    entry = lambda value, n: F.struct(value.alias("value"), n.alias("n"))
    parts = {"top_ips_suspectes": F.transform("top_ips_suspectes", lambda x: entry(x["ip"], x["count"])),
             "ips_bannies": F.transform("ips_bannies", lambda x: entry(x, none)),
             "nb_logs_lus": F.transform(F.array_sort(F.map_entries("nb_logs_lus")), lambda x: entry(x["key"], x["value"])),
             "derniers_events": F.transform("derniers_events", lambda x: entry(x, none))}
    named = F.array(*[F.struct(F.lit(name).alias("part"), rows.alias("rows")) for name, rows in parts.items()])
    return record.select("timestamp", F.explode(named).alias("p")).select("timestamp", "p.part", F.posexplode("p.rows").alias("pos", "row")) \
        .select("timestamp", "part", (F.col("pos") + 1).cast("bigint").alias("pos"), "row.value", "row.n")


# ------------------------------------------------------------------ L8, L9

def four_hour_counts(df: DataFrame, ts_col: str = "ts", keys: list[str] | None = None,
                     width: str = "4 hours") -> DataFrame:
    """L8 batch twin: tumbling event-time windows (a TIMESTAMP_NTZ column is
    windowed as is, so the result does not depend on the session time zone)."""
    keys = keys or ["source_log"]
    return (df.groupBy(F.window(F.col(ts_col), width).alias("w"), *keys)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .select(F.col("w.start").alias("window_start"), *keys, "n"))


def recent_window(df: DataFrame, ts_col: str, hours: int = 24, as_of: Column | None = None,
                  min_rows: int = 5) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of`` (default: newest row);
    all rows when fewer than ``min_rows`` are that recent."""
    ts = F.col(ts_col).cast("timestamp")
    ref = as_of if as_of is not None else df.agg(F.max(ts).alias("m")).scalar()
    start = ref - F.expr(f"INTERVAL {int(hours)} HOURS")
    n_recent = df.where(ts >= start).agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.where((ts >= start) | (n_recent < min_rows))


# ------------------------------------------------------------------ streaming

def start_window_counts(spark, source_path: str, schema: str, sink_path: str, checkpoint: str,
                        ts_col: str = "ts", keys: list[str] | None = None, width: str = "4 hours",
                        available_now: bool = True):
    """L8 stream: every micro-batch's tumbling counts go to a partition of
    their own; ``read_window_counts`` sums them. A line counts in its window
    however late its file arrives, and no state is held between batches.
    Returns the StreamingQuery."""
    stream = spark.readStream.schema(schema).parquet(source_path)

    def store(batch: DataFrame, batch_id: int) -> None:
        counts = four_hour_counts(batch, ts_col, keys, width).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id") \
            .parquet(sink_path)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_window_counts(spark, sink_path: str, keys: list[str] | None = None) -> DataFrame:
    """Totals by window and key over all micro-batches stored so far."""
    return spark.read.parquet(sink_path).groupBy("window_start", *(keys or ["source_log"])) \
        .agg(F.sum("n").cast("bigint").alias("n"))


def start_counters_stream(spark, source_path: str, schema: str, sink_path: str, checkpoint: str,
                          available_now: bool = True):
    """L1-L3 + L6 as a stream: every line counted once (running totals).

    A global aggregation keeps one row of state; complete mode re-emits that
    row each micro-batch and ``foreachBatch`` overwrites the KPI table, so a
    replayed batch leaves the same result."""
    stream = spark.readStream.schema(schema).parquet(source_path)
    src = live_source("source_log")
    keyed = stream.select(src.alias("src"), "line").where(F.col("src").isNotNull())
    per_source = [F.count_if(F.col("src") == s).cast("bigint").alias(f"lus_{s}") for s in LIVE_SOURCES]
    kpi = keyed.agg(*counter_columns(F.col("src"), F.col("line")), *per_source)

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(sink_path)

    w = kpi.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def _first_seen(rows: DataFrame, keys: list[str], hold: str) -> DataFrame:
    """Rows of a stream whose keys were not seen within ``hold``, by arrival.

    The watermark follows the time of arrival, so no row counts as late, however
    old its line; a key's state goes once ``hold`` has passed since the key was
    emitted. A key that comes back later is emitted again.
    """
    return rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", hold) \
        .dropDuplicatesWithinWatermark(keys).drop("_arrived")


def _start_append(rows: DataFrame, sink_path: str, checkpoint: str, available_now: bool):
    w = rows.writeStream.outputMode("append").format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def start_banned_stream(spark, source_path: str, schema: str, sink_path: str, checkpoint: str,
                        available_now: bool = True, hold: str = "7 days"):
    """L4 as a stream: banned addresses, each at most once within ``hold``.
    State holds the addresses of that time only; ``read_banned`` gives the whole set."""
    stream = spark.readStream.schema(schema).parquet(source_path)
    bans = (stream.where(live_source("source_log") == "fail2ban")
            .select(F.explode(F.regexp_extract_all("line", F.lit(IPV4_AFTER_BAN), F.lit(1))).alias("ip")))
    return _start_append(_first_seen(bans, ["ip"], hold), sink_path, checkpoint, available_now)


def read_banned(spark, sink_path: str) -> DataFrame:
    """L4: the distinct addresses the stream has stored so far."""
    return spark.read.schema("ip string").parquet(sink_path).distinct()


def start_distinct_stream(spark, source_path: str, schema: str, sink_path: str, checkpoint: str, ts_col: str = "ts",
                          width: str = "1 day", available_now: bool = True, hold: str = "7 days"):
    """L5 as a stream: the 'from' addresses of each event-time window, each at most once
    within ``hold``; ``read_distinct_counts`` counts them. Late files lose no address."""
    stream = spark.readStream.schema(schema).parquet(source_path)
    seen = stream.where(live_source("source_log") == "auth").select(
        F.window(F.col(ts_col), width)["start"].alias("window_start"),
        F.explode(F.regexp_extract_all("line", F.lit(IPV4_AFTER_FROM), F.lit(1))).alias("ip"))
    return _start_append(_first_seen(seen, ["window_start", "ip"], hold), sink_path, checkpoint, available_now)


def read_distinct_counts(spark, sink_path: str, ts_type: str = "timestamp_ntz") -> DataFrame:
    """Distinct addresses by window over all that the stream has stored so far."""
    return spark.read.schema(f"window_start {ts_type}, ip string").parquet(sink_path) \
        .groupBy("window_start").agg(F.count_distinct("ip").cast("bigint").alias("nb_ips_uniques"))


def window_distinct(t: DataFrame, ts_col: str = "ts", width: str = "1 day") -> DataFrame:
    """L5's batch twin: distinct 'from' addresses of the auth lines by window; a window without any has no row."""
    seen = t.where(live_source("source_log") == "auth").select(
        F.window(F.col(ts_col), width)["start"].alias("window_start"),
        F.explode(F.regexp_extract_all("line", F.lit(IPV4_AFTER_FROM), F.lit(1))).alias("ip"))
    return seen.groupBy("window_start").agg(F.count_distinct("ip").cast("bigint").alias("nb_ips_uniques"))
