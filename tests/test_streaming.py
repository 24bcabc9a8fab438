"""Stream = batch: incremental AvailableNow runs on one checkpoint."""

import tempfile

from pyspark.sql import functions as F

from lookout.plans.live import live_lines
from lookout.sources import tables as T
from lookout.streaming import live as L
from tests.conftest import SF_SMALL

SCHEMA = "ts timestamp_ntz, source_log string, line string"


def _sink(spark, path):
    return sorted(tuple(r) for r in L.read_window_counts(spark, path).select("window_start", "source_log", "n").collect())


def test_incremental_runs_equal_batch_and_replay_is_idempotent(spark):
    root = tempfile.mkdtemp(dir="/tmp")
    lines = T.v_lines(spark, SF_SMALL).select("ts", "source_log", "line")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    lines.where(F.col("ts") >= cut).write.parquet(f"{root}/in/a")

    def run():
        L.start_window_counts(spark, f"{root}/in/*", SCHEMA, f"{root}/out", f"{root}/ckpt").awaitTermination()

    run()
    first = _sink(spark, f"{root}/out")
    run()  # nothing new: same result
    assert _sink(spark, f"{root}/out") == first
    lines.where(F.col("ts") < cut).write.parquet(f"{root}/in/b")  # the older file comes late: no line is lost
    run()
    batch = L.four_hour_counts(lines).select("window_start", "source_log", "n")
    assert _sink(spark, f"{root}/out") == sorted(tuple(r) for r in batch.collect())


def test_counter_stream_equals_counts_over_all_lines(spark):
    root = tempfile.mkdtemp(dir="/tmp")
    lines = live_lines(spark, SF_SMALL).select("ts", "source_log", "line")
    lines.write.parquet(f"{root}/in/a")
    L.start_counters_stream(spark, f"{root}/in/*", SCHEMA, f"{root}/out", f"{root}/ckpt").awaitTermination()
    got = spark.read.parquet(f"{root}/out").first().asDict()
    keyed = lines.withColumn("src", L.live_source("source_log")).where(F.col("src").isNotNull())
    want = keyed.agg(*L.counter_columns(F.col("src"), F.col("line"))).first().asDict()
    assert {k: got[k] for k in want} == want


def test_live_files_are_known_by_name(spark):
    names = ["auth.log", "syslog.log", "kern.log", "fail2ban.log", "cron.log", "dpkg.log"]
    got = spark.createDataFrame([(n,) for n in names], "f string").select("f", L.live_source("f").alias("s")).collect()
    assert {r["f"]: r["s"] for r in got} == dict(zip(names, ["auth", "syslog", "kernel", "fail2ban", "cron", None]))


def test_distinct_stream_drops_expired_state_and_loses_no_late_address(spark):
    import time
    root = tempfile.mkdtemp(dir="/tmp")
    lines = live_lines(spark, SF_SMALL).select("ts", "source_log", "line")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")

    def run():
        q = L.start_distinct_stream(spark, f"{root}/in/*", SCHEMA, f"{root}/out", f"{root}/ckpt", hold="1 second")
        q.awaitTermination()
        return [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]

    lines.where(F.col("ts") >= cut).write.parquet(f"{root}/in/a")
    held = max(run())
    assert held > 0
    time.sleep(3)
    lines.where(F.col("ts") < cut).write.parquet(f"{root}/in/b")  # older lines, later
    run()
    time.sleep(3)
    lines.where("source_log = 'auth.log' AND line RLIKE 'from [0-9]+[.]'").limit(1).write.parquet(f"{root}/in/c")
    assert run()[-1] <= 1 < held  # at most the newest line is held, all else has expired
    got = L.read_distinct_counts(spark, f"{root}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, L.window_distinct(lines).collect()))


def test_record_of_no_lines_has_zero_counts_and_empty_lists(spark):
    empty = spark.createDataFrame([], "event_id long, ts timestamp_ntz, source_log string, line string")
    r = L.kpi_record(empty).first()
    assert r["timestamp"] is not None and r["tentatives_ssh"] == 0
    assert r["top_ips_suspectes"] == [] and r["ips_bannies"] == [] and r["derniers_events"] == []
    assert r["nb_ips_uniques"] == 0 and set(r["nb_logs_lus"].values()) == {0}
    assert L.flat_record(L.kpi_record(empty)).first()["top_ips_suspectes"] == ""
