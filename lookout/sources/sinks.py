"""Sinks that publish whole runs by a marker row.

A run's rows are written to a folder of their own attempt; only then is a marker
row (run, attempt, number) appended. Readers join the data with the newest marker
of each run, so a failed write changes nothing, a retried run replaces its rows,
also by none, and no copy has to be deleted before its successor stands.
Attempts that no marker points to any more are removed by ``sweep``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER_DDL = "run_id string, attempt string, number bigint"


def _all_markers(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MARKER_DDL).parquet(f"{path}/markers")
    except Exception as e:  # nothing published yet
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        return spark.createDataFrame([], MARKER_DDL)


def markers(spark: SparkSession, path: str) -> DataFrame:
    """``run_id``, ``attempt``, ``number``: the newest marker of each run."""
    newest = F.max_by(F.struct("attempt", "number"), F.struct("number", "attempt"))
    return _all_markers(spark, path).groupBy("run_id").agg(newest.alias("m")).select("run_id", "m.attempt", "m.number")


def stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> str:
    """Write one attempt; nobody reads it before it is marked. Returns its name."""
    attempt = uuid.uuid4().hex
    writer = df.write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{path}/data/attempt={attempt}")
    return attempt


def mark(spark: SparkSession, path: str, run_id: str, attempt: str) -> None:
    """Make an attempt the run's published rows."""
    number = (_all_markers(spark, path).agg(F.max("number").alias("n")).first()["n"] or 0) + 1
    spark.createDataFrame([(run_id, attempt, number)], MARKER_DDL).coalesce(1).write.mode("append").parquet(f"{path}/markers")


def publish(df: DataFrame, path: str, run_id: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """Stage and mark: the run's rows are then those of ``df``, none if it has none."""
    mark(df.sparkSession, path, run_id, stage(df, path, partition_by, fmt))


def read_runs(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet") -> DataFrame:
    """The published rows of all runs, with ``run_id``; attempts without a valid marker are pruned by the join."""
    marks = markers(spark, path)
    try:
        data = spark.read.schema(f"{ddl}, attempt string").format(fmt).load(f"{path}/data")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        data = spark.createDataFrame([], f"{ddl}, attempt string")
    return data.join(marks.select("attempt", "run_id"), "attempt").drop("attempt")


def read_latest(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet") -> DataFrame:
    """The rows of the run published last."""
    last = markers(spark, path).agg(F.max_by("run_id", F.struct("number", "attempt"))).scalar()
    return read_runs(spark, path, ddl, fmt).where(F.col("run_id") == last)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete attempts that a later marker of their run has replaced; call it when no reader or writer is at work. Returns how many."""
    valid = markers(spark, path).select("attempt")
    stale = [r["attempt"] for r in _all_markers(spark, path).select("attempt").join(valid, "attempt", "left_anti").collect()]  # names
    for attempt in stale:
        remove(spark, f"{path}/data/attempt={attempt}")
    return len(stale)
