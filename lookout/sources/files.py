"""File sources and sinks.

* CSV scans group files by header line: a single CSV read over files with
  different headers assigns values by position. Headers are found with one
  distributed pass (first line of each file); only the (file, header) list,
  one row per file, reaches the driver to issue one read per header.
* File names come from ``_metadata`` (no per-row UDF); listings use the
  ``binaryFile`` source with the content column pruned.
* Sinks are plain DataFrameWriter calls: partitioned raw zone, appended
  runs, overwritten "latest", versioned snapshots, keyed JSON reports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.functions.text import strip
from lookout.operators.metrics import source_type_severity
from lookout.sources import sinks


#: header line, a quote inside a quoted field doubled, blanks kept as they are: for reading and writing
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def file_path() -> Column:
    return F.col("_metadata.file_path")


def dataset_name(path: Column, prefix: str = "dataset_") -> Column:
    """Name of the 'dataset_<name>.csv' path component (file or folder)."""
    return F.regexp_extract(path, rf"{prefix}([^/]*?)(\.csv)?(/|$)", 1)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length) of every file under ``path``; content is not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "length", "modificationTime")


def file_headers(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """First line of every file (one row per file)."""
    lines = (spark.read.text(paths).where(F.col("_metadata.file_block_start") == 0)
             .select(file_path().alias("file"), "value", F.monotonically_increasing_id().alias("_i")))
    return lines.groupBy("file").agg(F.min_by("value", "_i").alias("header"))


def scan_csv_by_header(spark: SparkSession, paths: list[str] | str, provenance: bool = True,
                       multi_line: bool = False) -> DataFrame:
    """S1 + S2 + S3: read every CSV file under its own header, tag each row
    with ``Serveur = 'server_' + dataset name`` and union by name. Quotes in
    quoted fields are doubled, as pandas writes them; ``multi_line`` also
    reads fields with line breaks, at the price of one split per file."""
    heads = file_headers(spark, paths).collect()  # one row per file
    groups: dict[str, list[str]] = {}
    for r in heads:
        groups.setdefault(r["header"], []).append(r["file"])
    frames = []
    for files in groups.values():
        df = spark.read.options(**CSV).option("mode", "PERMISSIVE").option("multiLine", multi_line).csv(sorted(files))
        if provenance:
            df = df.withColumn("Serveur", F.concat(F.lit("server_"), dataset_name(file_path())))
        frames.append(df)
    if not frames:
        raise FileNotFoundError(f"no CSV file under {paths}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_lines(spark: SparkSession, path: str, source_of: Column | None = None) -> DataFrame:
    """Raw lines of a log folder with their source name; a missing folder
    gives an empty frame with the same schema."""
    try:
        df = spark.read.text(path)
    except Exception as e:  # missing source: empty, not an error
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        return spark.createDataFrame([], "source_log string, line string")
    src = source_of if source_of is not None else F.col("_metadata.file_name")
    return df.select(src.alias("source_log"), F.col("value").alias("line"))


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """Structured Linux-log CSV with an explicit schema."""
    schema = "Month string, Date int, Time string, Component string, Content string, EventId string"
    return spark.read.options(**CSV).schema(schema).csv(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Event templates (EventId, EventTemplate); whitespace is kept as written."""
    return spark.read.options(**CSV).schema("EventId string, EventTemplate string").csv(path)


def corpus_files(spark: SparkSession, path: str) -> DataFrame:
    """CSV files whose name holds 'dataset_' or 'latest_logs', unioned
    (header groups) and deduplicated on the full row (U1)."""
    listing = list_files(spark, path, "*.csv").select("path")
    keep = listing.where(F.col("path").contains("dataset_") | F.col("path").contains("latest_logs"))
    paths = [r["path"] for r in keep.collect()]  # file list, one row per file
    return scan_csv_by_header(spark, paths, provenance=False).dropDuplicates()


# ------------------------------------------------------------------ sinks

EVENT_DDL = "timestamp string, source_ip string, type_event string, severite string, statut string, detail string, source_log string"


def write_raw_zone(lines: DataFrame, path: str, run_id: str) -> None:
    """A run's raw lines, partitioned by ingest date and source (empty sources produce no partition)."""
    sinks.publish(lines.select("ingest_date", "source_log", "line"), path, run_id, ("ingest_date", "source_log"))


def read_raw_zone(spark: SparkSession, path: str) -> DataFrame:
    return sinks.read_runs(spark, path, "line string, ingest_date string, source_log string")


def write_processed(events: DataFrame, path: str, run_id: str) -> None:
    """The run's dataset and its counts by source, type and severity.

    The counts are taken from the staged dataset, so that the events are derived
    once, and both are marked after both stand. ``latest`` is the run marked
    last, not a second copy.
    """
    spark = events.sparkSession
    attempt = sinks.stage(events, f"{path}/datasets")
    staged = spark.read.schema(events.schema).parquet(f"{path}/datasets/data/attempt={attempt}")
    counts = sinks.stage(source_type_severity(staged), f"{path}/stats")
    sinks.mark(spark, f"{path}/datasets", run_id, attempt)
    sinks.mark(spark, f"{path}/stats", run_id, counts)


def write_results(clean: DataFrame, summaries: dict, path: str) -> None:
    """The clean events, and result tables as CSV with header (one folder per table).

    ``summaries`` maps a name to a function of the events; all of them read the
    events as written, which are derived once and kept on no executor.
    """
    clean.write.mode("overwrite").parquet(f"{path}/logs_clean")
    back = clean.sparkSession.read.schema(clean.schema).parquet(f"{path}/logs_clean")
    for name, summary in summaries.items():
        summary(back).write.mode("overwrite").options(**CSV).csv(f"{path}/{name}")


def write_snapshot(df: DataFrame, path: str, name: str, run_ts: str) -> None:
    """One run of a table's history; the current copy is the run marked last."""
    sinks.publish(df, f"{path}/{name}", run_ts)


def write_reports(df: DataFrame, key_col: str, path: str, run_id: str) -> None:
    """A run's JSON records, partitioned by report key; reports of other runs stay."""
    sinks.publish(df, path, run_id, (key_col,), "json")


# ------------------------------------------------------------------ S13, S14, J5

def file_manifest(spark: SparkSession, path: str, name: Column | None = None, max_bytes: int = 1 << 30) -> DataFrame:
    """(name, size, md5) of the files under ``path``.

    A file's content is one row, so files above ``max_bytes`` are not read: they
    are listed by name and size with a null md5. The length filter reaches the
    scan, which opens only the other files.
    """
    named = (name if name is not None else F.regexp_extract("path", r"([^/]+)$", 1)).alias("name")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = f.where(F.col("length") <= max_bytes).select(named, F.col("length").alias("size"), F.md5("content").alias("md5"))
    large = f.where(F.col("length") > max_bytes).select(named, F.col("length").alias("size"), F.lit(None).cast("string").alias("md5"))
    return read.unionByName(large)


def compare_manifests(source: DataFrame, target: DataFrame, key: str = "name") -> DataFrame:
    """Full outer join of two manifests; OK when hashes agree, and (as
    the reference does) when the target cannot be verified (missing md5)."""
    s = source.select(key, F.col("md5").alias("md5_source"), F.col("size").alias("size"))
    t = target.select(key, F.col("md5").alias("md5_target"))
    j = s.join(t, key, "full")
    verdict = (F.when(F.col("md5_source").isNull(), "EXTRA")
               .when(F.col("md5_target").isNull(), "OK_NON_VERIFIE")
               .when(F.col("md5_source") == F.col("md5_target"), "OK").otherwise("ECHEC"))
    return j.withColumn("statut", verdict)


def transfer_report(manifest: DataFrame) -> DataFrame:
    """Totals over the compared manifest (details are its rows)."""
    ok = F.col("statut").isin("OK", "OK_NON_VERIFIE")
    return manifest.agg(F.count(F.lit(1)).cast("bigint").alias("nb_fichiers"),
                        F.count_if(ok).cast("bigint").alias("nb_ok"),
                        F.count_if(~ok).cast("bigint").alias("nb_echec"),
                        F.bround(F.sum("size") / 1024.0, 1).alias("taille_totale_ko"))


# ------------------------------------------------------------------ S16

def head_preview(lines: DataFrame, key: str, order: str, line_col: str = "line",
                 n_lines: int = 12, n_chars: int = 3000) -> DataFrame:
    """Per file, the first ``n_lines`` lines (+ truncation marker) and
    the first ``n_chars`` characters. Only the first ``n_chars`` lines of a
    file can reach those characters, so both come from a rank-limited head."""
    from lookout.operators.windows import top_k_per_group
    head = top_k_per_group(lines, [key], [F.asc(order)], max(n_lines, n_chars) + 1, rank_col="_r")
    agg = head.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(line_col).alias("l")))).alias("_h"))
    total = lines.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    first = F.transform(F.slice("_h", 1, n_lines), lambda x: x["l"])
    text = F.array_join(F.transform("_h", lambda x: x["l"]), "\n")
    return agg.join(total, key).select(
        key,
        F.concat(F.array_join(first, "\n"),
                 F.when(F.col("_n") > n_lines, F.lit(f"\n... [tronqué à {n_lines} lignes]")).otherwise(F.lit("")))
        .alias("preview_lines"),
        F.left(text, F.lit(n_chars)).alias("preview_chars"))
