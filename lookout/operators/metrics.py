"""Group summaries over canonical events (A1-A10).

All are single grouping sets; Spark runs them as partial (map-side) +
final hash aggregation, so a hot key (one address holding a third of the
rows) costs one partial row per map task, not a skewed reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.config import SEV_CRITICAL


def errors_per_hour(df: DataFrame) -> DataFrame:
    """A1: count of Etat='Error' rows per hour floor."""
    return (df.where(F.col("Etat") == "Error")
            .groupBy(F.date_trunc("hour", "Date").alias("Heure"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("Nombre_Erreurs")))


def attempts_per_ip(df: DataFrame) -> DataFrame:
    """A2: all rows per non-null address (named ``Nombre_Tentatives``)."""
    return (df.where(F.col("IP_Source").isNotNull())
            .groupBy("IP_Source")
            .agg(F.count(F.lit(1)).cast("bigint").alias("Nombre_Tentatives")))


def events_per_service(df: DataFrame) -> DataFrame:
    """A3: rows per service."""
    return df.groupBy("Service").agg(F.count(F.lit(1)).cast("bigint").alias("Nombre_Events"))


def ip_features(df: DataFrame, order_col: str = "event_id") -> DataFrame:
    """A4: per-address error count (``Nombre_Tentatives``, errors only) and
    the first Date in input order (``min_by`` on a line order, never ``first``)."""
    return (df.where(F.col("IP_Source").isNotNull())
            .groupBy("IP_Source")
            .agg(F.count_if(F.col("Etat") == "Error").cast("bigint").alias("Nombre_Tentatives"),
                 F.min_by("Date", order_col).alias("Date")))


def source_type_severity(df: DataFrame) -> DataFrame:
    """A5: counts by (source, type, severity)."""
    return (df.groupBy("source_log", "type_event", "severite")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def top_event_types(df: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent event types (ties by name)."""
    return (df.groupBy("type_event").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .orderBy(F.desc("n"), F.asc("type_event")).limit(k))


def most_active_ip(df: DataFrame) -> DataFrame:
    """The address with most rows, 'N/A' excluded (ties: smallest address)."""
    counts = (df.where((F.col("source_ip") != "N/A") & F.col("source_ip").isNotNull())
              .groupBy("source_ip").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    return counts.orderBy(F.desc("n"), F.asc("source_ip")).limit(1)


def run_summary(df: DataFrame) -> DataFrame:
    """Total events and critical events of the run."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                  F.count_if(F.col("severite") == SEV_CRITICAL).cast("bigint").alias("critical"))


def state_distribution(df: DataFrame) -> DataFrame:
    """Rows per Etat."""
    return df.groupBy("Etat").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def server_summary(df: DataFrame) -> DataFrame:
    """Distinct servers and their sorted, comma-joined list.

    Two-level: distinct first (bounded by the number of servers), then one
    row; the set is the bounded server list, not the event rows.
    """
    servers = df.select("Serveur").where(F.col("Serveur").isNotNull()).distinct()
    return servers.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_servers"),
        F.array_join(F.array_sort(F.collect_list("Serveur")), ",").alias("servers"))


def score_summary(scored: DataFrame) -> DataFrame:
    """A10: counts per alert level and score mean / max (unrounded score)."""
    s = F.col("score_raw")
    return scored.agg(
        F.count_if(s >= 0.7).cast("bigint").alias("n_critique"),
        F.count_if((s >= 0.5) & (s < 0.7)).cast("bigint").alias("n_anomalie"),
        F.count_if((s >= 0.3) & (s < 0.5)).cast("bigint").alias("n_suspect"),
        F.count_if(s < 0.3).cast("bigint").alias("n_normal"),
        F.avg(s).alias("score_mean"),
        F.max(s).alias("score_max"))
