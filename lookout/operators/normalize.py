"""Null markers, schema-adaptive canonical mapping, state classifiers.

Column presence is resolved on ``df.columns`` while the plan is built (never
per row); every mapping is a projection, so the whole normalisation stays in
the scan's codegen stage.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lookout.config import (DEFAULT_YEAR, MESSAGE_ERROR_WORDS, MESSAGE_WARNING_WORDS,
                            NULL_MARKERS, SEVERITY_ERROR_VALUES, SEVERITY_WARNING_VALUES,
                            STATUS_ERROR_WORDS, STATUS_WARNING_WORDS)
from lookout.functions.text import col, first_ipv4, lower_contains_any


def null_markers(df: DataFrame, cols: list[str] | None = None,
                 markers: list[str] = NULL_MARKERS) -> DataFrame:
    """Exact null-marker strings become null on every string column."""
    targets = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.when(F.col(c).isin(markers), None).otherwise(F.col(c))
                           for c in targets})


def state_from_status(c) -> Column:
    """Substring classifier on the lowered status text."""
    c = col(c)
    return (F.when(lower_contains_any(c, STATUS_ERROR_WORDS), "Error")
            .when(lower_contains_any(c, STATUS_WARNING_WORDS), "Warning")
            .otherwise("Info"))


def state_from_severity(c) -> Column:
    """Exact-value classifier on the lowered severity."""
    low = F.lower(col(c))
    return (F.when(low.isin(SEVERITY_ERROR_VALUES), "Error")
            .when(low.isin(SEVERITY_WARNING_VALUES), "Warning")
            .otherwise("Info"))


def state_from_message(c) -> Column:
    """Wider substring classifier for free-text messages."""
    c = F.coalesce(col(c).cast("string"), F.lit("none"))
    return (F.when(lower_contains_any(c, MESSAGE_ERROR_WORDS), "Error")
            .when(lower_contains_any(c, MESSAGE_WARNING_WORDS), "Warning")
            .otherwise("Info"))


def parse_ts(c) -> Column:
    """Lenient timestamp parse; invalid text -> null (ANSI-safe)."""
    return F.try_to_timestamp(col(c).cast("string"))


def canonicalize(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Map whichever source columns exist to Date / IP_Source / Etat /
    Service / Message (first present wins; defaults as_of / null / Info /
    unknown / '')."""
    cols = set(df.columns)
    if "Date" in cols:
        date = parse_ts("Date")
    elif "timestamp" in cols:
        date = parse_ts("timestamp")
    elif "DateTime" in cols:
        date = parse_ts("DateTime")
    else:
        date = F.lit(as_of or datetime.now()).cast("timestamp")

    if "IP_Source" in cols:
        ip = F.col("IP_Source")
    elif "source_ip" in cols:
        ip = F.col("source_ip")
    else:
        ip = F.lit(None).cast("string")

    if "Etat" in cols:
        etat = F.col("Etat")
    elif "statut" in cols:
        etat = state_from_status("statut")
    elif "severite" in cols:
        etat = state_from_severity("severite")
    else:
        etat = F.lit("Info")

    if "Service" in cols:
        service = F.col("Service")
    elif "source_log" in cols:
        service = F.col("source_log")
    elif "type_event" in cols:
        service = F.col("type_event")
    else:
        service = F.lit("unknown")

    if "Message" in cols:
        message = F.col("Message")
    elif "detail" in cols:
        message = F.col("detail")
    else:
        message = F.lit("")

    return df.withColumns({"Date": date, "IP_Source": ip, "Etat": etat,
                           "Service": service, "Message": message})


def drop_invalid_dates(df: DataFrame) -> DataFrame:
    """Rows whose Date did not parse are removed."""
    return df.where(F.col("Date").isNotNull())


def invalid_date_count(df: DataFrame) -> DataFrame:
    """One-row count of rows that would be dropped (partial aggregation)."""
    return df.agg(F.count_if(F.col("Date").isNull()).cast("bigint").alias("dropped"),
                  F.count(F.lit(1)).cast("bigint").alias("total"))


def assemble_timestamp(month, day, time, year: str = DEFAULT_YEAR) -> Column:
    """N8: 'Month Date YEAR Time' -> timestamp, invalid -> null."""
    text = F.concat_ws(" ", col(month), col(day).cast("string"), F.lit(year), col(time))
    return F.try_to_timestamp(text, F.lit("MMM d yyyy HH:mm:ss"))


def canonical_from_structured(df: DataFrame, server: str = "server1",
                              year: str = DEFAULT_YEAR, keep: list[str] | None = None) -> DataFrame:
    """Structured Linux log (Month, Date, Time, Component, Content,
    EventId) -> canonical event projection using N6-N8."""
    return df.select(
        *(keep or []),
        assemble_timestamp("Month", "Date", "Time", year).alias("Date"),
        F.lit(server).alias("Serveur"),
        F.col("Component").alias("Service"),
        F.col("Content").alias("Message"),
        F.col("EventId"),
        state_from_message("Content").alias("Etat"),
        first_ipv4(F.coalesce(F.col("Content").cast("string"), F.lit("None"))).alias("IP_Source"),
    )
