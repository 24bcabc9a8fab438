"""Top-k, tails, bounded histories, first-seen unions, session deltas.

Per-group top-k uses ``row_number() <= k`` which Spark plans as a
WindowGroupLimit *before* the shuffle, so each map task forwards at most k
rows per group: a group holding a third of all rows never lands whole in
one task. Global top-k is ``orderBy().limit()`` (TakeOrderedAndProject,
per-partition top-k then a k-row merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.functions.text import strip
from lookout.operators.order import with_global_rank, with_previous


def top_k(df: DataFrame, score_col: str, tie_col: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score_col), F.asc(tie_col)).limit(k)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                    rank_col: str = "rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def tail(df: DataFrame, file_col: str, line_no: str, n: int) -> DataFrame:
    """Last n lines of every file."""
    return top_k_per_group(df, [file_col], [F.desc(line_no)], n, rank_col="_from_end").drop("_from_end")


def recent_lines(df: DataFrame, sources: list[str], source_col: str, line_no: str,
                 tail_n: int = 500, last: int = 20, keep: int = 10,
                 line_col: str = "line") -> DataFrame:
    """Of (tail of source[0] ++ tail of source[1] ++ ...), the last ``last``
    lines, stripped, blanks dropped, newest ``keep``; output in file order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col(source_col))
    tails = tail(df.where(F.col(source_col).isin(sources)), source_col, line_no, tail_n) \
        .withColumn("_src", rank)
    newest_first = [F.desc("_src"), F.desc(line_no)]
    last20 = tails.orderBy(*newest_first).limit(last)
    kept = (last20.withColumn(line_col, strip(line_col)).where(F.length(line_col) > 0)
            .orderBy(*newest_first).limit(keep))
    return kept.select(F.row_number().over(Window.orderBy("_src", line_no)).cast("bigint").alias("pos"),
                       F.col(line_col).alias("line"))


def newest(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """Keep the newest n rows of a history table."""
    return df.orderBy(F.desc(order_col)).limit(n)


def session_delta(df: DataFrame, order_col: str, value_col: str, tol: float = 0.001) -> DataFrame:
    """Change against the previous session (nulls as 0) and a trend label."""
    rows = with_previous(df, [F.asc(order_col)], value_col, "_previous")
    delta = F.coalesce(F.col(value_col), F.lit(0.0)) - F.coalesce(F.col("_previous"), F.lit(0.0))
    return (rows.withColumn("delta", delta).drop("_previous")
            .withColumn("trend", F.when(F.col("delta") > tol, "up")
                        .when(F.col("delta") < -tol, "down").otherwise("stable")))


def merge_set(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old set plus members of ``new`` not already in it."""
    old_d = old.select(key).distinct()
    added = new.select(key).distinct().join(old_d, key, "left_anti")
    return old_d.withColumn("origin", F.lit("old")).unionByName(added.withColumn("origin", F.lit("new")))


def first_seen_order(df: DataFrame, key: str, session_col: str, pos_col: str) -> DataFrame:
    """Order-preserving union of per-session lists: each key once, at its
    first (session, position)."""
    first = df.groupBy(key).agg(F.min(F.struct(session_col, pos_col)).alias("_k"))
    ranked = with_global_rank(first, [F.asc(F.col("_k")[session_col]), F.asc(F.col("_k")[pos_col])], "pos")
    return ranked.select(key, F.date_format(F.col("_k")[session_col], "yyyy-MM-dd").alias("first_seen"), "pos")
