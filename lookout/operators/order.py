"""Order over a whole table without one task that holds it.

Rows are dealt to ranges of the order (a sampled range partition), numbered
inside their range, and shifted by what the ranges before hold. Only the
per-range totals - as many rows as there are shuffle partitions - meet in one
task. The dealt rows are written once into the shared folder: the sampled
bounds then stay the same for every later pass and for retried tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.session import written

RANGE, TIE = "_range", "_tie"


def dealt_by_range(df: DataFrame, order: list[Column]) -> tuple[DataFrame, list[Column]]:
    """The rows with their range of the order (``_range``) and a tie-breaker (``_tie``), and the full order.

    The tie-breaker numbers the written rows, so that rows equal in ``order``,
    however many, spread over several ranges.
    """
    numbered = written(df.withColumn(TIE, F.monotonically_increasing_id()), "order-rows")
    full = [*order, F.asc(TIE)]
    dealt = numbered.repartitionByRange(*full).withColumn(RANGE, F.spark_partition_id())
    return written(dealt, "order-ranges"), full


def offsets(totals: DataFrame, sums: list[str]) -> DataFrame:
    """Per range, the sums over all ranges before it; one row a range."""
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(RANGE, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums])


def with_global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's place (from 1) in the whole table's order; equal rows in any order."""
    dealt, full = dealt_by_range(df, order)
    place = F.row_number().over(Window.partitionBy(RANGE).orderBy(*full)).cast("bigint")
    start = offsets(dealt.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")), ["n"])
    return dealt.withColumn("_place", place).join(F.broadcast(start), RANGE) \
        .select(*df.columns, (F.col("_before_n") + F.col("_place")).alias(name))


def with_previous(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the row before in the whole table's order, null for the first row."""
    dealt, full = dealt_by_range(df, order)
    inside = Window.partitionBy(RANGE).orderBy(*full)
    rows = dealt.withColumns({"_place": F.row_number().over(inside), "_own": F.lag(value).over(inside),
                              "_rows": F.count(F.lit(1)).over(Window.partitionBy(RANGE))})
    # the last value of each range goes to the next range; in a struct, so that a null is told from no row
    last = rows.where("_place = _rows").select(RANGE, F.struct(F.col(value).alias("v")).alias("_last"))
    carried = last.select(RANGE, F.lag("_last").over(Window.orderBy(RANGE)).alias("_carried"))
    return rows.join(F.broadcast(carried), RANGE) \
        .select(*df.columns, F.when(F.col("_place") == 1, F.col("_carried")["v"]).otherwise(F.col("_own")).alias(name))


def with_running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums over the whole table's order, one column for each entry of ``sums``."""
    dealt, full = dealt_by_range(df.withColumns({f"_v_{k}": v for k, v in sums.items()}), order)
    inside = Window.partitionBy(RANGE).orderBy(*full).rowsBetween(Window.unboundedPreceding, 0)
    start = offsets(dealt.groupBy(RANGE).agg(*[F.sum(f"_v_{k}").alias(k) for k in sums]), list(sums))
    rows = dealt.withColumns({f"_in_{k}": F.sum(f"_v_{k}").over(inside) for k in sums})
    return rows.join(F.broadcast(start), RANGE) \
        .select(*df.columns, *[(F.col(f"_before_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums])
