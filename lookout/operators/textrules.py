"""Text-level rules over log lines: multi-label attack counters, exclusive
triage with samples, per-document alert rules, display levels, top
addresses seen after 'from'.

Counters are ``count_if`` aggregates (partial aggregation, no per-group
lists); samples are bounded by a rank limit that Spark applies before the
shuffle (WindowGroupLimit), so a hot group never travels whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.config import ATTACK_LABELS
from lookout.functions.text import all_contains, any_contains, col, lower_contains_any
from lookout.operators.windows import top_k_per_group


def _label_cond(upper: Column, any_words, all_words) -> Column:
    conds = []
    if any_words:
        conds.append(any_contains(upper, any_words))
    if all_words:
        conds.append(all_contains(upper, all_words))
    return reduce(lambda a, b: a & b, conds)


def attack_counters(df: DataFrame, keys: list[str], line_col: str = "line") -> DataFrame:
    """8 multi-label counters per key (a line may count in several),
    unpivoted to (key, label, n), zero labels dropped, plus a TOTAL row."""
    up = F.upper(F.col(line_col))
    wide = df.groupBy(*keys).agg(*[
        F.count_if(_label_cond(up, a, b)).cast("bigint").alias(label)
        for label, a, b in ATTACK_LABELS])
    labels = [l for l, _, _ in ATTACK_LABELS]
    long = wide.unpivot(keys, labels, "label", "n")
    total = long.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n")) \
        .withColumn("label", F.lit("TOTAL")).select(*keys, "label", "n")
    return long.where(F.col("n") > 0).unionByName(total)


def triage_label(line) -> Column:
    """Exclusive label error > warning > ssh (null otherwise)."""
    c = col(line)
    return (F.when(lower_contains_any(c, ["error", "failed"]), "erreurs")
            .when(lower_contains_any(c, ["warning", "warn"]), "warnings")
            .when(lower_contains_any(c, ["ssh", "accepted"]), "connexions_ssh"))


def triage(df: DataFrame, keys: list[str], order_col: str, line_col: str = "line",
           n_samples: int = 5) -> DataFrame:
    """Per key, counts of each exclusive label with the first samples
    (by line order, 200 chars, newline-joined) and the total line count."""
    labelled = df.select(*keys, order_col, line_col, triage_label(line_col).alias("label"))
    # one scan: counts per (key, label) including unlabelled lines; totals
    # per key are sums over that small aggregate
    per = labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    counts = per.where(F.col("label").isNotNull())
    totals = per.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n")) \
        .select(*keys, F.lit("total_lignes").alias("label"), "n", F.lit(None).cast("string").alias("samples"))
    firsts = top_k_per_group(labelled.where(F.col("label").isNotNull()), keys + ["label"], [F.asc(order_col)],
                             n_samples, rank_col="rn")
    samples = firsts.groupBy(*keys, "label").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.left(line_col, F.lit(200)).alias("t")))),
                                 lambda s: s["t"]), "\n").alias("samples"))
    per_label = counts.join(samples, keys + ["label"], "left")
    return per_label.select(*keys, "label", "n", "samples").unionByName(totals)


def text_alerts(df: DataFrame, keys: list[str], line_col: str = "line") -> DataFrame:
    """Per document (key), 'error' occurrences (> 10 alerts) and phrase
    rules; alert codes joined by ' | ' or 'NONE'."""
    low = F.lower(F.col(line_col))
    agg = df.groupBy(*keys).agg(
        F.sum(F.regexp_count(low, F.lit("error"))).cast("bigint").alias("n_error"),
        F.max(low.contains("failed password")).alias("_fp"),
        F.max(low.contains("invalid user")).alias("_iu"),
        F.max(low.contains("out of memory")).alias("_oom"))
    codes = F.array_compact(F.array(
        F.when(F.col("n_error") > 10, F.lit("ERRORS")),
        F.when(F.col("_fp"), F.lit("FAILED_PASSWORD")),
        F.when(F.col("_iu"), F.lit("INVALID_USER")),
        F.when(F.col("_oom"), F.lit("OUT_OF_MEMORY"))))
    return agg.select(*keys, "n_error",
                      F.when(F.size(codes) > 0, F.array_join(codes, " | ")).otherwise(F.lit("NONE")).alias("alerts"))


def display_level(line) -> Column:
    """P10: case-sensitive 'Failed'/'Accepted', folded error/warning/success."""
    c = col(line)
    low = F.lower(c)
    return (F.when(c.contains("Failed") | low.contains("error") | c.contains("Error"), "error")
            .when(low.contains("warning") | c.contains("Warning"), "warning")
            .when(c.contains("Accepted") | low.contains("success"), "success")
            .otherwise("info"))


def top_from_ips(df: DataFrame, k: int = 10, line_col: str = "line") -> DataFrame:
    """K4: most frequent addresses following 'from ' (ties by address)."""
    ips = df.select(F.explode(F.regexp_extract_all(F.col(line_col), F.lit(r"from (\d+\.\d+\.\d+\.\d+)"),
                                                   F.lit(1))).alias("ip"))
    return (ips.groupBy("ip").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .orderBy(F.desc("n"), F.asc("ip")).limit(k))
