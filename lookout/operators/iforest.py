"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs.

* Sampling: tree t keeps the ``psi`` rows with the smallest
  ``xxhash64(key, t, seed)`` - deterministic under retries and repartition.
  A Bernoulli pre-filter (expected 4*psi rows per tree) runs map-side, and
  the per-tree ``row_number() <= psi`` limit is applied before the shuffle.
* Building: ``groupBy(tree).applyInPandas`` - one group per tree, at most
  ``psi`` rows each (bounded by parameters, not by data).
* Scoring: the flat tree table (trees x 2^(depth+1) nodes at most) is
  collected once and broadcast; an Arrow-batched pandas UDF walks all trees
  for a whole batch of rows with numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StructField, StructType)

from lookout.operators.quantile import exact_quantile
from lookout.session import cut_lineage

EULER = 0.5772156649

TREE_SCHEMA = StructType([
    StructField("tree", IntegerType()), StructField("node", IntegerType()),
    StructField("feature", IntegerType()), StructField("threshold", DoubleType()),
    StructField("left", IntegerType()), StructField("right", IntegerType()),
    StructField("size", LongType())])


def c_factor(m: float) -> float:
    """Average path length of an unsuccessful BST search among m points."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1.0) + EULER) - 2.0 * (m - 1.0) / m


def sample_rows(df: DataFrame, key_col: str, feats: list[str], n_trees: int, psi: int,
                seed: int, n_rows: int) -> DataFrame:
    p = min(1.0, 4.0 * psi / max(n_rows, 1))
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    u = lambda t: F.xxhash64(F.col(key_col), t, F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFFFFFF)) / float(2 ** 47)  # noqa
    picked = df.select(key_col, *feats, F.explode(F.filter(trees, lambda t: u(t) < p)).alias("tree"))
    picked = picked.withColumn("_u", u(F.col("tree")))
    from pyspark.sql import Window
    w = Window.partitionBy("tree").orderBy("_u", key_col)
    return picked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r", "_u")


def _build_tree(pdf: pd.DataFrame, feats: list[str], seed: int, psi: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    # sort so the build is independent of arrival order
    pdf = pdf.sort_values(list(pdf.columns)).reset_index(drop=True)
    X = pdf[feats].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, tree])
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    rows = []

    def grow(idx: np.ndarray, depth: int) -> int:
        node = len(rows)
        rows.append(None)
        sub = X[idx]
        if depth >= max_depth or len(idx) <= 1:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx))
            return node
        mins, maxs = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(maxs > mins)
        if usable.size == 0:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx))
            return node
        f = int(rng.choice(usable))
        thr = float(rng.uniform(mins[f], maxs[f]))
        go_left = sub[:, f] <= thr
        left = grow(idx[go_left], depth + 1)
        right = grow(idx[~go_left], depth + 1)
        rows[node] = (tree, node, f, thr, left, right, len(idx))
        return node

    grow(np.arange(len(X)), 0)
    return pd.DataFrame(rows, columns=[f.name for f in TREE_SCHEMA.fields])


def fit_forest(df: DataFrame, key_col: str, feats: list[str], n_trees: int = 200, psi: int = 256,
               seed: int = 42) -> tuple[DataFrame, int]:
    """D5 fit: returns the flat tree table and the sample size actually used."""
    n_rows = df.count()
    psi_eff = min(psi, n_rows)
    # at most n_trees * psi rows: materialised once, then checked and built from
    sample = cut_lineage(sample_rows(df, key_col, feats, n_trees, psi_eff, seed, n_rows))
    sizes = sample.groupBy("tree").count().agg(F.count(F.lit(1)).alias("trees"),
                                               F.min("count").alias("smallest")).first()
    if sizes["trees"] < n_trees or (sizes["smallest"] or 0) < psi_eff:
        # the pre-filter kept too few rows for some tree: take every row (exact fallback)
        sample = cut_lineage(sample_rows(df, key_col, feats, n_trees, psi_eff, seed, 1))
    trees = sample.select("tree", *feats).groupBy("tree").applyInPandas(
        lambda pdf: _build_tree(pdf, feats, seed, psi_eff), TREE_SCHEMA)
    return trees, psi_eff


def score_forest(df: DataFrame, trees: DataFrame, feats: list[str], psi: int,
                 out_col: str = "if_raw") -> DataFrame:
    """D5 score: raw = -2^(-mean path / c(psi)) (higher = more normal)."""
    t = trees.toPandas().sort_values(["tree", "node"])  # bounded: n_trees * 2^(depth+1) rows
    spark = df.sparkSession
    size = t["size"].to_numpy(dtype=float)
    m = np.maximum(size, 2.0)
    leaf_c = np.where(size <= 1, 0.0, np.where(size == 2, 1.0,
                                               2.0 * (np.log(m - 1.0) + EULER) - 2.0 * (m - 1.0) / m))
    cuts = np.flatnonzero(np.diff(t["tree"].to_numpy())) + 1
    cols = [t["feature"].to_numpy(), t["threshold"].to_numpy(), t["left"].to_numpy(), t["right"].to_numpy(), leaf_c]
    parts = list(zip(*[np.split(c, cuts) for c in cols]))
    bc = spark.sparkContext.broadcast(parts)
    denom = c_factor(psi)

    @F.pandas_udf(DoubleType())
    def iforest_score(*cols: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        total = np.zeros(len(X))
        for feat, thr, left, right, leaf_c in bc.value:
            node = np.zeros(len(X), dtype=np.int64)
            depth = np.zeros(len(X))
            while True:
                f = feat[node]
                inner = f >= 0
                if not inner.any():
                    break
                xi = X[np.arange(len(X)), np.where(inner, f, 0)]
                nxt = np.where(xi <= thr[node], left[node], right[node])
                node = np.where(inner, nxt, node)
                depth = depth + inner
            total += depth + leaf_c[node]
        mean = total / len(bc.value)
        return pd.Series(-np.power(2.0, -mean / denom) if denom > 0 else -np.ones(len(X)))

    return df.withColumn(out_col, iforest_score(*[F.col(f).cast("double") for f in feats]))


def forest_votes(scored: DataFrame, contamination: float, raw_col: str = "if_raw") -> DataFrame:
    """Vote = raw < percentile(raw, contamination) of the same rows; see ``offset_votes``."""
    return offset_votes(scored, exact_quantile(scored, F.col(raw_col), float(contamination)), raw_col)


def offset_votes(scored: DataFrame, offset: float | None, raw_col: str = "if_raw") -> DataFrame:
    """Vote = raw < ``offset``; continuous = 1 - minmax(raw), or the vote itself when all raws are equal."""
    agg = scored.agg(F.min(raw_col).alias("lo"), F.max(raw_col).alias("hi"))
    st = agg.select(F.struct(*agg.columns)).scalar()
    vote = F.coalesce(F.col(raw_col) < F.lit(offset).cast("double"), F.lit(False)).cast("int")
    cont = F.when(st["hi"] > st["lo"], 1 - (F.col(raw_col) - st["lo"]) / (st["hi"] - st["lo"])) \
        .otherwise(vote.cast("double"))
    return scored.withColumns({"v_if": vote, "cont_if": cont})
