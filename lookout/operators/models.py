"""Stored detector models (D21): fitted once, kept as versioned tables, applied to rows they have not seen.

A model version holds the scaler, the forest's trees, the local-outlier
reference (its sorted values with their neighbours; of several features, its
points with their densities), the kernel's mean features, and each model's threshold from its own training rows. A run is
scored with the version of the latest run before it; only the first run is
scored with models fitted on itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lookout.config import DEFAULT, Settings
from lookout.operators import density, iforest, neighbours
from lookout.operators import scoring as S
from lookout.operators.order import with_running_sums
from lookout.operators.quantile import exact_quantile
from lookout.session import cut_lineage

PARAM_DDL = "name string, feature string, value double"
TREE_DDL = "tree int, node int, feature int, threshold double, left int, right int, size bigint"
NEIGHBOUR = "struct<x:double,cnt:bigint,kdist:double,lrd:double>"
LOF_DDL = f"rank bigint, near array<{NEIGHBOUR}>"
POINT_DDL = "id bigint, x array<double>, cnt bigint, kdist double, lrd double"
KERNEL_DDL = "k int, mean double"


@dataclass
class Models:
    """``params``: one value by (name, feature); the tables as stored. Both are a few rows, or bounded by settings, but ``lof`` and ``points``."""

    feats: list[str]
    params: dict[tuple[str, str], float | None]
    trees: DataFrame
    lof: DataFrame      # the outlier reference of one feature
    points: DataFrame   # that of several
    kernel: DataFrame

    def value(self, name: str, feature: str = "") -> float | None:
        return self.params.get((name, feature))


# ------------------------------------------------------------------ fit

def _scaled(df: DataFrame, feats: list[str], params: dict) -> DataFrame:
    """``x_`` columns: the features in the stored scaler's units."""
    return df.withColumns({"x_" + f: (F.col(f).cast("double") - F.lit(params["mean", f])) / F.lit(params["std", f] or 1.0) for f in feats})


def _lof_reference(df: DataFrame, feature: str, k: int, contamination: float) -> tuple[DataFrame, float | None]:
    """Each distinct value's rank and neighbours by rank, k on either side, with their densities; and the score below which rows are outliers."""
    ranked, scores = density.lof_fit(df.withColumn("_raw", F.col(feature).cast("double")), "_raw", k)
    near = Window.partitionBy("_band").orderBy("rank").rowsBetween(-k, k)
    held = density.halo_by_rank(ranked, k).withColumn("near", F.collect_list(F.struct("x", "cnt", "kdist", "lrd")).over(near)).where("_is_home")
    return held.select("rank", "near"), exact_quantile(scores, -F.col("lof_fit"), contamination, F.col("cnt"))


def fit(df: DataFrame, feats: list[str], contamination: float, key: str, settings: Settings = DEFAULT) -> Models:
    """Fit all models on ``df``; rows with a null feature are left out."""
    for f in feats:
        df = df.where(F.col(f).isNotNull())
    df = cut_lineage(df)
    stats = S.global_stats(df, feats, quantiles=False).first()
    n = stats["n"]
    params: dict[tuple[str, str], float | None] = {("n", ""): float(n), ("contamination", ""): contamination}
    for f in feats:
        params["mean", f], params["std", f] = stats[f"{f}__mean"] or 0.0, stats[f"{f}__std_pop"] or 1.0
    x, xf = _scaled(df, feats, params), ["x_" + f for f in feats]

    trees, psi = iforest.fit_forest(x, key, xf, settings.n_trees, settings.sample_size, settings.seed)
    trees = cut_lineage(trees)
    params["if_psi", ""] = float(psi)
    params["if_offset", ""] = exact_quantile(iforest.score_forest(x, trees, xf, psi), F.col("if_raw"), contamination)

    k = min(settings.lof_k, n - 1)
    params["lof_k", ""] = float(k)
    lof, points = df.sparkSession.createDataFrame([], LOF_DDL), df.sparkSession.createDataFrame([], POINT_DDL)
    if k >= 1 and len(feats) == 1:
        lof, params["lof_offset", ""] = _lof_reference(df, feats[0], k, contamination)
    elif k >= 1:
        reference, scores = neighbours.lof_fit(x, xf, k)
        points = reference.select("id", F.array(*[f"_x{i}" for i in range(len(xf))]).alias("x"), "cnt", "kdist", "lrd")
        params["lof_offset", ""] = exact_quantile(scores, -F.col("lof_fit"), contamination, F.col("cnt"))

    gamma = density.scale_gamma(x, xf)
    freq, phase = density.fourier_features(len(xf), gamma)
    distinct = cut_lineage(x.groupBy(*xf).agg(F.count(F.lit(1)).cast("bigint").alias("cnt")))
    mean = density.feature_means(distinct, xf, freq, phase)
    params["kernel_gamma", ""] = gamma
    params["kernel_offset", ""] = exact_quantile(density.point_density(distinct, xf, freq, phase, mean), F.col("density"), contamination, F.col("cnt"))
    kernel = df.sparkSession.createDataFrame([(i, float(m)) for i, m in enumerate(mean)], KERNEL_DDL)
    return Models(feats, params, trees, cut_lineage(lof), cut_lineage(points), kernel)


# ------------------------------------------------------------------ store

def save(models: Models, root: str, run_id: str, write) -> None:
    """One version, by ``write(table, root, name, run_id)``; the parameters come last, as a version without them is not read."""
    spark = models.trees.sparkSession
    write(models.trees, root, "model_trees", run_id)
    write(models.lof, root, "model_lof", run_id)
    write(models.points, root, "model_points", run_id)
    write(models.kernel, root, "model_kernel", run_id)
    rows = [(n, f, None if v is None else float(v)) for (n, f), v in models.params.items()]
    write(spark.createDataFrame(rows, PARAM_DDL).coalesce(1), root, "model_params", run_id)


def load(spark: SparkSession, root: str, run_id: str, read) -> Models | None:
    """The version that ``run_id`` stored, by ``read(spark, root, name, schema)``; None if there is none."""
    of_run = lambda name, ddl: read(spark, root, name, ddl).where(F.col("run_id") == run_id).drop("run_id")
    rows = of_run("model_params", PARAM_DDL).collect()  # a few values
    if not rows:
        return None
    params = {(r["name"], r["feature"]): r["value"] for r in rows}
    feats = [r["feature"] for r in rows if r["name"] == "mean"]
    return Models(feats, params, of_run("model_trees", TREE_DDL), of_run("model_lof", LOF_DDL), of_run("model_points", POINT_DDL),
                  of_run("model_kernel", KERNEL_DDL))


# ------------------------------------------------------------------ apply

def _lof_votes(values: DataFrame, models: Models) -> DataFrame:
    """(x, v_lof) of distinct raw values: each meets the reference row of its place in the order, whose neighbours hold its own."""
    k, offset = int(models.value("lof_k")), models.value("lof_offset")
    if offset is None:
        return values.select("x", F.lit(0).alias("v_lof"))
    own = models.lof.select("rank", F.get("near", F.least(F.col("rank"), F.lit(k)).cast("int"))["x"].alias("x"))
    marks = own.select("x", F.lit(0).alias("kind")).unionByName(values.select("x", F.lit(1).alias("kind")))
    placed = with_running_sums(marks, [F.asc("x"), F.asc("kind")], {"_place": F.when(F.col("kind") == 0, 1).otherwise(0)}).where("kind = 1")
    last = models.lof.agg(F.max("rank")).scalar()
    met = placed.select("x", F.least(F.col("_place").cast("bigint"), last).alias("rank")).join(models.lof, "rank")
    walk = density.walk_neighbours(F.col("near"), F.col("x"), k, lambda c: c["cnt"])
    rated = met.select("x", walk.alias("w"))
    score = F.col("w.s_lrd") / k * (F.col("w.s_reach") / k + 1e-10)
    return rated.select("x", (-score < F.lit(offset)).cast("int").alias("v_lof"))


def _lof_point_votes(points: DataFrame, models: Models, xf: list[str]) -> DataFrame:
    """(xf..., v_lof) of distinct scaled points, by the stored reference points."""
    offset = models.value("lof_offset")
    if offset is None:
        return points.select(*xf, F.lit(0).alias("v_lof"))
    reference = models.points.select("id", *[F.get("x", F.lit(i)).alias(f"_x{i}") for i in range(len(xf))], "cnt", "kdist", "lrd")
    scored = neighbours.lof_scores(points, xf, reference, int(models.value("lof_k")))
    return scored.select(*xf, (-F.col("lof_score") < F.lit(offset)).cast("int").alias("v_lof"))


def apply(df: DataFrame, models: Models) -> DataFrame:
    """Add the scaled features and the votes ``v_if``, ``cont_if``, ``v_lof`` and ``v_svm`` of stored models.

    A row with a null feature gets no vote. Only the continuous forest score is
    relative to the rows at hand.
    """
    feats, xf = models.feats, ["x_" + f for f in models.feats]
    x = cut_lineage(_scaled(df, feats, models.params))
    whole = F.lit(True)
    for f in feats:
        whole = whole & F.col(f).isNotNull()

    if len(feats) == 1:
        values = x.where(F.col(feats[0]).isNotNull()).select(F.col(feats[0]).cast("double").alias("x")).distinct()
        lof = _lof_votes(values, models).withColumnRenamed("x", "_lx")
        out = x.join(lof, F.col(feats[0]).cast("double") == F.col("_lx"), "left").drop("_lx")
    else:
        out = x.join(_lof_point_votes(x.where(whole).select(*xf), models, xf), xf, "left")

    freq, phase = density.fourier_features(len(xf), models.value("kernel_gamma"))
    mean = np.zeros(len(phase))
    for r in models.kernel.collect():  # one value a feature
        mean[r["k"]] = r["mean"]
    points = x.where(whole).select(*xf).distinct()
    offset = F.lit(models.value("kernel_offset")).cast("double")
    kernel = density.point_density(points, xf, freq, phase, mean).select(*xf, (F.col("density") < offset - 1e-8).cast("int").alias("v_svm"))
    out = out.join(kernel, xf, "left")

    scored = iforest.score_forest(out.where(whole), models.trees, xf, int(models.value("if_psi")))
    scored = iforest.offset_votes(scored, models.value("if_offset"))
    rest = out.where(~whole).withColumns({"if_raw": F.lit(None).cast("double"), "v_if": F.lit(0), "cont_if": F.lit(0.0)})
    return scored.unionByName(rest).fillna(0, ["v_lof", "v_svm", "v_if"])
