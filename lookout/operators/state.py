"""Run state between batches (D17-D21): thresholds, remembered addresses,
training counters and session rows, stored as tables keyed by ``run_id``.

Every run writes a partition of its own (``run_id``): a retried or re-run
batch replaces it, even by nothing, instead of adding a second copy. A run reads the state of the latest *earlier* run.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.config import DEFAULT, DEFAULT_THRESHOLDS, Settings
from lookout.operators import density
from lookout.operators import models as M
from lookout.operators import scoring as S
from lookout.operators.ensemble import RunState, detect
from lookout.session import cut_lineage

TABLES = ["thresholds", "blacklist", "training", "performance", "model_params", "model_trees", "model_lof", "model_points", "model_kernel"]


def _write(df: DataFrame, root: str, name: str, run_id: str) -> None:
    """Replace the run's partition, also by an empty table."""
    df.write.mode("overwrite").parquet(f"{root}/{name}/run_id={quote(run_id, safe='')}")


def _order(run_id: Column) -> Column:
    """Run ids of one scheme in order: counters such as r9, r10, or timestamps of equal length."""
    return F.struct(F.length(run_id), run_id)


def _before(run_id: str) -> Column:
    return _order(F.col("run_id")) < _order(F.lit(run_id))


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, run_id string").parquet(f"{root}/{name}")
    except Exception as e:  # first run: no state yet
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, run_id string")


@dataclass
class Previous:
    state: RunState
    sessions: int
    samples: int
    run_id: str | None  # the run whose models and thresholds are used


def load_previous(spark: SparkSession, root: str, run_id: str) -> Previous:
    """State of the latest run before ``run_id`` (None / zeros on the first run).

    Runs store the addresses they add; all earlier runs' together are remembered.
    """
    thr = _read(spark, root, "thresholds", "feature string, seuil double").where(_before(run_id))
    last = thr.agg(F.max_by("run_id", _order(F.col("run_id"))).alias("r")).first()["r"]
    thresholds = None
    if last is not None:  # one row per feature
        thresholds = {**DEFAULT_THRESHOLDS,
                      **{r["feature"]: r["seuil"] for r in thr.where(F.col("run_id") == last).collect()}}
    bl = _read(spark, root, "blacklist", "ip string").where(_before(run_id)).select("ip").distinct()
    tr = (_read(spark, root, "training", "sessions bigint, total_samples bigint").where(_before(run_id))
          .orderBy(_order(F.col("run_id")).desc()).limit(1).collect())
    sessions, samples = (tr[0]["sessions"], tr[0]["total_samples"]) if tr else (0, 0)
    models = M.load(spark, root, last, _read) if last is not None else None
    return Previous(RunState(thresholds, bl, models), sessions, samples, last)


def run_batch(spark: SparkSession, features: DataFrame, attempts: DataFrame, root: str, run_id: str,
              settings: Settings = DEFAULT, key: str = "IP_Source") -> DataFrame:
    """Score ``features`` (A4) with the previous run's models and state, then
    refit models and thresholds on ``attempts`` (A2) for the next run, add this
    run's critical addresses to the blacklist, and store the session row and
    training counters. Both tables are written once: each of the steps below
    reads them, and would else aggregate the events again."""
    features, attempts = cut_lineage(features), cut_lineage(attempts)
    prev = load_previous(spark, root, run_id)
    scored = detect(features, settings, prev.state)
    feats = S.resolve_features(features)
    used = prev.state.thresholds or {r["feature"]: r["seuil"]
                                     for r in S.updated_thresholds(features, feats).collect()}
    # blacklist size before this run's merge (as the session row counts it)
    bl_before = prev.state.blacklist.agg(F.count(F.lit(1)).alias("n")).scalar()
    lab = scored.withColumn("label", F.when(F.col("score_raw") >= 0.3, -1).otherwise(1))
    sil = density.silhouette_1d(lab, "x_" + feats[0], "label").scalar()
    perf = S.session_performance(scored, bl_before, sil, F.lit(prev.sessions or 1))  # the first run has trained once before it scores
    refit = S.updated_thresholds(attempts, [f for f in feats if f in attempts.columns], used)
    added = S.critical_ips(scored).join(prev.state.blacklist, "ip", "left_anti")
    contamination = S.contamination(attempts, feats[0], float(used.get(feats[0], 50.0))).first()[0]
    refitted = M.fit(attempts, [f for f in feats if f in attempts.columns], float(contamination), key, settings)
    # without stored models the batch itself is trained on first; the refit on its attempts counts at every run
    first = prev.sessions == 0
    n_new = attempts.count() + (features.count() if first else 0)
    training = spark.createDataFrame([(prev.sessions + 1 + first, prev.samples + n_new, prev.run_id or run_id)],
                                     "sessions bigint, total_samples bigint, scored_with string")
    M.save(refitted, root, run_id, _write)
    _write(added, root, "blacklist", run_id)
    _write(training, root, "training", run_id)
    _write(perf, root, "performance", run_id)
    _write(refit, root, "thresholds", run_id)  # last: a run is previous to others once its thresholds stand
    return scored
