"""Full five-layer detector on one per-address table (D22, D21 state).

First run semantics: models are fitted on the table and thresholds refreshed
from it before C1 reads them (training precedes scoring); with a previous run's
state, its stored models, thresholds and blacklist are used instead. The feature
table is checkpointed once into the shared checkpoint folder: every layer
re-reads it, and a lost executor does not recompute the upstream aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.config import DEFAULT, Settings
from lookout.operators import density
from lookout.operators import models as M
from lookout.operators import scoring as S
from lookout.session import cut_lineage


@dataclass
class RunState:
    thresholds: dict | None = None
    blacklist: DataFrame | None = None
    models: M.Models | None = None


def detect(df: DataFrame, settings: Settings = DEFAULT, state: RunState | None = None,
           key: str = "IP_Source") -> DataFrame:
    state = state or RunState()
    df = cut_lineage(df)
    feats = S.resolve_features(df)
    first = feats[0]
    stats = S.attach(S.global_stats(df, feats))
    base_thr = state.thresholds or settings.thresholds
    cont = float(S.contamination(df, first, float(base_thr.get(first, 50.0))).first()[0])
    if state.thresholds is None:
        rows = S.updated_thresholds(df, feats, base_thr).collect()  # one row per feature
        thresholds = {**base_thr, **{r["feature"]: r["seuil"] for r in rows}}
    else:
        thresholds = state.thresholds

    models = state.models or M.fit(df, feats, cont, key, settings)
    state.models = models
    votes = M.apply(df, models)
    xf = ["x_" + f for f in models.feats]
    # noise is a matter of the table's own rows, in the models' units
    db = density.dbscan_noise_nd(votes, xf, settings.eps, settings.min_samples) if len(xf) > 1 else \
        density.dbscan_noise(votes, xf[0], settings.eps, settings.min_samples).withColumnRenamed("x", xf[0])
    votes = votes.join(db.select(*xf, F.col("noise").cast("int").alias("v_db")), xf, "left").fillna(0, ["v_db"])
    votes = cut_lineage(votes)

    weights = S.attach(S.model_weights(votes))
    out = S.blend_votes(votes, weights)
    out = S.rule_score(out, feats, thresholds, settings.feature_weights)
    out = S.temporal_score(out, feats, stats)
    out = S.memory_score(out, state.blacklist, key)
    out = S.contribution_score(out, feats, stats, settings.feature_weights)
    out = S.levels(S.final_score(out, settings.layer_weights))
    # one scored row per address, materialised once: alarms, session rows,
    # silhouette and the blacklist merge all read it
    return cut_lineage(out.withColumn("seuil_courant", F.lit(float(thresholds.get(first, 50.0)))))
