"""Per-address anomaly layers that need no fitted model (C1, C3, C4, C5),
the final blend, alert levels, alarms and the state-table updates.

Global statistics (mean, std, q99, counts) are computed once as a one-row
aggregate and attached as a scalar subquery (J2): partial aggregation on
the executors, a single tiny result, no join and no per-row recomputation.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lookout.config import (BLACKLIST_SCORE, DEFAULT_MODEL_WEIGHTS, DEFAULT_THRESHOLDS,
                            EXTRA_FEATURES, FALLBACK_FEATURE_WEIGHT, FALLBACK_THRESHOLD,
                            FEATURE_WEIGHTS, FEATURES, LAYER_WEIGHTS, LEVELS, NIGHT_HOURS,
                            SEV_CRITICAL, SEV_WARNING)
from lookout.functions.fmt import py_fixed
from lookout.operators.order import with_running_sums
from lookout.operators.quantile import exact_quantiles


# ------------------------------------------------------------------ D1, J2

def resolve_features(df: DataFrame) -> list[str]:
    """Known feature names present, else every numeric column."""
    known = [f for f in FEATURES + EXTRA_FEATURES if f in df.columns]
    if known:
        return known
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if not numeric:
        raise ValueError(f"no numeric feature among {df.columns}")
    return numeric


def global_stats(df: DataFrame, feats: list[str], quantiles: bool = True) -> DataFrame:
    """One-row statistics of every feature (J2 input); the 99 % quantile is exact, found by distributed selection."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in feats:
        v = F.col(f).cast("double")
        aggs += [F.avg(v).alias(f"{f}__mean"), F.stddev_pop(v).alias(f"{f}__std_pop"), F.stddev_samp(v).alias(f"{f}__std")]
    stats = df.agg(*aggs)
    if not quantiles:
        return stats
    found = exact_quantiles(df, [F.col(f) for f in feats], [0.99])
    return stats.withColumns({f"{f}__q99": F.lit(q[0]).cast("double") for f, q in zip(feats, found)})


def attach(stats: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery."""
    return stats.select(F.struct(*stats.columns).alias("s")).scalar()


# ------------------------------------------------------------------ D2, D3

def scale(df: DataFrame, feats: list[str], stats: Column, prefix: str = "x_") -> DataFrame:
    """Standard scaling with population std, zero std -> 1."""
    cols = {}
    for f in feats:
        sd = stats[f"{f}__std_pop"]
        cols[prefix + f] = (F.col(f).cast("double") - stats[f"{f}__mean"]) / \
            F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
    return df.withColumns(cols)


def contamination(df: DataFrame, feature: str, threshold: float) -> DataFrame:
    """D3: share of rows above the threshold of the first feature, clipped to [0.05, 0.20]."""
    share = F.count_if(F.col(feature) > threshold) / F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.agg(F.least(F.lit(0.20), F.greatest(F.lit(0.05), share)).alias("contamination"))


# ------------------------------------------------------------------ D4

def _threshold(thresholds: dict, f: str) -> float:
    return float(thresholds.get(f, DEFAULT_THRESHOLDS.get(f, FALLBACK_THRESHOLD)))


def rule_score(df: DataFrame, feats: list[str], thresholds: dict | None = None,
               weights: dict | None = None) -> DataFrame:
    """C1 = min(sum of w*min((v-s)/max(s,1),1) over features above threshold, 1)
    with a reason per exceeded feature, joined by ' | ' or 'RAS'."""
    thresholds = thresholds or DEFAULT_THRESHOLDS
    weights = weights or FEATURE_WEIGHTS
    contribs, reasons = [], []
    for f in feats:
        s = _threshold(thresholds, f)
        w = float(weights.get(f, FALLBACK_FEATURE_WEIGHT))
        v = F.col(f).cast("double")
        c = F.lit(w) * F.least((v - s) / max(s, 1.0), F.lit(1.0))
        above = v > s
        contribs.append(F.when(above, c).otherwise(0.0))
        reasons.append(F.when(above, F.concat(F.lit(f"{f}="), py_fixed(v, 1),
                                              F.lit(f" > seuil={s:.1f} (+"), py_fixed(c, 2), F.lit(")"))))
    total = contribs[0]
    for c in contribs[1:]:
        total = total + c
    arr = F.array_compact(F.array(*reasons))
    return df.withColumns({
        "s_c1": F.least(total, F.lit(1.0)),
        "raisons_c1": F.when(F.size(arr) > 0, F.array_join(arr, " | ")).otherwise(F.lit("RAS")),
    })


# ------------------------------------------------------------------ D11

def temporal_score(df: DataFrame, feats: list[str], stats: Column, date_col: str = "Date") -> DataFrame:
    """Night hour +0.35; per feature z>3 +0.35 / z>2 +0.15 (sample std,
    skipped when std is 0 or undefined); above q99 +0.25; capped at 1."""
    lo, hi = NIGHT_HOURS
    h = F.hour(date_col)
    score = F.when(F.col(date_col).isNotNull() & h.between(lo, hi), 0.35).otherwise(0.0)
    for f in feats:
        v = F.col(f).cast("double")
        sd = stats[f"{f}__std"]
        z = F.abs((v - stats[f"{f}__mean"]) / sd)
        zs = F.when(sd.isNotNull() & (sd > 0),
                    F.when(z > 3, 0.35).when(z > 2, 0.15).otherwise(0.0)).otherwise(0.0)
        score = score + zs + F.when(v > stats[f"{f}__q99"], 0.25).otherwise(0.0)
    return df.withColumn("s_c3", F.least(score, F.lit(1.0)))


# ------------------------------------------------------------------ J1 (C4)

def memory_score(df: DataFrame, blacklist: DataFrame | None, ip_col: str = "IP_Source",
                 bl_col: str = "ip") -> DataFrame:
    """0.85 when the address is in the remembered blacklist.

    A left join on the address; AQE turns it into a broadcast join at run
    time only when the measured blacklist is below the broadcast threshold,
    otherwise it stays a shuffle join (the list grows across runs).
    """
    if blacklist is None:
        return df.withColumn("s_c4", F.lit(0.0))
    bl = blacklist.select(F.col(bl_col).alias("_bl_ip")).where(F.col("_bl_ip").isNotNull()).distinct()
    joined = df.join(bl, F.col(ip_col) == F.col("_bl_ip"), "left")
    return joined.withColumn("s_c4", F.when(F.col("_bl_ip").isNotNull(), BLACKLIST_SCORE)
                             .otherwise(0.0)).drop("_bl_ip")


# ------------------------------------------------------------------ D12

def contribution_score(df: DataFrame, feats: list[str], stats: Column,
                       weights: dict | None = None) -> DataFrame:
    """Sum of w*max((v-mean)/mean, 0) (0 when mean <= 0), capped at 1,
    and the top-3 positive causes as 'Causes : f=v | ...'."""
    weights = weights or FEATURE_WEIGHTS
    contrib = {}
    for f in feats:
        v = F.col(f).cast("double")
        m = stats[f"{f}__mean"]
        w = float(weights.get(f, FALLBACK_FEATURE_WEIGHT))
        contrib[f"_c5_{f}"] = F.when(m > 0, F.lit(w) * F.greatest((v - m) / m, F.lit(0.0))).otherwise(0.0)
    df = df.withColumns(contrib)
    items = [F.struct(F.negative(F.col(f"_c5_{f}")).alias("neg"), F.lit(pos).alias("pos"),
                      F.col(f"_c5_{f}").alias("c"), F.concat(F.lit(f"{f}="), py_fixed(f, 0)).alias("t"))
             for pos, f in enumerate(feats)]
    arr = F.sort_array(F.array(*items))
    return df.withColumn("_c5_arr", arr).withColumns({
        "s_c5": F.least(F.aggregate("_c5_arr", F.lit(0.0), lambda acc, x: acc + x["c"]), F.lit(1.0)),
        "explication": F.when(F.col("_c5_arr")[0]["c"] > 0,
                              F.concat(F.lit("Causes : "), F.array_join(F.transform(
                                  F.filter(F.slice("_c5_arr", 1, 3), lambda x: x["c"] > 0),
                                  lambda x: x["t"]), " | ")))
                       .otherwise(F.lit("Comportement normal")),
    }).drop("_c5_arr", *contrib)


# ------------------------------------------------------------------ D9, D10 (C2 blend)

def model_weights(votes: DataFrame, v_if="v_if", v_lof="v_lof", v_svm="v_svm") -> DataFrame:
    """Agreement-based weights of the three models (0.85 shared, dbscan 0.15)."""
    a = votes.agg(F.avg((F.col(v_if) == F.col(v_lof)).cast("double")).alias("a_if_lof"),
                  F.avg((F.col(v_if) == F.col(v_svm)).cast("double")).alias("a_if_svm"),
                  F.avg((F.col(v_lof) == F.col(v_svm)).cast("double")).alias("a_lof_svm"))
    return weights_from_agreements(a)


def weights_from_agreements(a: DataFrame) -> DataFrame:
    t = F.col("a_if_lof") + F.col("a_if_svm") + F.col("a_lof_svm")
    p_if = (F.col("a_if_lof") + F.col("a_if_svm")) / (2 * t)
    p_lof = (F.col("a_if_lof") + F.col("a_lof_svm")) / (2 * t)
    p_svm = (F.col("a_if_svm") + F.col("a_lof_svm")) / (2 * t)
    somme = p_if + p_lof + p_svm

    def w(p, default):
        return F.when(t == 0, F.lit(default)).otherwise(F.bround(p * 0.85 / somme, 3))

    d = DEFAULT_MODEL_WEIGHTS
    return a.select("a_if_lof", "a_if_svm", "a_lof_svm",
                    w(p_if, d["if"]).alias("w_if"), w(p_lof, d["lof"]).alias("w_lof"),
                    w(p_svm, d["svm"]).alias("w_svm"),
                    F.when(t == 0, F.lit(d["dbscan"])).otherwise(F.lit(0.15)).alias("w_dbscan"))


def blend_votes(df: DataFrame, weights: Column, v_if="v_if", cont_if="cont_if", v_lof="v_lof",
                v_svm="v_svm", v_db="v_db") -> DataFrame:
    """C2 = clip(w_if*vote*continuous + w_lof*v + w_svm*v + w_db*v, 0, 1)."""
    raw = (weights["w_if"] * F.col(v_if) * F.col(cont_if) + weights["w_lof"] * F.col(v_lof)
           + weights["w_svm"] * F.col(v_svm) + weights["w_dbscan"] * F.col(v_db))
    return df.withColumn("s_c2", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


# ------------------------------------------------------------------ D13, D14

def final_score(df: DataFrame, layer_weights: dict | None = None) -> DataFrame:
    """Weighted sum of the five layers, clipped; layer columns rounded to 4."""
    lw = layer_weights or LAYER_WEIGHTS
    raw = sum((F.lit(lw[k]) * F.col(f"s_{k}") for k in ["c1", "c2", "c3", "c4", "c5"]), F.lit(0.0))
    out = df.withColumn("score_raw", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
    return out.withColumns({**{f"score_{k}": F.bround(f"s_{k}", 4) for k in ["c1", "c2", "c3", "c4", "c5"]},
                            "score_final": F.bround("score_raw", 4)})


def levels(df: DataFrame, score_col: str = "score_raw") -> DataFrame:
    """Level, emoji, -1/1 flag and negated score from the unrounded score."""
    s = F.col(score_col)
    lvl, emo = None, None
    for cut, name, emoji in LEVELS:
        lvl = F.when(s >= cut, name) if lvl is None else lvl.when(s >= cut, name)
        emo = F.when(s >= cut, emoji) if emo is None else emo.when(s >= cut, emoji)
    return df.withColumns({
        "niveau_alerte": lvl.otherwise(LEVELS[-1][1]),
        "emoji_alerte": emo.otherwise(LEVELS[-1][2]),
        "anomalie": F.when(s >= 0.3, -1).otherwise(1),
        "anomalie_score": -s,
    })


# ------------------------------------------------------------------ K1, D15, K2, D16

def anomalies(scored: DataFrame, ip_col: str = "IP_Source") -> DataFrame:
    """K1: rows whose rounded score is >= 0.3, highest first."""
    return scored.where(F.col("score_final") >= 0.3).orderBy(F.desc("score_final"), F.asc(ip_col))


def alarms(scored: DataFrame, threshold_value: float, as_of: Column | datetime | None = None,
           ip_col: str = "IP_Source", value_col: str = "Nombre_Tentatives") -> DataFrame:
    """Alarm rows for CRITIQUE / ANOMALIE addresses (15 fields)."""
    if as_of is None:
        ts = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    elif isinstance(as_of, datetime):
        ts = F.lit(as_of.isoformat())
    else:
        ts = as_of
    ip = F.coalesce(F.col(ip_col).cast("string"), F.lit("N/A"))
    sel = scored.where((F.col("score_final") >= 0.3) & F.col("niveau_alerte").isin("CRITIQUE", "ANOMALIE"))
    return sel.select(
        ts.alias("timestamp"), ip.alias("ip"), F.col("niveau_alerte").alias("niveau"),
        "score_final", "score_c1", "score_c2", "score_c3", "score_c4", "explication",
        F.col("raisons_c1").alias("raisons"),
        F.when(F.col("score_final") >= 0.7, SEV_CRITICAL).otherwise(SEV_WARNING).alias("severite"),
        F.concat(F.col("emoji_alerte"), F.lit(" "), F.col("niveau_alerte"), F.lit(" | IP="), ip,
                 F.lit(" | Score="), py_fixed("score_final", 2), F.lit(" | "), F.col("explication")).alias("message"),
        F.concat(F.lit("DÉTECTION "), F.col("niveau_alerte")).alias("type"),
        F.coalesce(F.col(value_col).cast("double"), F.lit(0.0)).alias("valeur"),
        F.lit(float(threshold_value)).alias("seuil"))


def critical_alarms(alarm_df: DataFrame, k: int = 5) -> DataFrame:
    """K2: first k CRITIQUE alarms (score order), projected to 4 fields."""
    return (alarm_df.where(F.col("severite") == SEV_CRITICAL)
            .orderBy(F.desc("score_final"), F.asc("ip")).limit(k)
            .select("ip", "type", "valeur", "severite"))


def critical_ips(scored: DataFrame, ip_col: str = "IP_Source") -> DataFrame:
    """Distinct non-null addresses at level CRITIQUE."""
    return (scored.where((F.col("niveau_alerte") == "CRITIQUE") & F.col(ip_col).isNotNull())
            .select(F.col(ip_col).alias("ip")).distinct())


# ------------------------------------------------------------------ D17, D18, D20

def updated_thresholds(df: DataFrame, feats: list[str], old: dict | None = None) -> DataFrame:
    """Per feature, round(.7*old + .3*(mean + 2*std), 2) when std > 0 and n > 30."""
    old = old or DEFAULT_THRESHOLDS
    stats = global_stats(df, feats, quantiles=False)
    rows = []
    for f in feats:
        o = F.lit(_threshold(old, f))
        sd, m = F.col(f"{f}__std"), F.col(f"{f}__mean")
        new = F.when(sd.isNotNull() & (sd > 0) & (F.col("n") > 30),
                     F.bround(0.70 * o + 0.30 * (m + 2 * sd), 2)).otherwise(o)
        rows.append(F.struct(F.lit(f).alias("feature"), new.cast("double").alias("seuil")))
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def session_performance(scored: DataFrame, blacklist_size: Column, silhouette: Column, session: Column | None = None,
                        as_of: Column | None = None) -> DataFrame:
    """One row per scoring session, none for fewer than three addresses."""
    s = F.col("score_raw")
    row = scored.agg(
        F.count(F.lit(1)).cast("bigint").alias("nb_echantillons"),
        F.bround(F.avg((s >= 0.3).cast("double")) * 100, 2).alias("taux_anomalies"),
        F.bround(F.avg(s), 4).alias("score_moyen"),
        F.bround(F.max(s), 4).alias("score_max"),
    ).where(F.col("nb_echantillons") >= 3)
    when = as_of if as_of is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return row.select((session if session is not None else F.lit(0)).cast("bigint").alias("session"), when.alias("timestamp"), "*",
                      blacklist_size.cast("bigint").alias("nb_blacklistes"), silhouette.alias("silhouette"))


def training_counters(history: DataFrame, order_col: str, n_col: str) -> DataFrame:
    """Cumulative sessions and samples after each training."""
    sums = with_running_sums(history, [F.asc(order_col)], {"_sessions": F.lit(1), "_samples": F.col(n_col)})
    return sums.select(order_col, F.col("_sessions").cast("bigint").alias("sessions"), F.col("_samples").cast("bigint").alias("total_samples"))
