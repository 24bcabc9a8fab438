"""Registered queries: per-address scoring layers, blend, levels, alarms
(D2-D4, D9-D17, D20, J1, J2, K1, K2, A10) over the ``v_ip`` binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.config import DEFAULT_THRESHOLDS, FEATURE_WEIGHTS, LEVELS
from lookout.operators import scoring as S
from lookout.plans.catalog import register
from lookout.session import cut_lineage
from lookout.sources import tables as T

FEATS = ["Nombre_Tentatives", "Nombre_Erreurs"]
VIEWS = ("v_ip", "v_votes")


def features(spark, sf):
    """Per-address feature table with the detector's column names,
    materialised once (every layer and statistic re-reads it)."""
    return cut_lineage(T.v_ip(spark, sf).select(F.col("ip").alias("IP_Source"),
                                    F.col("attempts").alias("Nombre_Tentatives"),
                                    F.col("errors").alias("Nombre_Erreurs"),
                                    F.col("first_ts").alias("Date")))


def blacklist(spark, sf):
    """Remembered addresses of an earlier run: those above 300 attempts."""
    return T.v_ip(spark, sf).where(F.col("attempts") > 300).select("ip")


def with_votes(df):
    """Model votes of the binding (same rule as ``v_votes``), as columns."""
    a = F.col("Nombre_Tentatives")
    return df.withColumns({
        "v_if": F.when(a > 250, 1).otherwise(0), "v_lof": F.when(a > 180, 1).otherwise(0),
        "v_svm": F.when((a > 100) | (a == 1), 1).otherwise(0), "v_db": F.when(a > 300, 1).otherwise(0),
        "cont_if": a.cast("double") / 500})


def layers(f, bl):
    """All five layer scores of a materialised feature table ``f``."""
    stats = S.attach(S.global_stats(f, FEATS))
    votes = with_votes(f)
    weights = S.attach(S.model_weights(votes))  # numeric plan only: cheap subquery
    df = S.blend_votes(votes, weights)
    df = S.temporal_score(df, FEATS, stats)
    df = S.memory_score(df, bl)
    df = S.rule_score(df, FEATS)
    return S.contribution_score(df, FEATS, stats)


def scored_from(f, bl):
    """Scored per-address table, materialised once: alarms, levels, lists
    and summaries are all read from it."""
    return cut_lineage(S.levels(S.final_score(layers(f, bl))))


def scored(spark, sf):
    return scored_from(features(spark, sf), blacklist(spark, sf))


def as_of(f):
    return F.date_format(f.agg(F.max("Date").alias("m")).scalar(), "yyyy-MM-dd'T'HH:mm:ss")


# ------------------------------------------------------------------ oracle SQL pieces

def d(x):
    return f"CAST({x} AS DOUBLE)"


def _thr(f):
    return float(DEFAULT_THRESHOLDS.get(f, 50.0))


def _w(f):
    return float(FEATURE_WEIGHTS.get(f, 0.1))


STATS_SQL = "st AS (SELECT count(*) AS n, " + ", ".join(
    f"avg({d(f)}) AS m_{i}, stddev_pop({d(f)}) AS sp_{i}, stddev_samp({d(f)}) AS ss_{i}, "
    f"quantile_cont({d(f)}, 0.99) AS q_{i}" for i, f in enumerate(FEATS)) + " FROM f)"

FEAT_SQL = """f AS (SELECT ip AS IP_Source, attempts AS Nombre_Tentatives, errors AS Nombre_Erreurs,
  first_ts AS Date FROM v_ip)"""


def _c1_terms():
    terms, reasons = [], []
    for f in FEATS:
        s, w = _thr(f), _w(f)
        c = f"({w} * least(({d(f)} - {s}) / {max(s, 1.0)}, 1.0))"
        terms.append(f"(CASE WHEN {d(f)} > {s} THEN {c} ELSE 0.0 END)")
        reasons.append(f"CASE WHEN {d(f)} > {s} THEN format('{f}={{:.1f}} > seuil={s:.1f} (+{{:.2f}})', "
                       f"{d(f)}, {c}) END")
    return " + ".join(terms), ", ".join(reasons)


C1_SUM, C1_REASONS = _c1_terms()


def _c3():
    parts = ["(CASE WHEN hour(Date) BETWEEN 0 AND 5 THEN 0.35 ELSE 0.0 END)"]
    for i, f in enumerate(FEATS):
        z = f"abs(({d(f)} - m_{i}) / ss_{i})"
        parts.append(f"(CASE WHEN ss_{i} > 0 THEN CASE WHEN {z} > 3 THEN 0.35 WHEN {z} > 2 THEN 0.15 ELSE 0.0 END "
                     f"ELSE 0.0 END)")
        parts.append(f"(CASE WHEN {d(f)} > q_{i} THEN 0.25 ELSE 0.0 END)")
    return "least(" + " + ".join(parts) + ", 1.0)"


def _c5():
    items = []
    for i, f in enumerate(FEATS):
        c = f"(CASE WHEN m_{i} > 0 THEN {_w(f)} * greatest(({d(f)} - m_{i}) / m_{i}, 0.0) ELSE 0.0 END)"
        items.append(f"struct_pack(neg := -{c}, pos := {i}, c := {c}, t := '{f}=' || format('{{:.0f}}', {d(f)}))")
    return "list_sort([" + ", ".join(items) + "])"


LAYERS_SQL = f"""{FEAT_SQL}, {STATS_SQL},
bl AS (SELECT DISTINCT ip FROM v_ip WHERE attempts > 300),
wv AS (SELECT avg(CAST(v_if = v_lof AS DOUBLE)) AS a1, avg(CAST(v_if = v_svm AS DOUBLE)) AS a2,
  avg(CAST(v_lof = v_svm AS DOUBLE)) AS a3 FROM v_votes),
ww AS (SELECT *, a1 + a2 + a3 AS t, (a1 + a2) / (2 * (a1 + a2 + a3)) AS p_if, (a1 + a3) / (2 * (a1 + a2 + a3)) AS p_lof,
  (a2 + a3) / (2 * (a1 + a2 + a3)) AS p_svm FROM wv),
w AS (SELECT CASE WHEN t = 0 THEN 0.40 ELSE round_even(p_if * 0.85 / (p_if + p_lof + p_svm), 3) END AS w_if,
  CASE WHEN t = 0 THEN 0.25 ELSE round_even(p_lof * 0.85 / (p_if + p_lof + p_svm), 3) END AS w_lof,
  CASE WHEN t = 0 THEN 0.20 ELSE round_even(p_svm * 0.85 / (p_if + p_lof + p_svm), 3) END AS w_svm,
  0.15 AS w_db FROM ww),
lay AS (SELECT f.*, least({C1_SUM}, 1.0) AS s_c1,
  COALESCE(NULLIF(concat_ws(' | ', {C1_REASONS}), ''), 'RAS') AS raisons_c1,
  {_c3()} AS s_c3,
  CASE WHEN bl.ip IS NOT NULL THEN 0.85 ELSE 0.0 END AS s_c4,
  {_c5()} AS c5l,
  least(greatest(w_if * v.v_if * v.cont + w_lof * v.v_lof + w_svm * v.v_svm + w_db * v.v_db, 0.0), 1.0) AS s_c2,
  v.attempts AS _a
  FROM f CROSS JOIN st CROSS JOIN w JOIN v_votes v ON v.ip = f.IP_Source LEFT JOIN bl ON bl.ip = f.IP_Source),
lay2 AS (SELECT *, least(list_reduce(list_transform(c5l, lambda x: x.c), lambda a, b: a + b), 1.0) AS s_c5,
  CASE WHEN c5l[1].c > 0 THEN 'Causes : ' || array_to_string(list_transform(list_filter(c5l[1:3], lambda x: x.c > 0), lambda x: x.t), ' | ')
       ELSE 'Comportement normal' END AS explication FROM lay),
sc AS (SELECT *, least(greatest(0.25 * s_c1 + 0.40 * s_c2 + 0.20 * s_c3 + 0.10 * s_c4 + 0.05 * s_c5, 0.0), 1.0) AS score_raw
  FROM lay2),
lv AS (SELECT *, round_even(s_c1, 4) AS score_c1, round_even(s_c2, 4) AS score_c2, round_even(s_c3, 4) AS score_c3,
  round_even(s_c4, 4) AS score_c4, round_even(s_c5, 4) AS score_c5, round_even(score_raw, 4) AS score_final,
  CASE {' '.join(f"WHEN score_raw >= {c} THEN '{n}'" for c, n, _ in LEVELS)} END AS niveau_alerte,
  CASE {' '.join(f"WHEN score_raw >= {c} THEN '{e}'" for c, _, e in LEVELS)} END AS emoji_alerte,
  CASE WHEN score_raw >= 0.3 THEN -1 ELSE 1 END AS anomalie, -score_raw AS anomalie_score FROM sc)"""


def q(sql):
    if sql.startswith("WITH "):
        return f"WITH {LAYERS_SQL},\n{sql[5:]}"
    return f"WITH {LAYERS_SQL}\n{sql}"


# ------------------------------------------------------------------ registrations

@register("d2_standard_scaling", f"""WITH {FEAT_SQL}, {STATS_SQL}
SELECT IP_Source, round_even(({d('Nombre_Tentatives')} - m_0) / CASE WHEN sp_0 = 0 OR sp_0 IS NULL THEN 1.0 ELSE sp_0 END, 6)
  AS x_Nombre_Tentatives,
  round_even(({d('Nombre_Erreurs')} - m_1) / CASE WHEN sp_1 = 0 OR sp_1 IS NULL THEN 1.0 ELSE sp_1 END, 6) AS x_Nombre_Erreurs
FROM f CROSS JOIN st""", views=VIEWS)
def d2_standard_scaling(spark, sf):
    f = features(spark, sf)
    out = S.scale(f, FEATS, S.attach(S.global_stats(f, FEATS, quantiles=False)))
    return out.select("IP_Source", *[F.bround("x_" + x, 6).alias("x_" + x) for x in FEATS])


@register("d3_contamination", """SELECT least(0.20, greatest(0.05,
  CAST(count(CASE WHEN attempts > 50 THEN 1 END) AS DOUBLE) / greatest(count(*), 1))) AS contamination FROM v_ip""",
          views=("v_ip",))
def d3_contamination(spark, sf):
    return S.contamination(features(spark, sf), "Nombre_Tentatives", DEFAULT_THRESHOLDS["Nombre_Tentatives"])


@register("d4_rule_score", q("SELECT IP_Source, score_c1, raisons_c1 FROM lv"), views=VIEWS)
def d4_rule_score(spark, sf):
    return scored(spark, sf).select("IP_Source", "score_c1", "raisons_c1")


@register("j2_global_stats", f"""WITH {FEAT_SQL}, {STATS_SQL}
SELECT IP_Source, Nombre_Tentatives, round_even(m_0, 6) AS mean, round_even(ss_0, 6) AS std, round_even(q_0, 6) AS q99
FROM f CROSS JOIN st""", views=VIEWS)
def j2_global_stats(spark, sf):
    f = features(spark, sf)
    s = S.attach(S.global_stats(f, FEATS))
    return f.select("IP_Source", "Nombre_Tentatives", F.bround(s["Nombre_Tentatives__mean"], 6).alias("mean"),
                    F.bround(s["Nombre_Tentatives__std"], 6).alias("std"),
                    F.bround(s["Nombre_Tentatives__q99"], 6).alias("q99"))


@register("d11_temporal", q("SELECT IP_Source, score_c3 FROM lv"), views=VIEWS)
def d11_temporal(spark, sf):
    return scored(spark, sf).select("IP_Source", "score_c3")


@register("j1_blacklist_flag", q("SELECT IP_Source, score_c4 FROM lv"), views=VIEWS)
def j1_blacklist_flag(spark, sf):
    return scored(spark, sf).select("IP_Source", "score_c4")


@register("d12_contribution", q("SELECT IP_Source, score_c5, explication FROM lv"), views=VIEWS)
def d12_contribution(spark, sf):
    return scored(spark, sf).select("IP_Source", "score_c5", "explication")


@register("d9_model_weights", """WITH wv AS (SELECT avg(CAST(v_if = v_lof AS DOUBLE)) AS a1, avg(CAST(v_if = v_svm AS DOUBLE)) AS a2,
  avg(CAST(v_lof = v_svm AS DOUBLE)) AS a3 FROM v_votes),
ww AS (SELECT *, a1 + a2 + a3 AS t, (a1 + a2) / (2 * (a1 + a2 + a3)) AS p_if, (a1 + a3) / (2 * (a1 + a2 + a3)) AS p_lof,
  (a2 + a3) / (2 * (a1 + a2 + a3)) AS p_svm FROM wv)
SELECT a1 AS a_if_lof, a2 AS a_if_svm, a3 AS a_lof_svm,
  CASE WHEN t = 0 THEN 0.40 ELSE round_even(p_if * 0.85 / (p_if + p_lof + p_svm), 3) END AS w_if,
  CASE WHEN t = 0 THEN 0.25 ELSE round_even(p_lof * 0.85 / (p_if + p_lof + p_svm), 3) END AS w_lof,
  CASE WHEN t = 0 THEN 0.20 ELSE round_even(p_svm * 0.85 / (p_if + p_lof + p_svm), 3) END AS w_svm,
  0.15 AS w_dbscan FROM ww""", views=("v_votes",))
def d9_model_weights(spark, sf):
    return S.model_weights(T.v_votes(spark, sf))


@register("d10_blended_vote", q("SELECT IP_Source, score_c2 FROM lv"), views=VIEWS)
def d10_blended_vote(spark, sf):
    return scored(spark, sf).select("IP_Source", "score_c2")


@register("d13_final_score", q("""SELECT IP_Source, score_c1, score_c2, score_c3, score_c4, score_c5, score_final
FROM lv"""), views=VIEWS)
def d13_final_score(spark, sf):
    return scored(spark, sf).select("IP_Source", "score_c1", "score_c2", "score_c3", "score_c4", "score_c5",
                                    "score_final")


@register("d14_levels", q("""SELECT IP_Source, niveau_alerte, emoji_alerte, anomalie,
  round_even(anomalie_score, 6) AS anomalie_score FROM lv"""), views=VIEWS)
def d14_levels(spark, sf):
    return scored(spark, sf).select("IP_Source", "niveau_alerte", "emoji_alerte", "anomalie",
                                    F.bround("anomalie_score", 6).alias("anomalie_score"))


@register("k1_anomaly_list", q("""SELECT IP_Source, score_final FROM lv WHERE score_final >= 0.3
ORDER BY score_final DESC, IP_Source"""), views=VIEWS)
def k1_anomaly_list(spark, sf):
    return S.anomalies(scored(spark, sf)).select("IP_Source", "score_final")


ALARMS_SQL = """SELECT (SELECT strftime(max(Date), '%Y-%m-%dT%H:%M:%S') FROM f) AS timestamp, COALESCE(IP_Source, 'N/A') AS ip,
  niveau_alerte AS niveau, score_final, score_c1, score_c2, score_c3, score_c4, explication, raisons_c1 AS raisons,
  CASE WHEN score_final >= 0.7 THEN 'CRITIQUE' ELSE 'AVERTISSEMENT' END AS severite,
  emoji_alerte || ' ' || niveau_alerte || ' | IP=' || COALESCE(IP_Source, 'N/A') || ' | Score=' || format('{:.2f}', score_final)
    || ' | ' || explication AS message,
  'DÉTECTION ' || niveau_alerte AS type, CAST(_a AS DOUBLE) AS valeur, 50.0 AS seuil
FROM lv WHERE score_final >= 0.3 AND niveau_alerte IN ('CRITIQUE', 'ANOMALIE')"""


def alarm_table(spark, sf, f=None, sc=None):
    f = f if f is not None else features(spark, sf)
    sc = sc if sc is not None else scored_from(f, blacklist(spark, sf))
    return S.alarms(sc, DEFAULT_THRESHOLDS["Nombre_Tentatives"], as_of=as_of(f))


@register("d15_alarms", q(ALARMS_SQL), views=VIEWS)
def d15_alarms(spark, sf):
    return alarm_table(spark, sf)


@register("k2_critical_alarms", q(f"""WITH al AS ({ALARMS_SQL})
SELECT ip, type, valeur, severite FROM al WHERE severite = 'CRITIQUE' ORDER BY score_final DESC, ip LIMIT 5"""),
          views=VIEWS)
def k2_critical_alarms(spark, sf):
    return S.critical_alarms(alarm_table(spark, sf))


@register("d16_critical_ips", q("SELECT DISTINCT IP_Source AS ip FROM lv WHERE niveau_alerte = 'CRITIQUE' "
                                "AND IP_Source IS NOT NULL"), views=VIEWS)
def d16_critical_ips(spark, sf):
    return S.critical_ips(scored(spark, sf))


@register("a10_score_summary", q("""SELECT CAST(count(CASE WHEN score_raw >= 0.7 THEN 1 END) AS BIGINT) AS n_critique,
  CAST(count(CASE WHEN score_raw >= 0.5 AND score_raw < 0.7 THEN 1 END) AS BIGINT) AS n_anomalie,
  CAST(count(CASE WHEN score_raw >= 0.3 AND score_raw < 0.5 THEN 1 END) AS BIGINT) AS n_suspect,
  CAST(count(CASE WHEN score_raw < 0.3 THEN 1 END) AS BIGINT) AS n_normal,
  round_even(avg(score_raw), 6) AS score_mean, round_even(max(score_raw), 6) AS score_max FROM lv"""), views=VIEWS)
def a10_score_summary(spark, sf):
    from lookout.operators.metrics import score_summary
    out = score_summary(scored(spark, sf))
    return out.withColumns({"score_mean": F.bround("score_mean", 6), "score_max": F.bround("score_max", 6)})


@register("d17_thresholds", f"""WITH {FEAT_SQL}, {STATS_SQL}
SELECT 'Nombre_Tentatives' AS feature, CASE WHEN ss_0 > 0 AND n > 30 THEN round_even(0.7 * 50.0 + 0.3 * (m_0 + 2 * ss_0), 2)
  ELSE 50.0 END AS seuil FROM st
UNION ALL SELECT 'Nombre_Erreurs', CASE WHEN ss_1 > 0 AND n > 30 THEN round_even(0.7 * 200.0 + 0.3 * (m_1 + 2 * ss_1), 2)
  ELSE 200.0 END FROM st""", views=VIEWS)
def d17_thresholds(spark, sf):
    return S.updated_thresholds(features(spark, sf), FEATS)


@register("d20_training_counters", """SELECT strftime(session_day, '%Y-%m-%d') AS session_day,
  CAST(count(*) OVER (ORDER BY session_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sessions,
  CAST(sum(n) OVER (ORDER BY session_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_samples
FROM v_sessions""", views=("v_sessions",))
def d20_training_counters(spark, sf):
    out = S.training_counters(T.v_sessions(spark, sf), "session_day", "n")
    return out.withColumn("session_day", F.date_format("session_day", "yyyy-MM-dd"))
