"""Registered queries: density votes, silhouette, session row, forest and
the full detector (D5-D8, D18, D19, D21, D22) on scaled attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookout.config import DEFAULT, DEFAULT_THRESHOLDS
from lookout.operators import density, iforest, neighbours
from lookout.operators import scoring as S
from lookout.plans.catalog import register
from lookout.plans.events import CANON_SQL
from lookout.plans.scoring import FEAT_SQL, as_of, features, q as scored_sql, scored
from lookout.operators.ensemble import detect
from lookout.session import cut_lineage, scratch, written
from lookout.sources import tables as T

X = "x_Nombre_Tentatives"


def wire_features(spark, sf):
    """A4 on the canonical wire events: errors per address and first date."""
    from lookout.operators.metrics import ip_features
    from lookout.plans.events import canonical_wire
    return ip_features(canonical_wire(spark, sf))


def scaled(spark, sf):
    f = features(spark, sf)
    return S.scale(f, ["Nombre_Tentatives"], S.attach(S.global_stats(f, ["Nombre_Tentatives"], quantiles=False)))


def contamination_of(df) -> float:
    """D3 value (one aggregate row) as a plain number for the model fits."""
    return float(S.contamination(df, "Nombre_Tentatives", DEFAULT_THRESHOLDS["Nombre_Tentatives"]).first()[0])


X_SQL = f"""{FEAT_SQL},
st AS (SELECT avg(CAST(Nombre_Tentatives AS DOUBLE)) AS m, stddev_pop(CAST(Nombre_Tentatives AS DOUBLE)) AS sp, count(*) AS n,
  least(0.20, greatest(0.05, CAST(count(CASE WHEN Nombre_Tentatives > 50 THEN 1 END) AS DOUBLE) / greatest(count(*), 1))) AS c FROM f),
x AS (SELECT IP_Source, (CAST(Nombre_Tentatives AS DOUBLE) - m) / CASE WHEN sp = 0 OR sp IS NULL THEN 1.0 ELSE sp END AS x,
  row_number() OVER (ORDER BY IP_Source) AS id FROM f CROSS JOIN st)"""


def quantile_sql(name: str, rel: str, col: str, p_expr: str) -> str:
    """Linear-interpolated quantile (numpy / Spark ``percentile``) at a
    data-derived fraction, as two CTEs; result column ``q`` of ``name``."""
    return f"""{name}_o AS (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS i, count(*) OVER () AS n FROM {rel}),
{name}_h AS (SELECT *, (n - 1) * ({p_expr}) AS h FROM {name}_o),
{name} AS (SELECT max(CASE WHEN i = floor(h) THEN v END)
  + (h - floor(h)) * (max(CASE WHEN i = least(floor(h) + 1, n - 1) THEN v END) - max(CASE WHEN i = floor(h) THEN v END)) AS q
  FROM {name}_h GROUP BY h, n)"""


# ------------------------------------------------------------------ D8

@register("d8_dbscan_noise", f"""WITH {X_SQL},
c AS (SELECT *, count(*) OVER (ORDER BY x RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) >= 5 AS core FROM x),
nz AS (SELECT *, max(CAST(core AS INT)) OVER (ORDER BY x RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) = 0 AS noise FROM c)
SELECT IP_Source, CAST(core AS INT) AS core, CAST(noise AS INT) AS noise FROM nz""", views=("v_ip",))
def d8_dbscan_noise(spark, sf):
    x = scaled(spark, sf)
    h = density.dbscan_noise(x, X, DEFAULT.eps, DEFAULT.min_samples)
    return x.join(h, x[X] == h["x"]).select("IP_Source", F.col("core").cast("int").alias("core"),
                                            F.col("noise").cast("int").alias("noise"))


@register("d8_dbscan_noise_2d", f"""WITH {FEAT_SQL},
st AS (SELECT avg(CAST(Nombre_Tentatives AS DOUBLE)) AS m0, stddev_pop(CAST(Nombre_Tentatives AS DOUBLE)) AS s0,
  avg(CAST(Nombre_Erreurs AS DOUBLE)) AS m1, stddev_pop(CAST(Nombre_Erreurs AS DOUBLE)) AS s1 FROM f),
x AS (SELECT IP_Source, (CAST(Nombre_Tentatives AS DOUBLE) - m0) / CASE WHEN s0 = 0 OR s0 IS NULL THEN 1.0 ELSE s0 END AS x0,
  (CAST(Nombre_Erreurs AS DOUBLE) - m1) / CASE WHEN s1 = 0 OR s1 IS NULL THEN 1.0 ELSE s1 END AS x1 FROM f CROSS JOIN st),
c AS (SELECT a.IP_Source, a.x0, a.x1, count(*) >= 5 AS core FROM x a CROSS JOIN x b
  WHERE (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) <= 0.25 GROUP BY a.IP_Source, a.x0, a.x1),
nz AS (SELECT a.IP_Source, a.core, NOT bool_or(b.core) AS noise FROM c a CROSS JOIN c b
  WHERE (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) <= 0.25 GROUP BY a.IP_Source, a.core)
SELECT IP_Source, CAST(core AS INT) AS core, CAST(noise AS INT) AS noise FROM nz""", views=("v_ip",))
def d8_dbscan_noise_2d(spark, sf):
    f = features(spark, sf)
    feats = ["Nombre_Tentatives", "Nombre_Erreurs"]
    x = S.scale(f, feats, S.attach(S.global_stats(f, feats, quantiles=False)))
    xs = ["x_" + c for c in feats]
    h = density.dbscan_noise_nd(x, xs, DEFAULT.eps, DEFAULT.min_samples)
    return x.join(h, xs).select("IP_Source", F.col("core").cast("int").alias("core"),
                                F.col("noise").cast("int").alias("noise"))


# ------------------------------------------------------------------ D6

LOF_SQL = f"""WITH {X_SQL.replace("(CAST(Nombre_Tentatives AS DOUBLE) - m) / CASE WHEN sp = 0 OR sp IS NULL THEN 1.0 ELSE sp END AS x",
                               "CAST(Nombre_Tentatives AS DOUBLE) AS x")},
kk AS (SELECT least(20, n - 1) AS k FROM st),
pf AS (SELECT a.id AS aid, b.id AS bid, abs(a.x - b.x) AS d, b.x AS bx FROM x a JOIN x b ON a.id <> b.id),
nf AS (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY aid ORDER BY d, bx, bid) <= (SELECT k FROM kk)),
kd AS (SELECT aid AS id, max(d) AS kdist FROM nf GROUP BY aid),
lr AS (SELECT nf.aid AS id, 1.0 / (avg(greatest(kd.kdist, nf.d)) + 1e-10) AS lrd FROM nf JOIN kd ON kd.id = nf.bid GROUP BY nf.aid),
lf AS (SELECT nf.aid AS id, avg(l2.lrd) / any_value(l1.lrd) AS lof_fit FROM nf JOIN lr l2 ON l2.id = nf.bid
  JOIN lr l1 ON l1.id = nf.aid GROUP BY nf.aid),
ps AS (SELECT a.id AS aid, b.id AS bid, abs(a.x - b.x) AS d, b.x AS bx FROM x a CROSS JOIN x b),
ns AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY aid ORDER BY d, bx, bid) <= (SELECT k FROM kk)),
ls AS (SELECT ns.aid AS id, avg(lr.lrd) * (avg(greatest(kd.kdist, ns.d)) + 1e-10) AS lof_score
  FROM ns JOIN kd ON kd.id = ns.bid JOIN lr ON lr.id = ns.bid GROUP BY ns.aid),
neg AS (SELECT -lof_fit AS v FROM lf),
{quantile_sql('off', 'neg', 'v', '(SELECT c FROM st)')}
SELECT x.IP_Source, round_even(lf.lof_fit, 6) AS lof_fit, round_even(ls.lof_score, 6) AS lof_score,
  CAST(-ls.lof_score < (SELECT q FROM off) AS INT) AS vote
FROM x JOIN lf ON lf.id = x.id JOIN ls ON ls.id = x.id"""


@register("d6_lof_vote", LOF_SQL, views=("v_ip",))
def d6_lof_vote(spark, sf):
    # LOF is invariant to uniform scaling; on the raw counts the distances are
    # exact, so neighbour ties break the same way in every engine.
    x = features(spark, sf).withColumn("raw", F.col("Nombre_Tentatives").cast("double"))
    n = x.count()
    res = density.lof(x, "raw", min(DEFAULT.lof_k, n - 1), contamination_of(x))
    return x.join(res, x["raw"] == res["x"]).select(
        "IP_Source", F.bround("lof_fit", 6).alias("lof_fit"), F.bround("lof_score", 6).alias("lof_score"),
        F.col("vote").cast("int").alias("vote"))


# the scaled features are rounded, so that distances, and with them ties, are the same in every engine
LOF2_SQL = f"""WITH {FEAT_SQL},
st AS (SELECT avg(CAST(Nombre_Tentatives AS DOUBLE)) AS m0, stddev_pop(CAST(Nombre_Tentatives AS DOUBLE)) AS s0,
  avg(CAST(Nombre_Erreurs AS DOUBLE)) AS m1, stddev_pop(CAST(Nombre_Erreurs AS DOUBLE)) AS s1, count(*) AS n,
  least(0.20, greatest(0.05, CAST(count(CASE WHEN Nombre_Tentatives > 50 THEN 1 END) AS DOUBLE) / greatest(count(*), 1))) AS c
  FROM f),
x AS (SELECT IP_Source, round_even((CAST(Nombre_Tentatives AS DOUBLE) - m0) / CASE WHEN s0 = 0 OR s0 IS NULL THEN 1.0 ELSE s0 END, 6) AS x0,
  round_even((CAST(Nombre_Erreurs AS DOUBLE) - m1) / CASE WHEN s1 = 0 OR s1 IS NULL THEN 1.0 ELSE s1 END, 6) AS x1,
  row_number() OVER (ORDER BY IP_Source) AS id FROM f CROSS JOIN st),
kk AS (SELECT least(20, n - 1) AS k FROM st),
ps AS (SELECT a.id AS aid, b.id AS bid, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) AS d, b.x0, b.x1 FROM x a CROSS JOIN x b),
nf AS (SELECT * FROM ps WHERE aid <> bid QUALIFY row_number() OVER (PARTITION BY aid ORDER BY d, x0, x1, bid) <= (SELECT k FROM kk)),
ns AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY aid ORDER BY d, x0, x1, bid) <= (SELECT k FROM kk)),
kd AS (SELECT aid AS id, max(d) AS kdist FROM nf GROUP BY aid),
lr AS (SELECT nf.aid AS id, 1.0 / (avg(greatest(kd.kdist, nf.d)) + 1e-10) AS lrd FROM nf JOIN kd ON kd.id = nf.bid GROUP BY nf.aid),
lf AS (SELECT nf.aid AS id, round_even(avg(l2.lrd) / any_value(l1.lrd), 9) AS lof_fit FROM nf JOIN lr l2 ON l2.id = nf.bid
  JOIN lr l1 ON l1.id = nf.aid GROUP BY nf.aid),
ls AS (SELECT ns.aid AS id, round_even(avg(lr.lrd) * (avg(greatest(kd.kdist, ns.d)) + 1e-10), 9) AS lof_score
  FROM ns JOIN kd ON kd.id = ns.bid JOIN lr ON lr.id = ns.bid GROUP BY ns.aid),
neg AS (SELECT -lof_fit AS v FROM lf),
{quantile_sql('off', 'neg', 'v', '(SELECT c FROM st)')}
SELECT x.IP_Source, round_even(lf.lof_fit, 6) AS lof_fit, round_even(ls.lof_score, 6) AS lof_score,
  CAST(-ls.lof_score < (SELECT q FROM off) AS INT) AS vote
FROM x JOIN lf ON lf.id = x.id JOIN ls ON ls.id = x.id"""


@register("d6_lof_vote_2d", LOF2_SQL, views=("v_ip",))
def d6_lof_vote_2d(spark, sf):
    f = features(spark, sf)
    feats = ["Nombre_Tentatives", "Nombre_Erreurs"]
    xs = ["x_" + c for c in feats]
    x = S.scale(f, feats, S.attach(S.global_stats(f, feats, quantiles=False)))
    x = cut_lineage(x.withColumns({c: F.bround(c, 6) for c in xs}))
    res = neighbours.lof_nd(x, xs, min(DEFAULT.lof_k, x.count() - 1), contamination_of(f))
    return x.join(res, xs).select("IP_Source", F.bround("lof_fit", 6).alias("lof_fit"),
                                  F.bround("lof_score", 6).alias("lof_score"), "vote")


# ------------------------------------------------------------------ D7

@register("d7_kernel_vote", f"""WITH {X_SQL},
gm AS (SELECT CASE WHEN var_pop(x) > 0 THEN 1.0 / var_pop(x) ELSE 1.0 END AS g FROM x),
dn AS (SELECT a.IP_Source, avg(exp(-(SELECT g FROM gm) * (a.x - b.x) * (a.x - b.x))) AS density
  FROM x a CROSS JOIN x b GROUP BY a.IP_Source),
{quantile_sql('qd', 'dn', 'density', '(SELECT c FROM st)')}
SELECT IP_Source, round_even(density, 6) AS density, CAST(density < (SELECT q FROM qd) AS INT) AS vote FROM dn""",
          views=("v_ip",))
def d7_kernel_vote(spark, sf):
    x = scaled(spark, sf)
    res = density.kernel_novelty(x, X, contamination_of(x))
    return x.join(res, x[X] == res["x"]).select("IP_Source", F.bround("density", 6).alias("density"),
                                                F.col("vote").cast("int").alias("vote"))


X2_SQL = f"""{FEAT_SQL},
st AS (SELECT avg(CAST(Nombre_Tentatives AS DOUBLE)) AS m0, stddev_pop(CAST(Nombre_Tentatives AS DOUBLE)) AS s0,
  avg(CAST(Nombre_Erreurs AS DOUBLE)) AS m1, stddev_pop(CAST(Nombre_Erreurs AS DOUBLE)) AS s1,
  least(0.20, greatest(0.05, CAST(count(CASE WHEN Nombre_Tentatives > 50 THEN 1 END) AS DOUBLE) / greatest(count(*), 1))) AS c
  FROM f),
x AS (SELECT IP_Source, (CAST(Nombre_Tentatives AS DOUBLE) - m0) / CASE WHEN s0 = 0 OR s0 IS NULL THEN 1.0 ELSE s0 END AS x0,
  (CAST(Nombre_Erreurs AS DOUBLE) - m1) / CASE WHEN s1 = 0 OR s1 IS NULL THEN 1.0 ELSE s1 END AS x1 FROM f CROSS JOIN st)"""


@register("d7_kernel_vote_2d", f"""WITH {X2_SQL},
vv AS (SELECT var_pop(v) AS v FROM (SELECT x0 AS v FROM x UNION ALL SELECT x1 FROM x)),
gm AS (SELECT CASE WHEN v > 0 THEN 1.0 / (2 * v) ELSE 1.0 END AS g FROM vv),
dn AS (SELECT a.IP_Source, avg(exp(-(SELECT g FROM gm) * ((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1))))
  AS density FROM x a CROSS JOIN x b GROUP BY a.IP_Source),
{quantile_sql('qd', 'dn', 'density', '(SELECT c FROM st)')}
SELECT IP_Source, round_even(density, 6) AS density, CAST(density < (SELECT q FROM qd) AS INT) AS vote FROM dn""",
          views=("v_ip",))
def d7_kernel_vote_2d(spark, sf):
    f = features(spark, sf)
    feats = ["Nombre_Tentatives", "Nombre_Erreurs"]
    x = S.scale(f, feats, S.attach(S.global_stats(f, feats, quantiles=False)))
    xs = ["x_" + c for c in feats]
    res = density.kernel_novelty_nd(x, xs, contamination_of(f))
    return x.join(res, xs).select("IP_Source", F.bround("density", 6).alias("density"),
                                  F.col("vote").cast("int").alias("vote"))


# ------------------------------------------------------------------ D19, D18

def _silhouette_sql(label_sql: str, source: str) -> str:
    return f"""lab AS (SELECT x, CASE WHEN {label_sql} THEN 0 ELSE 1 END AS l, IP_Source FROM {source}),
cnt AS (SELECT l, count(*) AS m FROM lab GROUP BY l),
pr AS (SELECT a.IP_Source, a.l, sum(CASE WHEN b.l = a.l THEN abs(a.x - b.x) ELSE 0 END) AS sa,
  sum(CASE WHEN b.l <> a.l THEN abs(a.x - b.x) ELSE 0 END) AS sb FROM lab a CROSS JOIN lab b GROUP BY a.IP_Source, a.l),
sv AS (SELECT pr.*, mo.m AS m_own, sa / (mo.m - 1) AS a, sb / mt.m AS b FROM pr JOIN cnt mo ON mo.l = pr.l JOIN cnt mt ON mt.l <> pr.l),
sil AS (SELECT CASE WHEN (SELECT count(*) FROM cnt) = 2 AND (SELECT min(m) FROM cnt) >= 2
  THEN round_even(avg(CASE WHEN m_own > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END), 4) END AS silhouette
  FROM sv)"""


@register("d19_silhouette", f"""WITH {X_SQL}, xv AS (SELECT x.*, f.Nombre_Tentatives FROM x JOIN f USING (IP_Source)),
{_silhouette_sql('Nombre_Tentatives > 180', 'xv')}
SELECT silhouette FROM sil""", views=("v_ip",))
def d19_silhouette(spark, sf):
    x = scaled(spark, sf).withColumn("label", F.when(F.col("Nombre_Tentatives") > 180, -1).otherwise(1))
    return density.silhouette_1d(x, X, "label")


def perf_row(spark, sf):
    from lookout.plans.scoring import blacklist, scored_from
    f = features(spark, sf)
    sc = scored_from(f, blacklist(spark, sf))
    st = S.attach(S.global_stats(f, ["Nombre_Tentatives"], quantiles=False))
    lab = S.scale(sc, ["Nombre_Tentatives"], st).withColumn(
        "label", F.when(F.col("score_raw") >= 0.3, -1).otherwise(1))
    sil = density.silhouette_1d(lab, X, "label").scalar()
    bl = T_blacklist_size(spark, sf)
    session = T.v_sessions(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()  # each day is a session
    return S.session_performance(sc, bl, sil, session, as_of(f))


def T_blacklist_size(spark, sf):
    from lookout.plans.scoring import blacklist
    return blacklist(spark, sf).agg(F.count_distinct("ip").alias("n")).scalar()


@register("d18_session_performance", scored_sql(f"""WITH xst AS (SELECT avg(CAST(Nombre_Tentatives AS DOUBLE)) AS m2,
  stddev_pop(CAST(Nombre_Tentatives AS DOUBLE)) AS sp2 FROM lv),
xs AS (SELECT IP_Source, (CAST(Nombre_Tentatives AS DOUBLE) - m2) / CASE WHEN sp2 = 0 OR sp2 IS NULL THEN 1.0 ELSE sp2 END AS x,
  score_raw FROM lv CROSS JOIN xst),
{_silhouette_sql('score_raw >= 0.3', 'xs')}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM v_sessions) AS session, (SELECT strftime(max(Date), '%Y-%m-%dT%H:%M:%S') FROM f) AS timestamp,
  CAST(count(*) AS BIGINT) AS nb_echantillons, round_even(avg(CASE WHEN score_raw >= 0.3 THEN 1.0 ELSE 0.0 END) * 100, 2)
  AS taux_anomalies, round_even(avg(score_raw), 4) AS score_moyen, round_even(max(score_raw), 4) AS score_max,
  (SELECT CAST(count(DISTINCT ip) AS BIGINT) FROM bl) AS nb_blacklistes, (SELECT silhouette FROM sil) AS silhouette
FROM lv HAVING count(*) >= 3"""), views=("v_ip", "v_votes", "v_sessions"))
def d18_session_performance(spark, sf):
    return perf_row(spark, sf)


# ------------------------------------------------------------------ D5, D21, D22 (no SQL oracle: randomised forest)

@register("d5_iforest")
def d5_iforest(spark, sf):
    x = scaled(spark, sf)
    trees, psi = iforest.fit_forest(x, "IP_Source", [X], DEFAULT.n_trees, DEFAULT.sample_size, DEFAULT.seed)
    out = iforest.forest_votes(iforest.score_forest(x, trees, [X], psi), contamination_of(x))
    return out.select("IP_Source", F.bround("if_raw", 6).alias("if_raw"), "v_if",
                      F.bround("cont_if", 6).alias("cont_if"))


@register("d21_model_tables")
def d21_model_tables(spark, sf):
    x = scaled(spark, sf)
    trees, _ = iforest.fit_forest(x, "IP_Source", [X], DEFAULT.n_trees, DEFAULT.sample_size, DEFAULT.seed)
    return trees


@register("d22_full_detector")
def d22_full_detector(spark, sf):
    return detect(wire_features(spark, sf)).select(
        "IP_Source", "score_c1", "score_c2", "score_c3", "score_c4", "score_c5", "score_final",
        "niveau_alerte", "anomalie")


def two_runs(spark, sf, again: bool = False) -> str:
    """Two batches (first / second half of the month) through run_batch, the second one repeated
    if ``again``: a re-run replaces its own state, never adds to it. The folder of the stored state."""
    from lookout.operators import metrics, state
    from lookout.plans.events import canonical_wire
    root = scratch(spark, "state")
    # parsed once, for both tables of all runs
    canon = written(canonical_wire(spark, sf).select("event_id", "Date", "IP_Source", "Etat"), "canonical-events")
    half = F.col("Date") < F.lit("2024-01-16").cast("timestamp")
    for run_id, part in [("r1", canon.where(half))] + [("r2", canon.where(~half))] * (1 + again):
        state.run_batch(spark, metrics.ip_features(part), metrics.attempts_per_ip(part), root, run_id)
    return root


def _upd(mean: str, std: str, n: str, old: str) -> str:
    return f"CASE WHEN {std} > 0 AND {n} > 30 THEN round_even(0.7 * {old} + 0.3 * ({mean} + 2 * {std}), 2) ELSE {old} END"


@register("d21_stored_models", f"""WITH {CANON_SQL},
p AS (SELECT *, CASE WHEN Date < TIMESTAMP '2024-01-16' THEN 'r1' ELSE 'r2' END AS run FROM canon WHERE Date IS NOT NULL AND IP_Source IS NOT NULL),
a AS (SELECT run, IP_Source, CAST(count(*) AS DOUBLE) AS v, CAST(count(CASE WHEN Etat = 'Error' THEN 1 END) AS DOUBLE) AS e FROM p GROUP BY 1, 2),
s AS (SELECT run, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sp, stddev_samp(v) AS ss, avg(e) AS me, stddev_samp(e) AS se FROM a GROUP BY run),
t0 AS (SELECT {_upd('me', 'se', 'n', '50.0')} AS seuil FROM s WHERE run = 'r1'),
t1 AS (SELECT {_upd('m', 'ss', 'n', 't0.seuil')} AS seuil FROM s, t0 WHERE run = 'r1'),
t2 AS (SELECT {_upd('m', 'ss', 'n', 't1.seuil')} AS seuil FROM s, t1 WHERE run = 'r2')
SELECT run AS run_id, 'r1' AS scored_with, 'Nombre_Tentatives' AS feature, round_even(m, 6) AS mean, round_even(sp, 6) AS std,
  CASE WHEN run = 'r1' THEN (SELECT seuil FROM t1) ELSE (SELECT seuil FROM t2) END AS seuil FROM s""", views=("v_wire",))
def d21_stored_models(spark, sf):
    """Run r2 is scored with the models that r1 stored; both runs' scaler and thresholds."""
    root = two_runs(spark, sf)
    rd = lambda name, ddl: spark.read.schema(f"{ddl}, run_id string").parquet(f"{root}/{name}")
    par = rd("model_params", "name string, feature string, value double")
    scaler = par.where("feature <> ''").groupBy("run_id", "feature").agg(
        F.max(F.when(F.col("name") == "mean", F.col("value"))).alias("mean"), F.max(F.when(F.col("name") == "std", F.col("value"))).alias("std"))
    out = scaler.join(rd("thresholds", "feature string, seuil double"), ["run_id", "feature"]) \
        .join(rd("training", "scored_with string"), "run_id")
    return out.select("run_id", "scored_with", "feature", F.bround("mean", 6).alias("mean"), F.bround("std", 6).alias("std"), "seuil")


@register("d21_run_state")
def d21_run_state(spark, sf):
    """The state tables that two runs stored, one row per (table, run, key)."""
    root = two_runs(spark, sf, again=True)
    def rd(name, schema):
        return spark.read.schema(f"{schema}, run_id string").parquet(f"{root}/{name}")
    thr = rd("thresholds", "feature string, seuil double").select(
        F.lit("thresholds").alias("table"), "run_id", F.col("feature").alias("key"), F.col("seuil").cast("string").alias("value"))
    bl = rd("blacklist", "ip string").groupBy("run_id").agg(F.count(F.lit(1)).cast("string").alias("value")) \
        .select(F.lit("blacklist").alias("table"), "run_id", F.lit("size").alias("key"), "value")
    tr = rd("training", "sessions bigint, total_samples bigint").select(
        F.lit("training").alias("table"), "run_id", F.lit("sessions/samples").alias("key"),
        F.concat_ws("/", F.col("sessions").cast("string"), F.col("total_samples").cast("string")).alias("value"))
    pf = rd("performance", "nb_echantillons bigint, taux_anomalies double, score_moyen double, score_max double, "
            "nb_blacklistes bigint, silhouette double").select(
        F.lit("performance").alias("table"), "run_id", F.lit("n/taux/moyen/max").alias("key"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in ["nb_echantillons", "taux_anomalies", "score_moyen",
                                                               "score_max"]]).alias("value"))
    return thr.unionByName(bl).unionByName(tr).unionByName(pf)
