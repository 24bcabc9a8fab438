"""Unit tests with literal fixtures: small goldens, edge rows, brute force."""

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lookout.functions.fmt import py_fixed
from lookout.operators import density, iforest, parsers, response, retrieval, scoring, windows
from lookout.sources import files, sinks


# ------------------------------------------------------------------ scoring goldens

def test_model_weights_from_agreements(spark):
    a = spark.createDataFrame([(1.0, 0.333, 0.333)], "a_if_lof double, a_if_svm double, a_lof_svm double")
    r = scoring.weights_from_agreements(a).first()
    assert (r.w_if, r.w_lof, r.w_svm, r.w_dbscan) == (0.34, 0.34, 0.17, 0.15)


def test_model_weights_all_disagree_gives_defaults(spark):
    a = spark.createDataFrame([(0.0, 0.0, 0.0)], "a_if_lof double, a_if_svm double, a_lof_svm double")
    r = scoring.weights_from_agreements(a).first()
    assert (r.w_if, r.w_lof, r.w_svm, r.w_dbscan) == (0.40, 0.25, 0.20, 0.15)


def test_thresholds_unchanged_for_small_n(spark):
    df = spark.createDataFrame([(10,), (500,), (20,)], "Nombre_Tentatives long")
    rows = {r.feature: r.seuil for r in scoring.updated_thresholds(df, ["Nombre_Tentatives"]).collect()}
    assert rows == {"Nombre_Tentatives": 50.0}


def test_level_cutoffs_use_unrounded_score(spark):
    df = spark.createDataFrame([(0.7,), (0.69999,), (0.5,), (0.3,), (0.29999,)], "score_raw double")
    got = [(r.niveau_alerte, r.anomalie) for r in scoring.levels(df).orderBy(F.desc("score_raw")).collect()]
    assert got == [("CRITIQUE", -1), ("ANOMALIE", -1), ("ANOMALIE", -1), ("SUSPECT", -1), ("NORMAL", 1)]


def test_python_exact_fixed_text(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (0.005,), (2.5,)], "v double")
    got = [r.t for r in df.select(py_fixed("v", 2).alias("t")).collect()]
    assert got == ["0.12", "2.67", "0.01", "2.50"]
    assert df.select(py_fixed("v", 0).alias("t")).collect()[3].t == "2"


# ------------------------------------------------------------------ parsers

def test_auth_ip_after_last_from(spark):
    df = spark.createDataFrame(
        [(1, "auth.log", "Failed password for x from evil from 1.2.3.4 port 22"),
         (2, "auth.log", "Accepted password for u"),
         (3, "apache2_access.log", '5.6.7.8 - - "GET / HTTP/1.1" 403 1 "-" "curl"'),
         (4, "kern.log", "[UFW BLOCK] IN=eth0 SRC=9.9.9.9 DST=1.1.1.1"),
         (5, "syslog", "   ")],
        "event_id long, source_log string, line string")
    out = {r.event_id: r for r in parsers.classify_lines(df, keep=["event_id"]).collect()}
    assert out[1].source_ip == "1.2.3.4" and out[1].type_event == "SSH_BRUTE_FORCE"
    assert out[2].source_ip == "N/A" and out[2].statut == "SUCCESS"
    assert out[3].source_ip == "5.6.7.8" and out[3].statut == "403" and out[3].severite == "AVERTISSEMENT"
    assert out[4].source_ip == "9.9.9.9" and out[4].statut == "BLOCKED"
    assert 5 not in out  # blank line dropped


# ------------------------------------------------------------------ sets, windows

def test_remembered_ips_first_seen_order(spark):
    rows = [("d1", 1, "a"), ("d1", 2, "b"), ("d2", 1, "b"), ("d2", 2, "c"), ("d3", 1, "d"), ("d3", 2, "a")]
    df = spark.createDataFrame(rows, "session_day string, r int, ip string").withColumn(
        "session_day", F.to_date(F.concat(F.lit("2024-01-0"), F.substring("session_day", 2, 1))))
    got = [r.ip for r in windows.first_seen_order(df, "ip", "session_day", "r").orderBy("pos").collect()]
    assert got == ["a", "b", "c", "d"]


# ------------------------------------------------------------------ density brute force

def _lof_brute(x, k):
    n = len(x)
    D = np.abs(x[:, None] - x[None, :])

    def knn(i, self_incl):
        return sorted([j for j in range(n) if self_incl or j != i], key=lambda j: (D[i, j], x[j]))[:k]
    nn = [knn(i, False) for i in range(n)]
    kd = np.array([D[i, nn[i][-1]] for i in range(n)])
    lrd = np.array([1 / (np.mean([max(kd[j], D[i, j]) for j in nn[i]]) + 1e-10) for i in range(n)])
    fit = np.array([np.mean([lrd[j] for j in nn[i]]) / lrd[i] for i in range(n)])
    ns = [knn(i, True) for i in range(n)]
    lrd_s = np.array([1 / (np.mean([max(kd[j], D[i, j]) for j in ns[i]]) + 1e-10) for i in range(n)])
    score = np.array([np.mean([lrd[j] for j in ns[i]]) / lrd_s[i] for i in range(n)])
    return fit, score


def test_lof_matches_brute_force_with_ties_and_duplicates(spark):
    vals = [1, 1, 1, 2, 3, 3, 5, 8, 8, 9, 10, 12, 30, 31, 100]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    res = {r.x: r for r in density.lof(df, "v", 4, 0.1, block=4).collect()}
    fit, score = _lof_brute(np.array(vals, dtype=float), 4)
    for i, v in enumerate(vals):
        assert res[float(v)].lof_fit == pytest.approx(fit[i], rel=1e-9)
        assert res[float(v)].lof_score == pytest.approx(score[i], rel=1e-9)


def test_dbscan_small_n_is_all_noise(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (5.0,)], "x double")
    assert all(r.noise for r in density.dbscan_noise(df, "x").collect())


def test_dbscan_core_and_border(spark):
    xs = [0.0, 0.1, 0.2, 0.3, 0.4, 0.8, 3.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    res = {r.x: (r.core, r.noise) for r in density.dbscan_noise(df, "x").collect()}
    assert res[0.2] == (True, False)
    assert res[0.8] == (False, False)   # border: a core point lies within 0.5
    assert res[3.0] == (False, True)


def test_kernel_density_near_the_exact_one(spark):
    xs = np.array([0.0, 0.5, 1.0, 1.0, 4.0, 40.0])
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,), (float("nan"),)], "x double")
    res = {r.x: r.density for r in density.kernel_novelty(df, "x", 0.2, gamma=0.5).collect()}
    assert set(res) == set(xs)
    for a in set(xs):
        assert res[a] == pytest.approx(np.mean(np.exp(-0.5 * (a - xs) ** 2)), abs=4 / np.sqrt(2 * density.FOURIER))


def test_silhouette_matches_pairwise(spark):
    xs = [0.0, 0.2, 0.3, 5.0, 5.5, 6.0, 6.1]
    labels = [1, 1, 1, -1, -1, -1, -1]
    df = spark.createDataFrame(list(zip(xs, labels)), "x double, label int")
    got = density.silhouette_1d(df, "x", "label").first().silhouette
    s = []
    for i, (xi, li) in enumerate(zip(xs, labels)):
        own = [abs(xi - xj) for j, (xj, lj) in enumerate(zip(xs, labels)) if lj == li and j != i]
        oth = [abs(xi - xj) for xj, lj in zip(xs, labels) if lj != li]
        a, b = np.mean(own), np.mean(oth)
        s.append((b - a) / max(a, b))
    assert got == round(float(np.mean(s)), 4)


# ------------------------------------------------------------------ forest invariants

def test_forest_votes_and_scores(spark):
    rng = np.random.default_rng(42)
    vals = np.concatenate([rng.poisson(5, 360), rng.poisson(90, 40)]).astype(float)
    df = spark.createDataFrame([(f"ip{i}", float(v)) for i, v in enumerate(vals)], "k string, x double")
    trees, psi = iforest.fit_forest(df, "k", ["x"], n_trees=50, psi=64, seed=7)
    out = iforest.forest_votes(iforest.score_forest(df, trees, ["x"], psi), 0.1)
    rows = out.collect()
    votes = sum(r.v_if for r in rows)
    assert 30 <= votes <= 50
    assert all(0.0 <= r.cont_if <= 1.0 for r in rows)
    high = [r.v_if for r in rows if r.x > 60]
    assert sum(high) >= 0.8 * len(high)
    again = iforest.score_forest(df.repartition(5), trees, ["x"], psi).select("k", "if_raw").collect()
    assert sorted(again) == sorted((r.k, r.if_raw) for r in rows)


# ------------------------------------------------------------------ response

def test_block_decision_ignores_unspecific_addresses(spark):
    df = spark.createDataFrame([("BRUTE-FORCE SSH", ip, "CRITIQUE") for ip in ["multiple", "N/A", "", "1.2.3.4"]],
                               "type_anomalie string, ip string, severite string")
    got = [r.decision for r in response.block_decision(df).collect()]
    assert got == ["IGNORÉ", "IGNORÉ", "IGNORÉ", "BLOQUER"]


def test_blocked_add_is_idempotent(spark):
    df = spark.createDataFrame([(["10.0.0.1/32"], ["10.0.0.2/32", "10.0.0.2/32"])], "ips array<string>, a array<string>")
    got = df.select(response.add_blocked(F.col("ips"), F.col("a")).alias("l")).first().l
    assert got == ["10.0.0.1/32", "10.0.0.2/32"]


def test_stored_list_text_is_trimmed(spark):
    df = spark.createDataFrame([("a, b,",), ('["a", " b "]',), ("",)], "t string")
    assert [r.l for r in df.select(response.parse_tag_list("t").alias("l")).collect()] == [["a", "b"], ["a", "b"], []]


def test_blocked_add_keeps_newest_ten_past_256_chars(spark):
    adds = [f"10.0.0.{i}/32" for i in range(30)]
    df = spark.createDataFrame([([], adds)], "ips array<string>, a array<string>")
    got = df.select(response.add_blocked(F.col("ips"), F.col("a")).alias("l")).first().l
    lst = []
    for ip in adds:  # the rule, step by step
        if ip not in lst:
            lst.append(ip)
        if len(str(lst).replace("'", '"')) > 256:
            lst = lst[-10:]
    assert got == lst


def test_transfer_report_totals(spark):
    sizes_kb = [0.1, 0.1, 0.1, 23249.8]
    df = spark.createDataFrame([(f"f{i}", int(round(s * 1024)), "OK") for i, s in enumerate(sizes_kb)],
                               "name string, size long, statut string")
    r = files.transfer_report(df).first()
    assert (r.nb_fichiers, r.nb_ok, r.nb_echec, r.taille_totale_ko) == (4, 4, 0, 23250.1)


# ------------------------------------------------------------------ sources

def test_header_trap_keeps_values_under_their_names(spark):
    root = tempfile.mkdtemp(dir="/tmp")
    with open(os.path.join(root, "dataset_a.csv"), "w") as f:
        f.write("Date,statut\n2024-01-01 00:00:00,FAILED\n")
    with open(os.path.join(root, "dataset_b.csv"), "w") as f:
        f.write("statut,Date\nWARNING,2024-01-02 00:00:00\n")
    rows = {r.Serveur: r for r in files.scan_csv_by_header(spark, f"{root}/dataset_*.csv").collect()}
    assert rows["server_a"].statut == "FAILED" and rows["server_b"].statut == "WARNING"
    assert rows["server_b"].Date == "2024-01-02 00:00:00"


def test_csv_of_pandas_keeps_quotes_and_commas(spark):
    root = tempfile.mkdtemp(dir="/tmp")
    rows = [('10.0.0.1 - "GET /a, b HTTP/1.1" 200 "-" "x"', "apache2_access.log"), ("  plain  ", "syslog")]
    pd.DataFrame(rows, columns=["detail", "source_log"]).to_csv(os.path.join(root, "dataset_a.csv"), index=False)
    got = files.scan_csv_by_header(spark, f"{root}/dataset_*.csv").collect()
    assert sorted((r.detail, r.source_log) for r in got) == sorted(rows)


def test_sinks_replace_a_retried_run_and_keep_others(spark):
    root = tempfile.mkdtemp(dir="/tmp")
    ddl = "source_log string, type_event string, severite string, k string"
    df = spark.createDataFrame([("a", "t", "s", "k1"), ("a", "t", "s", "k2")], ddl)
    for run_id in ("r1", "r2", "r1"):
        files.write_processed(df, f"{root}/p", run_id)
        files.write_reports(df.where(F.col("k") == ("k1" if run_id == "r1" else "k2")), "k", f"{root}/r", run_id)
    runs = sinks.read_runs(spark, f"{root}/p/datasets", ddl).groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in runs} == {"r1": 2, "r2": 2}
    assert [r.n for r in sinks.read_runs(spark, f"{root}/p/stats", "source_log string, n long").collect()] == [2, 2]
    assert {r.k for r in sinks.read_runs(spark, f"{root}/r", ddl, "json").collect()} == {"k1", "k2"}


def test_sinks_survive_empty_and_failed_runs(spark):
    root, ddl = tempfile.mkdtemp(dir="/tmp") + "/s", "k string, v int"
    df = spark.createDataFrame([("a", 1), ("b", 2)], ddl)
    assert sinks.read_runs(spark, root, ddl).count() == 0 and sinks.read_latest(spark, root, ddl).count() == 0
    for part in ((), ("k",)):
        path = f"{root}{len(part)}"
        sinks.publish(df, path, "r1", part)
        sinks.publish(df.limit(1), path, "r2", part)
        sinks.stage(df, path, part)  # written, never marked: its run failed
        broken = df.withColumn("v", F.raise_error(F.lit("broken")).cast("int"))
        with pytest.raises(Exception):
            sinks.publish(broken, path, "r1", part)
        assert sinks.read_runs(spark, path, ddl).groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 2), ("r2", 1)]
        assert sinks.read_latest(spark, path, ddl).count() == 1
        sinks.publish(df.limit(0), path, "r1", part)
        assert [r.run_id for r in sinks.read_runs(spark, path, ddl).collect()] == ["r2"]
        assert sinks.read_latest(spark, path, ddl).count() == 0
        assert sinks.sweep(spark, path) == 1 and sinks.sweep(spark, path) == 1  # by marker rows; deleting again does no harm
        sinks.publish(df, path, "r1", part)
        assert sinks.read_runs(spark, path, ddl).count() == 3


def test_run_state_orders_counters_and_forgets_stale_rows(spark):
    from lookout.operators import state
    root = tempfile.mkdtemp(dir="/tmp")
    for run_id, seuil in [("r1", 1.0), ("r9", 9.0)]:
        state._write(spark.createDataFrame([("f", seuil)], "feature string, seuil double"), root, "thresholds", run_id)
        state._write(spark.createDataFrame([(run_id,)], "ip string"), root, "blacklist", run_id)
        state._write(spark.createDataFrame([(1, 1)], "sessions long, total_samples long"), root, "training", run_id)
    state._write(spark.createDataFrame([], "ip string"), root, "blacklist", "r1")  # re-run without an address
    prev = state.load_previous(spark, root, "r10")
    assert prev.state.thresholds["f"] == 9.0
    assert [r.ip for r in prev.state.blacklist.collect()] == ["r9"]


def test_missing_log_source_is_empty(spark):
    df = files.read_lines(spark, "/tmp/definitely-missing-lookout-folder")
    assert df.count() == 0 and df.columns == ["source_log", "line"]


def test_nearest_includes_exact_match(spark):
    corpus = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "vec_id long, embedding array<float>")
    q = corpus.where("vec_id = 3").select(F.col("vec_id").alias("qid"), "embedding")
    got = [r.vec_id for r in retrieval.nearest(corpus, q, 3).orderBy("rank").collect()]
    assert got == [3, 2, 4]


def test_dbscan_nd_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = np.round(np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(3, 1.5, (15, 2))]), 2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    got = {(r.x, r.y): (r.core, r.noise) for r in density.dbscan_noise_nd(df, ["x", "y"], 0.5, 5).collect()}
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    core = (d2 <= 0.25).sum(1) >= 5
    noise = ~((d2 <= 0.25) & core[None, :]).any(1)
    for i, (a, b) in enumerate(pts):
        assert got[(float(a), float(b))] == (bool(core[i]), bool(noise[i]))


def test_kernel_density_over_all_pairs(spark):
    rng = np.random.default_rng(5)
    for pts in (np.round(rng.normal(size=(400, 1)) * 3, 1), np.round(rng.normal(size=(300, 2)), 1)):
        cols = [f"c{i}" for i in range(pts.shape[1])]
        df = spark.createDataFrame([tuple(map(float, p)) for p in pts] + [tuple([None] * len(cols))], ", ".join(f"{c} double" for c in cols))
        g = 1.0 / (len(cols) * pts.var())
        want = np.exp(-g * ((pts[:, None] - pts[None]) ** 2).sum(-1)).mean(1)
        limit = np.quantile(want, 0.1)
        got = {tuple(r[c] for c in cols): r for r in density.kernel_novelty_nd(df, cols, 0.1).collect()}
        for p, w in zip(pts, want):
            r = got[tuple(map(float, p))]
            assert r.density == pytest.approx(w, abs=1e-12)
            if abs(w - limit) > 1e-12:
                assert r.vote == int(w < limit)
        points = df.dropna().groupBy(*cols).agg(F.count(F.lit(1)).alias("cnt"))
        blocked = {tuple(r[c] for c in cols): r.density for r in density.kernel_density(points, cols, g, block=20).collect()}
        assert set(blocked) == set(got) and all(blocked[k] == pytest.approx(got[k].density, abs=1e-12) for k in got)


def test_kernel_nd_near_the_exact_one(spark):
    rng = np.random.default_rng(3)
    pts = np.round(rng.normal(size=(150, 3)), 1)
    pts[0] = 9.0
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "a double, b double, c double")
    rows = density.kernel_novelty_nd(df, ["a", "b", "c"], 0.05).collect()
    g = 1.0 / (3 * pts.var())
    for r in rows:
        want = np.mean(np.exp(-g * ((pts - [r.a, r.b, r.c]) ** 2).sum(1)))
        assert r.density == pytest.approx(want, abs=4 / np.sqrt(2 * density.FOURIER))
    assert [r.vote for r in rows if r.a == 9.0] == [1]


def test_run_state_rerun_replaces(spark):
    from lookout.operators import state
    rng = np.random.default_rng(11)
    rows = [(f"10.0.0.{i}", int(v), None) for i, v in enumerate(rng.poisson(20, 60))] + [("10.0.9.9", 900, None)]
    feats = spark.createDataFrame(rows, "IP_Source string, Nombre_Tentatives long, Date timestamp")
    root = tempfile.mkdtemp(dir="/tmp")
    for run_id in ["r1", "r2", "r2"]:
        state.run_batch(spark, feats, feats, root, run_id)
    tr = {r.run_id: (r.sessions, r.total_samples) for r in spark.read.parquet(f"{root}/training").collect()}
    assert tr == {"r1": (2, 122), "r2": (3, 183)}  # the first run trains before it scores, and refits after
    thr = {r.run_id: r.seuil for r in spark.read.parquet(f"{root}/thresholds").collect()}
    x = np.array([v for _, v, _ in rows], dtype=float)
    step = lambda old: round(0.7 * old + 0.3 * (x.mean() + 2 * x.std(ddof=1)), 2)
    # first run: trained (one update) before scoring, refitted after the batch
    assert thr["r1"] == step(step(50.0))
    assert thr["r2"] == step(thr["r1"])
