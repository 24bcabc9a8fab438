"""Stored models applied to rows they were not fitted on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookout.config import Settings
from lookout.operators import density, models, state

SMALL = Settings(n_trees=20, sample_size=32, lof_k=4)


def _table(spark, values, errors=None):
    rows = [(f"10.0.0.{i}", int(v), int(e)) for i, (v, e) in enumerate(zip(values, errors if errors is not None else values))]
    return spark.createDataFrame(rows, "IP_Source string, Nombre_Tentatives long, Nombre_Erreurs long")


def _novelty(ref, new, k):
    """LOF of values against a reference, neighbours by (distance, value)."""
    def near(x, pool, skip=None):
        return sorted((abs(x - v), v, j) for j, v in enumerate(pool) if j != skip)[:k]
    kd = [near(v, ref, i)[-1][0] for i, v in enumerate(ref)]
    lrd = lambda x, skip=None: 1 / (np.mean([max(kd[j], d) for d, _, j in near(x, ref, skip)]) + 1e-10)
    own = [lrd(v, i) for i, v in enumerate(ref)]
    score = lambda x, skip=None: np.mean([own[j] for _, _, j in near(x, ref, skip)]) / lrd(x, skip)
    return [score(v, i) for i, v in enumerate(ref)], [score(x) for x in new]


def test_stored_models_rate_unseen_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    ref = [*map(int, rng.poisson(20, 60)), 200, 300]
    new = [0, 5, 20, 21, 33, 90, 200, 250, 1000, *ref[:5]]
    fitted = models.fit(_table(spark, ref), ["Nombre_Tentatives"], 0.1, "IP_Source", SMALL)
    models.save(fitted, str(tmp_path), "r1", state._write)
    stored = models.load(spark, str(tmp_path), "r1", state._read)
    assert stored.feats == ["Nombre_Tentatives"] and stored.params == fitted.params
    assert models.load(spark, str(tmp_path), "r2", state._read) is None
    assert stored.value("mean", "Nombre_Tentatives") == pytest.approx(np.mean(ref)) and stored.value("std", "Nombre_Tentatives") == pytest.approx(np.std(ref))

    got = {r.IP_Source: r for r in models.apply(_table(spark, new), stored).collect()}
    fit, scores = _novelty(ref, new, 4)
    offset = np.quantile(-np.array(fit), 0.1)
    x = (np.array(new) - np.mean(ref)) / np.std(ref)
    z = (np.array(ref) - np.mean(ref)) / np.std(ref)
    freq, phase = density.fourier_features(1, stored.value("kernel_gamma"))
    mean = np.cos(z[:, None] @ freq.T + phase).mean(0)
    dens = lambda v: 2 / len(phase) * (np.cos(v[:, None] @ freq.T + phase) @ mean)
    assert stored.value("kernel_offset") == pytest.approx(np.quantile(dens(z), 0.1), abs=1e-7)
    for i in range(len(new)):
        r = got[f"10.0.0.{i}"]
        assert r["v_lof"] == int(-scores[i] < offset), (new[i], scores[i], offset)
        assert r["x_Nombre_Tentatives"] == pytest.approx(x[i])
        if abs(dens(x[i:i + 1])[0] - stored.value("kernel_offset")) > 1e-6:
            assert r["v_svm"] == int(dens(x[i:i + 1])[0] < stored.value("kernel_offset"))
    assert got["10.0.0.8"]["v_if"] == 1 and got["10.0.0.2"]["v_if"] == 0
    assert got["10.0.0.8"]["v_lof"] == 1 and got["10.0.0.8"]["v_svm"] == 1


def test_models_of_several_features_null_rows_and_one_row(spark):
    rng = np.random.default_rng(2)
    df = _table(spark, rng.poisson(9, 50), rng.poisson(3, 50)).unionByName(spark.createDataFrame(
        [("n", None, 1), ("m", 4, None)], "IP_Source string, Nombre_Tentatives long, Nombre_Erreurs long"))
    fitted = models.fit(df, ["Nombre_Tentatives", "Nombre_Erreurs"], 0.1, "IP_Source", SMALL)
    got = {r.IP_Source: r for r in models.apply(df, fitted).collect()}
    assert len(got) == 52 and fitted.value("n") == 50
    assert got["n"]["v_if"] == got["n"]["v_lof"] == got["n"]["v_svm"] == 0 and got["m"]["v_svm"] == 0
    one = models.fit(df.limit(1), ["Nombre_Tentatives"], 0.1, "IP_Source", SMALL)
    assert models.apply(df, one).where("v_lof > 0").count() == 0


def test_a_run_uses_the_models_of_the_run_before(spark, tmp_path):
    root = str(tmp_path)
    first, second = _table(spark, [5, 6, 5, 7, 6, 5, 90, 6]).drop("Nombre_Erreurs"), _table(spark, [500, 510, 505, 6]).drop("Nombre_Erreurs")
    dated = lambda df: df.withColumn("Date", F.lit("2024-01-02 12:00:00").cast("timestamp"))
    state.run_batch(spark, dated(first), first, root, "r1", SMALL)
    out = state.run_batch(spark, dated(second), second, root, "r2", SMALL)
    scaled = {r.Nombre_Tentatives: r["x_Nombre_Tentatives"] for r in out.collect()}
    ref = np.array([5, 6, 5, 7, 6, 5, 90, 6])
    assert scaled[500] == pytest.approx((500 - ref.mean()) / ref.std())  # the first run's scaler
    used = spark.read.schema("scored_with string, run_id string").parquet(f"{root}/training").collect()
    assert {r.run_id: r.scored_with for r in used} == {"r1": "r1", "r2": "r1"}
    mean = state._read(spark, root, "model_params", models.PARAM_DDL).where("run_id = 'r2' AND name = 'mean'").first()["value"]
    assert mean == pytest.approx(np.mean([500, 510, 505, 6]))


def test_a_run_derives_its_tables_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    events = spark.createDataFrame([(f"10.0.0.{i % 12}", i % 5) for i in range(300)], "IP_Source string, n long").mapInPandas(seen, "IP_Source string, n long")
    attempts = events.groupBy("IP_Source").agg(F.count(F.lit(1)).alias("Nombre_Tentatives"))
    feats = attempts.withColumn("Date", F.lit("2024-01-02 12:00:00").cast("timestamp"))
    out = state.run_batch(spark, feats, attempts, str(tmp_path), "r1", SMALL)
    assert out.count() == 12 and read.value == 2 * 300  # once for each of the two tables
