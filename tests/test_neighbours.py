"""Nearest neighbours and local outlier factor on several features, against brute force."""

import numpy as np
import pytest

from lookout.operators import neighbours as N


def brute(x: np.ndarray, k: int):
    """(fit, score) of every row; neighbours by distance, then coordinates."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    place = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)

    def first(i, own):
        order = sorted((j for j in range(n) if own or j != i), key=lambda j: (d[i, j], place[j]))
        return order[:k]

    fit = [first(i, False) for i in range(n)]
    kdist = np.array([d[i, fit[i][-1]] for i in range(n)])
    dens = lambda i, near: 1 / (np.mean(np.maximum(kdist[near], d[i, near])) + 1e-10)
    lrd = np.array([dens(i, fit[i]) for i in range(n)])
    full = [first(i, True) for i in range(n)]
    return np.array([lrd[fit[i]].mean() / lrd[i] for i in range(n)]), np.array([lrd[full[i]].mean() / dens(i, full[i]) for i in range(n)])


def cloud(d: int) -> np.ndarray:
    rng = np.random.default_rng(d)
    return np.concatenate([np.round(rng.normal(size=(150, d)), 1), np.round(rng.normal(8, 0.1, (60, d)), 2),
                           np.round(rng.uniform(-30, 30, (25, d)), 0), np.zeros((12, d)), np.zeros((2, d)) + 3.0])


@pytest.mark.parametrize("d,leaf", [(2, 16), (2, 1024), (3, 24)])
def test_lof_equals_brute_force_with_copies_ties_and_outliers(spark, d, leaf):
    x, k = cloud(d), 5
    cols = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    odd = spark.createDataFrame([(None, *[1.0] * (d - 1)), (float("nan"), *[1.0] * (d - 1))], df.schema)
    got = {tuple(r[c] for c in cols): r for r in N.lof_nd(df.unionByName(odd), cols, k, 0.1, leaf).collect()}
    fit, score = brute(x, k)
    assert sum(r["cnt"] for r in got.values()) == len(x)
    offset = np.quantile(-fit, 0.1)
    for p, f, s in zip(x, fit, score):
        r = got[tuple(map(float, p))]
        assert r["lof_fit"] == pytest.approx(f, rel=1e-6) and r["lof_score"] == pytest.approx(s, rel=1e-6)
        if abs(-s - offset) > 1e-6:
            assert r["vote"] == int(-s < offset)


def test_every_neighbour_is_found_when_many_points_ask_one_leaf(spark):
    x = np.unique(cloud(2), axis=0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    points = N.distinct_points(df, ["a", "b"])
    asks = points.selectExpr("id", "_x0", "_x1", "4 AS need", "id AS own")
    tree = N.point_tree(points, 4, 16)
    assert (tree.dim < 0).sum() > 4
    got: dict = {}
    for r in N.nearest(asks, points, 4, tree, asks_a_task=3).collect():
        got.setdefault(r["id"], []).append((r["d"], r["nid"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(len(x)):  # np.unique sorts as the ids do
        want = sorted((d[i, j], j + 1) for j in range(len(x)) if j != i)[:4]
        assert [nid for _, nid in sorted(got[i + 1])] == [nid for _, nid in want]
        assert [v for v, _ in sorted(got[i + 1])] == pytest.approx([v for v, _ in want])


def test_unseen_points_are_scored_by_the_reference(spark):
    x = cloud(2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    ref, scores = N.lof_fit(df, ["a", "b"], 5, 16)
    again = {(r["a"], r["b"]): r["lof_score"] for r in N.lof_scores(df, ["a", "b"], ref, 5, 16).collect()}
    for r in scores.collect():
        assert again[r["_x0"], r["_x1"]] == pytest.approx(r["lof_score"], rel=1e-6)
    far = spark.createDataFrame([(500.0, 500.0), (None, 1.0)], "a double, b double")
    got = N.lof_scores(far, ["a", "b"], ref, 5, 16).collect()
    assert len(got) == 1 and got[0]["lof_score"] > 5


def test_stored_models_of_two_features_take_both(spark, tmp_path):
    from lookout.operators import models, state
    x = np.concatenate([np.round(np.random.default_rng(3).normal(size=(80, 2)), 2), [[0.0, 9.0]]])
    feats = ["Nombre_Tentatives", "Nombre_Erreurs"]
    df = spark.createDataFrame([(f"10.0.0.{i}", float(a), float(b)) for i, (a, b) in enumerate(x)], "IP_Source string, Nombre_Tentatives double, Nombre_Erreurs double")
    fitted = models.fit(df, feats, 0.05, "IP_Source")
    models.save(fitted, str(tmp_path), "r1", state._write)
    stored = models.load(spark, str(tmp_path), "r1", state._read)
    assert stored.points.count() == 81
    votes = {r["IP_Source"]: r["v_lof"] for r in models.apply(df, stored).collect()}
    # only the second feature tells the last row from the others
    assert votes["10.0.0.80"] == 1 and sum(votes.values()) < 12


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert N.lof_nd(df, ["a", "b"], 3, 0.1).count() == 0
