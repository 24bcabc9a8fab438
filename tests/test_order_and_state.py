"""Global order, exact quantiles, grid DBSCAN, blocked-address state and nearest search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookout.operators import blocked, density, order, quantile, response, retrieval


@pytest.fixture(scope="module")
def ordered(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 40, 500), rng.integers(0, 9, 500)))]
    rows += [(None, 1.0, 500), (None, None, 501)]
    return spark.createDataFrame(rows, "k int, v double, i int").repartition(7).cache(), rows


def test_global_rank_numbers_every_row_once(spark, ordered):
    df, rows = ordered
    got = order.with_global_rank(df, [F.desc_nulls_last("k"), F.asc("i")], "rank").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r["rank"])] == [(k, i) for k, _, i in want]
    assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))


def test_equal_rows_spread_over_ranges_and_keep_distinct_ranks(spark):
    got = order.with_global_rank(spark.range(300).select(F.lit(1).alias("x")), [F.asc("x")], "rank").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 301))
    assert order.with_global_rank(spark.range(0).select(F.lit(1).alias("x")), [F.asc("x")], "rank").count() == 0


def test_previous_value_and_running_sum_cross_the_ranges(spark, ordered):
    df, rows = ordered
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    back = {r.i: r.p for r in order.with_previous(df, [F.asc_nulls_first("k"), F.asc("i")], "v", "p").collect()}
    assert [back[i] for *_, i in want] == [None] + [v for _, v, _ in want[:-1]]
    sums = {r.i: r.s for r in order.with_running_sums(df, [F.asc_nulls_first("k"), F.asc("i")], {"s": F.coalesce("v", F.lit(0.0))}).collect()}
    assert [sums[i] for *_, i in want] == list(np.cumsum([v or 0.0 for _, v, _ in want]))


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_quantiles_equal_numpy(spark, monkeypatch, n):
    monkeypatch.setattr(quantile, "SMALL", 16)
    rng = np.random.default_rng(n)
    x, y = rng.lognormal(3, 2, n), rng.integers(0, 5, n).astype(float)
    df = spark.createDataFrame([(float(a), float(b), 1 + i % 3) for i, (a, b) in enumerate(zip(x, y))], "x double, y double, w int")
    probs = [0.0, 0.05, 0.5, 0.99, 1.0]
    odd = df.unionByName(spark.createDataFrame([(None, float("nan"), 9)], "x double, y double, w int"))
    got = quantile.exact_quantiles(odd, [F.col("x"), F.col("y")], probs)
    assert got[0] == pytest.approx(list(np.quantile(x, probs))) and got[1] == pytest.approx(list(np.quantile(y, probs)))
    weighted = quantile.exact_quantiles(df, [F.col("x")], probs, F.col("w"))[0]
    assert weighted == pytest.approx(list(np.quantile(np.repeat(x, [1 + i % 3 for i in range(n)]), probs)))
    assert quantile.exact_quantiles(df.limit(0), [F.col("x")], [0.5]) == [[None]]


@pytest.mark.parametrize("d", [1, 2, 3])
def test_dbscan_equals_brute_force(spark, d):
    rng = np.random.default_rng(d)
    pts = np.concatenate([np.round(rng.normal(size=(160, d)), 2), np.round(rng.uniform(-6, 6, (60, d)), 1), np.zeros((20, d))])
    cols = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts] + [(None,) * d], ", ".join(f"{c} double" for c in cols))
    near = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(2) <= 0.25
    core = near.sum(1) >= 5
    want = {tuple(p): (bool(c), not (near[i] & core).any()) for i, (p, c) in enumerate(zip(pts, core))}
    got = density.dbscan_noise_nd(df, cols).collect()
    assert {tuple(r[c] for c in cols): (r["core"], r["noise"]) for r in got} == want and len(got) == len(want)
    if d == 1:
        assert {(r.x,): (r["core"], r["noise"]) for r in density.dbscan_noise(df, "c0").collect()} == want


# -- blocked addresses ------------------------------------------------------------
def _rows(spark, rows):
    return spark.createDataFrame(rows, "grp string, cidr string, place long")


def test_blocked_state_adds_removes_and_answers(spark, tmp_path):
    one = blocked.add(blocked.empty_state(spark), _rows(spark, [("g", "1.1.1.1/32", 5), ("g", "1.1.1.1/32", 2), ("g", " ", 1), (None, "x", 1), ("h", "2.2.2.2/32", 1)]), 1)
    assert sorted(map(tuple, one.collect())) == [("g", "1.1.1.1/32", 1, 2), ("h", "2.2.2.2/32", 1, 1)]
    blocked.publish(one, str(tmp_path), 1)
    held = blocked.load(spark, str(tmp_path), 1)
    two = blocked.add(held, _rows(spark, [("g", "1.1.1.1/32", 9), ("g", "3.3.3.3/32", 9)]), 2)
    assert sorted(map(tuple, two.where("grp = 'g'").collect())) == [("g", "1.1.1.1/32", 1, 2), ("g", "3.3.3.3/32", 2, 9)]
    asked = _rows(spark, [("g", "1.1.1.1/32", 0), ("h", "1.1.1.1/32", 0)])
    assert {(r.grp, r.statut) for r in blocked.removal_status(two, asked).collect()} == {("g", "DÉBLOQUÉE"), ("h", "NON_TROUVÉE")}
    assert {(r.grp, r.since, r.bloquee) for r in blocked.membership(two, asked).collect()} == {("g", 1, True), ("h", 0, False)}
    left = blocked.remove(two, asked)
    assert sorted((r.grp, r.cidr) for r in left.collect()) == [("g", "3.3.3.3/32"), ("h", "2.2.2.2/32")]
    # a version that becomes empty replaces what was written before
    blocked.publish(two, str(tmp_path), 2)
    blocked.publish(two.limit(0), str(tmp_path), 2)
    assert blocked.load(spark, str(tmp_path), 2).count() == 0 and blocked.load(spark, str(tmp_path), 1).count() == 2


def test_group_of_any_number_of_addresses(spark):
    many = spark.range(3000).select(F.lit("g").alias("grp"), F.concat(F.lit("10."), F.col("id").cast("string"), F.lit(".0.1/32")).alias("cidr"),
                                    F.col("id").alias("place"))
    state = blocked.add(blocked.empty_state(spark), many, 1)
    assert blocked.summary(state).first()["nb_ips_bloquees"] == 3000
    tag = blocked.tag_text(state).first()["tag"]
    assert response.parse_tag_list(F.lit(tag)) is not None and len(tag) <= 256
    assert tag == "[" + ", ".join(f'"10.{i}.0.1/32"' for i in range(2990, 3000)) + "]"
    few = blocked.add(blocked.empty_state(spark), many.where("id < 12"), 1)
    assert blocked.tag_text(few).first()["tag"] == "[" + ", ".join(f'"10.{i}.0.1/32"' for i in range(12)) + "]"


# -- nearest ------------------------------------------------------------------------
def test_nearest_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 3, (300, 4)).astype(float)  # many ties
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(v)]
    corpus = spark.createDataFrame(rows + [(999, None), (None, [0.0] * 4)], "vec_id long, embedding array<double>")
    queries = corpus.where("vec_id < 70").withColumnRenamed("vec_id", "qid")
    got = {(r.qid, r["rank"]): (r.vec_id, r.dist) for r in retrieval.nearest(corpus, queries, 5, part_rows=64, block_rows=16).collect()}
    for q in range(70):
        d = ((v - v[q]) ** 2).sum(1)
        assert [got[q, k + 1] for k in range(5)] == [(i, d[i]) for i in np.lexsort((np.arange(300), d))[:5]]
    assert len(got) == 350 and retrieval.nearest(corpus, queries.limit(0), 3).count() == 0


def test_gaps_of_a_series_are_filled(spark):
    from lookout.operators.forecast import fill_gaps
    rows = [("a", "2024-01-01 00:00:00", 2), ("a", "2024-01-01 03:00:00", 1), (None, "2024-01-01 05:00:00", 4), ("a", None, 9)]
    df = spark.createDataFrame(rows, "k string, t string, y long").withColumn("t", F.col("t").cast("timestamp"))
    got = [(r.k, r.t.hour, r.y) for r in fill_gaps(df, ["k"], "t", "y").orderBy("k", "t").collect()]
    assert got == [(None, 5, 4), ("a", 0, 2), ("a", 1, 0), ("a", 2, 0), ("a", 3, 1)]
    assert fill_gaps(df.limit(0), ["k"], "t", "y").count() == 0


def test_session_row_needs_three_addresses(spark):
    from lookout.operators import scoring
    df = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "score_raw double")
    row = scoring.session_performance(df, F.lit(2), F.lit(None).cast("double"), F.lit(7), F.lit("t")).first()
    assert (row.session, row.timestamp, row.nb_echantillons, row.taux_anomalies, row.nb_blacklistes) == (7, "t", 3, 66.67, 2)
    assert scoring.session_performance(df.limit(2), F.lit(2), F.lit(None).cast("double")).count() == 0
