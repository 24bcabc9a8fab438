"""Density detectors on scaled features: DBSCAN noise (D8), local outlier
factor (D6), kernel novelty (D7) and the silhouette (D19).

Scale design
------------
* Everything runs on the *histogram* of distinct values or points: a hot
  value holding a third of all rows is one histogram row.
* Global order is never a single-task window: running sums go over sampled
  ranges of the order (``operators.order``).
* D8 in one dimension is a difference of running sums; in several, grid cells
  whose diagonal is the radius: a cell of enough rows is all core, and only the
  few points of thin cells are compared with their neighbour cells.
* D7 sums the kernel over all pairs of distinct points, in blocks of points by
  blocks of points: the pairs spread over tasks, and a task holds two blocks.
  Stored models keep the mean of random Fourier features instead.
* D6 walks k ranks to either side; a row is copied into the next block of
  ranks only near the blocks' ends.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.operators.order import with_running_sums
from lookout.operators.quantile import exact_quantile
from lookout.session import cut_lineage

LOF_BLOCK = 4096
PAIR_BLOCK = 32768  # distinct points of a block of the kernel sums
FOURIER = 512   # random features of a stored kernel
FOURIER_SEED = 42


def one_row(agg: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery."""
    return agg.select(F.struct(*agg.columns)).scalar()


def histogram(df: DataFrame, x_col: str) -> DataFrame:
    """Distinct values with counts, materialised once in the shared
    checkpoint folder: the bucket bounds, halos and passes below all re-read
    it instead of replaying the upstream aggregation."""
    return cut_lineage(df.groupBy(F.col(x_col).alias("x"))
                       .agg(F.count(F.lit(1)).cast("bigint").alias("cnt")))


def ordered_prefix(hist: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums of ``sums`` over rows ordered by ``x``."""
    return with_running_sums(hist, [F.asc("x")], sums)


# ------------------------------------------------------------------ D8

def sums_within(hist: DataFrame, weight: str, eps: float, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows with ``x`` in [x - eps, x + eps].

    Each row asks for the running sum at both ends of its interval; ends and
    rows are put into one order, in which an interval's lower end stands before
    a row of the same value and its upper end after it.
    """
    asks = F.array(F.struct((F.col("x") - eps).alias("v"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("w")),
                   F.struct(F.col("x").alias("v"), F.lit(1).alias("kind"), F.col(weight).cast("bigint").alias("w")),
                   F.struct((F.col("x") + eps).alias("v"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("w")))
    marks = hist.select("x", F.explode(asks).alias("e")).select("x", "e.*")
    run = with_running_sums(marks, [F.asc("v"), F.asc("kind")], {"_run": F.col("w")})
    near = run.where("kind <> 1").groupBy("x").agg(
        F.sum(F.when(F.col("kind") == 2, F.col("_run")).otherwise(-F.col("_run"))).cast("bigint").alias(name))
    return hist.join(near, "x")


def dbscan_noise(df: DataFrame, x_col: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Per distinct x, core (>= min_samples rows within eps, self
    included) and noise (no core row within eps). Returns (x, cnt, core, noise).
    Null and NaN values are left out."""
    hist = histogram(df.where(F.col(x_col).isNotNull() & ~F.isnan(F.col(x_col).cast("double"))), x_col)
    core = cut_lineage(sums_within(hist, "cnt", eps, "_near").select("x", "cnt", (F.col("_near") >= min_samples).alias("core")))
    flagged = sums_within(core.withColumn("_core", F.col("core").cast("bigint")), "_core", eps, "_any")
    return flagged.select("x", "cnt", "core", (F.col("_any") == 0).alias("noise"))


# ------------------------------------------------------------------ D6

def _rank(hist: DataFrame) -> DataFrame:
    r = ordered_prefix(hist, {"_r1": F.lit(1).cast("bigint")})
    return r.withColumn("rank", F.col("_r1") - 1).drop("_r1")


def halo_by_rank(ranked: DataFrame, k: int, block: int = LOF_BLOCK) -> DataFrame:
    """Copies of rows near a block's ends in the block next to it, so that each block holds k ranks beyond its own."""
    blk = F.floor(F.col("rank") / block)
    pos = F.col("rank") % block
    bands = F.array_compact(F.array(
        F.when(pos < k, blk - 1), blk, F.when(pos >= block - k, blk + 1)))
    return (ranked.withColumn("_home", blk).withColumn("_band", F.explode(bands))
            .withColumn("_is_home", F.col("_band") == F.col("_home")).drop("_home"))


def walk_neighbours(candidates: Column, x: Column, k: int, available) -> Column:
    """Walk candidates by (distance, value) and take row copies until k.

    ``available`` gives the copies of a candidate that may be taken. Returns the
    kth distance and the sums of reach distances and of neighbour densities.
    """
    ordered = F.array_sort(F.transform(candidates, lambda c: F.struct(
        F.abs(c["x"] - x).alias("d"), c["x"].alias("v"), available(c).alias("avail"), c["kdist"].alias("kd"), c["lrd"].alias("lrd"))))
    init = F.struct(F.lit(0).cast("bigint").alias("taken"), F.lit(0.0).alias("kdist_"),
                    F.lit(0.0).alias("s_reach"), F.lit(0.0).alias("s_lrd"))

    def step(acc, e):
        take = F.greatest(F.least(e["avail"], F.lit(k) - acc["taken"]), F.lit(0)).cast("bigint")
        return F.struct((acc["taken"] + take).alias("taken"),
                        F.when(take > 0, e["d"]).otherwise(acc["kdist_"]).alias("kdist_"),
                        (acc["s_reach"] + take * F.greatest(e["kd"], e["d"])).alias("s_reach"),
                        (acc["s_lrd"] + take * e["lrd"]).alias("s_lrd"))

    return F.aggregate(ordered, init, step)


def _knn_pass(ranked: DataFrame, k: int, block: int, with_self: tuple[bool, ...]) -> DataFrame:
    """For every distinct x: one walk over its candidates (ranks within +-k)
    for each entry of ``with_self``, columns ``_knn0``, ``_knn1``. Columns
    ``kdist`` and ``lrd`` count as 0 until they are known."""
    known = ranked.withColumns({c: F.lit(0.0) for c in ("kdist", "lrd") if c not in ranked.columns})
    w = Window.partitionBy("_band").orderBy("rank").rowsBetween(-k, k)
    cand = halo_by_rank(known, k, block).withColumn("_c", F.collect_list(F.struct("x", "cnt", "rank", "kdist", "lrd")).over(w)).where("_is_home")
    others = lambda c: F.when(c["rank"] == F.col("rank"), c["cnt"] - 1).otherwise(c["cnt"])
    walks = [walk_neighbours(F.col("_c"), F.col("x"), k, (lambda c: c["cnt"]) if own else others).alias(f"_knn{i}")
             for i, own in enumerate(with_self)]
    return cand.select(*ranked.columns, *walks)


def lof_fit(df: DataFrame, x_col: str, k: int, block: int = LOF_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(reference rows: x, cnt, rank, kdist, lrd; their scores: x, cnt, lof_fit, lof_score).

    Fit neighbours exclude the row; scoring a training row includes it
    (distance 0). Null values are left out.
    """
    hist = histogram(df.where(F.col(x_col).isNotNull()), x_col)
    ranked = cut_lineage(_rank(hist))
    p1 = _knn_pass(ranked, k, block, (False,))
    p1 = cut_lineage(p1.select(*ranked.columns, F.col("_knn0.kdist_").alias("kdist")))
    p2 = _knn_pass(p1, k, block, (False,))
    p2 = cut_lineage(p2.select(*p1.columns, (1.0 / (F.col("_knn0.s_reach") / k + 1e-10)).alias("lrd")))
    both = _knn_pass(p2, k, block, (False, True))
    lrd_sc = 1.0 / (F.col("_knn1.s_reach") / k + 1e-10)
    return p2, cut_lineage(both.select("x", "cnt", (F.col("_knn0.s_lrd") / k / F.col("lrd")).alias("lof_fit"),
                                       (F.col("_knn1.s_lrd") / k / lrd_sc).alias("lof_score")))


def lof(df: DataFrame, x_col: str, k: int, contamination: float, block: int = LOF_BLOCK) -> DataFrame:
    """Novelty LOF on the training rows themselves.

    Vote = -LOF_score < percentile(-LOF_fit, contamination).
    Returns (x, cnt, lof_fit, lof_score, vote).
    """
    _, out = lof_fit(df, x_col, k, block)
    offset = F.lit(exact_quantile(out, -F.col("lof_fit"), float(contamination), F.col("cnt"))).cast("double")
    return out.withColumn("vote", (-F.col("lof_score") < offset).cast("int"))


# ------------------------------------------------------------------ D7

def fourier_features(d: int, gamma: float, n: int = FOURIER, seed: int = FOURIER_SEED) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (n by d) and phases of the random Fourier features of exp(-gamma |a - b|^2)."""
    rng = np.random.default_rng([seed, d])
    return rng.standard_normal((n, d)) * math.sqrt(2.0 * gamma), rng.uniform(0.0, 2.0 * math.pi, n)


def _waves(batch: pa.RecordBatch, d: int, freq: np.ndarray, phase: np.ndarray) -> Iterator[np.ndarray]:
    """cos(frequency x + phase) of every row, some thousand rows at a time; the batch's first d columns are the features."""
    x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)])
    for at in range(0, len(x), 4096):
        yield np.cos(x[at:at + 4096] @ freq.T + phase)


def feature_means(points: DataFrame, cols: list[str], freq: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """The mean feature vector over all rows (``cnt`` of each point): as many sums as features, from every task."""
    d = len(cols)

    def run(batches):
        total, n = np.zeros(len(phase)), 0
        for batch in batches:
            cnt = batch.column(d).to_numpy(zero_copy_only=False)
            for i, z in enumerate(_waves(batch, d, freq, phase)):
                total += cnt[i * 4096:i * 4096 + len(z)] @ z
            n += int(cnt.sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(phase)), pa.int32()), pa.array(total), pa.array([n] * len(phase), pa.int64())],
                                         names=["k", "s", "n"])

    own = points.select(*[F.col(c).cast("double") for c in cols], "cnt")
    sums = own.mapInArrow(run, "k int, s double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = np.zeros(len(phase))
    for r in sums:
        out[r["k"]] = r["s"] / max(r["n"], 1)
    return out


def feature_density(points: DataFrame, cols: list[str], freq: np.ndarray, phase: np.ndarray, mean: np.ndarray) -> DataFrame:
    """Add ``density``: twice the mean product of a point's features and the mean features."""
    names, d = [f.name for f in points.schema.fields], len(cols)

    def run(batches):
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in cols], names=[str(i) for i in range(d)])
            density = [2.0 / len(phase) * (z @ mean) for z in _waves(own, d, freq, phase)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(density) if density else np.zeros(0))],
                                             names=[*names, "density"])

    return points.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields) + ", density double")


def point_density(points: DataFrame, cols: list[str], freq: np.ndarray, phase: np.ndarray, mean: np.ndarray) -> DataFrame:
    """``feature_density`` once for each point, rounded so that sums of another order decide no tie."""
    return cut_lineage(feature_density(points, cols, freq, phase, mean).withColumn("density", F.bround("density", 9)))


def scale_gamma(df: DataFrame, cols: list[str]) -> float:
    """1 / (features x variance of all feature values); one value."""
    var = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in cols])).alias("v")).agg(F.var_pop("v").alias("v")).first()["v"] or 0.0
    return 1.0 / (len(cols) * var) if var > 0 else 1.0


def _kernel_sums(gamma: float, d: int):
    """For cogroups (points, points): sums of the kernel of each point of the left over all rows of the right."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (np.column_stack([t.column(i).to_numpy().astype(float) for i in range(d)]) for t in (left, right))
        cnt, total = right.column(d).to_numpy().astype(float), np.zeros(len(a))
        for i in range(0, len(a), 256):
            for j in range(0, len(b), 4096):
                d2 = sum((a[i:i + 256, k, None] - b[None, j:j + 4096, k]) ** 2 for k in range(d))
                total[i:i + 256] += np.exp(-gamma * d2) @ cnt[j:j + 4096]
        return pa.table([*[left.column(i) for i in range(d)], left.column(d), pa.array(total)], names=[*left.column_names[:d + 1], "_s"])

    return run


def kernel_density(points: DataFrame, cols: list[str], gamma: float, block: int = PAIR_BLOCK) -> DataFrame:
    """Add ``density`` to distinct points (cols..., ``cnt``): the mean of exp(-gamma |a - b|^2) over all rows b.

    Every pair of distinct points is evaluated, so work grows with their square.
    Points are dealt to blocks, a task pairs two of them; a point is sent to
    each block twice.
    """
    n, rows = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("cnt"), F.lit(0))).first()
    blocks = max(math.ceil(n / block), min(math.ceil(n / 1024), 16), 1)
    own, every = F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    points = points.select(*cols, "cnt")
    left = points.withColumn("_a", own).withColumn("_b", every).groupBy("_a", "_b")
    right = points.withColumn("_b", own).withColumn("_a", every).groupBy("_a", "_b")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields) + ", _s double"
    return left.cogroup(right).applyInArrow(_kernel_sums(gamma, len(cols)), ddl) \
        .groupBy(*cols, "cnt").agg((F.sum("_s") / F.lit(rows)).alias("density"))


def kernel_novelty_nd(df: DataFrame, cols: list[str], contamination: float, gamma: float | None = None) -> DataFrame:
    """s(a) = mean over rows b of exp(-g |a - b|^2), over all pairs; vote = s < q_c(s).

    Rows with a null or NaN feature are left out. Returns (cols..., cnt, density, vote).
    """
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    gamma = scale_gamma(df, cols) if gamma is None else gamma
    pts = cut_lineage(df.groupBy(*cols).agg(F.count(F.lit(1)).cast("bigint").alias("cnt")))
    out = cut_lineage(kernel_density(pts, cols, gamma))
    q = exact_quantile(out, F.col("density"), float(contamination), F.col("cnt"))
    return out.withColumn("vote", (F.col("density") < F.lit(q).cast("double")).cast("int"))


def kernel_novelty(df: DataFrame, x_col: str, contamination: float, gamma: float | None = None) -> DataFrame:
    """D7 for one feature. Returns (x, cnt, density, vote)."""
    return kernel_novelty_nd(df.select(F.col(x_col).alias("x")), ["x"], contamination, gamma)


# ------------------------------------------------------------------ D19

def silhouette_1d(df: DataFrame, x_col: str, label_col: str) -> DataFrame:
    """Mean silhouette (Euclidean, 1-D) of a two-label split, rounded to
    4; null unless both labels have >= 2 rows. Sums of |x - y| come from
    ordered prefix sums: sum_{y in S} |x-y| = x(2c - m) + T - 2P."""
    lab = F.col(label_col)
    hist = df.groupBy(F.col(x_col).alias("x")).agg(
        F.count_if(lab == 1).cast("bigint").alias("c0"), F.count_if(lab != 1).cast("bigint").alias("c1"))
    pref = ordered_prefix(hist, {"pc0": F.col("c0"), "pc1": F.col("c1"),
                                 "ps0": F.col("x") * F.col("c0"), "ps1": F.col("x") * F.col("c1")})
    tot = one_row(hist.agg(F.sum("c0").alias("m0"), F.sum("c1").alias("m1"),
                           F.sum(F.col("x") * F.col("c0")).alias("t0"),
                           F.sum(F.col("x") * F.col("c1")).alias("t1")))
    x = F.col("x")

    def dist_sum(i):
        return x * (2 * F.col(f"pc{i}") - tot[f"m{i}"]) + tot[f"t{i}"] - 2 * F.col(f"ps{i}")

    def s_of(own, other):
        a = F.try_divide(dist_sum(own), tot[f"m{own}"] - 1)
        b = F.try_divide(dist_sum(other), tot[f"m{other}"])
        return F.when(tot[f"m{own}"] > 1,
                      F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))).otherwise(0.0)

    per = pref.select((F.col("c0") * F.coalesce(s_of(0, 1), F.lit(0.0))
                       + F.col("c1") * F.coalesce(s_of(1, 0), F.lit(0.0))).alias("_s"))
    ok = (tot["m0"] >= 2) & (tot["m1"] >= 2)
    return per.agg(F.sum("_s").alias("_s")).select(
        F.when(ok, F.bround(F.col("_s") / (tot["m0"] + tot["m1"]), 4)).alias("silhouette"))


# ------------------------------------------------------------------ D8, N-D

def dbscan_noise_nd(df: DataFrame, cols: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """D8 for several features, on grid cells of side eps / sqrt(d).

    Two points of one cell are never farther apart than eps, so a cell of
    ``min_samples`` rows is all core. The points of thinner cells, fewer than
    ``min_samples`` a cell, are compared with the points of the cells that may
    be in reach (an equi-join on cell ids): a cell's points meet a fixed number
    of others, however many rows it holds. Distances compare squared sums with
    eps^2. Rows with a null or NaN feature are left out. Returns
    (cols..., cnt, core, noise) per distinct point.
    """
    d = len(cols)
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    side = eps / math.sqrt(d) * (1.0 - 1e-9)
    points = df.groupBy(*cols).agg(F.count(F.lit(1)).cast("bigint").alias("cnt")) \
        .withColumn("cell", F.array(*[F.floor(F.col(c) / side) for c in cols]))
    cells = points.groupBy("cell").agg((F.sum("cnt") >= min_samples).alias("dense"))
    points = cut_lineage(points.join(cells, "cell"))
    reach = math.ceil(math.sqrt(d) * (1.0 + 1e-9))
    # cells whose nearest corners are in reach
    near = [o for o in itertools.product(range(-reach, reach + 1), repeat=d)
            if sum(max(abs(x) - 1, 0) ** 2 for x in o) * side * side <= eps * eps]
    offsets = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in o]) for o in near])
    thin = points.where("NOT dense").select(*[F.col(c).alias(f"a{i}") for i, c in enumerate(cols)], F.explode(
        F.transform(offsets, lambda o: F.zip_with("cell", o, lambda x, y: x + y))).alias("cell"))
    other = points.select(*[F.col(c).alias(f"b{i}") for i, c in enumerate(cols)], "cnt", "dense", "cell")
    d2 = sum(((F.col(f"a{i}") - F.col(f"b{i}")) ** 2 for i in range(d)), F.lit(0.0))
    mine = [F.col(f"a{i}").alias(c) for i, c in enumerate(cols)]
    met = cut_lineage(thin.join(other, "cell").where(d2 <= eps * eps))
    counted = met.groupBy(*[f"a{i}" for i in range(d)]).agg(F.sum("cnt").alias("n"), F.max("dense").alias("by_dense")) \
        .select(*mine, (F.col("n") >= min_samples).alias("core"), "by_dense")
    counted = cut_lineage(counted)
    # thin points that only thin points may rescue from noise
    cores = counted.where("core").select(*[F.col(c).alias(f"b{i}") for i, c in enumerate(cols)])
    rescued = met.join(cores, [f"b{i}" for i in range(d)], "left_semi").select(*mine).distinct().withColumn("by_thin", F.lit(True))
    flags = counted.join(rescued, cols, "left").select(*cols, F.col("core").alias("_core"), (F.col("by_dense") | F.col("by_thin").isNotNull()).alias("_near"))
    return points.join(flags, cols, "left").select(
        *cols, "cnt", (F.col("dense") | F.coalesce("_core", F.lit(False))).alias("core"),
        (~(F.col("dense") | F.coalesce("_core", F.lit(False)) | F.coalesce("_near", F.lit(False)))).alias("noise"))
