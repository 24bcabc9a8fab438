"""Exact nearest neighbours and the local outlier factor on several features.

Scale design
------------
* Distinct points with counts: a point that a third of all rows share is one row.
* A k-d tree over a bounded sample deals the points to leaves of about ``LEAF``
  points. Its cuts decide the work only, never the answer.
* A point's own leaf bounds its kth distance; only leaves that this ball reaches
  are asked again. Points that ask one leaf are split into parts of ``ASKS``.
* At most k neighbours of a point leave a task; densities pass along them by joins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookout.operators.order import with_global_rank
from lookout.operators.quantile import exact_quantile
from lookout.session import cut_lineage

LEAF = 1024            # points of a leaf, about
SAMPLE = 64            # sampled points of a leaf
MAX_SAMPLE = 1_000_000  # sampled points in all; beyond it leaves grow
ASKS = 50_000          # points that ask a leaf in one task
ROWS = 256             # points compared with a leaf at once


@dataclass(frozen=True)
class Tree:
    """Cuts of the feature space: ``x[dim] <= cut`` goes left; ``dim`` -1 marks a leaf."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x``."""
        node = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.dim[node] >= 0)
        while len(inner):
            at = node[inner]
            node[inner] = np.where(x[inner, self.dim[at]] <= self.cut[at], self.left[at], self.right[at])
            inner = inner[self.dim[node[inner]] >= 0]
        return node

    def reached(self, x: np.ndarray, r: np.ndarray):
        """(leaf, rows) for every leaf that the balls of radius ``r`` around the rows may reach."""
        wide = r * (1 + 1e-9)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if self.dim[at] < 0:
                yield at, rows
                continue
            v = x[rows, self.dim[at]]
            todo.append((self.left[at], rows[v - wide[rows] <= self.cut[at]]))
            todo.append((self.right[at], rows[v + wide[rows] >= self.cut[at]]))


def build_tree(sample: np.ndarray, most: float, least: int) -> Tree:
    """Halve the sample along its widest feature while a part holds over ``most`` points; no part gets fewer than ``least``."""
    dim, cut, left, right = [-1], [0.0], [0], [0]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        at, rows = todo.pop()
        if len(rows) <= most:
            continue
        x = sample[rows]
        for j in np.argsort(-(x.max(0) - x.min(0)), kind="stable"):
            v = np.sort(x[:, j])
            value = v[(len(v) - 1) // 2]
            if value == v[-1]:  # cut below the greatest value, if that leaves enough
                value = v[max(np.searchsorted(v, value) - 1, 0)]
            low = x[:, j] <= value
            if min(low.sum(), (~low).sum()) >= least:
                dim[at], cut[at], left[at], right[at] = int(j), float(value), len(dim), len(dim) + 1
                for part in (rows[low], rows[~low]):
                    todo.append((len(dim), part))
                    dim.append(-1), cut.append(0.0), left.append(0), right.append(0)
                break
    return Tree(np.array(dim), np.array(cut), np.array(left), np.array(right))


def distinct_points(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct points ``_x0``, ``_x1``, ... with ``cnt`` rows and ``id``, their place in the order of coordinates.

    Rows with a null or NaN feature are left out.
    """
    xs = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]
    whole = df.select(*xs).where(" AND ".join(f"_x{i} IS NOT NULL AND NOT isnan(_x{i})" for i in range(len(cols))))
    names = [f"_x{i}" for i in range(len(cols))]
    # 0.0 + x: both zeros are one value
    grouped = whole.select(*[(F.lit(0.0) + F.col(c)).alias(c) for c in names]).groupBy(*names).agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
    return cut_lineage(with_global_rank(grouped, [F.asc(c) for c in names], "id").withColumn("id", F.col("id").cast("bigint")))


def _coordinates(points: DataFrame) -> list[str]:
    return [f"_x{i}" for i in range(sum(c.startswith("_x") for c in points.columns))]


def point_tree(points: DataFrame, k: int, leaf: int = LEAF) -> Tree:
    """A tree over the points; the driver holds at most ``MAX_SAMPLE`` sampled points."""
    n = points.count()
    if n <= leaf:
        return build_tree(np.zeros((0, 1)), 0, 1)
    share = min(1.0, SAMPLE / leaf, MAX_SAMPLE / n)
    share = max(share, min(1.0, 4 * (k + 1) / leaf))  # so many that a leaf can hold k others
    xs = _coordinates(points)
    drawn = points.where(F.pmod(F.xxhash64(*xs), F.lit(1_000_000_007)) < F.lit(int(share * 1_000_000_007))).select(*xs).toPandas()
    return build_tree(drawn.to_numpy(float), max(leaf * share, 2 * (k + 1)), k + 1)


def _dealt(points: DataFrame, tree: Tree, reach: bool) -> DataFrame:
    """Add ``leaf``: each row's own, or (``reach``) a row for every other leaf within the distance ``r``."""
    xs, names = _coordinates(points), points.columns

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in xs])
            own = tree.leaves(x)
            if not reach:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*names, "leaf"])
                continue
            r = batch.column(names.index("r")).to_numpy(zero_copy_only=False)
            for at, rows in tree.reached(x, r):
                rows = rows[own[rows] != at]
                if len(rows):
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), at, np.int64))], names=[*names, "leaf"])

    return points.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields) + ", leaf long")


def _nearest_of_leaf(asks: pd.DataFrame, refs: pd.DataFrame, xs: list[str], k: int) -> pd.DataFrame:
    """The nearest of ``refs`` of every asking point, within ``r``: by distance, then id, until ``need`` rows are met."""
    refs = refs.sort_values("id")
    px, pid, pcnt = refs[xs].to_numpy(float), refs["id"].to_numpy(), refs["cnt"].to_numpy()
    qx, qid = asks[xs].to_numpy(float), asks["id"].to_numpy()
    own, need, r = asks["own"].to_numpy(), asks["need"].to_numpy(), asks["r"].to_numpy()
    out = []
    for at in range(0, len(qx) if len(px) else 0, ROWS):
        part = slice(at, at + ROWS)
        d2 = np.zeros((len(qx[part]), len(px)))
        for j in range(len(xs)):
            d2 += (qx[part, j, None] - px[None, :, j]) ** 2
        d = np.sqrt(d2)
        d[own[part, None] == pid[None, :]] = np.inf
        first = np.argsort(d, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(d, first, 1)
        copies = pcnt[first]
        before = np.cumsum(copies, 1) - copies
        row, col = np.nonzero((before < need[part, None]) & (near <= r[part, None]) & np.isfinite(near))
        out.append(pd.DataFrame({"id": qid[part][row], "nid": pid[first[row, col]], "d": near[row, col], "ncnt": copies[row, col]}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "nid": [], "d": [], "ncnt": []})


def _met(asks: DataFrame, refs: DataFrame, xs: list[str], k: int, most: int) -> DataFrame:
    """Every leaf's points with the points that ask it, at most about ``most`` of them in a task."""
    asks = cut_lineage(asks)
    parts = cut_lineage(asks.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")))
    mine = asks.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
    theirs = refs.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return mine.groupBy("leaf", "part").cogroup(theirs.groupBy("leaf", "part")).applyInPandas(
        lambda a, b: _nearest_of_leaf(a, b, xs, k), "id long, nid long, d double, ncnt long")


def nearest(asks: DataFrame, refs: DataFrame, k: int, tree: Tree, asks_a_task: int = ASKS) -> DataFrame:
    """The nearest ``refs`` (``id``, coordinates, ``cnt``) of every row of ``asks`` (``id``, coordinates, ``need``, ``own``).

    Neighbours are taken by distance, ties by id, until their rows sum to
    ``need`` (at most k); the point ``own`` is left out. Returns ``id``, ``nid``,
    ``d``, ``ncnt`` and ``before`` (rows of nearer neighbours). Exact: a leaf left out
    holds no point within the distance already found. A row that needs none has no neighbours.
    """
    xs = _coordinates(asks)
    refs = cut_lineage(_dealt(refs.select("id", *xs, "cnt"), tree, False))
    asks = cut_lineage(asks.select("id", *xs, F.col("need").cast("bigint").alias("need"),
                                   F.coalesce("own", F.lit(-1)).cast("bigint").alias("own"), F.lit(math.inf).alias("r")).where("need > 0"))
    found = cut_lineage(_met(_dealt(asks, tree, False), refs, xs, k, asks_a_task))
    if len(tree.dim) > 1:
        bound = found.groupBy("id").agg(F.max("d").alias("_d"), F.sum("ncnt").alias("_n"))
        again = asks.drop("r").join(bound, "id", "left").withColumn("r", F.when(F.col("_n") >= F.col("need"), F.col("_d")).otherwise(math.inf))
        found = found.unionByName(_met(_dealt(again.drop("_d", "_n"), tree, True), refs, xs, k, asks_a_task))
    order = Window.partitionBy("id").orderBy("d", "nid")
    ranked = found.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= k)
    before = F.sum("ncnt").over(Window.partitionBy("id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumn("before", F.coalesce(before, F.lit(0)).cast("bigint")).drop("_p")
    return cut_lineage(ranked.join(asks.select("id", "need"), "id").where("before < need").drop("need"))


def _sums(points: DataFrame, near: DataFrame, own: str, k: int, value: str) -> DataFrame:
    """Add ``value``: the sum over a point's k neighbour rows, ``own`` copies of itself first.

    ``near`` has ``id``, ``ncnt``, ``before`` and ``_v``, the value of one neighbour row.
    """
    take = F.least(F.col("ncnt"), F.lit(k) - F.col(own) - F.col("before"))
    got = near.join(points.select("id", own), "id").where(take > 0).groupBy("id").agg(F.sum(take * F.col("_v")).alias("_s"))
    return points.join(got, "id", "left").withColumn(value, F.coalesce("_s", F.lit(0.0))).drop("_s")


def lof_fit(df: DataFrame, cols: list[str], k: int, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(reference points: id, coordinates, cnt, kdist, lrd; their scores: coordinates, cnt, lof_fit, lof_score).

    Fit neighbours leave the row itself out, its copies stay; scoring a training
    row includes it (distance 0). Neighbours at one distance are taken by
    coordinates. Needs k below the number of rows. Scores are rounded to 9
    digits, so that sums of another order decide no tie.
    """
    points = distinct_points(df, cols)
    xs = _coordinates(points)
    asks = points.withColumn("need", F.lit(k) - (F.col("cnt") - 1)).withColumn("own", F.col("id"))
    near = nearest(asks, points, k, point_tree(points, k, leaf))

    far = near.groupBy("id").agg(F.max("d").alias("_d"))
    base = cut_lineage(points.join(far, "id", "left").withColumn("kdist", F.coalesce("_d", F.lit(0.0))).drop("_d")
                       .withColumn("_fit", F.least(F.col("cnt") - 1, F.lit(k))).withColumn("_all", F.least(F.col("cnt"), F.lit(k))))
    reach = cut_lineage(near.join(base.select(F.col("id").alias("nid"), "kdist"), "nid").withColumn("_v", F.greatest("kdist", "d")).drop("kdist"))
    dense = _sums(base, reach, "_fit", k, "_r0")
    dense = _sums(dense, reach, "_all", k, "_r1")
    density = lambda own, s: 1.0 / ((F.col(own) * F.col("kdist") + F.col(s)) / k + 1e-10)
    dense = cut_lineage(dense.withColumn("lrd", density("_fit", "_r0")).withColumn("_lrd1", density("_all", "_r1")))
    lrds = cut_lineage(near.join(dense.select(F.col("id").alias("nid"), F.col("lrd").alias("_v")), "nid"))
    out = _sums(_sums(dense, lrds, "_fit", k, "_l0"), lrds, "_all", k, "_l1")
    score = lambda own, s, mine: F.bround((F.col(own) * F.col("lrd") + F.col(s)) / k / F.col(mine), 9)
    scores = cut_lineage(out.select(*xs, "cnt", score("_fit", "_l0", "lrd").alias("lof_fit"), score("_all", "_l1", "_lrd1").alias("lof_score")))
    return dense.select("id", *xs, "cnt", "kdist", "lrd"), scores


def lof_nd(df: DataFrame, cols: list[str], k: int, contamination: float, leaf: int = LEAF) -> DataFrame:
    """D6 on several features: (cols..., cnt, lof_fit, lof_score, vote) of every distinct point.

    Vote = -lof_score < percentile(-lof_fit, contamination).
    """
    _, out = lof_fit(df, cols, k, leaf)
    offset = F.lit(exact_quantile(out, -F.col("lof_fit"), float(contamination), F.col("cnt"))).cast("double")
    return out.select(*[F.col(f"_x{i}").alias(c) for i, c in enumerate(cols)], "cnt", "lof_fit", "lof_score",
                      (-F.col("lof_score") < offset).cast("int").alias("vote"))


def lof_scores(rows: DataFrame, cols: list[str], reference: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """(cols..., lof_score) of distinct points, seen or not, by a stored reference of ``lof_fit``."""
    points = distinct_points(rows, cols)
    xs = _coordinates(points)
    reference = cut_lineage(reference)
    near = nearest(points.withColumn("need", F.lit(k)).withColumn("own", F.lit(None).cast("bigint")), reference, k,
                   point_tree(reference, k, leaf))
    held = near.join(reference.select(F.col("id").alias("nid"), "kdist", "lrd"), "nid")
    take = F.least(F.col("ncnt"), F.lit(k) - F.col("before"))
    rated = held.groupBy("id").agg(F.sum(take * F.greatest("kdist", "d")).alias("_r"), F.sum(take * F.col("lrd")).alias("_l"))
    score = F.bround(F.col("_l") / k * (F.col("_r") / k + 1e-10), 9)
    return points.join(rated, "id").select(*[F.col(f"_x{i}").alias(c) for i, c in enumerate(cols)], score.alias("lof_score"))
