"""Sharding by a k-d tree over document metadata.

A node that stands for several shards is cut along its widest dimension (its
extent over that of all rows) at the weighted quantile that leaves each side
its part of the bytes: the median where the shards divide evenly. The quantile
is found on the executors' histograms: sums of sizes by bin, then only the bin
with the cut is split again, until it holds one value; rows that share it are
cut by a fixed hash key. Only bins of the open nodes reach the driver, as many
as parameters allow, and the finished tree is a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.llm.common import written
from lookout.llm.mixing import KEY_BITS, document_key

KEY = "_key"
ALL_KEYS = (1 << KEY_BITS) - 1
MOST = 1e300  # values of a dimension beyond it, infinite ones too, count as null


@dataclass(frozen=True)
class ShardParams:
    shards: int = 40
    target_bytes: int | None = None  # if given, as many shards as keep them near this size, in place of ``shards``
    bins: int = 256         # histogram bins of one refinement
    slot_bits: int = 8      # each shard is numbered in 2^slot_bits parts


@dataclass
class _Node:
    """A node of one level; its number is its place in the level's list. ``shards`` numbers from ``first`` are made of it.

    While its cut is sought, the rows that matter have a value of ``dim`` (or,
    once that is the single value ``at``, a key) within [low, high].
    """

    first: int
    shards: int
    dim: int = 0
    low: float = 0.0
    high: float = 0.0
    goal: float = 0.0           # bytes that are to lie on the left
    below: float = 0.0          # bytes left of [low, high]
    at: float | None = None
    key: int | None = None      # the cut: rows of a smaller value, and rows of value ``at`` up to this key, lie on the left

    def narrow(self, found: list) -> None:
        """Go on with the bin that holds the goal, or finish."""
        for r in found:
            if self.below + r["s"] < self.goal and r is not found[-1]:
                self.below += r["s"]
                continue
            break
        if self.at is None:
            self.low, self.high = r["v0"], r["v1"]
            if self.low == self.high:
                self.at, self.low, self.high = self.low, 0, ALL_KEYS
        else:
            self.low, self.high = r["k0"], r["k1"]
            if self.low == self.high:  # one row, or its repeats: it goes where the sum comes nearer to the goal
                self.key = self.low if self.below + r["s"] - self.goal < self.goal - self.below else self.low - 1


def text_code(text: Column) -> Column:
    """A number for each distinct string, whatever prefixes strings share; null stays null."""
    return F.when(text.isNotNull(), F.xxhash64(text).cast("double"))


def _finite(value: Column) -> Column:
    """NaN and values beyond ``MOST`` as null."""
    value = value.cast("double")
    return F.when(F.abs(value) <= MOST, value)


def _null_places(rows: DataFrame, names: list[str]) -> dict[str, float]:
    """A value just below the least real one of each dimension, so that nulls lie at its edge and hardly widen it."""
    ends = rows.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for n in names:
        low, high = ends[f"lo_{n}"], ends[f"hi_{n}"]
        out[n] = 0.0 if low is None else low - max(high - low, abs(low), 1.0) * 1e-9
    return out


def _pick(values: list, kind: str, node: Column) -> Column:
    """The node's own value of a list that has one for each node of a level."""
    return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), node)


def _child(node: Column, value: Column, at: Column, key: Column) -> Column:
    """The child of ``node`` that a row lies in; nodes without a cut pass their rows to the left."""
    left = at.isNull() | key.isNull() | (value < at) | ((value == at) & (F.col(KEY) <= key))
    return node * 2 + F.when(left, 0).otherwise(1)


def _cuts(nodes: list[_Node]) -> list[tuple[list, str]]:
    return [([n.dim for n in nodes], "int"), ([n.at for n in nodes], "double"), ([n.key for n in nodes], "bigint")]


def _down(rows: DataFrame, level: list[_Node], dims: list[str]) -> DataFrame:
    """The rows one level deeper, ``_node`` written anew: passes over a level read it instead of walking the tree again."""
    dim, at, key = (_pick(values, kind, F.col("_node")) for values, kind in _cuts(level))
    return written(rows.withColumn("_node", _child(F.col("_node"), F.get(F.array(*dims), dim), at, key)), "shard-level")


def leaf(levels: list[list[_Node]], dims: list[str]) -> Column:
    """The shard of a row: a walk down the finished tree, whose nodes stand level by level in one list."""
    nodes, starts = [], []
    for level in levels[:-1]:
        starts.append(len(nodes))
        nodes += level

    def step(node: Column, start: Column) -> Column:
        dim, at, key = (_pick(values, kind, start + node) for values, kind in _cuts(nodes))
        return _child(node, F.get(F.array(*dims), dim), at, key)

    last = F.lit(0) if not nodes else F.aggregate(F.array(*[F.lit(s) for s in starts]), F.lit(0), step)
    return _pick([n.first for n in levels[-1]], "int", last)


def _refine(rows: DataFrame, level: list[_Node], dims: list[str], bins: int) -> None:
    """One pass over the rows for all nodes whose cut is still sought."""
    open_ = [n.shards > 1 and n.key is None for n in level]
    by_key = [n.at is not None for n in level]
    node = F.col("_node")
    rows = rows.where(_pick(open_, "boolean", node)) \
        .withColumn("_v", F.get(F.array(*dims), _pick([n.dim for n in level], "int", node))) \
        .withColumn("_by_key", _pick(by_key, "boolean", node))
    low = _pick([0.0 if k else float(n.low) for n, k in zip(level, by_key)], "double", node)
    high = _pick([0.0 if k else float(n.high) for n, k in zip(level, by_key)], "double", node)
    at = _pick([n.at for n in level], "double", node)
    first = _pick([int(n.low) if k else 0 for n, k in zip(level, by_key)], "bigint", node)
    last = _pick([int(n.high) if k else 0 for n, k in zip(level, by_key)], "bigint", node)
    inside = F.when(F.col("_by_key"), (F.col("_v") == at) & F.col(KEY).between(first, last)) \
        .otherwise(F.col("_v").between(low, high))
    place = F.when(F.col("_by_key"), (F.col(KEY) - first) / F.greatest(last - first, F.lit(1))) \
        .otherwise(F.when(high > low, (F.col("_v") - low) / (high - low)).otherwise(0.0))
    found = rows.where(inside).withColumn("_b", F.least(F.floor(place * bins), F.lit(bins - 1))) \
        .groupBy("_node", "_b").agg(F.sum("size").alias("s"), F.min("_v").alias("v0"), F.max("_v").alias("v1"),
                                    F.min(KEY).alias("k0"), F.max(KEY).alias("k1")).orderBy("_node", "_b").collect()
    for i, n in enumerate(level):
        if open_[i]:
            n.narrow([r for r in found if r["_node"] == i])


def grow(rows: DataFrame, dims: list[str], params: ShardParams) -> list[list[_Node]]:
    """The levels of the tree over ``rows``: the dimensions (doubles), ``size`` and ``_key``; the last one holds the shards."""
    extent = [f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    levels, span = [[_Node(0, params.shards)]], None
    rows = rows.withColumn("_node", F.lit(0))
    while any(n.shards > 1 for n in levels[-1]):
        level = levels[-1]
        stats = {r["_node"]: r for r in rows.groupBy("_node").agg(F.sum("size").alias("s"), *extent).collect()}
        if span is None:
            span = [stats[0][f"hi{i}"] - stats[0][f"lo{i}"] if 0 in stats else 0.0 for i in range(len(dims))]
        for i, n in enumerate(level):
            if n.shards > 1 and i in stats:
                wide = [(stats[i][f"hi{k}"] - stats[i][f"lo{k}"]) / (span[k] or 1.0) for k in range(len(dims))]
                n.dim = max(range(len(dims)), key=lambda k: (wide[k], -k))
                n.low, n.high = stats[i][f"lo{n.dim}"], stats[i][f"hi{n.dim}"]
                n.goal = stats[i]["s"] * (n.shards // 2) / n.shards
            elif n.shards > 1:
                n.at, n.key = 0.0, -1  # no rows: its shards stay empty
        while any(n.shards > 1 and n.key is None for n in level):
            _refine(rows, level, dims, params.bins)
        rows = _down(rows, level, dims)
        halves = [(n.shards // 2 if n.shards > 1 else n.shards) for n in level]
        levels.append([child for n, left in zip(level, halves)
                       for child in (_Node(n.first, left), _Node(n.first + left, n.shards - left))])
    return levels


def document_dims(docs: DataFrame) -> dict[str, Column]:
    """Metadata dimensions of the ``documents`` table."""
    return {"source": text_code(F.col("source")), "lang": text_code(F.col("lang")),
            "length": F.log2(F.length("text") + 1.0), "id": F.col("doc_id").cast("double")}


def shard(docs: DataFrame, dims: dict[str, Column], doc_id: str = "doc_id", text: str = "text",
          params: ShardParams = ShardParams()) -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes.

    ``dims`` names the metadata dimensions (numeric, double). A row's size is
    its text's UTF-8 bytes plus 16. Adds ``size``, ``shard`` and ``slot`` (its
    gapless place in the shard, by key) to all columns of the rows. Nulls, NaN
    and infinite values of a dimension lie just below its least value; a null text has size 16.
    Rows of equal id and text have one key and stay together. An empty table
    gives an empty result.
    """
    names = [f"_dim{i}" for i in range(len(dims))]
    marks = {n: _finite(c) for n, c in zip(names, dims.values())}
    marks |= {"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 16,
              KEY: document_key(F.col(doc_id), F.col(text))}
    marked = docs.drop("shard", "slot", "size").withColumns(marks)
    rows = written(marked.select("size", KEY, *names), "shard-rows")
    nulls = _null_places(rows, names)
    rows, marked = rows.fillna(nulls), marked.fillna(nulls)
    if params.target_bytes is not None:
        total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
        params = replace(params, shards=max(1, -(-total // params.target_bytes)))
    levels = grow(rows, names, params)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("shard", leaf(levels, names)).withColumn("_part", F.shiftright(KEY, KEY_BITS - params.slot_bits))

    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed(rows).groupBy("shard", "_part").count() \
        .select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    starts = written(starts, "shard-starts")
    inside = Window.partitionBy("shard", "_part").orderBy(KEY)
    return placed(marked).join(starts, ["shard", "_part"]) \
        .withColumn("slot", F.col("_start") + F.row_number().over(inside) - 1) \
        .select(*[c for c in docs.columns if c not in ("shard", "slot", "size")], "size", "shard", "slot")
