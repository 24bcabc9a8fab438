"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit key. Words are summed by source and leading
key bits; the running sum finds the bucket in which a source's budget ends, and
only that bucket is split by further bits, until it holds a single key. What
lies below the threshold is taken: a filter, no sort. Larger budgets keep all
that smaller ones take (nested thresholds).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.llm.common import written

KEY_BITS = 60
CUTS = "array<struct<start: bigint, edge: bigint, largest: double>>"    # keys from start to below edge, of rows up to largest words


@dataclass(frozen=True)
class MixParams:
    level_bits: int = 12    # key bits of one histogram; divides KEY_BITS
    passes: int = 3         # thresholds a turn: the first, and those that fill what a large boundary document left open
    max_repeat: int = 3     # a target stops at so many times its source's size; no document is taken more often
    near: float = 0.001     # a source is filled, by up to max_repeat turns over its documents, until this share of its target is open


def document_key(doc_id: Column, text: Column) -> Column:
    """60 fixed bits of a document's id and text; equal rows have equal keys."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: int = 3, params: MixParams = MixParams()) -> DataFrame:
    """Targets of the sources (``source``, ``source_size``): shares by weight, capped, the excess reshared.

    Sources weigh 1, 2, ..., ``weights`` in turn, by code point, null last.
    Adds ``weight`` and ``target``. The driver holds one line of sums a round.
    """
    # the rank of a source: rows before it in its range, and the sizes of the ranges before
    n = sizes.sparkSession.sparkContext.defaultParallelism
    dealt = written(sizes.withColumn("_none", F.col("source").isNull()).repartitionByRange(n, "_none", "source")
                    .withColumn("_part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_none", "source")
    ranked = dealt.withColumn("_in", F.row_number().over(inside)).join(parts, "_part") \
        .withColumn("weight", (F.col("_before") + F.col("_in") - 1) % weights + 1)
    ranked = written(ranked.select("source", "source_size", "weight"), "mix-weights")
    cap = F.col("source_size") * params.max_repeat
    share, capped = None, -1
    while True:
        full = F.lit(False) if share is None else cap <= F.col("weight") * F.lit(share)
        s = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("capped"),
                       F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if s["n"] == capped or not s["weight"]:
            break
        capped = s["n"]
        share = ((s["all"] or 0) - (s["capped"] or 0)) / s["weight"]
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(share or 0.0))))


def thresholds(rows: DataFrame, budgets: DataFrame, params: MixParams) -> DataFrame:
    """Where each source's budget (``_s``, ``open``) ends among its rows (``_s``, ``size``, ``key``).

    Returns ``_s``, ``edge`` (the first key that does not fit: those below it are
    taken; null if all rows of the source fit) and ``rest`` (what is left of the
    budget). Sources without rows are left out.
    """
    bits = 0
    state = budgets.select("_s", F.lit(0).cast("bigint").alias("_prefix"), F.col("open").alias("_open"))
    done = None
    while bits < KEY_BITS:
        bits += params.level_bits
        shift = KEY_BITS - bits
        inside = rows.join(state, "_s")
        if done is not None:
            inside = inside.where(F.shiftright("key", shift + params.level_bits) == F.col("_prefix"))
        hist = inside.groupBy("_s", F.shiftright("key", shift).alias("_bucket"), "_open") \
            .agg(F.sum("size").alias("_sum"), F.min("key").alias("_low"), F.max("key").alias("_high"))
        run = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("_upto", F.sum("_sum").over(run))
        first = F.min(F.when(F.col("_upto") > F.col("_open"), F.struct("_bucket", "_sum", "_upto", "_low", "_high")))
        part = hist.groupBy("_s", "_open").agg(first.alias("_b"), F.sum("_sum").alias("_all")).select("_s", "_open", "_all", "_b.*") \
            .withColumn("_under", F.col("_open") - F.coalesce(F.col("_upto") - F.col("_sum"), "_all"))
        part = written(part, "mix-level")
        split = (F.col("_low") < F.col("_high")) if bits < KEY_BITS else F.lit(False)   # the boundary bucket holds several keys
        ready = part.where(~F.coalesce(split, F.lit(False)))
        done = ready if done is None else done.unionByName(ready)
        state = part.where(split).select("_s", F.col("_bucket").alias("_prefix"), F.col("_under").alias("_open"))
        if state.isEmpty():
            break
    return written(done.select("_s", F.col("_low").alias("edge"), F.col("_under").alias("rest")), "mix-threshold")


def _marked(docs: DataFrame, size: Column, doc_id: str, text: str, source: str, *keep: Column) -> DataFrame:
    """``_s`` (the source, nulls as one), ``size`` and ``key`` of every row, beside the columns to keep."""
    s = F.struct(F.coalesce(F.col(source), F.lit("")).alias("name"), F.col(source).isNull().alias("none"))
    return docs.select(*keep, F.col(source).alias("source"), s.alias("_s"), size.cast("bigint").alias("size"),
                       document_key(F.col(doc_id), F.col(text)).alias("key"))


def source_cuts(rows: DataFrame, weights: int, params: MixParams) -> DataFrame:
    """What is taken of every source ``_s``: ``source_size``, ``target``, ``whole`` passes, the ``cuts`` of further ones and what stays ``open``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = source_targets(sizes, weights, params).withColumn("whole", whole.cast("bigint")) \
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")) \
        .withColumn("_s", F.struct(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none")))
    plan = written(plan, "mix-plan")

    state = plan.select("_s", "source_size", "target", "whole", F.col("budget").alias("open"),
                        F.array().cast(CUTS).alias("cuts"))
    for turn in range(params.max_repeat):
        for step in range(params.passes):
            state, fitted = _filled(rows, state, fresh=step == 0, whole=turn == step == 0, params=params)
            if not fitted or _open_sources(state, params).isEmpty():
                break
        if step == 0:   # a turn over all keys that left nothing to do
            break
    return _nearest(rows, state, params)


def _open_sources(state: DataFrame, params: MixParams) -> DataFrame:
    """Sources whose rest is above ``near`` of their target."""
    return state.where(F.col("open") > F.col("target") * params.near)


def _fitting(rows: DataFrame, state: DataFrame, params: MixParams) -> DataFrame:
    """Rows of open sources that hold words and can be taken once more."""
    return rows.where(F.col("size") > 0).join(_open_sources(state, params), "_s").where(_repeats(params) < params.max_repeat)


def _filled(rows: DataFrame, state: DataFrame, fresh: bool, whole: bool, params: MixParams) -> tuple[DataFrame, bool]:
    """One pass: the next cut of every open source, and whether any row fitted.

    A fresh pass starts at the least key again, others behind the last edge.
    """
    start = F.lit(0) if fresh else F.coalesce(F.get("cuts", F.size("cuts") - 1)["edge"] + 1, F.lit(0))
    largest = F.lit(None).cast("double") if whole else F.col("open")
    fits = _fitting(rows, state.withColumn("_start", start.cast("bigint")), params).where(F.col("key") >= F.col("_start"))
    if not whole:
        fits = fits.where(F.col("size") <= F.col("open"))
    found = thresholds(fits.select("_s", "size", "key"), _open_sources(state, params).select("_s", "open"), params)
    cut = F.struct(start.cast("bigint").alias("start"), F.col("edge"), largest.alias("largest"))
    after = written(state.join(found, "_s", "left").select(
        "_s", "source_size", "target", "whole", F.coalesce("rest", "open").alias("open"),
        F.when(F.col("rest").isNull(), F.col("cuts")).otherwise(F.concat("cuts", F.array(cut))).cast(CUTS).alias("cuts")), "mix-taken")
    return after, not found.isEmpty()


def _nearest(rows: DataFrame, state: DataFrame, params: MixParams) -> DataFrame:
    """A last cut of one key, the smallest that brings an open source nearer to its target by passing it."""
    wide = _fitting(rows, state, params).where((F.col("size") > F.col("open")) & (F.col("size") < 2 * F.col("open"))) \
        .groupBy("_s", "key", "open").agg(F.sum("size").alias("_here")).where(F.col("_here") < 2 * F.col("open")) \
        .groupBy("_s").agg(F.min(F.struct("_here", "key"))["key"].alias("_key"))
    cut = F.struct(F.col("_key").alias("start"), (F.col("_key") + 1).alias("edge"), F.lit(None).cast("double").alias("largest"))
    return written(state.join(wide, "_s", "left").withColumn(
        "cuts", F.when(F.col("_key").isNull(), F.col("cuts")).otherwise(F.concat("cuts", F.array(cut))).cast(CUTS)).drop("_key"), "mix-cuts")


def _repeats(params: MixParams) -> Column:
    """How often a row (``key``, ``size``) is taken, by the ``whole`` passes and the ``cuts`` of its source.

    An empty row is taken at least once, at no cost.
    """
    def inside(cut: Column) -> Column:
        return (F.col("key") >= cut["start"]) & (cut["edge"].isNull() | (F.col("key") < cut["edge"])) \
            & (cut["largest"].isNull() | (F.col("size") <= cut["largest"]))

    # rows that had all their copies before a cut were not counted by it
    more = F.least(F.col("whole") + F.size(F.filter("cuts", inside)), F.lit(params.max_repeat))
    return F.when(F.col("size") == 0, F.greatest("whole", F.lit(1))).otherwise(more)


def mix(docs: DataFrame, size: Column, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: int = 3, params: MixParams = MixParams()) -> DataFrame:
    """How much of every document the mix takes.

    Returns ``doc_id``, ``text_hash``, ``source``, ``size``, ``source_size``,
    ``target``, ``repeats`` (how often the document is taken) and ``taken``
    (size by repeats). Whole passes of a source come first, the rest of its
    target by thresholds on the key: what a large document at the boundary
    leaves open is filled by smaller ones behind it, then by further turns over
    the documents below ``max_repeat`` copies, until no more than ``near`` of
    the target is open or nothing fits; last, one document may pass the target
    if that comes nearer. Rows with equal id and text share their key and are
    taken together; empty documents are taken at no cost, at least once; an
    empty table gives an empty mix. Reruns agree: nothing is drawn at random.
    """
    rows = written(_marked(docs, size, doc_id, text, source, F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash")),
                   "mix-rows")
    return rows.join(source_cuts(rows, weights, params), "_s").withColumn("repeats", _repeats(params)) \
        .select("doc_id", "text_hash", "source", "size", "source_size", "target", "repeats",
                (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame, size: Column, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: int = 3, params: MixParams = MixParams()) -> DataFrame:
    """The mix itself: every row with all its columns, as often as ``mix`` takes it; rows it leaves out are gone."""
    rows = written(_marked(docs, size, doc_id, text, source), "mix-rows")
    cuts = source_cuts(rows, weights, params)
    return _marked(docs, size, doc_id, text, source, F.struct("*").alias("_doc")).join(cuts, "_s") \
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(_repeats(params), F.lit(1))))) \
        .where(F.col("_copy") <= _repeats(params)).select("_doc.*")
