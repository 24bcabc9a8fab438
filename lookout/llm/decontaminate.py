"""Benchmark decontamination by spaced-seed hashing.

A seed looks at a window of ``len(mask)`` tokens and hashes only the positions
that the mask marks, so a substituted token at an ignored position leaves the
hash as it is. Seeds of the training texts are joined with those of the
benchmark; around every hit the two texts are compared token by token on the
hit's alignment, and the best run (matches minus substitutions) decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import written


@dataclass(frozen=True)
class SeedParams:
    masks: tuple[str, ...] = ("111010011011", "110110010111", "101101110011")  # 1: the token counts
    shortest: int = 5           # benchmark texts of fewer tokens name no passage and are never matched
    min_score: int = 10         # matches minus substitutions of an overlap; a shorter benchmark text must match whole
    broadcast_rows: int = 2_000_000   # seeds of a benchmark that are broadcast; more meet narrow seeds of the documents in a shuffle
    block: int = 1024           # windows of a text that are looked up together

    @property
    def span(self) -> int:
        return len(self.masks[0])


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    bare = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def _hashed(texts: DataFrame, text: str, *keep: Column) -> DataFrame:
    return texts.select(*keep, tokens(F.col(text)).alias("_tokens")) \
        .withColumn("_h", F.transform("_tokens", lambda w: F.xxhash64(w))).drop("_tokens") \
        .withColumn("_n", F.size("_h"))


def _seeds(hashed: DataFrame, params: SeedParams, short: list[int]) -> DataFrame:
    """One row for each window and mask: ``_at`` and ``_seed`` beside the columns to keep, without the text.

    ``short`` lists the lengths below the span for which whole runs are hashed,
    for benchmark texts that are shorter than a mask. A text is first cut into
    blocks of windows: the generated code holds the matches of one row of its
    input at once, so that row must be a block and no match may carry a text.
    """
    reach = min([params.span, *short])
    keep = [c for c in hashed.columns if c not in ("_h", "_n")]
    starts = F.when(F.col("_n") >= reach, F.sequence(F.lit(0), F.col("_n") - reach, F.lit(params.block)))
    rows = hashed.select(*keep, F.inline(F.transform(starts, lambda at: F.struct(
        at.alias("_first"), F.slice("_h", at + 1, params.block + params.span - 1).alias("_b"))))) \
        .withColumn("_in", F.explode(F.sequence(F.lit(0), F.least(F.lit(params.block - 1), F.size("_b") - reach))))
    each = [(m, params.span, [i for i, c in enumerate(mask) if c == "1"]) for m, mask in enumerate(params.masks)]
    each += [(len(params.masks) + n, n, list(range(n))) for n in short]
    seeds = [F.when(F.col("_in") + length <= F.size("_b"),
                    F.xxhash64(F.lit(m), *[F.get("_b", F.col("_in") + i) for i in at])) for m, length, at in each]
    return rows.select(*keep, (F.col("_first") + F.col("_in")).alias("_at"), F.explode(F.array(*seeds)).alias("_seed")) \
        .where(F.col("_seed").isNotNull())


def _run_score(a: Column, b: Column) -> Column:
    """Largest sum, over a run of positions, of 1 for equal tokens and -1 for others."""
    step = lambda acc, hit: F.struct(
        F.greatest(acc["now"] + hit, F.lit(0)).alias("now"), F.greatest(acc["best"], acc["now"] + hit).alias("best"))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(-1)), zero, step, lambda acc: acc["best"])


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
             item_id: str = "item_id", item_text: str = "text", params: SeedParams = SeedParams()) -> DataFrame:
    """Passages of benchmark texts in the documents.

    Returns ``doc_id``, ``text_hash``, ``item_id``, ``offset`` (token of the
    document less token of the item at which the two are aligned) and ``score``.
    Null, blank and too short texts have no overlap; benchmark items of equal
    text are reported each; repeated documents are reported once.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    items = _hashed(items, "text", F.col("item_id")).where(F.col("_n") >= params.shortest)
    items = written(items.groupBy("_h", "_n").agg(F.collect_set("item_id").alias("items"))
                    .withColumn("_item", F.xxhash64(F.col("_h"), F.lit(1))), "decon-items")
    short = sorted(r["_n"] for r in items.where(F.col("_n") < params.span).select("_n").distinct().collect())
    wanted = written(_seeds(items, params, short).select("_seed", "_item", F.col("_at").alias("_item_at")), "decon-seeds")
    bodies = items.select("_item", F.col("_h").alias("_item_h"), F.col("_n").alias("_item_n"))
    own = _hashed(docs, text, F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    few = wanted.count() <= params.broadcast_rows   # then so do the texts, which have fewer tokens than seeds
    near = F.broadcast if few else lambda table: table
    # seeds travel without their texts; each hit document fetches its own once
    places = written(_seeds(own, params, short).join(near(wanted), "_seed")
                     .select("doc_id", "text_hash", "_item", (F.col("_at") - F.col("_item_at")).alias("offset")).distinct(), "decon-places")
    hit = places.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash")).distinct()
    if places.count() <= params.broadcast_rows:     # else all documents would be sorted by key
        hit = F.broadcast(hit)
    fetched = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text")) \
        .join(hit, F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.col("text_hash") == F.col("_hit_hash")), "left_semi") \
        .dropDuplicates(["doc_id", "text_hash"])
    fetched = _hashed(fetched, "_text", F.col("doc_id").alias("_own_id"), F.col("text_hash").alias("_own_hash"))
    # sorted, a document meets its places one by one; each takes its own run of tokens along, not the text
    begin = F.greatest(F.lit(0), -F.col("offset"))
    length = F.least(F.col("_item_n"), F.col("_n") - F.col("offset")) - begin
    runs = places.join(near(bodies.select("_item", "_item_n")), "_item").hint("merge") \
        .join(fetched, F.col("doc_id").eqNullSafe(F.col("_own_id")) & (F.col("text_hash") == F.col("_own_hash"))) \
        .select("doc_id", "text_hash", "_item", "offset", begin.alias("_begin"), F.slice("_h", F.col("offset") + begin + 1, length).alias("_run"))
    found = runs.join(near(bodies), "_item") \
        .withColumn("score", _run_score(F.col("_run"), F.slice("_item_h", F.col("_begin") + 1, F.size("_run")))) \
        .where(F.col("score") >= F.least(F.lit(params.min_score), F.col("_item_n")))
    return found.join(items.select("_item", "items"), "_item") \
        .select("doc_id", "text_hash", F.explode("items").alias("item_id"), "offset", "score")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  params: SeedParams = SeedParams()) -> DataFrame:
    """The documents without an overlap, with all columns; documents without an id or text stay."""
    bad = overlaps(docs, benchmark, doc_id, text, params=params) \
        .select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    bad = written(bad, "decon-bad")
    if bad.count() <= params.broadcast_rows:    # else all documents would be sorted by key
        bad = F.broadcast(bad)
    return docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash")) \
        .join(bad, F.col("_id").eqNullSafe(F.col("_bad_id")) & (F.col("_hash") == F.col("_bad_hash")), "left_anti").select("_doc.*")
