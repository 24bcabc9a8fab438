"""Chat formatting: logged conversations that are cumulative snapshots of longer ones collapse to the longest.

Each turn's hash covers its place, role and text; sums of these hashes over the
first k turns are rolling prefix hashes, so a prefix is extended by one addition
and long conversations can be summed in parts. A conversation whose whole hash
is a proper prefix hash of another is dropped by an anti-join; of equal ones the
smallest id stays. What remains is rendered turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.llm.common import written

CHUNK = 1024    # turns that are summed by one window; their sums by a second one
HASHES = ["_h0", "_h1", "_h2", "_h3"]   # four 32-bit lanes, summed as longs: 128 bits that cannot overflow


def _running(rows: DataFrame, value: dict[str, Column], chunk: Column, order: list) -> DataFrame:
    """Running sums by conversation, in two steps so that no window holds a long conversation whole."""
    inside = Window.partitionBy("conv", "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_chunk", chunk).withColumns(value)
    sums = rows.groupBy("conv", "_chunk").agg(*[F.sum(n).alias(n) for n in value])
    before = sums.select("conv", "_chunk", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before{n}") for n in value])
    part = rows.select("*", *[F.sum(n).over(inside).alias(f"_part{n}") for n in value])
    joined = part.alias("p").join(before.alias("b"), F.expr("p.conv = b.conv AND p._chunk <=> b._chunk"))
    return joined.select("p.*", *[F.col(f"_before{n}").alias(f"_b{n}") for n in value]) \
        .withColumns({n: F.col(f"_b{n}") + F.col(f"_part{n}") for n in value}) \
        .drop("_chunk", *[f"_part{n}" for n in value], *[f"_b{n}" for n in value])


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each distinct turn with its place ``k`` (from 1) and the hash of the conversation's first k turns.

    Returns ``conv``, ``turn``, ``role``, ``text``, ``k`` and the four lanes.
    Turns are ordered by number (null first), then role and text; exact repeats
    of a turn count once. Rows without a conversation id belong to none and are
    left out.
    """
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.col(text).alias("text")).where(F.col("conv").isNotNull()) \
        .withColumn("_body", F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text"))
    rows = rows.dropDuplicates(["conv", "turn", "role", "text"])
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    placed = _running(rows, {"k": F.lit(1).cast("bigint")}, F.floor(F.col("turn") / CHUNK), order)
    one, two = F.xxhash64("k", "_body"), F.xxhash64("_body", "k", F.lit(7))
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    lanes = dict(zip(HASHES, [low(one), F.shiftrightunsigned(one, 32), low(two), F.shiftrightunsigned(two, 32)]))
    return _running(placed, lanes, F.floor(F.col("k") / CHUNK), [F.col("k")]).drop("_body")


def collapse(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns of the maximal conversations: ``conv``, ``k``, ``turn``, ``role``, ``text``, ``n_turns``, ``snapshots``.

    ``snapshots`` counts the conversations equal to the kept one, itself included.
    """
    rows = written(prefixes(turns, conv_id, turn, role, text), "chat-prefixes")
    length = rows.groupBy("conv").agg(F.max("k").alias("n_turns"))
    whole = rows.join(length, "conv").where(F.col("k") == F.col("n_turns"))
    # conversations of equal turns as one row, prefixes of equal turns as one row: no hot first turn
    classes = whole.groupBy("k", *HASHES).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("snapshots"))
    inner = rows.join(length, "conv").where(F.col("k") < F.col("n_turns")).select("k", *HASHES).distinct()
    kept = written(classes.join(inner, ["k", *HASHES], "left_anti")
                   .select("conv", F.col("k").alias("n_turns"), "snapshots"), "chat-kept")
    return rows.drop(*HASHES).join(kept, "conv")


ROLES = ["system", "user", "assistant", "tool"]     # FIXED VALUES: roles a template knows


def render(turns: DataFrame) -> DataFrame:
    """Add ``rendered``: the turn in the chat template, role marks around its text; an unknown or null role is a user."""
    role = F.lower(F.trim(F.coalesce("role", F.lit("user"))))
    known = F.when(role.isin(ROLES), role).otherwise(F.lit("user"))
    body = F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"<\|(im_start|im_end)\|>", "<$1>")
    return turns.withColumn("rendered", F.concat(F.lit("<|im_start|>"), known, F.lit("\n"), body, F.lit("<|im_end|>\n")))


def conversations(rendered: DataFrame) -> DataFrame:
    """One row a conversation: ``conv``, ``n_turns``, ``snapshots`` and its whole rendered ``text``."""
    turns = F.sort_array(F.collect_list(F.struct("k", "rendered")))
    return rendered.groupBy("conv", "n_turns", "snapshots").agg(
        F.array_join(F.transform(turns, lambda t: t["rendered"]), "").alias("text"))
