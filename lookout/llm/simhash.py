"""SimHash near-duplicates: fingerprints linked at few differing bits, by a Gray-order hierarchical index.

Every text's 64-bit fingerprint is set by majority over its shingle hashes.
Distinct fingerprints are dealt to groups that agree on ``agree`` of ``blocks``
bit blocks: two fingerprints with at most ``blocks - agree`` differing bits meet
in at least one group (pigeonhole), so no link is lost. Inside a group the
fingerprints are sorted by Gray rank; each upper node of the index holds the bits
that all fingerprints below it share. A pair of nodes is searched from the top,
and dropped whole when the shared bits already differ too often, or when all
below it is linked already. What leaves a group are links that span its
components, never all its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookout.llm.common import written


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 4        # words in a shingle
    seed: int = 42
    max_bits: int = 4       # differing bits of linked fingerprints
    blocks: int = 6         # bit blocks; blocks - max_bits of them agree for every link
    split_at: int = 200_000  # groups of more fingerprints are dealt anew by blocks of the bits that remain
    leaf_pairs: int = 1 << 17   # node pairs handled at once; a task holds a few times as many for each level of the index


def _fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """64-bit majority fingerprint as a signed integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-shingle]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b - 1], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    found, total = np.array(hashes, np.uint64), np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        total += np.unpackbits(found[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") \
            .sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(found), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", params: SimHashParams = SimHashParams()) -> DataFrame:
    """Replace the text by ``fp``, its fingerprint as a signed 64-bit integer; other columns pass through."""
    others = [c for c in docs.columns if c not in (text, "fp")]
    docs = docs.select(text, *others)
    shingle, seed = params.shingle, params.seed

    def run(batches):
        for batch in batches:
            fps = [_fingerprint(t, shingle, seed) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names=[*others, "fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[1:], T.StructField("fp", T.LongType())]))


# ---------------------------------------------------------------------------
# the index inside a task
# ---------------------------------------------------------------------------
def _gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray sequence."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


def _levels(values: np.ndarray, groups: np.ndarray):
    """Upper nodes over fingerprints sorted by (group, Gray rank).

    A list of (pattern, shared bits, first leaf, end leaf) per level, leaves
    first; a node covers two neighbours of the level below if both lie in the
    same group, so the last level has one node a group.
    """
    at = np.arange(len(values))
    pattern, mask, first, end, own = values, np.full(len(values), ~np.uint64(0)), at, at + 1, groups
    out = [(pattern, mask, first, end, own, None)]
    while True:
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        if len(start) == len(own):
            return out
        place = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
        left = np.flatnonzero(place % 2 == 0)
        right = left + 1
        paired = (right < len(own)) & (own[np.minimum(right, len(own) - 1)] == own[left])
        right = np.where(paired, right, left)
        shared = mask[left] & mask[right] & ~(pattern[left] ^ pattern[right])
        pattern, mask, first, end, own = pattern[left], shared, first[left], end[right], own[left]
        out.append((pattern, mask, first, end, own, (left, right)))


class _Labels:
    """Components of the leaves: each leaf's label is the smallest leaf linked to it."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def _whole(level, labels: np.ndarray):
    """The component of each node if all its leaves are in one, else -1 for the node."""
    first, end = level[2], level[3]
    cuts = np.stack([first, end], 1).ravel()
    padded = np.append(labels, 0)
    low = np.minimum.reduceat(padded, cuts)[::2]
    high = np.maximum.reduceat(padded, cuts)[::2]
    return np.where(low == high, low, -1)


def link_groups(values: np.ndarray, groups: np.ndarray, max_bits: int, chunk: int = 1 << 20) -> np.ndarray:
    """Component labels (leaf numbers) of fingerprints sorted by (group, Gray rank).

    Exact: two fingerprints of one group within ``max_bits`` share a label.
    """
    labels = _Labels(len(values))
    near = np.flatnonzero((groups[1:] == groups[:-1]) & (np.bitwise_count(values[1:] ^ values[:-1]) <= max_bits))
    labels.link(near, near + 1)
    levels = _levels(values, groups)
    roots = np.flatnonzero(levels[-1][3] - levels[-1][2] > 1)
    stack = [(len(levels) - 1, roots, roots)]
    whole, linked = {}, True
    while stack:
        depth, a, b = stack.pop()
        if len(a) > chunk:
            stack += [(depth, a[i:i + chunk], b[i:i + chunk]) for i in range(0, len(a), chunk)]
            continue
        if linked:
            whole, linked = {}, False
        if depth not in whole:
            whole[depth] = _whole(levels[depth], labels.of)
        pattern, mask = levels[depth][:2]
        known = whole[depth]
        keep = (known[a] < 0) | (known[a] != known[b])
        keep &= np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= max_bits
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if depth == 0:
            labels.link(a, b)
            linked = True
            continue
        left, right = levels[depth][5]
        same, ra, rb = a == b, right[a] != left[a], right[b] != left[b]
        pairs = [(left[a], left[b], np.full(len(a), depth > 1) | ~same), (left[a], right[b], rb),
                 (right[a], left[b], ra & ~same), (right[a], right[b], ra & rb & ((depth > 1) | ~same))]
        down_a = np.concatenate([x[use] for x, _, use in pairs])
        down_b = np.concatenate([y[use] for _, y, use in pairs])
        # near leaves first: they join components that let later pairs be dropped whole
        order = np.argsort(np.abs(levels[depth - 1][2][down_a] - levels[depth - 1][2][down_b]), kind="stable")[::-1]
        down_a, down_b = down_a[order], down_b[order]
        stack += [(depth - 1, down_a[i:i + chunk // 4], down_b[i:i + chunk // 4]) for i in range(0, len(down_a), chunk // 4)]
    return labels.of


# ---------------------------------------------------------------------------
# dealing fingerprints to groups
# ---------------------------------------------------------------------------
def _block_masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks of every choice of ``agree`` out of ``blocks`` equal parts of the given bits."""
    parts = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), blocks)]
    return [sum(choice) for choice in combinations(parts, agree)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _deal(fps: DataFrame, params: SimHashParams, base: int = 0) -> DataFrame:
    """One row (key, fp) for each group a fingerprint lies in; a key is a mask and the bits under it.

    With ``base`` the rows have a mask already, and the blocks are cut from the
    bits outside it.
    """
    agree = params.blocks - params.max_bits
    free = [b for b in range(64) if not base >> b & 1]
    masks = [_signed(base | m) for m in _block_masks(free, params.blocks, agree)]
    return fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")) \
        .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")


LINK, DEAL_AGAIN = 0, 1
LINK_SCHEMA = "kind int, a long, b long"


def _rows(kind: int, a, b):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.asarray(a, np.int64)),
                                       pa.array(np.asarray(b, np.int64))], names=["kind", "a", "b"])


def _links_of_task(batches, max_bits: int, chunk: int, split_at: int | None):
    """Spanning links of the groups of one partition, sorted by key; keys of groups over ``split_at`` are handed back.

    Holds the groups of a few batches, and of the largest group at most ``split_at`` rows.
    """
    held, passed = [np.zeros(0, np.int64)] * 3, None

    def solve(mask, bits, fp):
        values = fp.view(np.uint64)
        order = np.lexsort((_gray_rank(values), bits, mask))
        mask, bits, values = mask[order], bits[order], values[order]
        new = np.r_[True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])]
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        several = np.repeat(size > 1, size)
        values, groups = values[several], np.cumsum(new)[several]
        if len(values):
            label = link_groups(values, groups, max_bits, chunk)
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield _rows(LINK, values[linked].view(np.int64), values[label[linked]].view(np.int64))

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if passed is not None:
            rest = (new[0] != passed[0]) | (new[1] != passed[1])
            new = [x[rest] for x in new]
        if not len(new[0]):
            continue
        mask, bits, fp = (np.concatenate([x, y]) for x, y in zip(held, new))
        last = (mask == mask[-1]) & (bits == bits[-1])
        done = np.flatnonzero(~last)
        held = [mask, bits, fp]
        if len(done) >= min(chunk, 1 << 18):
            yield from solve(mask[done], bits[done], fp[done])
            held = [x[last] for x in held]
        if split_at is not None and last.sum() > split_at:
            passed = (mask[-1], bits[-1])
            yield _rows(DEAL_AGAIN, [passed[0]], [passed[1]])
            held = [x[(held[0] != passed[0]) | (held[1] != passed[1])] for x in held]
    if len(held[0]):
        yield from solve(*held)


def _search(dealt: DataFrame, params: SimHashParams, split_at: int | None) -> DataFrame:
    max_bits, chunk = params.max_bits, params.leaf_pairs
    return dealt.repartition("mask", "bits").sortWithinPartitions("mask", "bits").mapInArrow(
        lambda it: _links_of_task(it, max_bits, chunk, split_at), LINK_SCHEMA)


def links(fps: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints, column ``fp``; all links are within ``max_bits``."""
    if params.blocks <= params.max_bits:
        raise ValueError("blocks must exceed max_bits")
    found = written(_search(_deal(fps, params), params, params.split_at), "simhash-links")
    out = found.where(F.col("kind") == LINK).select("a", "b")
    again = found.where(F.col("kind") == DEAL_AGAIN).select(F.col("a").alias("mask"), F.col("b").alias("bits"))
    for r in again.select("mask").distinct().collect():  # at most one row for each choice of blocks
        group = fps.select("fp", F.lit(r["mask"]).alias("mask"), F.col("fp").bitwiseAND(F.lit(r["mask"])).alias("bits")) \
            .join(again, ["mask", "bits"], "left_semi")
        # the group's own bits agree, so a finer choice of blocks among the others loses no link
        out = out.unionByName(_search(_deal(group, params, r["mask"] % (1 << 64)), params, None).select("a", "b"))
    return out.distinct()


# ---------------------------------------------------------------------------
# components of the links
# ---------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes of one component share a root.

    Each round hooks every node to the neighbour of the smallest hash and
    contracts the edges; hooking uses an aggregate, so a node with very many
    neighbours costs one row per task. Rounds grow with the logarithm of the
    longest component.
    """
    edges = written(edges, "cc-edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("node"))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("near")) \
            .select(F.col("a").alias("node"), F.least("near", rank("a"))["node"].alias("up"))
        hook = written(hook, "cc-hooks")
        edges = written(
            edges.join(hook.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
            .join(hook.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
            .where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        if roots is None:
            roots = hook.select("node", F.col("up").alias("root"))
        else:
            roots = written(roots.join(hook.select(F.col("node").alias("root"), "up"), "root", "left")
                            .select("node", F.coalesce("up", "root").alias("root")), "cc-roots")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    params: SimHashParams = SimHashParams()) -> DataFrame:
    """Each row's fingerprint and component.

    Returns ``doc_id``, ``text_hash``, ``fingerprint`` (16 hex digits),
    ``component_id`` (smallest doc_id of the component; null if all are null)
    and ``representative`` (true for the row, and for its repeats, that stands
    for the component: smallest doc_id, nulls last, then smallest text hash). A
    null or blank text has fingerprint zero and is linked like any other.
    Repeated rows are returned as often as they occur.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rows = written(fingerprints(narrow, "text", params), "simhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    fps = written(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-fps")
    roots = components(links(fps.select("fp"), params))
    linked = roots.join(fps, roots["node"] == fps["fp"]).select("node", "root", "first")
    best = linked.groupBy("root").agg(F.min("first").alias("best"))
    of_fp = written(fps.join(roots.join(best, "root").select(F.col("node").alias("fp"), "best"), "fp", "left")
                    .select("fp", F.coalesce("best", "first").alias("best")), "simhash-components")
    return rows.join(of_fp, "fp").select(
        "doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"),
        (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_hash") == F.col("text_hash"))).alias("representative"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                params: SimHashParams = SimHashParams()) -> DataFrame:
    """The rows of ``docs`` that represent their component, one of each, with all columns."""
    keep = near_duplicates(docs, doc_id, text, params).where("representative") \
        .select(F.col("doc_id").alias("_keep_id"), F.col("text_hash").alias("_keep_hash")).distinct()
    keep = written(keep, "simhash-keep")
    marked = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"))
    kept = marked.join(keep, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_hash") == F.col("_keep_hash")), "left_semi")
    return kept.dropDuplicates(["_id", "_hash"]).select("_doc.*")
