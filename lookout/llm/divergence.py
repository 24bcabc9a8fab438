"""Source divergence audit by sorting token-start pointers.

Each task joins the texts of an Arrow batch into one byte buffer, keeps one
pointer for each word start and sorts the pointers by multikey quicksort, eight
bytes of the word at a time. Equal runs of the sorted pointers are the words of
that shard: a run yields the word's occurrences and its documents by source.
Spark adds the runs of all shards up, keeps a language's words of enough
documents, and compares the word shares of its sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.llm.common import written

RUN_DDL = "lang string, source string, term string, n long, docs long"
PAIR_DDL = "lang string, source string, item string, value long"
SCALE = 1_000_000_000


@dataclass(frozen=True)
class DivergenceParams:
    min_docs: int = 3               # documents of a language that hold a kept term
    top_terms: int = 200            # ranks of a group's terms (the report's length)
    shard_bytes: int = 8 << 20      # text sorted at once; a longer text is a shard of its own
    small_slice: int = 4096         # pointers below which a slice is sorted whole
    block_terms: int = 1 << 14      # kept terms of one task of the pair sums
    tile: int = 512                 # sources by sources of one task of the pair sums


# ---------------------------------------------------------------------------
# pointers of one shard
# ---------------------------------------------------------------------------
def lower_ascii(buffer: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((buffer >= 65) & (buffer <= 90), buffer + np.uint8(32), buffer)


def token_pointers(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the letter runs of each text; ``offsets`` bound the texts in the buffer.

    Every byte of a character beyond ASCII counts as a letter, so runs are the
    matches of the term pattern. No run passes the end of a text.
    """
    letter = np.zeros(len(buffer) + 1, bool)
    letter[:-1] = (buffer >= 0x80) | ((buffer >= 97) & (buffer <= 122))
    edge = np.zeros(len(buffer) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], letter[:-1]])
    starts = np.flatnonzero(letter & (~before | edge))
    ends = np.flatnonzero(before & (~letter | edge))
    return starts, ends


def _keys(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each word from ``depth`` on as one number that orders as the bytes do; zero past its end.

    ``padded`` is the buffer and eight bytes more.
    """
    at = np.minimum(starts + depth, len(padded) - 8)
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[at]).view(">u8")[:, 0].astype(np.uint64)
    past = np.clip(8 - (ends - starts - depth), 0, 8).astype(np.uint64) * np.uint64(8)
    return np.where(past < 64, key >> np.minimum(past, np.uint64(63)) << np.minimum(past, np.uint64(63)), np.uint64(0))


def _goes_on(key: np.ndarray) -> np.ndarray:
    """Whether a word may go on after the eight bytes: its last byte there is not the zero past its end."""
    return (key & np.uint64(0xFF)) != 0


def _sort_small(padded, starts, ends, own, depth, key) -> tuple[np.ndarray, np.ndarray]:
    """A slice's pointers in order and a flag at each first of an equal run: digit by digit for all unfinished runs at once."""
    order = np.argsort(key, kind="stable")
    own, key = own[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    while True:
        run = np.cumsum(new)
        left = np.flatnonzero(_goes_on(key) & (np.bincount(run)[run] > 1))
        if not len(left):
            return own, new
        depth += 8
        digit = _keys(padded, starts[own[left]], ends[own[left]], depth)
        order = np.lexsort((digit, run[left]))
        own[left], digit = own[left][order], digit[order]
        key[:] = 0
        key[left] = digit
        # the runs in ``left`` are whole, so neighbours of one run are neighbours here
        new[left[1:]] |= (run[left[1:]] == run[left[:-1]]) & (digit[1:] != digit[:-1])


def sorted_runs(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray]:
    """The pointers in the words' byte order, and a flag at the first pointer of each distinct word.

    Multikey quicksort with eight bytes a digit: a slice is cut in three by its
    pivot's digit; the equal part goes on with the next digit, or is a finished
    run if its words end here. Slices up to ``small`` are sorted whole. Equal
    words keep the pointers' order.
    """
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    order, flags = [np.zeros(0, starts.dtype)], [np.zeros(0, bool)]
    todo = [(np.arange(len(starts), dtype=starts.dtype), 0, None)] if len(starts) else []
    while todo:
        own, depth, key = todo.pop()
        if depth < 0:
            order.append(own)
            flags.append(np.arange(len(own)) == 0)
            continue
        if key is None:
            key = _keys(padded, starts[own], ends[own], depth)
        if len(own) <= small:
            own, new = _sort_small(padded, starts, ends, own, depth, key)
            order.append(own)
            flags.append(new)
            continue
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        less, same = key < pivot, key == pivot
        more = ~(less | same)
        if more.any():
            todo.append((own[more], depth, key[more]))
        todo.append((own[same], depth + 8 if _goes_on(pivot) else -1, None))
        if less.any():
            todo.append((own[less], depth, key[less]))
    return np.concatenate(order), np.concatenate(flags)


def _shard_rows(texts: pa.Array, langs: list[str], sources: list[str], params: DivergenceParams) -> pa.RecordBatch | None:
    """One row for each (language, source, term) of a shard: occurrences and documents."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    buffer = lower_ascii(raw)
    starts, ends = token_pointers(buffer, offsets)
    if not len(starts):
        return None
    if len(buffer) < 1 << 30:  # half the memory; only a single text is longer
        starts, ends = starts.astype(np.int32), ends.astype(np.int32)
    names: dict = {}
    group_of = np.array([names.setdefault(k, len(names)) for k in zip(langs, sources)], np.int32)
    doc = (np.searchsorted(offsets, starts, side="right") - 1).astype(starts.dtype)
    # pointers of a group side by side: the sort keeps their order within each run
    place = np.argsort(group_of[doc], kind="stable")
    starts, ends, doc = starts[place], ends[place], doc[place]
    del place
    pointer, new_run = sorted_runs(buffer, starts, ends, params.small_slice)
    doc = doc[pointer]
    group = group_of[doc]
    new_group = new_run | np.concatenate([[True], group[1:] != group[:-1]])
    new_doc = new_group | np.concatenate([[True], doc[1:] != doc[:-1]])
    first = np.flatnonzero(new_group)
    head = pointer[new_run]
    data = buffer.tobytes()
    terms = [data[s:e].decode("utf-8") for s, e in zip(starts[head].tolist(), ends[head].tolist())]
    keys, of = list(names), group[first].tolist()
    run = (np.cumsum(new_run) - 1)[first].tolist()
    return pa.RecordBatch.from_arrays(
        [pa.array([keys[g][0] for g in of], pa.string()), pa.array([keys[g][1] for g in of], pa.string()),
         pa.array([terms[r] for r in run], pa.string()), pa.array(np.diff(np.append(first, len(doc))), pa.int64()),
         pa.array(np.add.reduceat(new_doc.astype(np.int64), first), pa.int64())],
        names=["lang", "source", "term", "n", "docs"])


def _run_rows(batches: Iterator[pa.RecordBatch], params: DivergenceParams) -> Iterator[pa.RecordBatch]:
    """Runs of every shard of a task; columns text, lang, source without nulls."""
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        got = _shard_rows(table.column(0).chunk(0), table.column(1).to_pylist(), table.column(2).to_pylist(), params)
        held.clear()
        return got

    for batch in batches:
        sizes = np.cumsum(batch.column(3).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(sizes):
            room = params.shard_bytes - size + (sizes[at - 1] if at else 0)
            till = max(int(np.searchsorted(sizes, room, side="right")), at if held else at + 1)
            if till > at:
                held.append(batch.slice(at, till - at))
                size += int(sizes[till - 1] - (sizes[at - 1] if at else 0))
            at = till
            if at < len(sizes):
                if (rows := flush()) is not None:
                    yield rows
                size = 0
    if held and (rows := flush()) is not None:
        yield rows


# ---------------------------------------------------------------------------
# exact shares
# ---------------------------------------------------------------------------
def share(count, total):
    """1 + floor(10^9 * (count + 1) / total) by long division in three digits of a thousand; exact while total < 9 * 10^15."""
    rest, out = count + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _share_sql(count: str, total: str) -> Column:
    """``share`` as an expression."""
    start = f"named_struct('out', CAST(0 AS BIGINT), 'rest', CAST({count} + 1 AS BIGINT))"
    step = f"named_struct('out', acc.out * 1000 + (acc.rest * 1000) div ({total}), 'rest', (acc.rest * 1000) % ({total}))"
    return F.expr(f"aggregate(array(1, 2, 3), {start}, (acc, i) -> {step}, acc -> acc.out + 1)")


# ---------------------------------------------------------------------------
# tables
# ---------------------------------------------------------------------------
def term_counts(docs: DataFrame, text: str, lang: str, source: str, params: DivergenceParams) -> DataFrame:
    """``lang``, ``term``, ``n`` (in the language) and ``by`` (source and count) of every kept term."""
    own = docs.select(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(lang, F.lit("")).alias("lang"),
                      F.coalesce(source, F.lit("")).alias("source"))
    runs = own.withColumn("size", F.octet_length("text").cast("bigint")).mapInArrow(lambda it: _run_rows(it, params), RUN_DDL)
    by_source = runs.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by")) \
        .where(F.col("docs") >= params.min_docs).drop("docs")


def _pair_sums(terms: pa.Table, header: pa.Table) -> pa.Table:
    """Sums of f over one block of a language's terms, for the sources of one tile by the references of another."""
    empty = {"lang": [], "source": [], "item": [], "value": []}
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not header.num_rows:
        return pa.table(empty, schema)
    head = header.to_pylist()[0]
    own, ref = head["own"], head["ref"]
    names = sorted({s["source"] for s in own} | {s["source"] for s in ref})
    place = {s: i for i, s in enumerate(names)}
    known = {s["source"]: s["total"] for s in own + ref}
    total = np.array([known[s] for s in names], np.int64) + head["v"]
    sums = np.zeros((len(own), len(ref)), np.int64)
    mine, theirs = [place[s["source"]] for s in own], [place[s["source"]] for s in ref]
    step = max(1, (1 << 18) // max(len(names), 1))
    for at in range(0, terms.num_rows, step):
        part = terms.column("by").slice(at, step).combine_chunks()
        source, n = part.flatten().flatten()
        # a term's entries are read as columns: one object for each would take many times their size
        row = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False))
        j = pc.fill_null(pc.index_in(source, value_set=pa.array(names, source.type)), -1).to_numpy(zero_copy_only=False)
        known_source = j >= 0
        count = np.zeros((len(part), len(names)), np.int64)
        count[row[known_source], j[known_source]] = n.to_numpy(zero_copy_only=False)[known_source]
        p = share(count, total[None, :])
        for k, r in enumerate(theirs):
            q = p[:, r:r + 1]
            sums[:, k] += ((p[:, mine] - q) ** 2 // q).sum(0)
    pairs = [(a, b) for a in range(len(own)) for b in range(len(ref)) if own[a]["source"] != ref[b]["source"]]
    return pa.table({"lang": [head["lang"]] * len(pairs), "source": [own[a]["source"] for a, _ in pairs],
                     "item": [ref[b]["source"] for _, b in pairs], "value": [int(sums[a, b]) for a, b in pairs]}, schema)


def pair_values(kept: DataFrame, groups: DataFrame, langs: DataFrame, params: DivergenceParams) -> DataFrame:
    """Every ordered pair of sources of a language, f summed over the kept terms.

    Terms are dealt to blocks and sources to tiles, so that a task holds at most
    about ``block_terms`` terms and ``tile`` by ``tile`` sums; the tasks add
    their terms up, and no pair is made for a single term.
    """
    place = Window.partitionBy("lang").orderBy("source")
    tiled = groups.withColumn("tile", F.floor((F.row_number().over(place) - 1) / params.tile))
    tiles = tiled.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("s"))
    both = tiles.select("lang", F.col("tile").alias("a"), F.col("s").alias("own")) \
        .join(tiles.select("lang", F.col("tile").alias("b"), F.col("s").alias("ref")), "lang")
    shape = tiles.groupBy("lang").agg(F.count(F.lit(1)).alias("tiles")).join(langs, "lang") \
        .select("lang", "v", "tiles", F.greatest(F.ceil(F.col("v") / params.block_terms), F.lit(1)).alias("blocks"))
    headers = both.join(shape, "lang").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))) \
        .select("lang", "a", "b", "block", "v", "own", "ref")
    spread = F.expr("sequence(0L, tiles - 1)")
    dealt = kept.select("lang", "term", "by").join(shape, "lang") \
        .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))) \
        .withColumn("a", F.explode(spread)).withColumn("b", F.explode(spread)).select("lang", "a", "b", "block", "by")
    sums = dealt.groupBy("lang", "a", "b", "block").cogroup(headers.groupBy("lang", "a", "b", "block")).applyInArrow(_pair_sums, PAIR_DDL)
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """Each group's terms whose share is above that of the language."""
    flat = kept.select("lang", "term", F.col("n").alias("in_lang"), F.explode("by").alias("e")) \
        .select("lang", "term", "in_lang", "e.source", "e.n")
    rated = flat.join(groups, ["lang", "source"]).join(langs, "lang") \
        .withColumn("p", _share_sql("n", "total + v")).withColumn("q", _share_sql("in_lang", "lang_total + v"))
    return rated.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """How the word shares of a language's sources differ.

    Returns ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``:
    part ``pair`` has each other source of the language, part ``term`` the terms
    a source holds more of than its language, the first ``top_terms`` of them.
    Null texts, languages and sources count as empty strings, which are a
    language and a source like any other; equal rows are documents of their own;
    ties go by the item's bytes. A source without terms has its pairs too. An
    empty table gives an empty result. Exact while a source has fewer than
    9 * 10^15 words.
    """
    groups = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    kept = written(term_counts(docs, text, lang, source, params), "divergence-terms")
    totals = kept.select("lang", F.explode("by").alias("e")).groupBy("lang", F.col("e.source").alias("source")) \
        .agg(F.sum("e.n").alias("total"))
    groups = written(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")),
                     "divergence-groups")
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    langs = written(groups.select("lang").distinct().join(per_lang, "lang", "left").select(
        "lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")), "divergence-langs")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_values(kept, groups, langs, params).select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                                                           F.row_number().over(ranked).alias("rank"))
    terms = term_values(kept, groups, langs).select("lang", "source", F.lit("term").alias("part"), "item", "value",
                                                    F.row_number().over(ranked).alias("rank")).where(F.col("rank") <= params.top_terms)
    return pairs.unionByName(terms)
