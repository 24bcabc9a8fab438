"""Removal of repeated passages by sharded phrase automata.

1. Anchors: each window of words is stood for by its least 8-word hash, so equal
   windows have the same anchor; anchors are counted over all texts.
2. Confirmation: a text with anchors found twice is cut into segments, the runs of
   windows of one anchor. Equal segments are counted by digest; where an anchor
   has several segments, their windows are counted one by one. What is found
   twice is a recurring passage, owned by the place where it stands first.
3. Automata: the passages of each shard of owners are compiled into one
   Aho-Corasick automaton over word numbers. Every text that holds a passage of
   the shard is streamed through it, which finds each occurrence by its words.
   Texts without a recurring anchor hold no passage, and meet no automaton.
4. Words under an occurrence other than the owner's go.

Exact copies of a text are settled by its digest, and no copy but the first
takes part in 2 and 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import written

FIXED = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
OTHER_WORD = "\x01"  # a word of no passage
FIRST_WORD = 0x20
SURROGATES = range(0xD800, 0xE000)
MOST_WORDS = 1_000_000  # distinct words that one automaton has characters for; further passages of a shard go to a second one


@dataclass(frozen=True)
class SubstringParams:
    window: int = 20                # words of a passage
    anchor: int = 8                 # words of an anchor: fewer anchors than of ten words, and hardly more chance meetings
    batch_bytes: int = 4 << 20      # text hashed at once; a longer text is a batch of its own
    owner_block: int = 1 << 14      # first places of one text that share a shard
    shard_windows: int = 1 << 16    # passages of one automaton, about
    shard_texts: int = 1 << 12      # texts streamed through one copy of an automaton, about


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of sums of products."""
    x = (x ^ (x >> np.uint64(32))) * FIXED[2]
    return x ^ (x >> np.uint64(29))


def _runs(words: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """A hash of every run of ``n`` words."""
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for i in range(n):
        out = out * factor + words[i:i + len(out)]
    return _mix(out)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and its text. bytes.split() parts at U+0020 and U+0009 to U+000D only."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    one = xxhash.xxh3_64_intdigest
    flat = np.fromiter((one(w) for ws in words for w in ws), np.uint64, int(sizes.sum()))
    return flat, np.repeat(np.arange(len(texts)), sizes)


def _anchors(words: np.ndarray, doc: np.ndarray, params: SubstringParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one text, each one's anchor hash and the anchor's place."""
    n = len(words) - params.window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    starts = np.flatnonzero(doc[:n] == doc[params.window - 1:])
    grams = _runs(words, params.anchor, FIXED[0])
    views = np.lib.stride_tricks.sliding_window_view(grams, params.window - params.anchor + 1)
    at = starts + views[starts].argmin(1)
    return starts, grams[at], at


def _text_batches(batch: pa.RecordBatch, at: int, size: int) -> Iterator[tuple[int, list[bytes]]]:
    texts, held, first = [], 0, 0
    for i, text in enumerate(batch.column(at)):
        raw = (text.as_py() or "").encode("utf-8")
        if texts and held + len(raw) > size:
            yield first, texts
            texts, held, first = [], 0, i
        texts.append(raw)
        held += len(raw)
    if texts:
        yield first, texts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _anchor_rows(batches: Iterator[pa.RecordBatch], params: SubstringParams) -> Iterator[pa.RecordBatch]:
    """(anchor, the text's short digest, its places in the text) for the distinct anchors of each text."""
    for batch in batches:
        for first, texts in _text_batches(batch, 0, params.batch_bytes):
            words, doc = _word_hashes(texts)
            t0 = batch.column(1).slice(first, len(texts)).to_numpy(zero_copy_only=False)
            _, anchor, at = _anchors(words, doc, params)
            if not len(at):
                continue
            at, keep = np.unique(at, return_index=True)
            anchor, of = anchor[keep], doc[at]
            order = np.lexsort((anchor, of))
            anchor, of = anchor[order], of[order]
            begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]))
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor[begin]), pa.array(t0[of[begin]]), pa.array(np.diff(np.append(begin, len(of))), pa.int64())],
                names=["anchor", "t0", "n"])


def _segment_rows(batches: Iterator[pa.RecordBatch], params: SubstringParams) -> Iterator[pa.RecordBatch]:
    """Segments of recurring anchors: anchor, digest, text number, first window's start, windows; columns rid, text, anchors."""
    for batch in batches:
        for first, texts in _text_batches(batch, 1, params.batch_bytes):
            words, doc = _word_hashes(texts)
            starts, anchor, at = _anchors(words, doc, params)
            known = np.unique(batch.column(2).slice(first, len(texts)).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            own = np.isin(anchor, known)
            starts, anchor, at = starts[own], anchor[own], at[own]
            if not len(starts):
                continue
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            a, b = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
            # its first and its last window overlap, so both and their distance tell the segment's words
            d0, d1 = (_mix(w[a] * f + w[b] * FIXED[2] + (b - a).astype(np.uint64)) for f in FIXED[:2] for w in [_runs(words, params.window, f)])
            text_begin = np.searchsorted(doc, np.arange(len(texts)))
            rid = batch.column(0).slice(first, len(texts)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor[begin]), _signed(d0), _signed(d1), pa.array(rid[doc[a]]), pa.array(a - text_begin[doc[a]], pa.int32()),
                 pa.array(b - a + 1, pa.int32())], names=["anchor", "d0", "d1", "rid", "start", "windows"])


def _window_rows(batches: Iterator[pa.RecordBatch], params: SubstringParams) -> Iterator[pa.RecordBatch]:
    """Each window of the listed segments: digest, text number, start, its segment's start and count; columns rid, text, segments."""
    for batch in batches:
        for first, texts in _text_batches(batch, 1, params.batch_bytes):
            words, doc = _word_hashes(texts)
            begin = np.searchsorted(doc, np.arange(len(texts)))
            rows = [(i, s["start"] + k, s["start"], s["n"]) for i, segments in enumerate(batch.column(2).slice(first, len(texts)).to_pylist())
                    for s in segments for k in range(s["windows"])]
            i, start, segment, n = np.array(rows, np.int64).T
            at = begin[i] + start
            rid = batch.column(0).slice(first, len(texts)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*[_signed(_runs(words, params.window, f)[at]) for f in FIXED[:2]], pa.array(rid[i]), pa.array(start, pa.int32()),
                 pa.array(segment, pa.int32()), pa.array(n)], names=["w0", "w1", "rid", "start", "segment", "n"])


# ---------------------------------------------------------------------------
# automata
# ---------------------------------------------------------------------------
class _Automaton:
    """The passages of a shard; words are numbered and written as one character each.

    A passage's windows all hold one of its phrases: runs of ``piece`` words that
    begin each ``window - piece + 1`` words. The automaton finds the phrases in a
    text, and the windows around each are compared with the shard's windows.
    """

    def __init__(self, window: int):
        self.window, self.piece = window, (window + 1) // 2
        self.numbers: dict[bytes, str] = {}
        self.windows: dict[str, tuple[int, int]] = {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)

    def _number(self, word: bytes) -> str:
        got = self.numbers.get(word)
        if got is None:
            code = FIRST_WORD + len(self.numbers)
            got = self.numbers[word] = chr(code if code < SURROGATES.start else code + len(SURROGATES))
        return got

    def add(self, rid: int, first: int, words: list[bytes]) -> None:
        """The windows of a run of words that stands at ``first`` in the text ``rid``."""
        line = "".join([self._number(w) for w in words])
        for i in range(len(words) - self.window + 1):
            self.windows[line[i:i + self.window]] = (rid, first + i)
        for i in range(0, len(words) - self.piece + 1, self.window - self.piece + 1):
            self.trie.add_word(line[i:i + self.piece])

    @property
    def full(self) -> bool:
        return len(self.numbers) >= MOST_WORDS

    def compile(self) -> None:
        self.trie.make_automaton()

    def occurrences(self, rid: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Merged (first word, past the last word) of all occurrences but the passages' own places."""
        if not self.windows:
            return []
        get, known, window = self.numbers.get, self.windows.get, self.window
        line = "".join([get(w, OTHER_WORD) for w in words])
        spans: list[tuple[int, int]] = []
        done = 0  # windows that start before it have been compared
        for end, _ in self.trie.iter(line):
            for start in range(max(done, end + 1 - window), min(end + 1 - self.piece, len(line) - window) + 1):
                owner = known(line[start:start + window])
                if owner is None or owner == (rid, start):
                    continue
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], start + window)
                else:
                    spans.append((start, start + window))
            done = max(done, end + 2 - self.piece)
        return spans


def _joined(runs: list[dict]) -> list[tuple[int, int]]:
    """(first start, past the last) of runs of windows, those that touch made one."""
    out: list[tuple[int, int]] = []
    for r in sorted(runs, key=lambda r: r["start"]):
        if out and r["start"] == out[-1][1]:
            out[-1] = (out[-1][0], r["start"] + r["windows"])
        else:
            out.append((r["start"], r["start"] + r["windows"]))
    return out


def _occurrence_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Spans by text; rows come sorted by shard and part, the passages of each before its texts."""
    at, automata, ready = None, [], False
    for batch in batches:
        found = []
        for shard, part, rid, starts, text in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if (shard, part) != at:
                at, automata, ready = (shard, part), [_Automaton(window)], False
            words = text.encode("utf-8").split()
            if starts is not None:
                for a, past in _joined(starts):
                    if automata[-1].full:
                        automata.append(_Automaton(window))
                    automata[-1].add(rid, a, words[a:past + window - 1])
                continue
            if not ready:
                for automaton in automata:
                    automaton.compile()
                ready = True
            found += [(rid, a, b) for automaton in automata for a, b in automaton.occurrences(rid, words)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["rid", "a", "b"])


# ---------------------------------------------------------------------------
# tables
# ---------------------------------------------------------------------------
KEY = ["none", "id", "t"]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``none``, ``id`` (0 for a null id), ``t`` (the text's digest), ``t0`` (a short one) and ``text`` of every row; the digests of a null text are null."""
    number = F.col(doc_id).cast("bigint")
    return docs.select(number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("id"), F.unhex(F.md5(F.col(text))).alias("t"),
                       F.when(F.col(text).isNotNull(), F.xxhash64(text)).alias("t0"), F.col(text).alias("text"))


def candidates(docs: DataFrame, params: SubstringParams) -> tuple[DataFrame, DataFrame]:
    """(texts with a recurring anchor: rid, key, text, anchors), (later exact copies: key), of ``keyed`` rows with a text.

    Numbers ``rid`` rise with the key: null ids last, then the id, then the digest.
    """
    rows = written(docs.select(*KEY, "t0").distinct(), "substring-ids")
    firsts = rows.groupBy("t").agg(F.min(F.struct("none", "id")).alias("first"), F.min("t0").alias("t0"), F.count(F.lit(1)).alias("n"))
    copies = rows.join(firsts.where("n > 1").select("t", "first"), "t").where("none <> first.none OR id <> first.id").select(*KEY)

    found = written(docs.select("text", "t0").mapInArrow(lambda it: _anchor_rows(it, params), "anchor long, t0 long, n long"), "substring-anchors")
    # copies of one text count here too: their first text is then looked at in vain, but the rows stay short
    recurring = found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    # texts that share a short digest share their anchors, of which each finds its own
    held = found.select("anchor", "t0").join(recurring, "anchor", "left_semi").groupBy("t0").agg(F.collect_set("anchor").alias("anchors"))
    wanted = held.join(firsts.select("first.*", "t", "t0"), "t0").select(*KEY, "anchors")
    # numbered before the texts come in, so that those are dealt once only
    wanted = written(wanted.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("rid", F.monotonically_increasing_id()), "substring-wanted")
    own = docs.select(*KEY, "text").join(wanted, KEY).dropDuplicates(KEY)
    return written(own.select("rid", *KEY, "text", "anchors"), "substring-texts"), copies


def passages(own: DataFrame, params: SubstringParams) -> tuple[DataFrame, DataFrame]:
    """(recurring passages: owner, start, windows), (texts that may hold one elsewhere: rid, owner, start)."""
    segments = written(own.select("rid", "text", "anchors").mapInArrow(
        lambda it: _segment_rows(it, params), "anchor long, d0 long, d1 long, rid long, start int, windows int"), "substring-segments")
    distinct = written(segments.groupBy("anchor", "d0", "d1", "windows").agg(
        F.min(F.struct("rid", "start")).alias("first"), F.count(F.lit(1)).alias("n")).select("anchor", "d0", "d1", "windows", "first.*", "n"),
        "substring-distinct")
    several = distinct.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("several"))
    marked = written(distinct.join(several, "anchor").where("several OR n > 1").drop("anchor"), "substring-marked")

    # an anchor's only segment recurs as a whole
    whole = marked.where("NOT several").select(F.col("rid").alias("owner"), "start", "windows")
    lists = marked.where("several").groupBy("rid").agg(F.collect_list(F.struct("start", "windows", "n")).alias("segments"))
    windows = written(own.select("rid", "text").join(lists, "rid").mapInArrow(
        lambda it: _window_rows(it, params), "w0 long, w1 long, rid long, start int, segment int, n long"), "substring-windows")
    firsts = written(windows.groupBy("w0", "w1").agg(F.min(F.struct("rid", "start")).alias("first"), F.sum("n").alias("n")).where("n > 1")
                     .select("w0", "w1", F.col("first.rid").alias("owner"), F.col("first.start").alias("at")), "substring-firsts")
    single = firsts.select("owner", F.col("at").alias("start"), F.lit(1).alias("windows"))

    block = lambda c: F.floor(F.col(c) / params.owner_block)
    held = segments.alias("s").join(marked.alias("m"), ["d0", "d1"]) \
        .select(F.col("s.rid").alias("rid"), F.col("s.start").alias("start"), F.col("m.rid").alias("first_rid"),
                F.col("m.start").alias("first_start"), "m.several")
    of_segment = windows.join(firsts, ["w0", "w1"]).select(F.col("rid").alias("first_rid"), F.col("segment").alias("first_start"),
                                                         "owner", block("at").alias("block")).distinct()
    routes = held.where("NOT several AND (rid <> first_rid OR start <> first_start)") \
        .select("rid", F.col("first_rid").alias("owner"), block("first_start").alias("block")) \
        .unionByName(held.where("several").join(of_segment, ["first_rid", "first_start"]).select("rid", "owner", "block"))
    return whole.unionByName(single).withColumn("block", block("start")), routes


def occurrences(own: DataFrame, params: SubstringParams) -> DataFrame:
    """(rid, spans) of the candidate texts: words under passages that stand earlier."""
    found, routes = passages(own, params)
    found = written(found.groupBy("owner", "block").agg(F.collect_list(F.struct("start", "windows")).alias("starts"),
                                                        F.sum("windows").alias("n")), "substring-passages")
    shards = F.greatest(F.ceil(found.agg(F.sum("n").alias("n")).scalar() / params.shard_windows), F.lit(1))
    shard = F.pmod(F.xxhash64("owner", "block"), shards).alias("shard")
    routes = written(routes.select("rid", shard).distinct(), "substring-routes")
    parts = written(routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / params.shard_texts).alias("parts")), "substring-parts")
    texts, none = own.select("rid", "text"), F.lit(None).cast("array<struct<start:int,windows:int>>")
    sides = found.select(F.col("owner").alias("rid"), "starts", shard).join(parts, "shard") \
        .withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).join(texts, "rid").select("shard", "part", "rid", "starts", "text") \
        .unionByName(routes.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("rid"), "parts")).join(texts, "rid")
                     .select("shard", "part", "rid", none.alias("starts"), "text"))
    dealt = sides.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("starts").isNull(), "rid")
    spans = dealt.mapInArrow(lambda it: _occurrence_rows(it, params.window), "rid long, a long, b long")
    return spans.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _kept_rows(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Words, removed words and what is kept of each text; columns of the key, text and perhaps spans."""
    for batch in batches:
        sizes, removed, kept = [], [], []
        at = len(KEY)
        cut = batch.column(at + 1).to_pylist() if batch.num_columns > at + 1 else [None] * batch.num_rows
        for text, spans in zip(batch.column(at).to_pylist(), cut):
            words = (text or "").encode("utf-8").split()
            left = words
            if spans:
                stays = np.ones(len(words), bool)
                for s in spans:
                    stays[s["a"]:s["b"]] = False
                left = [words[i] for i in np.flatnonzero(stays)]
            sizes.append(len(words))
            removed.append(len(words) - len(left))
            line = b" ".join(left)
            kept.append(hashlib.sha256(line).hexdigest() if digest else line.decode("utf-8"))
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                         names=[*KEY, "n_words", "n_removed", "kept"])


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: SubstringParams = SubstringParams(),
                digest: bool = False) -> DataFrame:
    """Every document without the words of passages that also stand earlier.

    Returns ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words that
    stay, joined by one blank) of every row; with ``digest`` the SHA-256 of that
    line stands for it, and the texts that stay whole need not be shuffled again.
    Earlier means a smaller id (null ids last; under equal ids the smaller text
    digest), or a place further up in the same text. Rows of equal id and text
    are one document and get equal results. A null text has no words; a text
    shorter than the window keeps all. An empty table gives an empty result.
    """
    if not 0 < params.anchor <= params.window:
        raise ValueError("anchor must not exceed window")
    own = keyed(docs, doc_id, text)
    texts, copies = candidates(own.where(F.col("text").isNotNull()), params)
    result = "none boolean, id long, t binary, n_words long, n_removed long, kept string"
    changed = texts.select("rid", *KEY, "text").join(occurrences(texts, params), "rid").drop("rid") \
        .mapInArrow(lambda it: _kept_rows(it, digest), result).drop("n_words").withColumn("copy", F.lit(False))
    gone = copies.select(*KEY, F.lit(0).cast("bigint").alias("n_removed"), F.lit(None).cast("string").alias("kept"), F.lit(True).alias("copy"))
    cut = written(changed.unionByName(gone), "substring-cuts")
    whole = own.select(*KEY, "text").mapInArrow(lambda it: _kept_rows(it, digest), result)
    rows = whole.withColumnsRenamed({"n_removed": "_none", "kept": "_line"}).join(cut, KEY, "left")
    copy = F.coalesce("copy", F.lit(False)) & (F.col("n_words") >= params.window)
    empty = F.lit(hashlib.sha256(b"").hexdigest() if digest else "")
    return rows.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_words",
                       F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                       F.when(copy, empty).otherwise(F.coalesce("kept", "_line")).alias("kept"))
