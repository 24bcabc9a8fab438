"""Source divergence, importance resampling and substring dedup: brute force and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookout.llm import divergence, importance, substrings
from lookout.llm.queries import QUERIES
from tests.conftest import SF_SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = ("the river runs past the old mill and every evening the miller closes its heavy gate before he walks home through fields of "
         "barley where larks rise and a small dog waits beside the stone wall for his master to come back with bread and news")
DOCS = "doc_id long, text string, lang string, source string, rid long, spans string, rank string, size string, bucket string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", "y", "z", "b") for i, t, lang, s in rows], DOCS)


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"{w}{i % 7}" for i in range(900) for w in PROSE.split())
    return [(1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, None, None), (3, None, "en", "a"), (None, None, None, None),
            (None, PROSE, "en", "b"), (None, PROSE + " tail", "en", "b"), (4, "", "fr", "b"), (5, " \t\n", "fr", "b"), (6, long, "en", "c"),
            (7, "123 456 !!", None, "c"), (8, "été \U0001f600 naïve ÉTÉ x\x00y   \u0085", "fr", ""),
            (9, "start " + PROSE + "\n" + PROSE.replace("mill", "Mill"), "en", "c"), (9, "other " + PROSE, "en", "c"), (10, "a b " * 40, "", "")]


# -- source divergence ----------------------------------------------------------
def brute_audit(rows):
    docs = [((lang or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, lang, s in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        df[lang].update(set(words))
        count[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = [w for w, n in df[lang].items() if n >= 3]
        v = len(kept)
        total = {s: sum(count[lang, s][w] for w in kept) for s in sources}
        p = {s: {w: 1 + 10 ** 9 * (count[lang, s][w] + 1) // (total[s] + v) for w in kept} for s in sources}
        q = {w: 1 + 10 ** 9 * (sum(count[lang, s][w] for s in sources) + 1) // (sum(total.values()) + v) for w in kept}
        for s in sources:
            pairs = [(-sum((p[s][w] - p[r][w]) ** 2 // p[r][w] for w in kept), r.encode(), r) for r in sources if r != s]
            terms = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            out |= {(lang, s, part, item, -value, i + 1) for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200]))
                    for i, (value, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("params", [divergence.DivergenceParams(), divergence.DivergenceParams(shard_bytes=300, small_slice=3, block_terms=5, tile=2)])
def test_audit_equals_brute_force(spark, params):
    rows = odd_rows() + [(20 + i, f"word{chr(97 + i % 3)} und verylongwordwithaprefix{chr(97 + i % 2)} {PROSE}", "en", f"s{i % 5}") for i in range(12)]
    rows += [(50, "", "xx", "only"), (51, None, "xx", "two")]
    got = {tuple(r) for r in divergence.audit(_docs(spark, rows).repartition(3), params=params)
           .select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == brute_audit(rows)
    assert divergence.audit(_docs(spark, []), params=params).count() == 0


def test_runs_are_sorted_words():
    words = [b"abcdefgh", b"abcdefghi", b"abcdefgh", b"zz", b"a", b"abcdefghijklmnopqr", b"\xc3\xa9", b"abcdefghijklmnopqs", b"zz"]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    for small in (1, 4, 100):
        starts, ends = divergence.token_pointers(raw, np.array([0, len(raw)]))
        order, new = divergence.sorted_runs(raw, starts, ends, small)
        assert [words[i] for i in order] == sorted(words)
        assert [words[i] for i in order[new]] == sorted(set(words))
        assert all(a < b for a, b, n in zip(order, order[1:], new[1:]) if not n)


def test_share_is_exact_beyond_products_of_64_bits():
    for count, total in ((10 ** 14, 7 * 10 ** 15 + 1), (0, 3), (5, 6), (10 ** 12 + 7, 10 ** 12 + 9)):
        assert divergence.share(count, total) == 1 + 10 ** 9 * (count + 1) // total
        assert int(divergence.share(np.array([count]), np.array([total]))[0]) == 1 + 10 ** 9 * (count + 1) // total


# -- importance resampling ------------------------------------------------------
def brute_resample(rows, target, min_words=20, percent=25):
    def feats(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, feats(text)[1]))
    for text in target:
        t.update(map(bucket, feats(text)[1]))
    cs, ct = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (cs + 10000) / ((s[b] + 1) * (ct + 10000)))) for b in range(10000)}
    out = []
    for i, text in rows:
        words, fs = feats(text)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words])
    may = sorted((-r[3], r[0] is None, r[0] or 0, k) for k, r in enumerate(out) if r[4])
    rank = {k: n + 1 for n, (*_, k) in enumerate(may[:percent * len(may) // 100])}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(out)]


def _order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_draw_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    target = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op12_importance_resampling"](spark, SF_SMALL).collect()]
    assert _order(got) == _order(brute_resample([tuple(r) for r in docs], target))


def test_draw_of_odd_rows(spark):
    rows = [(i, t) for i, t, _, _ in odd_rows()] * 3
    docs = _docs(spark, odd_rows() * 3).repartition(4)
    bench = spark.createDataFrame([(PROSE,), (None,), ("",)], "text string")
    params = importance.ImportanceParams(batch_bytes=200)
    got = [tuple(r) for r in importance.resample(docs, bench, params=params).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert _order(got) == _order(brute_resample(rows, [PROSE, None, ""]))
    assert importance.resample(_docs(spark, []), bench).count() == 0
    assert importance.resample(docs, bench.limit(0)).count() == len(rows)


def test_runs_longer_than_two_words(spark):
    texts = [b"", b"Ab cd ef gh", b"x", b"cd ef"]
    n, bucket, doc = importance.features(texts, importance.ImportanceParams(max_run=3))
    want = [("ab", 1), ("cd", 1), ("ef", 1), ("gh", 1), ("x", 2), ("cd", 3), ("ef", 3), ("ab cd", 1), ("cd ef", 1), ("ef gh", 1),
            ("cd ef", 3), ("ab cd ef", 1), ("cd ef gh", 1)]
    assert n.tolist() == [0, 4, 1, 2]
    assert list(zip(bucket.tolist(), doc.tolist())) == [(zlib.crc32(w.encode()) % 10000, d) for w, d in want]


# -- substring dedup ------------------------------------------------------------
def brute_substrings(rows, window=20):
    """Rows of one id and text are one document; null ids last, then the smaller digest."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    docs = sorted({(i is None, i or 0, hashlib.md5(t.encode()).digest(), t) for i, t in rows if t is not None})
    seen, kept = set(), {}
    for doc in docs:
        words = split(doc[-1])
        stays = [True] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            if key in seen:
                stays[k:k + window] = [False] * window
            seen.add(key)
        kept[doc[0], doc[1], doc[-1]] = [w for w, s in zip(words, stays) if s]
    out = []
    for i, t in rows:
        left = [] if t is None else kept[i is None, i or 0, t]
        out.append((i, len(split(t)), len(split(t)) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


def _substrings(docs, **params):
    out = substrings.deduplicate(docs, params=substrings.SubstringParams(**params))
    return [tuple(r) for r in out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()]


def test_passages_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op13_substring_dedup"](spark, SF_SMALL).collect()]
    want = brute_substrings(docs)
    assert _order(got) == _order(want) and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("params", [{}, {"batch_bytes": 500, "owner_block": 7, "shard_windows": 20, "shard_texts": 2}, {"window": 5, "anchor": 5}])
def test_passages_of_odd_rows(spark, params):
    words = PROSE.split()
    rows = odd_rows() + [(100 + i, " ".join([f"own{i}"] + words[i:i + 24] + [f"end{i}"] * 3 + words[:21 - i % 3]), "en", "a") for i in range(15)]
    rows += [(200, "same word " * 60, "en", "a"), (201, "word same " * 40, "en", "a"), (202, " ".join(words[:20]), "en", "a"),
             (203, " ".join(words[:19]), "en", "a"), (203, " ".join(words[:19]), "en", "a")]
    got = _substrings(_docs(spark, rows).repartition(5), **params)
    assert _order(got) == _order(brute_substrings([(i, t) for i, t, _, _ in rows], params.get("window", 20)))
    short = substrings.deduplicate(_docs(spark, rows), params=substrings.SubstringParams(**params), digest=True)
    assert _order([tuple(r) for r in short.collect()]) == _order(got)
    assert _substrings(_docs(spark, []), **params) == []


def test_passages_outgrow_one_automaton(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_WORDS", 30)
    automata = []
    monkeypatch.setattr(substrings, "_Automaton", lambda w, own=substrings._Automaton: automata.append(own(w)) or automata[-1])
    texts = [" ".join(f"w{k}_{i}" for i in range(30)) for k in range(4)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 5), pa.array([0] * 5), pa.array([1, 2, 3, 4, 9]),
                                        pa.array([[{"start": 0, "windows": 5}, {"start": 5, "windows": 6}]] * 4 + [None]), pa.array([*texts, " x ".join(texts)])],
                                       names=["shard", "part", "rid", "starts", "text"])
    rows = [r for b in substrings._occurrence_rows(iter([batch]), 20) for r in zip(*[c.to_pylist() for c in b.columns])]
    assert len(automata) > 1 and sorted(rows) == [(9, 31 * k, 31 * k + 30) for k in range(4)]


def test_pair_sums_hold_no_object_for_each_entry():
    import tracemalloc

    import pyarrow as pa
    from lookout.llm.divergence import _pair_sums, share

    names, v = [f"s{i}" for i in range(6)], 30_000
    counts = np.random.default_rng(3).integers(0, 50, (v, 6))
    offsets = np.arange(0, 6 * v + 1, 6)
    entries = pa.StructArray.from_arrays([pa.array(names * v), pa.array(counts.reshape(-1))], names=["source", "n"])
    terms = pa.table({"by": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)})
    groups = [{"source": s, "total": int(t)} for s, t in zip(names, counts.sum(0))]
    header = pa.table({"lang": ["x"], "v": [v], "own": [groups], "ref": [groups[:2]]})
    tracemalloc.start()
    got = {(r["source"], r["item"]): r["value"] for r in _pair_sums(terms, header).to_pylist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    p = share(counts.astype(np.int64), counts.sum(0)[None, :] + v)
    assert got == {(names[a], names[b]): int(((p[:, a] - p[:, b]) ** 2 // p[:, b]).sum()) for a in range(6) for b in range(2) if a != b}
    assert peak < 30 << 20  # 180,000 entries as objects take over 60 MB
