"""Training-data operators: DuckDB twins, brute force, round trips, held-out accuracy and odd rows."""

from __future__ import annotations

from collections import Counter, defaultdict
from types import SimpleNamespace

import pytest
import xxhash
import zlib
from pyspark.sql import functions as F

import corpus_pipeline
from lookout.llm import (conversations, decontaminate, langid, licenses, mixing, quality, secrets, sharding, simhash, warc)
from lookout.llm.common import word_count
from lookout.llm.license_texts import HEADERS, TEXTS, long_texts
from lookout.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, "
        "key long, size long, host string, `_h` string, `_hash` string, label string, rest string")
PROSE = ("the river runs past the old mill and every evening the miller closes its heavy gate before he walks home "
         "through fields of barley where larks rise and a small dog waits beside the stone wall for his master to come "
         "back with bread and news from the market town beyond the hills")


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, 2, "x", "h", "k", "l", "r")
                                  for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"{w}{i % 7}" for i in range(600) for w in PROSE.split())
    rows = [(1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, None, None), (3, None, "en", "a"), (None, None, None, None),
            (None, PROSE, "en", "b"), (4, "", "fr", "b"), (5, " \t\n", "fr", "b"), (6, long, "en", "c"), (7, "123 456 !!", None, "c"),
            (8, "été \U0001f600 naïve", "fr", "")]
    return _docs(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, []).cache()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, duck_small, name):
    res = compare(spark, duck_small, name, SimpleNamespace(build=QUERIES[name], sql=ORACLES[name]), SF_SMALL)
    assert res["ok"], res


# -- odd rows -----------------------------------------------------------------
def _bench(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, "")], "item_id long, text string")


PER_ROW = {
    "quality": lambda s, d: quality.apply_rules(d),
    "mixing": lambda s, d: mixing.mix(d, word_count(F.col("text"))),
    "sharding": lambda s, d: sharding.shard(d, sharding.document_dims(d)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "langid": lambda s, d: langid.predict(d, langid.fit(d, F.lit(True))),
    "licenses": lambda s, d: licenses.scan(d, licenses.known_licenses(s)),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_result_for_every_row(spark, odd, empty, name):
    assert PER_ROW[name](spark, odd).count() == odd.count()
    assert PER_ROW[name](spark, empty).count() == 0


def test_odd_rows_of_filters(spark, odd, empty):
    for d in (odd, empty):
        assert secrets.scan(d).where("doc_id IN (3, 4, 5)").count() == 0
        left = decontaminate.decontaminate(d, _bench(spark))
        assert left.columns == d.columns
        assert left.where(F.col("text") == PROSE).count() == 0
        once = simhash.deduplicate(d)
        assert once.columns == d.columns
        mixed = mixing.mixed(d, word_count(F.col("text")))
        assert mixed.columns == d.columns
    assert decontaminate.decontaminate(odd, _bench(spark)).count() == odd.where(~F.coalesce(F.col("text") == PROSE, F.lit(False))).count()
    assert simhash.deduplicate(odd).where(F.col("text") == PROSE).count() == 1


# -- quality --------------------------------------------------------------------
def test_lines_of_many_documents_are_removed(spark):
    rows = [(i, f"Subscribe to our letter no {i % 10}!\n" * 20 + f"own words of text {chr(97 + i)} " * 2, "en", "a") for i in range(25)]
    rows += [(100, PROSE, "en", "a"), (101, PROSE.replace("the", "one"), "en", "b")]
    got = {r["doc_id"]: r for r in quality.apply_rules(_docs(spark, rows), params=quality.QualityParams(max_repeat_share=2.0)).collect()}
    assert all(not got[i]["kept"] and not got[i]["base_failed"] and got[i]["removed_words"] > 0 for i in range(9))
    assert got[100]["kept"] and got[100]["removed_words"] == 0 and got[101]["kept"]


def test_texts_lose_their_common_lines_only(spark):
    rows = [(i, f"Own LINE {chr(97 + i)}, kept.\n\nSubscribe to letter {i % 10}!\n  {PROSE}{chr(97 + i)}\nsubscribe, to letter 7\n", "en", "a") for i in range(25)]
    rows += [(30, "subscribe to letter 1\n" + PROSE, "en", "b"), (31, None, "en", "a"), (32, "subscribe to letter 1", "en", "a")]
    got = {r["doc_id"]: r for r in quality.apply_rules(_docs(spark, rows)).collect()}
    for i in range(25):
        assert got[i]["text"] == f"Own LINE {chr(97 + i)}, kept.\n\n  {PROSE}{chr(97 + i)}\n"
        assert got[i]["kept"] and got[i]["removed_words"] == 8 and got[i]["line_words"] == 12 + len(PROSE.split())
    assert got[30]["text"] == rows[25][1] and got[31]["text"] is None and got[32]["text"] == ""


def test_copies_of_a_text_are_documents_of_their_own(spark):
    rows = [(i, "subscribe to our letter\n" + PROSE, "en", "a") for i in range(21)] + [(50, "subscribe to our letter\n" + PROSE, "en", "b")] * 30
    got = {r["doc_id"]: r for r in quality.apply_rules(_docs(spark, rows)).collect()}
    assert all(got[i]["removed_words"] > 0 and not got[i]["kept"] for i in range(21))
    assert got[50]["removed_words"] == 0  # one document, however often its row is repeated


# -- conversations ----------------------------------------------------------------
def test_only_maximal_conversations_stay(spark):
    talks = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["b"], 6: [None, "a"], 7: [str(i) for i in range(3000)],
             8: [str(i) for i in range(2500)]}
    rows = [(c, t, "user", x, 1) for c, turns in talks.items() for t, x in enumerate(turns)] + [(None, 0, "user", "a", 1), (1, 0, "user", "a", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, k int")
    got = {r["conv"]: r["snapshots"] for r in conversations.conversations(conversations.render(conversations.collapse(turns))).collect()}
    assert got == {2: 2, 4: 1, 5: 1, 6: 1, 7: 1}
    assert conversations.collapse(turns.limit(0)).count() == 0


# -- mixing -------------------------------------------------------------------------
def test_mix_comes_near_targets(spark):
    out = QUERIES["op3_mix_to_weights"](spark, SF_SMALL).toPandas()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source").toPandas()
    out = out.merge(docs, on="doc_id")
    sizes = out.groupby("source")["size"].sum()
    weight, cap = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes.index))}, 3 * sizes
    target, open_, total = {}, set(sizes.index), float(sizes.sum())
    while open_:
        left = total - sum(target.values())
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if cap[s] <= weight[s] * share}
        target |= {s: float(cap[s]) if over else weight[s] * share for s in (over or open_)}
        open_ -= over or set(open_)
    for s, g in out.groupby("source"):
        assert g["target"].iloc[0] == pytest.approx(target[s])
        left = g[(g["size"] > 0) & (g["taken"] < 3 * g["size"])]["size"]
        assert abs(g["taken"].sum() - target[s]) <= max(0.001 * target[s], left.min() if len(left) else 0)
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"].where(out["size"] > 0, 0) % out["size"].clip(lower=1) == 0).all()


# -- sharding -----------------------------------------------------------------------
def brute_tree(rows, shards, dims):
    """(key, shard) of rows (size, key, *values): widest dimension, cut where the sum comes to the goal, rows of one value and key together."""
    span = [max(r[2 + k] for r in rows) - min(r[2 + k] for r in rows) for k in range(dims)]
    out = {}

    def cut(own, first, n):
        if n == 1 or not own:
            out.update({(r[1], r[2:]): first for r in own})
            return
        wide = [(max(r[2 + k] for r in own) - min(r[2 + k] for r in own)) / (span[k] or 1.0) for k in range(dims)]
        d = max(range(dims), key=lambda k: (wide[k], -k))
        goal, below, left = sum(r[0] for r in own) * (n // 2) / n, 0, set()
        for place in sorted({(r[2 + d], r[1]) for r in own}):
            size = sum(r[0] for r in own if (r[2 + d], r[1]) == place)
            if below + size < goal:
                left.add(place)
                below += size
                continue
            if below + size - goal < goal - below:
                left.add(place)
            break
        cut([r for r in own if (r[2 + d], r[1]) in left], first, n // 2)
        cut([r for r in own if (r[2 + d], r[1]) not in left], first + n // 2, n - n // 2)

    cut(rows, 0, shards)
    return out


@pytest.mark.parametrize("shards, bins", [(7, 4), (16, 256)])
def test_tree_equals_brute_force(spark, shards, bins):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").unionByName(
        spark.createDataFrame([(None, None, None, None, None), (900, "x", "en", "https://long.common.prefix/a", 1), (901, "x y", "en", "https://long.common.prefix/b", 1)],
                              "doc_id long, text string, lang string, source string, n_chars long"))
    odd = sharding.document_dims(docs) | {"odd": F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 7.0)}
    got = sharding.shard(docs, odd, params=sharding.ShardParams(shards=shards, bins=bins))
    marks = docs.select(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16, sharding.document_key(F.col("doc_id"), F.col("text")).alias("k"),
                        *[sharding._finite(c).alias(n) for n, c in odd.items()])
    fill = sharding._null_places(marks, list(odd))
    rows = [tuple(r) for r in marks.fillna(fill).collect()]
    want = brute_tree(rows, shards, len(odd))
    key = {(r["doc_id"], r["text"]): r["k"] for r in docs.select("doc_id", "text", sharding.document_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    shard_of = {k: s for (k, _), s in want.items()}
    assert {key[r["doc_id"], r["text"]]: r["shard"] for r in got.collect()} == shard_of


def test_nulls_and_nan_leave_the_tree_whole(spark):
    rows = [(i, "w " * (i % 50), "en", f"s{i}") for i in range(200)]
    plain = sharding.shard(_docs(spark, rows), {"id": F.col("doc_id").cast("double")}, params=sharding.ShardParams(shards=8))
    with_null = _docs(spark, rows + [(None, None, None, None)])
    more = sharding.shard(with_null, {"id": F.col("doc_id").cast("double")}, params=sharding.ShardParams(shards=8))
    a, b = ({r["doc_id"]: r["shard"] for r in x.collect()} for x in (plain, more))
    assert sum(a[i] != b[i] for i in range(200)) <= 8 and b[None] == 0
    nan = sharding.shard(_docs(spark, rows), {"n": F.lit(float("nan"))}, params=sharding.ShardParams(shards=2))
    assert nan.groupBy("shard").count().count() == 2
    target = sharding.shard(_docs(spark, rows), {"id": F.col("doc_id").cast("double")}, params=sharding.ShardParams(target_bytes=2000))
    sizes = [r["s"] for r in target.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert max(sizes) <= 2300 and len(sizes) == -(-sum(sizes) // 2000)


# -- secrets ------------------------------------------------------------------------
def test_every_secret_of_a_word_is_a_candidate(spark):
    aws, git, key = "AKIA" + "Q7Z2" * 4, "ghp_" + "a1B2c3D4e5" * 4, "zX9kLm3Qw7Tp"
    texts = [f'{{"api_key":"{key}A","user":"bob","token":"{key}B","secret":"{key},C"}}', f"https://h.io/p?api_key={key}A&token={key}B&secret={key}C",
             f"{aws},{git},token={key}A", f"token={git}|{aws}", f'password: "{key},D"', f'auth:{{\\"token\\":\\"{key}A\\"}}',
             f"secret={key}A;" + "x" * 200_000 + f",token={key}B"]
    got = defaultdict(list)
    for r in secrets.candidates(_docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).orderBy("doc_id", "at", "part").collect():
        got[r["doc_id"]].append((r["kind"], r["value"]))
    name = lambda *v: [("assigned", key + x) for x in v]
    assert got == {0: name("A", "B", ",C"), 1: name("A", "B", "C"), 2: [("aws_key", aws), ("github", git), *name("A")],
                   3: [("github", git), ("aws_key", aws)], 4: name(",D"), 5: name("A"), 6: name("A", "B")}


def test_forest_keeps_keys_and_drops_placeholders(spark):
    keys = ["AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[(i * 7 + j * j * 5) % 32] for j in range(16)) for i in range(30)]
    rows = [(i, f"{PROSE} aws_key={k} and so on", "en", "a") for i, k in enumerate(keys)]
    rows += [(100 + i, f"{PROSE} see example password=xxxxxxxx{i:04d}xxxx here", "en", "a") for i in range(30)]
    got = secrets.scan(_docs(spark, rows)).toPandas()
    kept = set(got[got["is_secret"]]["doc_id"])
    assert set(range(30)) <= kept and not kept & set(range(100, 130))


# -- sharding -----------------------------------------------------------------------
def test_shards_are_near_equal_and_slots_gapless(spark):
    out = QUERIES["op5_kd_tree_shards"](spark, SF_SMALL).toPandas()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    assert len(out) == len(docs) and set(out["shard"]) <= set(range(40))
    for r in out.itertuples():
        body = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body)) and r.law == "bytes"
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sums = out.groupby("shard")["size"].sum()
    assert sums.max() <= out["size"].sum() / 40 + out["size"].max()


def test_tree_walk_equals_level_by_level_descent(spark):
    rows = spark.range(500).selectExpr("id AS _key", "cast(id % 13 AS double) AS a", "cast((id * 7) % 101 AS double) AS b", "1L + id % 5 AS size")
    levels = sharding.grow(rows, ["a", "b"], sharding.ShardParams(shards=7, bins=8))
    step = rows.withColumn("_node", F.lit(0))
    for level in levels[:-1]:
        step = sharding._down(step, level, ["a", "b"])
    first = F.get(F.array(*[F.lit(n.first) for n in levels[-1]]), F.col("_node"))
    both = step.select(first.alias("x"), sharding.leaf(levels, ["a", "b"]).alias("y"), "size").toPandas()
    assert (both["x"] == both["y"]).all() and set(both["y"]) == set(range(7))
    sums = both.groupby("y")["size"].sum()
    assert sums.max() - sums.min() <= 25


# -- WARC ---------------------------------------------------------------------------
def test_archive_round_trip_and_seek(spark):
    big = "<p>" + "x" * 1200 + "é\r\n\r\n</p>"
    pages = spark.createDataFrame([(1, "http://a/é b", big, 0), (9, "http://b", big, 0), (4, None, big, 0), (5, "http://c", None, 0),
                                   (6, "http://d", "", 0), (7, "http://e", "small", 0), (8, "http://f", "small", 0), (7, "http://e", "small", 0)],
                                  "page_id long, url string, html string, digest int")
    path = warc.archive(pages, params=warc.WarcParams(frame_bytes=1500, bundle_bytes=500))
    got = warc.read_records(spark, path).toPandas()
    assert len(got) == 8
    by = {r.page_id: r for r in got.itertuples()}
    assert by[9].record_type == "response" and bytes(by[9].payload) == big.encode()
    assert {i: by[i].refers_to for i in (1, 4)} == {1: 9, 4: 9} and by[5].payload_bytes == by[6].payload_bytes == 0
    assert by[7].record_type == by[8].record_type == "response"
    wanted = spark.createDataFrame([("<urn:page:9>",), ("<urn:page:8>",)], "record_id string")
    assert {r["page_id"] for r in warc.fetch(spark, path, wanted).collect()} == {8, 9}
    assert warc.read_records(spark, warc.archive(pages.limit(0))).count() == 0


# -- decontamination ----------------------------------------------------------------
def test_passages_are_found_despite_substitutions(spark):
    item = "which of the seven metals melts at the lowest heat and stays liquid in an ordinary room through the winter"
    changed = item.replace("metals", "stones").replace("ordinary", "unheated")
    rows = [(1, f"{PROSE} {item.upper()}! {PROSE}", "en", "a"), (2, f"{PROSE} {changed} {PROSE}", "en", "a"), (3, PROSE, "en", "a"),
            (4, " ".join(reversed(item.split())), "en", "a"), (5, None, "en", "a")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.overlaps(_docs(spark, rows), bench).collect()} == {1, 2}
    assert {r["doc_id"] for r in decontaminate.decontaminate(_docs(spark, rows), bench).collect()} == {3, 4, 5}


def test_many_seeds_of_a_long_text_meet_in_a_shuffle(spark):
    item = "which of the seven metals melts at the lowest heat and stays liquid in an ordinary room through the winter"
    long = " ".join(f"w{i * 7919 % 1009}" for i in range(100_000))
    rows = [(1, f"{long} {item}", "en", "a"), (2, long, "en", "a"), (None, item, "en", "a"), (3, item, "en", "a"), (3, item, "en", "a"),
            (4, None, "en", "a"), (5, "", None, None)]
    bench = spark.createDataFrame([(1, item), (2, item), (3, "liquid in an ordinary room")], "item_id long, text string")
    docs = _docs(spark, rows)
    want = sorted(decontaminate.overlaps(docs, bench).collect(), key=str)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = sorted(decontaminate.overlaps(docs, bench, params=decontaminate.SeedParams(broadcast_rows=0)).collect(), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == want and {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in (1, None, 3) for i in (1, 2, 3)}


def test_many_passages_of_one_text_do_not_hold_its_copies(spark):
    item = "which of the seven metals melts at the lowest heat and stays liquid in an ordinary room through the winter"
    n, times = len(item.split()), 2600  # 27 seeds a passage: 29 GB if each match carries the tokens of the text
    docs = _docs(spark, [(1, " ".join([item] * times), "en", "a"), (2, PROSE, "en", "a"), (None, f"{PROSE} {item}", "en", "a")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(r["doc_id"], r["offset"]): r["score"] for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(1, n * k): n for k in range(times)} | {(None, len(PROSE.split())): n}


def test_texts_of_any_number_of_blocks_have_the_same_overlaps(spark):
    item = "which of the seven metals melts at the lowest heat and stays liquid in an ordinary room through the winter"
    rows = [(k, " ".join([f"w{i * 7919 % 1009}" for i in range(k)] + item.split() + ["end"] * (k % 3)), "en", "a") for k in range(40)]
    rows += [(100, " ".join(item.split()[5:]), "en", "a"), (101, "liquid in an ordinary", "en", "a"), (102, "in an ordinary room liquid in an ordinary room", "en", "a")]
    bench = spark.createDataFrame([(1, item), (2, "liquid in an ordinary room")], "item_id long, text string")
    got = [sorted(decontaminate.overlaps(_docs(spark, rows), bench, params=decontaminate.SeedParams(block=block)).collect())
           for block in (1, 7, 1024)]
    assert got[0] == got[1] == got[2]
    found = {(r["doc_id"], r["item_id"], r["offset"]): r["score"] for r in got[0]}
    assert found == {(k, 1, k): 20 for k in range(40)} | {(k, 2, k + 12): 5 for k in range(40)} \
        | {(100, 1, -5): 15, (100, 2, 7): 5, (102, 2, 4): 5}


def test_documents_are_not_sorted_for_few_bad_ones(spark):
    item = "which of the seven metals melts at the lowest heat and stays liquid in an ordinary room through the winter"
    docs = _docs(spark, [(1, f"{PROSE} {item}", "en", "a"), (1, PROSE, "en", "a"), (None, item, "en", "a"), (None, PROSE, None, None), (2, None, "en", "a"),
                         (3, " ".join([item] * 2600), "en", "a")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the list were above it
    try:
        left = decontaminate.decontaminate(docs, bench)
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
        many = decontaminate.decontaminate(docs, bench, params=decontaminate.SeedParams(broadcast_rows=0))
        for kept in (left, many):
            assert sorted((r["doc_id"], r["text"]) for r in kept.na.fill({"doc_id": -1, "text": ""}).collect()) == [(-1, PROSE), (1, PROSE), (2, "")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# -- SimHash ------------------------------------------------------------------------
def _fingerprint(text):
    words = [w for w in "".join(c if c not in "\t\n\x0b\f\r" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").toPandas()
    want = {i: _fingerprint(t) for i, t in zip(docs["doc_id"], docs["text"])}
    ids, root = sorted(want), {i: i for i in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (want[a] ^ want[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = QUERIES["op8_simhash_components"](spark, SF_SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{want[i]:016x}", find(i)) for i in ids}


# -- language -----------------------------------------------------------------------
def test_held_out_accuracy(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    out = QUERIES["op9_language_mixture"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id") \
        .where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").toPandas()
    assert ((out["score"] >= 0) & (out["score"] <= 1)).all()
    assert (out["lang"] == out["lang_pred"]).mean() >= 0.9


def test_copies_leave_a_label_all_its_texts(spark):
    rows = [(i, "zyx wvu", "xx", "a") for i in range(2000)] + [(3000 + i, f"text{chr(97 + i)} number", "xx", "a") for i in range(10)]
    model = langid.fit(_docs(spark, rows), F.lit(True), params=langid.LangIdParams(train_rows=20))
    assert {ord(c) for c in "zyxwvutextnumberabcdefghij"} <= set(model.letters)


# -- licences -----------------------------------------------------------------------
def test_a_hundred_labels_get_models_and_both_forms_agree(spark):
    import random
    rnd = random.Random(4)
    words = {f"l{i:03}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 7))) for _ in range(12)] for i in range(100)}
    rows = [(i * 10 + j, " ".join(rnd.choices(words[name], k=60)), name, "s") for i, name in enumerate(words) for j in range(4)]
    docs = _docs(spark, rows)
    train = F.col("doc_id") % 10 < 3
    sparse, dense = (langid.fit(docs, train, params=langid.LangIdParams(dense_languages=n)) for n in (64, 100))
    assert len(sparse.languages) == 100 and isinstance(sparse.log_p, langid.SparseTrigrams)
    got = {r["doc_id"]: r for r in langid.predict(docs, sparse).collect()}
    assert all(got[i]["lang_pred"] == name for i, _, name, _ in rows)
    for r in langid.predict(docs, dense, params=langid.LangIdParams(dense_languages=100)).collect():
        assert r["lang_pred"] == got[r["doc_id"]]["lang_pred"] and r["score"] == pytest.approx(got[r["doc_id"]]["score"], abs=1e-3)


def test_license_digest_ignores_owner_case_and_punctuation(spark):
    name, body = TEXTS[0]
    rows = [(1, "Copyright (c) 2020 Some Body\n\n" + body.upper().replace(",", " ;"), "en", "a"), (2, body + " and more words", "en", "a"), (3, None, "en", "a")]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(_docs(spark, rows), licenses.known_licenses(spark)).collect()}
    assert got == {1: name, 2: None, 3: None}


def test_long_licenses_and_headers_are_known(spark):
    apache = """// Licensed under the Apache License, Version 2.0 (the "License");
        // you may not use this file except in compliance with the License.
        // You may obtain a copy of the License at"""
    gpl = """ * Tool is free software: you can redistribute it and/or modify
        * it under the terms of the GNU General Public License as published by
        * the Free Software Foundation, either version 3 of the License, or
        * (at your option) any later version."""
    texts = [*long_texts(), ("", apache + "\nint main"), ("", gpl + "\nint main")]
    got = {r["doc_id"]: r for r in licenses.scan(_docs(spark, [(i, t, "en", "a") for i, (_, t) in enumerate(texts)]),
                                                 licenses.known_licenses(spark)).collect()}
    n = len(texts) - 2
    assert [got[i]["license_id"] for i in range(n)] == [name for name, _ in texts[:n]]
    assert got[n]["notices"] == ["Apache-2.0"] and got[n + 1]["notices"] == ["GPL-3.0-or-later"]
    assert got[n]["license_id"] is None and got[n + 1]["license_id"] is None
    forms = licenses.with_canonical(spark.createDataFrame(HEADERS, "license_id string, text string"), "text")
    assert forms.where("form <> text").count() == 0


# -- pipeline -----------------------------------------------------------------------
def test_stages_take_effect_and_agree_with_the_operators(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF_SMALL), "test-stage"))
    assert all(d.columns == docs.columns for d in out[:-1])
    _, lang, near, clean, mixed, shards = [d.toPandas() for d in out]
    assert all(any(c.isalpha() for c in t) for t in lang["text"])
    assert len(lang) == sum(any(c.isalpha() for c in (r["text"] or "")) for r in docs.collect())
    fps = [_fingerprint(t) for t in near["text"]]
    assert all((a ^ b).bit_count() > 4 for n, a in enumerate(fps) for b in fps[n + 1:])
    bad = {r["doc_id"] for r in decontaminate.overlaps(out[2], spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
    assert set(clean["doc_id"]) == set(near["doc_id"]) - bad
    taken = {r["doc_id"]: r["repeats"] for r in mixing.mix(out[3], word_count(F.col("text"))).collect()}
    assert Counter(mixed["doc_id"]) == {i: n for i, n in taken.items() if n}
    assert Counter(shards["doc_id"]) == Counter(mixed["doc_id"])
    slots = defaultdict(list)
    for s, k in zip(shards["shard"], shards["slot"]):
        slots[s].append(k)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
