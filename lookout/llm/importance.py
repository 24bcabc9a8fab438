"""Importance resampling towards a target distribution of hashed n-grams.

Each task joins the texts of a batch with separators, finds all words by one
regex pass, gives every word its document by ``searchsorted`` in the offsets,
drops n-grams that pass from one document into the next, and counts buckets by
``bincount``. The counts of all documents and of the target give each bucket's
log ratio; a second pass takes each document's mean, to which a fixed Gumbel
noise is added, so that the highest scores are a weighted draw.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import written
from lookout.operators.order import with_global_rank

SEPARATOR = b"\x00"  # no word character, so no word passes it
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class ImportanceParams:
    buckets: int = 10_000
    max_run: int = 2                # words of the longest feature
    min_words: int = 20             # shorter documents are not drawn
    percent: int = 25               # of the documents that may be drawn
    seed: int = 7
    batch_bytes: int = 4 << 20      # text joined at once; a longer text is a batch of its own


def features(texts: list[bytes], params: ImportanceParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the bucket and document of every feature of the joined texts."""
    joined = SEPARATOR.join(texts).lower()  # bytes: only A-Z have a lower case
    offsets = np.cumsum([0] + [len(t) + len(SEPARATOR) for t in texts[:-1]])
    spans = np.fromiter(chain.from_iterable(m.span() for m in TERM.finditer(joined)), np.int64).reshape(-1, 2)
    doc = np.searchsorted(offsets, spans[:, 0], side="right") - 1
    crc, buckets, docs = zlib.crc32, [], []
    words = [joined[a:b] for a, b in spans.tolist()]
    # the checksum of a run is that of the shorter run, carried on over a blank and the next word
    sums = [crc(w) for w in words]
    tails = [b" " + w for w in words] if params.max_run > 1 else []
    for n in range(1, params.max_run + 1):
        if n > 1:
            sums = list(map(crc, tails[n - 1:], sums))
        own = doc[:len(doc) - n + 1] == doc[n - 1:]
        buckets.append(np.fromiter(sums, np.int64, len(own))[own] % params.buckets)
        docs.append(doc[:len(doc) - n + 1][own])
        sums = sums[:max(len(doc) - n, 0)]
    return np.bincount(doc, minlength=len(texts)), np.concatenate(buckets), np.concatenate(docs)


def _joined_batches(batch: pa.RecordBatch, at: int, params: ImportanceParams) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows whose texts together stay near ``batch_bytes``."""
    texts, size, first = [], 0, 0
    for i, text in enumerate(batch.column(at)):
        raw = text.as_py()
        raw = b"" if raw is None else raw.encode("utf-8") if isinstance(raw, str) else raw
        if texts and size + len(raw) > params.batch_bytes:
            yield first, texts
            texts, size, first = [], 0, i
        texts.append(raw)
        size += len(raw)
    if texts:
        yield first, texts


def bucket_counts(texts: DataFrame, params: ImportanceParams = ImportanceParams(), text: str = "text") -> DataFrame:
    """``bucket`` and ``n``: features of all texts by bucket; buckets without a feature have no row."""

    def run(batches):
        total = np.zeros(params.buckets, np.int64)
        for batch in batches:
            for _, part in _joined_batches(batch, 0, params):
                total += np.bincount(features(part, params)[1], minlength=params.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, params: ImportanceParams = ImportanceParams()) -> np.ndarray:
    """Thousandfold log ratio of each bucket, floored; ``buckets`` numbers on the driver, whatever the input."""
    spark = source.sparkSession
    both = spark.range(params.buckets).select(F.col("id").alias("bucket")) \
        .join(source.select("bucket", F.col("n").alias("s")), "bucket", "left") \
        .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).select(F.struct("s", "t")).scalar()
    plus = lambda c, n: (c + n).cast("double")
    ratio = (plus(F.col("t"), 1) * plus(sums["s"], params.buckets)) / (plus(F.col("s"), 1) * plus(sums["t"], params.buckets))
    rows = both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("bigint").alias("gain")).collect()
    gains = np.zeros(params.buckets, np.int64)
    for r in rows:
        gains[r["bucket"]] = r["gain"]
    return gains


def weights(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text",
            params: ImportanceParams = ImportanceParams()) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` (floored mean gain, 0 without features) of every row."""

    def run(batches):
        for batch in batches:
            parts = []
            for _, texts in _joined_batches(batch, 1, params):
                n_words, bucket, doc = features(texts, params)
                n = np.bincount(doc, minlength=len(texts))
                order = np.argsort(doc, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gains[bucket[order]])])
                ends = np.cumsum(n)
                parts.append((n_words, n, (sums[ends] - sums[ends - n]) // np.maximum(n, 1)))
            found = [np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts)] or [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in found]],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A fixed thousandfold Gumbel value of a document, floored."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.ln(-F.ln((drawn.cast("double") + 0.5) / 4294967296))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             params: ImportanceParams = ImportanceParams()) -> DataFrame:
    """Draw the documents whose features look most like the target's, with noise.

    Returns ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and
    ``rank`` (from 1, null if not drawn) of every row. A null or empty text has
    no words, weight 0 and is never drawn; a null id is hashed as the empty
    string and comes last among ties; repeated rows are drawn each for itself,
    ties beyond the id in any order. Empty tables give empty results; with an
    empty target all gains measure the corpus against a flat distribution.
    """
    gains = bucket_gains(bucket_counts(docs, params, text), bucket_counts(target, params, target_text), params)
    scored = weights(docs, gains, doc_id, text, params).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), params.seed))
    scored = written(scored, "importance-scores")
    may = F.col("n_words") >= params.min_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = with_global_rank(scored.where(may), order, "rank")
    most = scored.agg(F.expr(f"({params.percent} * count_if(n_words >= {params.min_words})) div 100").alias("k")).scalar()
    drawn = F.when(F.col("rank") <= most, F.col("rank"))
    return ranked.withColumn("rank", drawn).unionByName(
        scored.where(~may).withColumn("rank", F.lit(None).cast("bigint")))
