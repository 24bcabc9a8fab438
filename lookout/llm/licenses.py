"""Licence scans by canonical digest lookup.

Texts are brought to a canonical form: lower case, no copyright lines, no
punctuation, one spelling of equivalent words. The digest of the whole form is
joined with the digests of known licences; the same lookup over a text's lines
finds notices, and over the blocks of words that begin like a standard header,
however its lines are broken, finds headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.llm.common import written
from lookout.llm.license_texts import HEADERS, NAMES, NOTICES, SPELLINGS, TEXTS, long_texts

#: lines that name an owner or reserve rights are not part of a licence's wording
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\n]*(?:\(c\)|©|\d|<|\[)|\(c\)|©|all rights reserved)[^\n]*$"


def with_canonical(texts: DataFrame, text: str, name: str = "form") -> DataFrame:
    """Add the canonical form, lines kept: words in lower case with one blank between them; null stays null."""
    lower, plain = F.col("_lower"), F.col("_plain")
    owned = lower.contains("copyright") | lower.contains("(c)") | lower.contains("©") | lower.contains("all rights reserved")
    same = plain
    for found, compared in SPELLINGS:
        same = F.regexp_replace(same, rf"\b{found}\b", compared)
    variants = r"\b(?:" + "|".join(found for found, _ in SPELLINGS) + r")\b"
    # each step is a column of its own, so that none is computed twice
    return texts.withColumn("_lower", F.lower(F.col(text))) \
        .withColumn("_plain", F.regexp_replace(F.when(owned, F.regexp_replace(lower, COPYRIGHT_LINE, "")).otherwise(lower),
                                               r"[^\p{L}\p{N}\n]+", " ")) \
        .withColumn(name, F.when(plain.rlike(variants), same).otherwise(plain)).drop("_lower", "_plain")


def _flat(form: Column) -> Column:
    return F.btrim(F.regexp_replace(form, r"[ \n]+", " "))


def digest(form: Column) -> Column:
    """Digest of a canonical form as one line; an empty form has none."""
    flat = _flat(form)
    return F.when(flat != "", F.sha2(flat.cast("binary"), 256))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(``license_id``, ``text``) of the built-in licences, headers and notices."""
    rows = [*TEXTS, *long_texts(), *HEADERS, *((i, n.format(name)) for i, name in NAMES for n in NOTICES)]
    rows += [(i, f"SPDX-License-Identifier: {i}") for i in dict.fromkeys(i for i, _ in [*TEXTS, *NAMES])]
    return spark.createDataFrame(rows, "license_id string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """One row a digest; of licences with equal canonical texts the smallest id stands for all."""
    return with_canonical(known, "text").withColumn("digest", digest(F.col("form"))).where(F.col("digest").isNotNull()) \
        .groupBy("digest").agg(F.min("license_id").alias("license_id"))


def header_blocks(form: Column) -> Column:
    """All blocks of a canonical form that begin with a header's first words and are as long as that header."""
    flat, shapes = _flat(form), {}
    for _, header in HEADERS:
        first = " ".join(header.split()[:5])
        shapes.setdefault(first, set()).add(len(header.split()) - 5)
    none = F.array().cast("array<string>")
    each = [F.when(form.rlike(r"\s+".join(first.split())), F.concat(*(
        F.regexp_extract_all(flat, F.lit(rf"(?<!\S)(?={first}\b)(?=({first}(?: \S+){{{n}}}))"), F.lit(1)) for n in sorted(more)))).otherwise(none)
        for first, more in sorted(shapes.items())]
    return F.concat(*each)


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences of every row: ``doc_id``, ``text_hash``, ``digest``, ``license_id``, ``notices``.

    ``license_id``: the licence that the whole text is, or null. ``notices``:
    sorted ids of the licences that whole lines are or name, and of headers in a
    text that is no licence as a whole. A null or blank
    text has no digest, no licence and no notices; repeated rows get equal
    results. The known digests are joined, never searched one by one.
    """
    known = written(known_digests(known), "license-known")
    form = with_canonical(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")), "text")
    lines = F.filter(F.transform(F.split("form", "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    hashes = lambda parts: F.array_distinct(F.transform(parts, lambda x: F.sha2(x.cast("binary"), 256)))
    rows = written(form.select("doc_id", "text_hash", digest(F.col("form")).alias("digest"), hashes(lines).alias("lines"),
                               hashes(header_blocks(F.col("form"))).alias("blocks")), "license-rows")
    whole = rows.join(known, "digest", "left")
    own = F.when(F.col("license_id").isNull(), F.array_union("lines", "blocks")).otherwise(F.col("lines"))
    each = whole.select("doc_id", "text_hash", F.explode(own).alias("digest"))
    notices = each.join(known, "digest").groupBy("doc_id", "text_hash").agg(F.collect_set("license_id").alias("found"))
    out = whole.select("doc_id", "text_hash", "digest", "license_id").alias("r").join(
        notices.alias("n"), F.expr("r.doc_id <=> n.doc_id AND r.text_hash = n.text_hash"), "left")
    return out.select("r.doc_id", "r.text_hash", "r.digest", "r.license_id",
                      F.coalesce(F.array_sort("found"), F.array().cast("array<string>")).alias("notices"))
