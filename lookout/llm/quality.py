"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; the distinct documents of each host that hold
a line are counted. Lines above the limit are boilerplate of that host: they are
removed, and documents that lose most of their words are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import BLANK_RUN, BLANKS, words, written


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50             # a text of fewer words fails
    max_repeat_share: float = 0.5   # of words in repeated 3-word windows
    max_documents: int = 20         # distinct documents of a host that may hold a line
    min_left: float = 0.5           # a document that keeps a smaller share of its line words is depleted


SYMBOLS = "#*$%&|<>"


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, "")).cast("bigint")


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` of every whole text."""
    rows = docs.withColumn("_words", words(F.col(text))).withColumn("n_words", F.size("_words").cast("bigint"))
    rows = rows.withColumn("word_chars", _without(F.col(text), BLANK_RUN)) \
        .withColumn("n_symbols", _without(F.col(text), f"[^{SYMBOLS}]+")) \
        .withColumn("_lines", F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")) \
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
    window = F.transform(F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
                         lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    rows = rows.withColumn("_windows", window)
    # only texts with a repeated window pay for the sort that finds its places
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("_placed", F.when(F.size("_windows") > F.size(F.array_distinct("_windows")), placed).otherwise(none))
    again = F.filter("_placed", lambda x, k: (F.get("_placed", k - 1)["h"].eqNullSafe(x["h"]))
                     | (F.get("_placed", k + 1)["h"].eqNullSafe(x["h"])))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return rows.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("bigint")) \
        .drop("_words", "_windows", "_placed", "_lines")


def normalised_lines(text: Column) -> Column:
    """Lines in lower case, digits as 0, other characters as one blank; lines without a letter or digit are empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    return F.split(F.regexp_replace(plain, r"\p{N}", "0"), "\n")


def line_counts(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct documents by host and line.

    ``lines`` has rows (``host``, ``text_hash``, ``line``), one text's lines once
    however many documents hold it; ``documents`` (``host``, ``text_hash``, ``n``)
    tells how many those are.
    """
    held = lines.select("host", "text_hash", "line").distinct().alias("l") \
        .join(documents.alias("d"), F.expr("l.host <=> d.host AND l.text_hash = d.text_hash"))
    return held.groupBy("l.host", "l.line").agg(F.sum("d.n").alias("documents"))


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines at the given places (from 0); without places it stays as it is."""
    lines = F.split(text, "\n")
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    # one flag a line, in order, so that long texts are not searched line by line
    flags = F.array_sort(F.concat(F.transform(dropped, lambda i: F.struct(i.alias("i"), F.lit(False).alias("stays"))),
                                  F.transform(F.array_except(places, dropped), lambda i: F.struct(i.alias("i"), F.lit(True).alias("stays")))))
    left = F.filter(F.zip_with(lines, flags, lambda x, f: F.struct(x.alias("line"), f["stays"].alias("stays"))), lambda x: x["stays"])
    return F.when(dropped.isNull(), text).otherwise(F.array_join(F.transform(left, lambda x: x["line"]), "\n"))


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                params: QualityParams = QualityParams()) -> DataFrame:
    """Every document's text without its boilerplate lines, measures and verdict.

    Returns ``doc_id``, ``text`` (the lines that stay), ``text_hash`` (of the
    whole text), the base measures (of the whole text), ``base_failed``,
    ``removed_words`` (words in removed lines, as normalised), ``line_words``
    (words in all lines) and ``kept``. A null text has no words and fails; a
    null host is a host of its own. Rows of equal id, host and text are one
    document and get equal verdicts; copies of a text under other ids are
    documents of their own, as are null ids all together.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"),
                      F.col(host).alias("host"))
    hashed = F.filter(F.transform(normalised_lines(F.col("text")), lambda x, i: F.struct(i.alias("place"), F.btrim(x).alias("line"))),
                      lambda x: x["line"] != "")
    hashed = F.transform(hashed, lambda x: F.struct(x["place"].alias("place"), F.xxhash64(x["line"]).alias("line"),
                                                    F.size(F.split(x["line"], " ")).alias("words")))
    # a document's lines, once however often its row is repeated
    texts = own.select("host", "text_hash", hashed.alias("lines")).groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    lines = written(texts.select("host", "text_hash", F.explode("lines").alias("l")).select("host", "text_hash", "l.*"),
                    "quality-lines")
    documents = own.select("host", "text_hash", "doc_id").distinct().groupBy("host", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    common = written(line_counts(lines, written(documents, "quality-documents")).where(F.col("documents") > params.max_documents).select("host", "line"), "quality-common")
    hit = lines.alias("l").join(common.alias("c"), F.expr("l.host <=> c.host AND l.line = c.line"))
    removed = written(hit.groupBy("l.host", "l.text_hash").agg(
        F.sum("l.words").alias("removed_words"), F.collect_list("l.place").alias("dropped")), "quality-removed")
    # the words of normalised lines are the runs of letters and digits
    rows = base_measures(own).withColumn("line_words", F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+")).cast("bigint"))
    joined = rows.alias("r").join(removed.alias("x"), F.expr("r.host <=> x.host AND r.text_hash = x.text_hash"), "left")
    failed = (F.col("n_words") < params.min_words) | (F.col("n_repeat_words") > params.max_repeat_share * F.col("n_words"))
    out = joined.select("r.*", F.coalesce("removed_words", F.lit(0)).cast("bigint").alias("removed_words"), "dropped",
                        failed.alias("base_failed"))
    left = F.col("line_words") - F.col("removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= params.min_left * F.col("line_words"))) \
        .withColumn("text", without_lines(F.col("text"), F.col("dropped"))).drop("dropped", "host")
