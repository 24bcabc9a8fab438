"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are words that look like a credential: a known format, a value
assigned to a telling name, or a long run that mixes letters and digits. A
random forest over length, character transitions, dictionary coverage, path and
neighbouring words, trained from labelled findings, tells secrets from numbers,
checksums, placeholders and odd words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import words, written

# FIXED VALUES: formats, telling names, words beside values that are no secrets
FORMATS = {
    "aws_key": r"A(?:KIA|SIA)[0-9A-Z]{16}", "github": r"gh[pousr]_[0-9A-Za-z]{36,}", "google": r"AIza[0-9A-Za-z_-]{35}",
    "slack": r"xox[abprs]-[0-9A-Za-z-]{10,}", "stripe": r"[rs]k_live_[0-9A-Za-z]{16,}", "gitlab": r"glpat-[0-9A-Za-z_-]{20,}",
    "jwt": r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
}
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|private_?key|auth|credential|bearer)s?"
HARMLESS = r"(?:example|sample|test|dummy|fake|placeholder|sha1|sha256|md5|checksum|digest|commit|uuid|isbn|iban|card|phone|order|invoice|version)s?"
PLACEHOLDER = r"(?i)x{4,}|\*{3,}|\.{3,}|(.)\1{5,}|example|changeme|your|placeholder|dummy|12345678|abcdef"
BLOB = r"[0-9A-Za-z+/_=-]{12,}"

# a word is cut into known formats, assigned values with their names, runs between marks, and marks
MARK = "\"'`,&;{}<>"
KNOWN = rf"(?<![0-9A-Za-z])(?:{'|'.join(FORMATS.values())})(?![0-9A-Za-z])"
NAMED = rf"(?i:{NAMES})[\\\"'`]*+[=:]++[\[(\\]*+[\"'`]?+"
STARTS = rf"{NAMED}[^{MARK}]"
QUOTED = "|".join(rf"(?<={q})(?![^{q}]*?{KNOWN})[^{q}]++(?={q})" for q in "\"'`")
PARTS = (rf"(?s){KNOWN}|{NAMED}(?!{STARTS})(?:{QUOTED}|(?:(?!{KNOWN}|(?<![0-9A-Za-z]){STARTS})[^{MARK}])++)"
         rf"|(?:(?!{KNOWN}|{STARTS})[^{MARK}])++|.")
LEAD = "token="
NEAR = 1000     # characters of the neighbouring words that are context of a candidate


@dataclass(frozen=True)
class SecretParams:
    train_rows: int = 20_000        # labelled findings the forest is grown on, by hash order
    trees: int = 40
    depth: int = 6
    seed: int = 42
    threshold: float = 0.5
    dictionary_count: int = 5       # a word of the corpus that occurs as often is in the dictionary
    common_pairs: int = 300         # most frequent pairs of neighbouring letters of the dictionary
    broadcast_rows: int = 1_000_000 # distinct letter runs of candidates that are broadcast; more are joined by a shuffle


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate: ``doc_id``, ``text_hash``, ``at`` (word, from 0), ``part``, ``value``, ``kind``, ``before``, ``after``, ``word``.

    A word may hold many: ``part`` numbers the parts it is cut into, and ``word``
    is the candidate with the parts beside it. A value ends at a quote, comma,
    semicolon, ampersand, brace or angle bracket, a quoted one at its closing quote.
    ``kind`` is a format's name, ``assigned`` or ``blob``. Texts without a
    digit, a known format and a telling name hold no candidate; null texts hold none.
    """
    t = F.col(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text")) \
        .where(F.col("text").rlike(rf"[0-9]|(?i:{NAMES}[\\\"'`]*\s*[=:])|" + "|".join(FORMATS.values()))).withColumn("w", words(F.col("text"))).drop("text")
    shaped = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("whole"))),
                      lambda s: s["whole"].rlike(rf"(?i){NAMES}[\\\"'`]*[=:].|{BLOB}") & (F.octet_length(s["whole"]) >= 8)
                      | (s["at"] > 0) & (F.octet_length(s["whole"]) >= 6) & F.get("w", s["at"] - 1).rlike(rf"(?i)(?:^|\W){NAMES}[\"']?[=:]$|^[=:]$"))
    found = rows.withColumn("s", F.explode(shaped)).select(
        "doc_id", "text_hash", "s.*",
        F.right(F.array_join(F.slice("w", F.greatest(F.col("s.at") - 2, F.lit(1)), F.least(F.col("s.at"), F.lit(3))), " "), F.lit(NEAR)).alias("before"),
        F.left(F.coalesce(F.get("w", F.col("s.at") + 1), F.lit("")), F.lit(NEAR)).alias("after"))
    # a name that ends in the word before stands in front of the word while it is cut into parts
    led = F.col("before").rlike(rf"(?i){NAMES}[\"']?\s*[=:]+[\"']?$")
    found = found.withColumn("led", led).withColumn("parts", F.regexp_extract_all(
        F.concat(F.when(led, F.lit(LEAD)).otherwise(F.lit("")), "whole"), F.lit(PARTS), F.lit(0)))
    near = lambda i: F.array_join(F.slice("parts", F.greatest(i - 3, F.lit(1)), F.least(i, F.lit(4)) + 3), "")
    long = F.filter(F.transform("parts", lambda x, i: F.struct(i.alias("part"), x.alias("own"))), lambda x: F.octet_length(x["own"]) >= 6)
    found = found.withColumn("p", F.explode(F.transform(long, lambda x: F.struct(
        x["part"], x["own"], F.when(F.col("led") & (x["part"] < 5), F.substring(near(x["part"]), len(LEAD) + 1, 1 << 30))
        .otherwise(near(x["part"])).alias("word"))))).select("doc_id", "text_hash", "at", "p.*", "before", "after")
    own, assigned = F.col("own"), F.col("own").rlike(f"^{NAMED}")
    kind = F.when(assigned, F.lit("assigned")).otherwise(F.lit("blob"))
    for name, shape in FORMATS.items():
        kind = F.when(own.rlike(f"^{shape}$"), F.lit(name)).otherwise(kind)
    value = F.when(assigned, F.regexp_replace(F.regexp_replace(own, f"^{NAMED}", ""), r"^[^0-9A-Za-z+/_=$-]+|[^0-9A-Za-z+/_=$-]+$", "")) \
        .otherwise(F.regexp_replace(own, r"^[^0-9A-Za-z+/_$-]+|[^0-9A-Za-z+/_=$-]+$", ""))
    found = found.withColumn("kind", kind).withColumn("value", F.when(kind.isin(*FORMATS), own).otherwise(value)).drop("own")
    mixed = F.col("value").rlike("[0-9]") & (F.octet_length("value") >= 12)
    return found.where((F.octet_length("value") >= 6) & ((F.col("kind") != "blob") | mixed))


def _runs(value: Column) -> Column:
    """Runs of four or more letters, in lower case."""
    return F.regexp_extract_all(F.lower(value), F.lit(r"[a-z]{4,}"), F.lit(0))


def dictionary(docs: DataFrame, runs: DataFrame, text: str, params: SecretParams) -> DataFrame:
    """The given runs (column ``run``) that are words of the corpus, counted over all texts, with their ``count``."""
    if runs.count() <= params.broadcast_rows:
        runs = F.broadcast(runs)
    all_words = docs.select(F.explode(words(F.lower(F.col(text)))).alias("word"))
    return all_words.select(F.regexp_replace("word", r"^[^a-z]+|[^a-z]+$", "").alias("run")).join(runs, "run") \
        .groupBy("run").count().where(F.col("count") >= params.dictionary_count)


FEATURES = ["length", "transitions", "digits", "uppers", "distinct", "common_pairs", "coverage", "in_path", "named", "harmless",
            "quoted", "known_format", "prose_before", "prose_after"]


def features(found: DataFrame, docs: DataFrame, text: str = "text", params: SecretParams = SecretParams()) -> DataFrame:
    """Add the feature columns to candidates; dictionary and letter pairs come from all texts of ``docs``."""
    found = written(found, "secrets-found")
    runs = written(found.select(F.explode(_runs(F.col("value"))).alias("run")).distinct(), "secrets-runs")
    known = written(dictionary(docs, runs, text, params), "secrets-words")
    covered = found.select("value", F.explode(_runs(F.col("value"))).alias("run")).distinct().join(known, "run") \
        .groupBy("value").agg(F.sum(F.length("run")).alias("_covered"))
    # pairs of letters that ordinary words have, from the candidates' surroundings
    near = F.regexp_replace(F.lower(F.concat_ws(" ", "before", "after")), "[^a-z ]+", " ")
    pairs = found.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(near) - 1, F.lit(1))),
                                       lambda i: F.substring(near, i, F.lit(2)))).alias("pair"))
    top = [r["pair"] for r in pairs.where(F.col("pair").rlike("^[a-z]{2}$")).groupBy("pair").count()
           .orderBy(F.desc("count"), "pair").limit(params.common_pairs).collect()]
    value, low = F.col("value"), F.lower("value")
    n = F.greatest(F.length(value), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    steps = F.sequence(F.lit(1), F.greatest(F.length(value) - 1, F.lit(1)))
    letter_pairs = F.filter(F.transform(steps, lambda i: F.substring(low, i, F.lit(2))), lambda p: p.rlike("^[a-z]{2}$"))
    common = F.size(F.filter(letter_pairs, lambda p: p.isin(top))) if top else F.lit(0)
    prose = r"(?:^|\s)[^\W\d_]+[,.;]?$"
    out = found.join(covered, "value", "left").withColumns({
        "length": F.length(value).cast("double"),
        "transitions": (F.length(classes) - 1) / n,
        "digits": share("[^0-9]+"), "uppers": share("[^A-Z]+"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "common_pairs": F.coalesce(common / F.nullif(F.size(letter_pairs), F.lit(0)), F.lit(0.0)),
        "coverage": F.least(F.coalesce("_covered", F.lit(0)) / n, F.lit(1.0)),
        "in_path": F.col("word").rlike(r"://|^/|[A-Za-z0-9]/[A-Za-z0-9]+/|\\|\.[a-z]{2,4}$").cast("double"),
        "named": F.concat_ws(" ", "before", "word").rlike(f"(?i){NAMES}").cast("double"),
        "harmless": F.concat_ws(" ", "before", "word", "after").rlike(rf"(?i)\b{HARMLESS}\b").cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "known_format": (~F.col("kind").isin("assigned", "blob")).cast("double"),
        "prose_before": F.col("before").rlike(prose).cast("double"),
        "prose_after": F.col("after").rlike(r"^[^\W\d_]+[,.;]?$").cast("double")})
    return written(out.drop("_covered"), "secrets-features")


def label_findings(found: DataFrame) -> DataFrame:
    """Labelled findings where no reviewer's labels are given: candidates whose shape settles the question.

    1: a known format, or a value with digits assigned to a telling name; 0:
    placeholders, numbers and addresses without letters, and values beside
    harmless words. All others stay unlabelled and are left to the forest.
    """
    value = F.col("value")
    fake = value.rlike(PLACEHOLDER) | (F.col("harmless") > 0)
    number = ~value.rlike("[A-Za-z]")
    good = (F.col("known_format") > 0) | (F.col("kind") == "assigned") & (F.col("digits") > 0) & (F.col("length") >= 12)
    return found.withColumn("label", F.when(fake | number, 0.0).when(good, 1.0))


def classify(found: DataFrame, labelled: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """Add ``score`` and ``is_secret`` to candidates with features, by a forest grown on ``labelled`` (features and ``label``).

    At most ``train_rows`` findings take part. Without findings of both kinds
    there is nothing to learn from and every candidate is kept with score 1.
    """
    sample = written(labelled.where(F.col("label").isNotNull()).select(*FEATURES, "label", F.xxhash64("value", "before").alias("_h"))
                     .orderBy("_h", *FEATURES, "label").limit(params.train_rows), "secrets-sample")
    kinds = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(kinds) < 2:
        return found.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=params.trees, maxDepth=params.depth,
                                    seed=params.seed, rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_label")
    # one partition of a bounded sample: the trees' draws do not depend on how the table was split
    model = forest.fit(gather.transform(sample.coalesce(1).sortWithinPartitions("_h", *FEATURES, "label")))
    return model.transform(gather.transform(found)).withColumn("score", vector_to_array("_p")[1]) \
        .drop("_features", "_raw", "_p", "_label").withColumn("is_secret", F.col("score") >= params.threshold)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None,
         params: SecretParams = SecretParams()) -> DataFrame:
    """All candidates of the documents with features, ``score`` and ``is_secret``.

    ``labelled`` has reviewed findings with the features of ``features`` and a
    ``label``; by default they come from ``label_findings``.
    """
    found = features(candidates(docs, doc_id, text), docs, text, params)
    return classify(found, label_findings(found) if labelled is None else labelled, params)
