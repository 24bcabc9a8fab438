"""Session memory and the searchable corpus.

* Session records are nested rows (date + payload) appended to a table;
  the bounded history (newest 50) is a rank limit on read.
* Corpus text, content ids (md5) and metadata are column expressions;
  the dedupe is a global ``dropDuplicates`` on the id (hash shuffle).
* Nearest-k search: parts of the corpus meet blocks of the queries; a task
  returns only the k best of each query, ranked once more at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookout.config import CORPUS_BLANKS, CORPUS_PRIORITY_FIELDS, HISTORY_KEEP
from lookout.functions.text import strip

# superset alarm schema: older sessions carry a ``feature`` field
ALARM = ("struct<timestamp:string,type:string,feature:string,valeur:double,seuil:double,ip:string,"
         "message:string,severite:string>")
DONNEES = (f"struct<ips_suspectes:array<string>,nb_anomalies:bigint,nb_alarmes:bigint,alarmes:array<{ALARM}>,"
           "resultat_agents:string>")
SESSION_ROW_DDL = f"date string, donnees {DONNEES}"
SESSION_DOC_DDL = (f"sessions array<struct<date:string,donnees:{DONNEES}>>, anomalies_vues array<string>, "
                   "ips_suspectes array<string>")


# ------------------------------------------------------------------ M1, S7, M2

def session_record(df: DataFrame, date_col: str, ips: Column, nb_anomalies: Column,
                   nb_alarmes: Column, result: Column | None = None) -> DataFrame:
    """M1: one nested session record per row (date + payload)."""
    return df.select(F.struct(
        F.col(date_col).cast("string").alias("date"),
        F.struct(ips.alias("ips_suspectes"), nb_anomalies.cast("bigint").alias("nb_anomalies"),
                 nb_alarmes.cast("bigint").alias("nb_alarmes"),
                 F.array().cast(f"array<{ALARM}>").alias("alarmes"),
                 (result if result is not None else F.lit("")).cast("string").alias("resultat_agents"))
        .alias("donnees")).alias("s"))


def append_sessions(records: DataFrame, path: str) -> None:
    """M1 sink: append session records (one JSON object per line)."""
    records.select("s.*").write.mode("append").json(path)


def read_sessions(spark, path: str, nested_file: bool = False) -> DataFrame:
    """Session history. ``nested_file`` reads the whole-document form
    ({"sessions": [...], ...}, multi-line) and explodes it."""
    if nested_file:
        doc = spark.read.option("multiLine", True).schema(SESSION_DOC_DDL).json(path)
        return doc.select(F.explode("sessions").alias("s")).select("s.*")
    return spark.read.schema(SESSION_ROW_DDL).json(path)


def bounded_history(sessions: DataFrame, keep: int = HISTORY_KEEP) -> DataFrame:
    """W3 on the session table: newest ``keep`` sessions."""
    return sessions.orderBy(F.desc("date")).limit(keep)


def latest_context(sessions: DataFrame, keep: int = HISTORY_KEEP) -> DataFrame:
    """M2: kept-session count, remembered addresses in first-seen order, last date."""
    ips = sessions.select("date", F.posexplode("donnees.ips_suspectes").alias("pos", "ip"))
    first = ips.groupBy("ip").agg(F.min(F.struct("date", "pos")).alias("k"))
    # the remembered list grows by at most 5 addresses per session
    ordered = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "ip"))),
                                                 lambda x: x["ip"]), ", ").alias("ips")).scalar()
    return sessions.agg(F.least(F.count(F.lit(1)), F.lit(keep)).cast("bigint").alias("n_sessions"),
                        F.coalesce(ordered, F.lit("")).alias("ips_connues"),
                        F.max("date").alias("derniere_analyse"))


# ------------------------------------------------------------------ M3-M6

def _blank(v: Column) -> Column:
    return v.isNull() | strip(v).isin(CORPUS_BLANKS)


def row_text(df: DataFrame, columns: list[str] | None = None,
             priority: list[str] = CORPUS_PRIORITY_FIELDS) -> Column:
    """M3: 'k: v' for priority fields first, then the other columns in order,
    skipping blank / 'nan' / 'None', joined by ' | '."""
    cols = columns or df.columns
    order = [c for c in priority if c in cols] + [c for c in cols if c not in priority]
    parts = []
    for c in order:
        v = F.col(c).cast("string")
        parts.append(F.when(~_blank(v), F.concat(F.lit(f"{c}: "), v)))
    return F.array_join(F.array_compact(F.array(*parts)), " | ")


def content_id(text) -> Column:
    """M4: md5 of the text (hex)."""
    return F.md5(F.col(text) if isinstance(text, str) else text)


def corpus_metadata(df: DataFrame, fields: dict | None = None) -> list[Column]:
    """M5: metadata with the defaults of absent fields; null values print as 'nan'."""
    defaults = fields or {"event_type": "UNKNOWN", "source_ip": "", "log_source": "", "timestamp": "", "status": ""}
    out = []
    for name, default in defaults.items():
        if name in df.columns:
            out.append(F.coalesce(F.col(name).cast("string"), F.lit("nan")).alias(name))
        else:
            out.append(F.lit(default).alias(name))
    return out


def build_corpus(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """M3-M5: (doc_id, text, metadata...) with one row per distinct text."""
    text = row_text(df, columns)
    docs = df.select(text.alias("text"), *corpus_metadata(df)).withColumn("doc_id", content_id("text"))
    return docs.dropDuplicates(["doc_id"])


def write_corpus(corpus: DataFrame, path: str) -> None:
    """M6: rebuild = overwrite the corpus table."""
    corpus.write.mode("overwrite").parquet(path)


# ------------------------------------------------------------------ M7

def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of each query's k least distances, ties by id; ``dist`` is rows by queries."""
    last = min(k, len(dist)) - 1
    near = dist <= np.partition(dist, last, axis=0)[last]
    row, query = np.nonzero(near)
    order = np.lexsort((ids[row], dist[row, query], query))
    row, query = row[order], query[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], row[keep]


def _block_distances(corpus: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of one part of the corpus, for each query of one block."""
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())])
    if not corpus.num_rows or not queries.num_rows:
        return schema.empty_table()
    rows, asks = (np.array(t.column("v").to_pylist(), float) for t in (corpus, queries))
    ids, qids = corpus.column("id").to_numpy(), queries.column("qid").to_numpy()
    found = []
    step = max(1, (1 << 21) // len(asks))
    for at in range(0, len(rows), step):
        part = rows[at:at + step]
        dist = np.zeros((len(part), len(asks)))
        for i in range(rows.shape[1]):  # summed in the vector's order, so that equal distances stay equal
            dist += (part[:, i:i + 1] - asks[None, :, i]) ** 2
        query, row = _best(dist, ids[at:at + step], k)
        found.append((query, ids[at + row], dist[row, query]))
    query, own, dist = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((own, dist, query))
    query, own, dist = query[order], own[order], dist[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return pa.table([qids[query[keep]], own[keep], dist[keep]], schema=schema)


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "vec_id", vec_col: str = "embedding",
            qid_col: str = "qid", part_rows: int = 1 << 15, block_rows: int = 1 << 10) -> DataFrame:
    """M7: the k nearest corpus vectors (squared L2, ties by id) per query.

    The corpus is dealt to parts and the queries to blocks, both of about a
    fixed number of rows; a task computes one part's distances to one block and
    returns k rows a query. So there may be any number of queries, and at most
    queries x parts x k rows are ranked. Rows and queries without a vector have
    no distance and do not appear; ids are whole numbers.
    """
    rows = corpus.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()) \
        .select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asks = queries.where(F.col(qid_col).isNotNull() & F.col(vec_col).isNotNull()) \
        .select(F.col(qid_col).cast("bigint").alias("qid"), F.col(vec_col).cast("array<double>").alias("v"))
    parts, blocks = (F.greatest(F.ceil(t.agg(F.count(F.lit(1)).alias("n")).scalar() / size), F.lit(1))
                     for t, size in ((rows, part_rows), (asks, block_rows)))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    asked = asks.withColumn("block", F.pmod(F.xxhash64("qid"), blocks)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    found = dealt.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(
        lambda c, q: _block_distances(c, q, k), "qid long, id long, dist double")
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select(F.col("qid").alias(qid_col), F.col("id").alias(id_col), "dist", "rank")
