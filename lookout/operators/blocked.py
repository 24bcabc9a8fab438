"""Blocked addresses of rule groups as a versioned state table.

A state row is one blocked address of one group, with the version that added it
and its place among that version's additions. A change never rewrites rows in
place: it derives the next version from the one before and publishes it under
its own folder. Adding is an anti-join, removing too, a membership question is
a join, and a summary an aggregate, so a group may hold any number of addresses.
The 256-character tag text that a cloud group carries is derived from the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lookout import config as C

STATE_DDL = "grp string, cidr string, version int, place bigint"
KEY = ["grp", "cidr"]
#: a list in JSON form takes at least this many characters an address: quotes, separator and d.d.d.d
LEAST_CHARS = 11


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_DDL)


def add(state: DataFrame, additions: DataFrame, version: int, place: str = "place") -> DataFrame:
    """The next state: all rows of ``state``, then the additions it lacks.

    ``additions`` has ``grp``, ``cidr`` and a place that orders them; an address
    added twice keeps its first place, one that is stored keeps its row. Null or
    blank addresses are not added.
    """
    new = additions.where(F.col("grp").isNotNull() & (F.btrim(F.col("cidr")) != "")) \
        .groupBy("grp", F.btrim(F.col("cidr")).alias("cidr")).agg(F.min(F.col(place).cast("bigint")).alias("place"))
    fresh = new.join(state.select(*KEY), KEY, "left_anti")
    return state.select(*KEY, "version", "place").unionByName(fresh.select(*KEY, F.lit(version).alias("version"), "place"))


def remove(state: DataFrame, requests: DataFrame) -> DataFrame:
    """The next state, without the requested addresses; others keep their rows."""
    return state.join(requests.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, "version", "place")


def removal_status(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request, removed (the address is stored) or not found."""
    held = state.select(*KEY, F.lit(True).alias("_held"))
    return requests.join(held, KEY, "left").withColumn(
        "statut", F.when(F.col("_held"), "DÉBLOQUÉE").otherwise("NON_TROUVÉE")).drop("_held")


def membership(state: DataFrame, questions: DataFrame) -> DataFrame:
    """Per (group, address) asked, whether the address is blocked there and since which version (0: none)."""
    held = state.select(*KEY, F.col("version").alias("_v"))
    return questions.join(held, KEY, "left").withColumns({"since": F.coalesce("_v", F.lit(0)), "bloquee": F.col("_v").isNotNull()}).drop("_v")


def summary(state: DataFrame) -> DataFrame:
    """Blocked addresses of each group; one partial row a group and task, no list."""
    return state.groupBy("grp").agg(F.count(F.lit(1)).cast("bigint").alias("nb_ips_bloquees"),
                                    F.max("version").alias("derniere_version"))


def tag_text(state: DataFrame) -> DataFrame:
    """Per group the tag's JSON text: the whole list if it fits in 256 characters, else its newest ten addresses.

    The length of the whole list is a sum; only the rows that could appear in a
    text reach a list, chosen by a rank limit before the shuffle.
    """
    fits = C.TAG_MAX_CHARS // LEAST_CHARS + 1
    newest = Window.partitionBy("grp").orderBy(F.desc("version"), F.desc("place"), F.desc("cidr"))
    late = state.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= max(fits, C.TAG_KEEP))
    lists = late.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("_k", "cidr")), asc=False).alias("l"))
    # two brackets, two quotes an address, and ", " between two
    sizes = state.groupBy("grp").agg((F.sum(F.length("cidr") + 4)).alias("chars"))
    text = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.concat(F.lit('"'), x["cidr"], F.lit('"'))), ", "), F.lit("]"))
    return lists.join(sizes, "grp").select(
        "grp", text(F.when(F.col("chars") <= C.TAG_MAX_CHARS, F.col("l")).otherwise(F.filter("l", lambda x: x["_k"] <= C.TAG_KEEP))).alias("tag"))


# ------------------------------------------------------------------ stored versions

def publish(state: DataFrame, root: str, version: int) -> None:
    """Write one version whole; a repeated write of a version replaces it, also by nothing."""
    state.write.mode("overwrite").parquet(f"{root}/version={version}")


def load(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(STATE_DDL).parquet(f"{root}/version={version}")
