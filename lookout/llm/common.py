"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookout.session import ensure_checkpoint_dir

#: white space of every operator here: space and U+0009 to U+000D
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, BLANK_RUN))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def scratch_path(df: DataFrame, name: str) -> str:
    """A new folder for one run, under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/lookout/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts the lineage as ``checkpoint()`` does (lost executors only repeat reads
    of shared files), but stays columnar, so later scans prune columns, and its
    file sizes let the planner broadcast it only when it is measured small.
    """
    path = scratch_path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
