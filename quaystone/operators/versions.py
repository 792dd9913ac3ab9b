"""Versions of a deliverable, told by its file name, and names that its content belies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.operators.ranking import spread_row_number

# Words that mark a version and words that claim a final one.
VERSION_WORDS = r"(?i)\b(v\d+|version\s*\d+|final|real|draft|copy|updated|revised|rev\d*|clean)\b"
FINAL_WORDS = r"(?i)(signed|executed|final|approved)"


def base_key(name: Column) -> Column:
    """What stays of a file name without suffix, version words, punctuation and case; its dates stay."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(stem, r"[_\-]+", " "), VERSION_WORDS, " ")), r"[^a-z0-9]+", "")


def version_rank(name: Column) -> Column:
    """struct that orders versions: final before plain before draft, then the number."""
    low = F.lower(name)
    level = F.when(low.rlike("final|real"), 2).when(low.rlike("draft"), -1).otherwise(0)
    return F.struct(level.alias("level"), F.coalesce(F.regexp_extract(name, r"(?i)v(?:ersion)?\s*(\d+)", 1).try_cast("int"), F.lit(0)).alias("number"))


def version_groups(files: DataFrame) -> DataFrame:
    """(version_key, doc_id, filename, version_no, n_versions, is_latest) of each distinct (doc_id, filename), from oldest to latest.

    The latest is the highest in rank, then in name, then in doc_id; what comes before it is superseded. A name of which no
    letter or digit stays when version words go is a version of nothing else, so such files are not pooled. Groups are numbered in spread
    partitions and never gathered.
    """
    rank = version_rank(F.col("filename"))
    ranked = files.where("filename is not null").select("doc_id", "filename").distinct()
    ranked = ranked.withColumns({"version_key": F.when(base_key(F.col("filename")) != "", base_key(F.col("filename"))).otherwise(F.concat_ws("|", F.lit(""), "filename", "doc_id")), "_level": rank["level"], "_number": rank["number"]})
    numbered = spread_row_number(ranked, ["version_key"], [F.col(c) for c in ("_level", "_number", "filename", "doc_id")], "version_no")
    n = ranked.groupBy("version_key").agg(F.count("*").alias("n_versions"))
    return numbered.join(n, "version_key").select("version_key", "doc_id", "filename", F.col("version_no").cast("long").alias("version_no"), "n_versions", (F.col("version_no") == F.col("n_versions")).alias("is_latest"))


def first_seen(occurrences: DataFrame) -> DataFrame:
    """(doc_id, filename, n_occurrences, n_sources): each document once, named as in its first occurrence.

    A minimum over (occ_id, name) instead of a window, so a document that recurs in a third of all rows is combined before the shuffle.
    """
    return occurrences.groupBy("doc_id").agg(F.min(F.struct("occ_id", "filename")).alias("f"), F.count("*").alias("n_occurrences"), F.count_distinct("message_source").alias("n_sources")).select("doc_id", F.col("f.filename").alias("filename"), "n_occurrences", "n_sources")


def last_per_key(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The value of the last row of each key, in order of the named columns; the upsert in which the last write wins."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def running_below(df: DataFrame, keys: list[str], order: list[str], amount: str, ceiling: float) -> DataFrame:
    """Rows of each key before which the running sum of amount is still below the ceiling."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(amount).over(w), F.lit(0))).where(F.col("_before") < ceiling).drop("_before")
