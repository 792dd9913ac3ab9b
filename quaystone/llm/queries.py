"""Queries and SQL of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaystone.llm import conversations, leaks, names, newtext, packing, pii, repetition
from quaystone.session import table


def _all_mail(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("messages", "sheets", "spans", "addresses")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_items(*_all_mail(spark, d)).select("src_table", "row_id", "pii_kind", "start_pos").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(*_all_mail(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return newtext.new_lines(table(spark, d, "messages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_name_pairs(table(spark, d, "addresses"), table(spark, d, "entities"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.same_name_classes(table(spark, d, "addresses"), table(spark, d, "entities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.sound_conversations(table(spark, d, "messages"), table(spark, d, "engagements"))


def p6_threads(spark: SparkSession, d: str) -> DataFrame:
    return conversations.disentangled(table(spark, d, "messages"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return leaks.covered_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents"))


def p9_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p5_found, p5_classes, p6_found, p6_threads, p7_packed, p8_found, p8_coverage, p9_found, p9_repetition)}
SQL: dict[str, str] = {
    "p9_found": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, len(ws) AS n FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS repeated FROM f, range(0, 8) AS t(o) GROUP BY doc_id)
SELECT doc_id FROM c JOIN n USING (doc_id) WHERE repeated / n >= 0.30
""",
}
