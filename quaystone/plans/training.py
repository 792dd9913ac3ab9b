"""Queries of the training-data problems tagged general."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaystone.operators import deliveries, timestamps
from quaystone.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.surplus_rows(table(spark, d, "messages"), table(spark, d, "occurrences"))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.kept_messages(table(spark, d, "messages"), ["delivery_id", "batch_id", "engagement_id", "source_path", "subject", "body_text"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.instants(table(spark, d, "messages"), table(spark, d, "spans"))


QUERIES = {f.__name__: f for f in (p3_found, p3_kept, p4_found)}

_KEY = r"""regexp_replace(message_id, '^[\s\x{A0}<]+|[\s\x{A0}>]+$', '', 'g')"""
_LOST = rf"""
WITH k AS (SELECT *, {_KEY} AS bare FROM messages),
f AS (SELECT *, CASE WHEN bare = '' THEN NULL WHEN contains(bare, '@') THEN regexp_extract(bare, '^(.*@)([^@]*)$', 1) || lower(regexp_extract(bare, '^(.*@)([^@]*)$', 2)) ELSE bare END AS mkey FROM k),
r AS (SELECT *, mkey IS NOT NULL AND row_number() OVER (PARTITION BY mkey ORDER BY received_at NULLS LAST, delivery_id) > 1 AS lost FROM f)
"""
_PATH = r"""regexp_replace(regexp_replace(regexp_replace(replace(trim({}), '\', '/'), '/{{2,}}', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '')"""
SQL = {
    "p3_found": _LOST
    + f"""
SELECT 'messages' AS src_table, delivery_id AS row_id FROM r WHERE lost
UNION
SELECT 'occurrences', occ_id FROM occurrences WHERE {_PATH.format("message_source")} IN (SELECT {_PATH.format("source_path")} FROM r WHERE lost AND source_path IS NOT NULL)
""",
    "p3_kept": _LOST + "SELECT delivery_id, batch_id, engagement_id, source_path, subject, body_text FROM r WHERE NOT lost",
}
