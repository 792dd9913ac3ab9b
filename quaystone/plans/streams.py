"""Queries of the streams, run to the end of what has arrived, and round trips of the sources."""

from __future__ import annotations

import io
import zipfile
from email.message import EmailMessage
from email.policy import default

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.mailids import message_key, message_keys
from quaystone.session import table
from quaystone.sources import containers
from quaystone.streaming import flows


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return flows.run_to_end(flows.tumbling_counts(flows.arrivals(spark, d, "events")), "complete")


def stream_without_copies(spark: SparkSession, d: str) -> DataFrame:
    # the delay spans the table, as the SQL looks at all of it
    return flows.run_to_end(flows.without_copies(flows.arrivals(spark, d, "messages"), late="1000 days"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return flows.run_to_end(flows.sessions(flows.arrivals(spark, d, "events")), "complete")


def stream_user_totals(spark: SparkSession, d: str) -> DataFrame:
    given = flows.run_to_end(flows.user_totals(flows.arrivals(spark, d, "events")), "update")
    return given.groupBy("user_id").agg(F.max("n").alias("n"), F.max("last_micros").alias("last_micros"))


def _mail_bytes(r) -> bytes:
    m = EmailMessage(policy=default)
    if r.key:
        m["Message-ID"] = f"<{r.key}>"
    if r.parent:
        m["In-Reply-To"] = f"<{r.parent}>"
    if len(r.refs):
        m["References"] = " ".join(f"<{x}>" for x in r.refs)
    m["Subject"] = " ".join((r.subject or "").split())
    if r.email:
        m["From"] = r.email
    for head, people in (("To", r.to), ("Cc", r.cc)):
        if people is not None and len(people):
            m[head] = ", ".join(people)
    m["Date"] = r.date
    m.set_content(r.body or "", cte="base64")
    return m.as_bytes()


def _emails(column: str) -> Column:
    return F.filter(F.transform(F.coalesce(F.col(column), F.array().cast("array<struct<display_name:string,email:string>>")), lambda a: a["email"]), lambda e: e.isNotNull() & e.rlike(r"^[\w.+-]+@[\w.-]+$"))


def mail_files(messages: DataFrame) -> DataFrame:
    """(source_path, content): the table's rows as mail files, to be read back."""

    @F.pandas_udf("binary")
    def build(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([_mail_bytes(r) for r in frame.itertuples()])

    fields = F.struct(
        message_key(F.col("message_id")).alias("key"), message_key(F.col("in_reply_to")).alias("parent"), message_keys(F.col("ref_ids")).alias("refs"), "subject",
        F.col("sender.email").alias("email"), _emails("to_addrs").alias("to"), _emails("cc_addrs").alias("cc"), F.date_format("received_at", "EEE, dd MMM yyyy HH:mm:ss +0000").alias("date"), F.col("body_text").alias("body"),
    )
    return messages.select("source_path", build(fields).alias("content"))


def source_mail_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = containers.parse_messages(mail_files(table(spark, d, "messages")))
    return m.select("source_path", "message_id", "in_reply_to", F.size("ref_ids").cast("long").alias("n_refs"), F.lower("sender.email").alias("email"), F.size("to_addrs").cast("long").alias("n_to"), F.array_join(F.array_sort(F.transform("cc_addrs", lambda a: F.lower(a["email"]))), ",").alias("cc"), F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at"), F.length(F.regexp_replace("body_text", r"\s+", "")).cast("long").alias("n_marks"), "error")


def _nested(chain: list[str], content: bytes) -> bytes:
    """A mail that holds the last of a chain within the containers before it."""
    data, name = content, chain[-1]
    for box in reversed(chain[1:-1]):
        if box.lower().endswith(".eml"):
            inner = EmailMessage(policy=default)
            inner["Subject"] = "inner"
            inner.set_content("")
            inner.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
            data = inner.as_bytes()
        else:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr(name, data)
            data = held.getvalue()
        name = box
    outer = EmailMessage(policy=default)
    outer["Subject"] = "outer"
    outer.set_content("")
    outer.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return outer.as_bytes()


def source_containers_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence packed into mails and archives as its chain says, and found again by the expansion."""

    @F.pandas_udf("binary")
    def pack(chain: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([_nested(["root", *c], x.encode()) for c, x in zip(chain, content)])

    o = table(spark, d, "occurrences")
    # a mail takes milliseconds to build and to walk, so even a small file is spread over all cores
    packed = o.select("occ_id", "container_chain", "doc_id").repartition(F.col("occ_id")).select(F.col("occ_id").cast("string").alias("source_path"), pack("container_chain", "doc_id").alias("content"))
    found = containers.expand(packed).where("sniffed_type not in ('archive', 'email')")
    chain = F.slice("container_chain", F.lit(2), F.size("container_chain"))
    return found.select(F.col("message_source").cast("long").alias("occ_id"), F.array_join(chain, " > ").alias("chain"), F.col("doc_id").alias("hash"), F.col("is_top_level_attachment").alias("top"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_without_copies, stream_sessions, stream_user_totals, source_mail_round_trip, source_containers_expanded)}

_KEY = r"""regexp_replace({0}, '^[\s\x{{A0}}<]+|[\s\x{{A0}}>]+$', '', 'g')"""
_FOLD = "CASE WHEN {0} = '' THEN NULL WHEN contains({0}, '@') THEN regexp_extract({0}, '^(.*@)([^@]*)$', 1) || lower(regexp_extract({0}, '^(.*@)([^@]*)$', 2)) ELSE {0} END"
SQL = {
    "stream_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_without_copies": "SELECT DISTINCT sha256(coalesce(body_text, '')) AS content_key FROM messages",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_user_totals": "SELECT user_id, count(*) AS n, epoch_us(max(ts)) AS last_micros FROM events GROUP BY user_id",
    "source_mail_round_trip": rf"""
WITH m AS (SELECT *, {_KEY.format("message_id")} AS a, {_KEY.format("in_reply_to")} AS b, len(list_filter(list_transform(flatten(list_transform(coalesce(ref_ids, []), lambda x: regexp_split_to_array(coalesce(x, ''), '[\s,;]+'))), lambda y: {_KEY.format("y")}), lambda z: z <> '')) AS n_refs FROM messages)
SELECT source_path, {_FOLD.format("a")} AS message_id, {_FOLD.format("b")} AS in_reply_to, n_refs, lower(sender.email) AS email, coalesce(len(list_filter(list_transform(to_addrs, lambda who: who.email), lambda mail: coalesce(regexp_full_match(mail, '[\w.+-]+@[\w.-]+'), false))), 0) AS n_to, coalesce(array_to_string(list_sort(list_transform(list_filter(list_transform(cc_addrs, lambda who: who.email), lambda mail: coalesce(regexp_full_match(mail, '[\w.+-]+@[\w.-]+'), false)), lambda mail: lower(mail))), ','), '') AS cc, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS sent_at, length(regexp_replace(coalesce(body_text, ''), '\s+', '', 'g')) AS n_marks, NULL::VARCHAR AS error FROM m""",
    "source_containers_expanded": "SELECT occ_id, array_to_string(container_chain, ' > ') AS chain, sha256(doc_id) AS hash, len(container_chain) = 1 AS top FROM occurrences",
}
