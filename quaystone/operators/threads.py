"""Mail threads: what shares an id or a subject belongs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions.mailids import message_key, message_keys
from quaystone.operators.graph import components
from quaystone.operators.ranking import spread_row_number


def plain_subject(subject: Column) -> Column:
    """Subject in lower case without reply and forward marks, however many."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^(\s*(re|fw|fwd)\s*:\s*)+", "")))


def threads(messages: DataFrame) -> DataFrame:
    """(delivery_id, thread_key): rows of one mailbox tied by ids, references or an equal, non-empty subject.

    Ids that no message bears tie those that name them. thread_key is the smallest
    delivery_id of the thread. A null engagement_id is a mailbox of its own.
    """
    keys = F.array_union(F.array_compact(F.array(message_key(F.col("message_id")), message_key(F.col("in_reply_to")))), message_keys(F.col("ref_ids")))
    subject = plain_subject(F.col("subject"))
    tied = F.concat(F.transform(keys, lambda k: F.concat(F.lit("i:"), k)), F.when(subject != "", F.array(F.concat(F.lit("s:"), subject))).otherwise(F.array().cast("array<string>")))
    rows = messages.select(F.col("delivery_id").cast("long").alias("id"), F.coalesce("engagement_id", F.lit("")).alias("box"), tied.alias("keys"))
    hubs = rows.select("id", F.explode("keys").alias("k"), "box").select(F.col("id").alias("x"), F.concat_ws("|", "box", "k").alias("k"))
    # a key is stood for by the smallest row that has it, so hubs need no nodes of their own
    first = hubs.groupBy("k").agg(F.min("x").alias("y"))
    links = hubs.join(first, "k").where("x <> y").select("x", "y").distinct()
    return components(rows.select(F.col("id").alias("node")), links).select(F.col("node").alias("delivery_id"), F.col("label").alias("thread_key"))


def thread_order(messages: DataFrame, thread: DataFrame, at: str) -> DataFrame:
    """Rows of messages with thread_key and their place in it: by time, nulls last, then by delivery_id."""
    joined = messages.join(thread, "delivery_id")
    return spread_row_number(joined, ["thread_key"], [F.col(at).asc_nulls_last(), F.col("delivery_id")], "place")


def thread_ids(messages: DataFrame, thread: DataFrame) -> DataFrame:
    """(thread_key, thread_id): the one `threadN` that the paths of a thread's mails name, else thread and its number by thread_key.

    A thread whose paths name none or several takes its number, with two digits at least, which may be that of a hint.
    """
    hint = F.lower(F.regexp_extract(F.coalesce("source_path", F.lit("")), r"(?i)(thread\d+)", 1))
    told = thread.join(messages.select("delivery_id", F.when(hint != "", hint).alias("hint")), "delivery_id").groupBy("thread_key").agg(F.min("hint").alias("lo"), F.max("hint").alias("hi"))
    numbered = spread_row_number(told.withColumn("_all", F.lit(0)), ["_all"], [F.col("thread_key")], "n")
    number = F.col("n").cast("string")
    return numbered.select("thread_key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.concat(F.lit("thread"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))).alias("thread_id"))
