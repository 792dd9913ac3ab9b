"""Streams over arriving files: windowed counts, copies dropped as they arrive, state for each user."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quaystone.session import shared_dir


def arrivals(spark: SparkSession, sf_dir: str, name: str, files_at_once: int = 1) -> DataFrame:
    """A table's files as a stream, so many in each batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream yields over what has arrived: in append and update mode all that it gave out, in complete mode its last state.

    Files and checkpoint lie in the shared folder.
    """
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{where}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{where}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    try:
        done = spark.read.parquet(f"{where}/out")
    except AnalysisException:  # no batch came
        return spark.createDataFrame([], stream.schema)
    if mode == "update":
        return done.drop("batch")
    last = done.agg(F.max("batch")).first()[0]
    return done.where(F.col("batch") == last).drop("batch")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events of each window and type. With a delay, what arrives later than it after its window is dropped and windows can be appended."""
    if late:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, n) of each run of a user's events with less than the gap between neighbours."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def without_copies(messages: DataFrame, late: str = "30 days") -> DataFrame:
    """Each content once, as it first arrives; a copy that comes later than the delay is let through again, so that the state stays bounded."""
    keyed = messages.withColumn("content_key", F.sha2(F.coalesce("body_text", F.lit("")), 256)).withWatermark("received_at", late)
    return keyed.dropDuplicatesWithinWatermark(["content_key"]).select("content_key")


def user_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, last_ts) kept as state for each user and given out whenever it changes."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        for p in parts:
            n += len(p)
            last = max(last, int(p["micros"].max()))
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_micros": [last]})

    slim = events.select(F.col("user_id").cast("long").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return slim.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, last_micros bigint", "n bigint, last bigint", "update", GroupStateTimeout.NoTimeout)
