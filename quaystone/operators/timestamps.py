"""Written times to UTC instants: parse, then an as-of join to the offset intervals of each zone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions.instants import read_many, segments_by_year

#: Years whose changes of offset are tabled; before and after them the offset at the edge holds.
FIRST_YEAR, LAST_YEAR = 1900, 2100
_PARSED = T.StructType([T.StructField("local", T.LongType()), T.StructField("offset", T.IntegerType()), T.StructField("zone", T.StringType())])


@F.pandas_udf(_PARSED)
def _whole(texts: pd.Series) -> pd.DataFrame:
    return read_many(texts, True)


@F.pandas_udf(_PARSED)
def _within(texts: pd.Series) -> pd.DataFrame:
    return read_many(texts, False)


def known_zones(zones: DataFrame) -> list[str]:
    """The zones of the tz database among the rows of a one-column frame; at most as many as it has (about 600)."""

    def valid(parts):
        from zoneinfo import available_timezones

        names = available_timezones()
        for part in parts:
            x = part.iloc[:, 0]
            yield pd.DataFrame({"zone": x[x.isin(names)].unique()})

    return sorted(r.zone for r in zones.distinct().mapInPandas(valid, "zone string").distinct().collect())


def to_utc(df: DataFrame, text: str, zone: str, whole: bool, out: str = "utc_micros") -> DataFrame:
    """df with the UTC microseconds of the time written in a column, null if there is none; a column of that name is replaced.

    A stated offset or zone wins; else the time is local to the zone column, and has no instant
    where that is null, blank or unknown. Of a repeated local time the first is meant, a
    skipped one is read with the offset before the change. Parsing is map-side; the
    intervals are broadcast, whose number the tz database bounds: zones in use times years.
    """
    spark = df.sparkSession
    # zones that texts name, in brackets or as Area/City, count besides those of the records
    bracketed = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?<=\[)[A-Za-z0-9_+/-]+(?=\])|[A-Z][A-Za-z]+/[A-Za-z0-9_+/-]+"), 0)).alias("zone"))
    zones = known_zones(df.select(F.col(zone).alias("zone")).unionByName(bracketed))
    segments = segments_by_year(sorted({"UTC", *zones}), FIRST_YEAR, LAST_YEAR)
    table = spark.createDataFrame(segments, "_zone string, _year int, _lo bigint, _hi bigint, _matches int, _shift int")
    cell: Column = F.col(text)
    cell_zone = F.col(zone)
    maybe = cell if whole else F.when(cell.rlike(r"(?i)\d[:T]\d\d|\d\s?(?:h|[ap]\.?m)\b|\dh\d\d|\dT?\s?h\s?\d\d|\d\s?Uhr"), cell)
    read = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != out]).alias("_own"), cell_zone.alias("_record_zone"), (_whole if whole else _within)(maybe).alias("_p"))
    year = F.year(F.timestamp_micros(F.col("_p.local")))
    read = read.select("_own", F.col("_p.offset").alias("_offset"), F.col("_p.local").alias("_local"), F.when(F.col("_p.offset").isNull(), F.coalesce(F.col("_p.zone"), F.col("_record_zone"))).alias("_at_zone"), F.least(F.greatest(year, F.lit(FIRST_YEAR)), F.lit(LAST_YEAR)).alias("_at_year"))
    near = (F.col("_at_zone") == F.col("_zone")) & (F.col("_at_year") == F.col("_year")) & (F.col("_local") >= F.col("_lo")) & (F.col("_local") < F.col("_hi"))
    found = read.join(F.broadcast(table), near, "left")
    shift = F.coalesce(F.col("_offset"), F.col("_shift"))
    return found.select("_own.*", (F.col("_local") - shift.cast("long") * 1_000_000).alias(out))


def instants(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """(src_table, row_id, utc_micros) of each readable time of the two tables."""
    m = to_utc(messages.select("delivery_id", "date_raw", "mailbox_tz"), "date_raw", "mailbox_tz", True)
    s = to_utc(spans.select("span_id", "snippet", "doc_tz"), "snippet", "doc_tz", False)
    pick = lambda df, name, key: df.where("utc_micros is not null").select(F.lit(name).alias("src_table"), F.col(key).cast("long").alias("row_id"), "utc_micros")
    return pick(m, "messages", "delivery_id").unionByName(pick(s, "spans", "span_id"))
