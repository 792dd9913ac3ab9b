"""Parts of a document with the place that facts and findings cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.operators.ranking import spread_row_number

_PART = "array<struct<locator:string,text:string>>"


def _sheets() -> Column:
    return F.transform("sheets", lambda s: F.struct(F.concat(F.lit("sheet '"), s["name"], F.lit("'")).alias("locator"), s["text"].alias("text")))


def _pages() -> Column:
    return F.transform("pages", lambda p, i: F.struct(F.concat(F.lit("page "), (i + 1).cast("string")).alias("locator"), p.alias("text")))


def _whole(name: Column | str) -> Column:
    return F.array(F.struct((F.lit(name) if isinstance(name, str) else name).alias("locator"), F.col("text").alias("text")))


def segments(documents: DataFrame, any_pages: bool = False) -> DataFrame:
    """(doc_id, seg_no, locator, text) of (doc_id, sniffed_type, text, pages, sheets): sheets, else pages of a PDF, else the whole.

    seg_no counts from 0. With any_pages, pages count for any type, as the scan for personal numbers wants. Of an image the
    place is `photo`, of anything else without parts `body`. Null lists are empty.
    """
    paged = F.size(F.coalesce("pages", F.array().cast("array<string>"))) > 0
    if not any_pages:
        paged = paged & (F.col("sniffed_type") == "pdf")
    parts = F.when(F.coalesce(F.size("sheets"), F.lit(0)) > 0, _sheets()).when(paged, _pages()).otherwise(_whole(F.when(F.col("sniffed_type") == "image", "photo").otherwise("body")))
    return documents.select("doc_id", F.posexplode(parts.cast(_PART)).alias("seg_no", "s")).select("doc_id", F.col("seg_no").cast("long").alias("seg_no"), "s.*")


def sheet_segments(sheets: DataFrame) -> DataFrame:
    """The same of a table with one row for each sheet: (doc_id, seg_no, locator, text, sheet_id), sheets in order of sheet_id."""
    numbered = spread_row_number(sheets.select("doc_id", "sheet_id", "sheet_name", "text"), ["doc_id"], [F.col("sheet_id")], "n")
    return numbered.select("doc_id", (F.col("n") - 1).cast("long").alias("seg_no"), F.concat(F.lit("sheet '"), F.coalesce("sheet_name", F.lit("")), F.lit("'")).alias("locator"), "text", "sheet_id")
