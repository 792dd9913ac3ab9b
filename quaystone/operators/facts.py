"""Facts in texts: dates, amounts, standards, signatures, entities, references; all but positions as expressions of the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.operators.ranking import spread_row_number

# The forms of dates, amounts, standards, signatures, drafts, putting off and open matters that count as facts.
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
ISO_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
LONG_DATE = rf"(?i)\b((?:{MONTH})\.?\s+\d{{1,2}},?\s+\d{{4}})\b"
US_DATE = r"\b(\d{1,2}/\d{1,2}/\d{4})\b"
MONEY = r"\$\s?(-?[\d,]+(?:\.\d{2})?)"
STANDARD = r"(?i)\bASC\s?(606|842|8\d\d|\d{3})\b"
SIGNED = r"(?i)(/s/|signed\s*:|signature\s*:|\bby\s*:\s*[A-Z][a-z]+|sincerely,|authorized\s+signature|\bexecuted\s+by\b)"
DRAFT = r"(?i)\bDRAFT\b|\bnot\s+for\s+(?:execution|signature)\b|\bto\s+be\s+signed\b|\bto\s+be\s+finalized\b|\[\s*signature\s*\]|\bunsigned\b"
REQUEST = r"(?i)pbc[-\s]?(\d{1,2})"
RESCHEDULED = r"(?i)(expect|by|instead of).{0,40}?(pbc[-\s]?\d+)?.{0,40}?(next\s+\w+|\b\w+day\b|\d{4}-\d{2}-\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2})"
DAY_PHRASE = rf"(?i)(\d{{4}}-\d{{2}}-\d{{2}}|(?:{MONTH})\s+\d{{1,2}})"
OPEN_PHRASES = (
    "still outstanding", "remains outstanding", "under investigation", "still investigating", "still pending", "not counter-signed", "to be signed",
    "awaiting", "yet to be", "resolution when done", "still chas", "not yet been received", "not yet provided", "still need",
)
RESOLVED_PHRASES = ("immaterial", "fully explained", "explained by", "resolved", "no exception")
LEGAL_END = r"(?i),?\s+(?:inc|llc|l\.l\.c|corp|co)\.?$"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def dates(text: Column) -> Column:
    """array<struct<pat_no, ord, value>>: ISO, then month names, then month/day/year; impossible ones left out."""
    iso = F.transform(_all(text, ISO_DATE), lambda x, i: F.struct(F.lit(1).alias("pat_no"), i.alias("ord"), F.try_to_date(x, "yyyy-MM-dd").alias("value")))
    long = F.transform(_all(text, LONG_DATE), lambda x, i: F.struct(F.lit(2).alias("pat_no"), i.alias("ord"), F.try_to_date(F.initcap(F.regexp_replace(F.regexp_replace(x, r"[.,]", " "), r"\s+", " ")), "MMMM d yyyy").alias("value")))
    us = F.transform(_all(text, US_DATE), lambda x, i: F.struct(F.lit(3).alias("pat_no"), i.alias("ord"), F.try_to_date(x, "M/d/yyyy").alias("value")))
    return F.filter(F.concat(iso, long, us), lambda s: s["value"].isNotNull())


def amounts(text: Column) -> Column:
    """array<double> of amounts in dollars, as written in order."""
    return F.filter(F.transform(_all(text, MONEY), lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda v: v.isNotNull())


def standards(text: Column) -> Column:
    return F.transform(_all(text, STANDARD), lambda x: F.concat(F.lit("ASC "), x))


def is_draft(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(DRAFT)


def signatures(text: Column) -> Column:
    """array<struct<signed, draft>>: one for each signature mark, void if the text anywhere reads as a draft; one of a draft without marks."""
    draft = is_draft(text)
    marks = F.transform(_all(text, SIGNED), lambda _: F.struct((~draft).alias("signed"), draft.alias("draft")))
    return F.when((F.size(marks) == 0) & draft, F.array(F.struct(F.lit(False).alias("signed"), F.lit(True).alias("draft")))).otherwise(marks)


def aliases(name: Column) -> Column:
    """Lower-case forms by which an entity goes: its name, and that without its legal form."""
    full = F.lower(F.trim(name))
    return F.array_distinct(F.filter(F.array(full, F.trim(F.regexp_replace(full, LEGAL_END, ""))), lambda a: F.length(a) > 0))


#: Entities of one scope that are held against a text at once.
BLOCK = 256


def entity_mentions(texts: DataFrame, entities: DataFrame, scope: str, key: str, text: str) -> DataFrame:
    """(key, entity_id, alias) of the entities of a text's own scope that it names, with the longest of the names it uses.

    Entities are gathered by scope in blocks of BLOCK, so a text is looked at once for each block of its scope and no scope is
    ever gathered whole. Null scopes, texts and names meet nothing.
    """
    named = spread_row_number(entities.where(F.col("entity_name").isNotNull() & F.col(scope).isNotNull()).select(scope, "entity_id", aliases(F.col("entity_name")).alias("names")), [scope], [F.col("entity_id")], "_n")
    held = named.groupBy(scope, F.floor((F.col("_n") - 1) / BLOCK).alias("_block")).agg(F.collect_list(F.struct("entity_id", F.array_sort("names", lambda a, b: F.length(b) - F.length(a)).alias("names"))).alias("es")).drop("_block")
    low = F.lower(F.col(text))
    hits = F.filter(F.transform("es", lambda e: F.struct(e["entity_id"].alias("entity_id"), F.get(F.filter(e["names"], lambda n: F.contains(F.col("_low"), n)), 0).alias("alias"))), lambda x: x["alias"].isNotNull())
    met = texts.where(F.col(text).isNotNull()).select(scope, key, low.alias("_low")).join(held, scope)
    return met.select(key, F.explode(hits).alias("e")).select(key, "e.entity_id", "e.alias")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n"), lambda s: F.length(F.trim(s)) > 0)


def request_refs(text: Column) -> Column:
    return F.transform(_all(text, REQUEST), lambda n: F.concat(F.lit("PBC-"), F.lpad(n.cast("int").cast("string"), 2, "0")))


def filename_years(name: Column) -> Column:
    """Years that a file name states, as 20xx or after FY, sorted."""
    low = F.lower(name)
    plain = F.transform(_all(low, r"\b(20\d\d)\b"), lambda y: y.cast("int"))
    fiscal = F.transform(_all(low, r"fy\s?(\d{2,4})"), lambda y: F.when(F.length(y) == 2, y.cast("int") + 2000).otherwise(y.cast("int")))
    return F.array_sort(F.array_union(plain, fiscal))


def claimed_count(text: Column, noun: Column | str) -> Column:
    """Largest number that a text claims of a noun or of a sample."""
    noun = F.lit(noun) if isinstance(noun, str) else noun
    of_noun = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.concat(F.lit(r"(\d+)\s+"), noun, F.lit(r"s?\b")), F.lit(1))
    return F.array_max(F.transform(F.concat(of_noun, _all(F.lower(text), r"(?:sample of|top)\s+(\d+)")), lambda n: n.try_cast("long")))


def loose_date(text: Column, year: Column) -> Column:
    """The day that a phrase names: ISO anywhere in it, else a month with a day, of the given year; null if it is impossible."""
    iso = F.regexp_extract(text, ISO_DATE.replace(r"\b", ""), 1)
    month = F.regexp_extract(text, rf"(?i)({MONTH})\s+(\d{{1,2}})", 1)
    day = F.regexp_extract(text, rf"(?i)({MONTH})\s+(\d{{1,2}})", 2)
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).when(month != "", F.try_to_date(F.concat_ws(" ", F.initcap(month), day, year.cast("string")), "MMMM d yyyy"))


def reschedules(texts: DataFrame, key: str, text: str, year: str) -> DataFrame:
    """(key, request, expected_by) of texts that put off a request to a named day; year: the column whose year a day without one means."""
    cell = F.coalesce(F.col(text), F.lit(""))
    told = texts.where(cell.rlike(RESCHEDULED) & cell.rlike(REQUEST) & cell.rlike(DAY_PHRASE))
    request = F.concat(F.lit("PBC-"), F.lpad(F.regexp_extract(cell, REQUEST, 1).cast("int").cast("string"), 2, "0"))
    return told.select(key, request.alias("request"), loose_date(F.regexp_extract(cell, DAY_PHRASE, 1), F.col(year)).alias("expected_by"))


def caveats(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, request, sentence) of sentences that call something open and nothing resolved, with the request they name or null."""
    s = texts.select(key, F.posexplode(sentences(F.col(text))).alias("ord", "sentence"))
    low = F.lower("sentence")
    said = lambda phrases: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))
    number = F.regexp_extract("sentence", REQUEST, 1)
    return s.where(said(OPEN_PHRASES) & ~said(RESOLVED_PHRASES)).select(key, F.col("ord").cast("long").alias("ord"), F.when(number != "", F.concat(F.lit("PBC-"), F.lpad(number.cast("int").cast("string"), 2, "0"))).alias("request"), F.trim("sentence").alias("sentence"))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether all words of more than two letters of a phrase are in a text."""
    low = F.lower(text)
    return F.forall(F.filter(F.split(F.lower(phrase), r"\s+"), lambda w: F.length(w) > 2), lambda w: F.contains(low, w))


_PLACED = [("date", ISO_DATE), ("date", LONG_DATE), ("date", US_DATE), ("money", MONEY), ("standard", STANDARD), ("signature", SIGNED)]
_COMPILED = [(k, re.compile(p)) for k, p in _PLACED]


def placed_facts(texts: DataFrame, key: str, text: str, around: int = 24) -> DataFrame:
    """(key, kind, ord, start_pos, raw, snippet) of each date, amount, standard and signature mark with the text around it, white space closed up.

    Only texts that have one, as the JVM tells, are read in Python for the positions.
    """
    some = F.lit(False)
    for pattern in dict.fromkeys(p for _, p in _PLACED):
        some = some | F.col(text).rlike(pattern)

    @F.pandas_udf("array<struct<kind:string,ord:int,start_pos:int,raw:string,snippet:string>>")
    def find(values: pd.Series) -> pd.Series:
        out = []
        for t in values:
            rows = []
            for kind, pattern in _COMPILED:
                for m in pattern.finditer(t or ""):
                    rows.append({"kind": kind, "ord": len(rows), "start_pos": m.start(), "raw": m[0], "snippet": " ".join(t[max(0, m.start() - around) : m.end() + around].split())})
            out.append(rows)
        return pd.Series(out)

    return texts.where(some).select(key, F.explode(find(text)).alias("f")).select(key, "f.*")
