"""The plain gate for personal numbers: five ordered patterns, masked findings, labelled redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of numbers and their patterns, in the order in which they are replaced.
PATTERNS = (
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("DOB", r"(?i)\b(?:DOB|date of birth)\b[:\s]*(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})"),
    ("credit_card", r"\b(?:\d[ -]?){15,16}\b"),
    ("routing", r"(?i)\b(?:routing|aba)\b[^\d]{0,12}(\d{9})\b"),
    ("bank_account", r"(?i)\b(?:account|acct)\b[^\d]{0,14}(\d{6,17})\b"),
)


def mask(value: Column) -> Column:
    return F.concat(F.lit("***"), F.when(F.length(value) > 4, F.right(value, F.lit(4))).otherwise(F.lit("")))


def scan(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pii_type, ord, masked) of each finding of each pattern; findings of different patterns may overlap."""

    def of(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)), lambda x, i: F.struct(F.lit(name).alias("pii_type"), i.alias("ord"), mask(x).alias("masked")))

    found = F.concat(*[of(*p) for p in PATTERNS])
    return texts.select(key, F.explode(found).alias("f")).select(key, "f.*")


def redact(text: Column) -> Column:
    for name, pattern in PATTERNS:
        text = F.regexp_replace(text, pattern, f"[REDACTED-{name}]")
    return text


def summary(findings: DataFrame, key: str) -> DataFrame:
    """(key, summary): kinds with their counts, sorted, as one string."""
    counts = findings.groupBy(key, "pii_type").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("pii_type"), F.lit("×"), F.col("n").cast("string")))), ", ").alias("summary"))
