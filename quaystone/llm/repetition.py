"""Repetition inside a single document (problem 9): rolling hashes of several n-gram lengths, one batch at a time in numpy."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Lengths in words whose coverage is measured; TESTDATA's share is that of RUN.
LENGTHS = (2, 3, 4, 8, 16)
RUN = 8


def repeated_windows(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Whether each word lies in a run of n words that began earlier in its document as well.

    ids: number of each word; doc: number of its document, ascending. The rolling hash
    of a run comes from prefix sums; runs of equal hash are compared word by word, so a
    collision can't count.
    """
    size = len(ids)
    hit = np.zeros(size, bool)
    if size < n:
        return hit
    starts = np.flatnonzero(doc[: size - n + 1] == doc[n - 1 :])
    if not len(starts):
        return hit
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        h = np.zeros(size - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + mixed[k : size - n + 1 + k]
        h = h[starts] ^ ((doc[starts].astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    later, earlier = starts[order[1:][same]], starts[order[:-1][same]]
    true = np.ones(len(later), bool)
    for k in range(n):
        true &= ids[later + k] == ids[earlier + k]
    true &= doc[later] == doc[earlier]
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, later[true], 1)
    np.add.at(edge, later[true] + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: pd.Series, lengths: tuple[int, ...] = LENGTHS) -> pd.DataFrame:
    """Words, repeated words for each length, and the characters in lines that came before."""
    n_docs = len(texts)
    words, doc, line_share = [], [], np.zeros(n_docs)
    for i, t in enumerate(texts):
        t = (t or "").lower()
        found = _WORD.findall(t)
        words += found
        doc.append(len(found))
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        if len(set(lines)) < len(lines):
            seen: set[str] = set()
            again = 0
            for x in lines:
                again += len(x) if x in seen else 0
                seen.add(x)
            line_share[i] = again / sum(map(len, lines))
    counts = np.array(doc, np.int64)
    of = np.repeat(np.arange(n_docs), counts)
    ids = pd.factorize(pd.Series(words, dtype=object))[0].astype(np.int64) if words else np.zeros(0, np.int64)
    out = {"n_words": counts, "line_share": line_share}
    for n in lengths:
        out[f"repeated_{n}"] = np.bincount(of, weights=repeated_windows(ids, of, n), minlength=n_docs).astype(np.int64) if len(ids) else np.zeros(n_docs, np.int64)
    return pd.DataFrame(out)


def repetition(documents: DataFrame, lengths: tuple[int, ...] = LENGTHS, keep: list[str] | None = None) -> DataFrame:
    """The key columns with n_words, line_share and repeated_n for each length.

    A null or blank text has no words and shares of 0. Map-side only: each document is
    read where it lies, whole.
    """
    schema = "n_words bigint, line_share double, " + ", ".join(f"repeated_{n} bigint" for n in lengths)

    @F.pandas_udf(schema)
    def udf(texts: pd.Series) -> pd.DataFrame:
        return measure(texts, lengths)

    keys = keep or ["doc_id"]
    return documents.select(*keys, udf("text").alias("_m")).select(*keys, "_m.*")


def repetitive(documents: DataFrame, least: float = 0.30) -> DataFrame:
    """doc_id of the documents of whose words at least the given share repeats."""
    return repetition(documents, (RUN,)).where((F.col("n_words") > 0) & (F.col(f"repeated_{RUN}") / F.col("n_words") >= least)).select("doc_id")
