"""Evaluation passages in training text (problem 8), by greedy string tiling.

The test items are the stated query set: their shared-token seeds are held in every task
and joined with the seeds of each document where it lies, so documents are never shuffled.
Seeds on one diagonal grow into matches by the rolling hash, and the longest that do not
overlap become tiles. covered_items reports the covered share of an item, which also catches reordered
passages. leaked_items asks for more, as the task does: a tile of fifteen words, or an alignment that counts altered,
dropped and added words around one insertion.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a seed, fewer for items so short that edits could break every longer run.
SEED = 5
#: So many consecutive words of an item are a leak by themselves.
RUN = 15
#: One word in so many of an item held in full may differ.
EDIT_EVERY = 8
#: Share of an item that tiles must cover for covered_items.
LEAST_COVER = 0.5
#: Words of test items held by a task at once; a larger set is taken in blocks, each a pass over the documents.
BLOCK_WORDS = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>|<![^<>]*>")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|[nrtbf])")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")


def plain_words(text: str) -> list[str]:
    """The words of a text without case, punctuation, markup, escapes and layout."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    if "-\n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.casefold())


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of each run of n ids."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + x[k : len(ids) - n + 1 + k]
    return h


def tiles(at: np.ndarray, of: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(length, position in the document, in the item) of the longest matches that overlap in neither.

    at, of: positions of matching seeds. Matches are marked from the longest; what a marked
    one leaves of another is kept if it is still as long as a seed.
    """
    diagonal = at - of
    order = np.lexsort((at, diagonal))
    a, d = at[order], diagonal[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)])
    ends = np.r_[new[1:], len(a)]
    import heapq

    heap = [(-(int(e - s) + seed - 1), int(a[s]), int(a[s] - d[s])) for s, e in zip(new, ends)]
    heapq.heapify(heap)
    marked: list[tuple[int, int, int]] = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        free = np.ones(n, bool)
        for m, x, y in marked:
            for lo, hi in ((x - p, x - p + m), (y - q, y - q + m)):
                free[max(lo, 0) : max(min(hi, n), 0)] = False
        if free.all():
            marked.append((n, p, q))
            continue
        edges = np.flatnonzero(np.diff(np.r_[0, free.astype(np.int8), 0]))
        for lo, hi in zip(edges[::2], edges[1::2]):
            if hi - lo >= seed:
                heapq.heappush(heap, (-int(hi - lo), p + int(lo), q + int(lo)))
    return marked


def edits_around_gap(item: np.ndarray, doc: np.ndarray) -> int:
    """Least words altered, dropped or added to find the whole item in doc, where doc may once hold other text in between."""
    n = len(doc)
    steps = np.arange(n + 1)
    one = np.zeros(n + 1, np.int64)
    two = np.full(n + 1, len(item) + 1, np.int64)
    for k, w in enumerate(item):
        miss = (doc != w).astype(np.int64)
        out = []
        for row in (one, two):
            now = row + 1
            now[1:] = np.minimum(now[1:], row[:-1] + miss)
            out.append(np.minimum.accumulate(now - steps) + steps)
        one = out[0]
        two = np.minimum(out[1], np.minimum.accumulate(one))
    return int(min(one.min(), two.min()))


def least_seeds(size: int, seed: int) -> int:
    """Seeds that an item held in full keeps at least: an edit breaks as many as a seed has words, an insertion one fewer."""
    return size - 2 * (seed - 1) - seed * (size // EDIT_EVERY)


def seed_of(size: int) -> int:
    """The longest seed, up to SEED words, of which an item held in full keeps one."""
    return next((n for n in range(SEED, 1, -1) if least_seeds(size, n) > 0), 1)


class _Seeds:
    """The seeds of one length of some items, in order of their hash."""

    def __init__(self, n: int, items: list[int], words: list[np.ndarray]):
        self.n = n
        h = [_hashes(words[k], n) for k in items]
        item = [np.full(len(x), k) for x, k in zip(h, items)]
        flat = np.concatenate(h)
        order = np.argsort(flat, kind="stable")
        self.h, self.item, self.pos = flat[order], np.concatenate(item)[order], np.concatenate([np.arange(len(x)) for x in h])[order]

    def joined(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, place in the item) of every seed that the words share with an item; unknown words are -1."""
        if len(flat) < self.n:
            return (np.zeros(0, np.int64),) * 3
        at = np.flatnonzero(np.convolve(flat >= 0, np.ones(self.n, np.int64), "valid") == self.n)
        h = _hashes(flat, self.n)[at]
        lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        n = hi - lo
        ref = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[ref], self.pos[ref]


class Items:
    """The seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.keys, self.words, self.vocab = [], [], {}
        by_seed: dict[int, list[int]] = {}
        for key, text in items:
            words = plain_words(text or "")
            if words:
                by_seed.setdefault(seed_of(len(words)), []).append(len(self.keys))
                self.keys.append(key)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int64))
        self.seeds = [_Seeds(n, ks, self.words) for n, ks in sorted(by_seed.items())]

    def pairs(self, texts: pd.Series) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, int]]:
        """(text, item, words of the text, places of shared seeds, their places in the item, seed length) of each text and item that share one."""
        get = self.vocab.get
        ids, counts = [], []
        for t in texts:
            mine = [get(w, -1) for w in plain_words(t)] if t else []
            ids += mine
            ids.append(-1)
            counts.append(len(mine) + 1)
        flat = np.array(ids, np.int64)
        start = np.r_[0, np.cumsum(counts)]
        for seeds in self.seeds:
            at, item, pos = seeds.joined(flat)
            doc = np.searchsorted(start, at, "right") - 1
            order = np.lexsort((at, item, doc))
            at, item, pos, doc = at[order], item[order], pos[order], doc[order]
            edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(at) else np.zeros(0, np.int64)
            for s, e in zip(edge, np.r_[edge[1:], len(at)]):
                d = int(doc[s])
                yield d, int(item[s]), flat[start[d] : start[d + 1] - 1], at[s:e] - start[d], pos[s:e], seeds.n

    def leaks(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Positions of texts and the keys of the items that leaked into them."""
        found = sorted((d, self.keys[k]) for d, k, words, at, of, n in self.pairs(texts) if _leaked(words, at, of, self.words[k], n))
        return np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int64)

    def covers(self, texts: pd.Series, least: float) -> list[tuple[int, int, int, int, float]]:
        """(text, item key, tiles, longest tile, covered share) of the pairs whose tiles cover enough of the item."""
        out = []
        for d, k, _, at, of, n in self.pairs(texts):
            size = len(self.words[k])
            if len(np.unique(of)) * n < least * size:  # a seed covers n words at most
                continue
            marked = tiles(at, of, n)
            share = sum(m for m, _, _ in marked) / size
            if share >= least:
                out.append((d, self.keys[k], len(marked), max(m for m, _, _ in marked), round(share, 6)))
        return out


def _leaked(doc: np.ndarray, at: np.ndarray, of: np.ndarray, item: np.ndarray, seed: int) -> bool:
    size = len(item)
    full = len(np.unique(of)) >= least_seeds(size, seed)
    if not full and (size < RUN or len(at) < RUN - seed + 1):
        return False
    if max(n for n, _, _ in tiles(at, of, seed)) >= min(RUN, size):
        return True
    if not full:
        return False
    if (~np.isin(item, doc)).sum() > size // EDIT_EVERY:  # words found nowhere are an edit each
        return False
    return edits_around_gap(item, doc) <= size // EDIT_EVERY  # the whole text, as what stands in between may be long


def _searched(documents: DataFrame, items: DataFrame, block_words: int, search, schema: str) -> DataFrame:
    """What search(Items, frame) yields for every block of items over all documents."""
    spark = documents.sparkSession
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        held = [(r.item_id, r.text) for r in part.select("item_id", "text").where("item_id is not null and text is not null").distinct().collect()]
        sent = spark.sparkContext.broadcast(held)

        def run(parts, sent=sent):
            known = Items(sent.value)
            for p in parts:
                yield search(known, p)

        one = texts.mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def leaked_items(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id) of each document and test item that leaked into it.

    A null or blank text holds nothing, an item without words is in nothing. The items
    go to every task, in blocks of a bounded number of words.
    """

    def search(known: Items, p: pd.DataFrame) -> pd.DataFrame:
        who, what = known.leaks(p["text"])
        return pd.DataFrame({"doc_id": p["doc_id"].to_numpy()[who].astype(np.int64), "item_id": what})

    return _searched(documents, items, block_words, search, "doc_id bigint, item_id bigint").distinct()


def covered_items(documents: DataFrame, items: DataFrame, least: float = LEAST_COVER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_tiles, longest_tile, coverage) of each pair whose tiles cover at least that share of the item, in whatever order."""

    def search(known: Items, p: pd.DataFrame) -> pd.DataFrame:
        rows = pd.DataFrame(known.covers(p["text"], least), columns=["doc_id", "item_id", "n_tiles", "longest_tile", "coverage"])
        rows["doc_id"] = p["doc_id"].to_numpy()[rows["doc_id"].to_numpy(np.int64)]
        return rows.astype({"doc_id": "int64", "item_id": "int64", "n_tiles": "int64", "longest_tile": "int64", "coverage": "float64"})

    return _searched(documents, items, block_words, search, "doc_id bigint, item_id bigint, n_tiles bigint, longest_tile bigint, coverage double").distinct()
