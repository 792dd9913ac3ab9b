"""Texts matched to requested items by BM25."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parameters of BM25, what a named item gains, the score from which a document belongs to an item, and shorthands with what they stand for.
K1, B, EPSILON = 1.5, 0.75, 0.25
PRIOR_SHARE, PRIOR = 0.25, 0.5
LEAST_SCORE = 1.5
SHORTHANDS = {
    "tb": "trial balance", "ap": "accounts payable", "ar": "accounts receivable", "far": "fixed asset register", "fa": "fixed asset", "recs": "reconciliations",
    "recon": "reconciliation", "ye": "year end", "op": "operating", "mmkt": "money market", "distr": "distribution", "conf": "confirmation",
    "agmt": "agreement", "comp": "compensation", "rep": "representation", "mgmt": "management", "hq": "headquarters", "cert": "certificate insurance",
    "1120": "form 1120 corporation income tax return", "5500": "form 5500", "401k": "401 k plan contribution", "salestax": "sales tax", "wb": "whiteboard",
    "msa": "master service agreement contract", "accruals": "accruals accrual", "disposals": "disposals disposal", "headcount": "headcount", "payroll": "payroll",
    "officer": "officer director compensation", "board": "board minutes", "lease": "lease", "revolver": "loan credit agreement revolver",
}
#: Cells of the word-by-item matrix that a task holds at most; more items are matched by a join on words.
MATRIX_CELLS = 20_000_000

def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def expanded(words: Column) -> Column:
    """Words with what the shorthands among them stand for appended, once for each time they occur."""
    table = F.create_map(*[x for k, v in SHORTHANDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v.split()]))])
    return F.concat(words, F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>")))))


def evidence_tokens(filename: Column, context: Column | None = None, standards: Column | None = None) -> Column:
    """The query of a document: its file name with shorthands written out, three times, then its context and standards."""
    name = expanded(tokens(filename))
    parts = [name, name, name]
    if context is not None:
        parts.append(tokens(context))
    if standards is not None:
        parts.append(tokens(F.array_join(standards, " ")))
    return F.concat(*parts)


def _weights(items: list[tuple[int, list[str]]]) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the words, and for each word its score in each item."""
    bags = [Counter(t) for _, t in items]
    sizes = np.array([sum(b.values()) for b in bags], float)
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log(len(bags) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = EPSILON * sum(idf.values()) / max(1, len(idf))
    words = {w: i for i, w in enumerate(sorted(df))}
    out = np.zeros((len(words), len(bags)))
    norm = K1 * (1 - B + B * sizes / max(sizes.mean() if len(sizes) else 1.0, 1e-9))
    for k, b in enumerate(bags):
        for w, n in b.items():
            out[words[w], k] = (idf[w] if idf[w] >= 0 else floor) * n * (K1 + 1) / (n + norm[k])
    return words, out


def best_items(queries: DataFrame, items: DataFrame, key: str, k: int, cells: int = MATRIX_CELLS) -> DataFrame:
    """(key, item_id, rank, score): the k best items of each query, less those whose score isn't positive, ties to the smaller item_id.

    queries: key, tokens, and if wanted refs, ids of items that the query names, each of which adds a quarter of the best score and a
    half, in order, and allowed, ids to choose among unless none of them is an item. items: item_id, tokens. Few items: their word
    scores go to every task and queries are scored where they lie. Many: a join on words. Both give the same.
    """
    for c in ("refs", "allowed"):
        if c not in queries.columns:
            queries = queries.withColumn(c, F.array().cast("array<bigint>"))
    queries = queries.select(F.col(key).cast("long").alias(key), "tokens", F.coalesce("refs", F.array().cast("array<bigint>")).alias("refs"), F.coalesce("allowed", F.array().cast("array<bigint>")).alias("allowed"))
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "tokens")
    n_items, n_words = items.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    if n_items * max(1, n_words) <= cells:
        return _by_matrix(queries, items, key, k)
    return _by_words(queries, items, key, k)


def _by_matrix(queries: DataFrame, items: DataFrame, key: str, k: int) -> DataFrame:
    held = sorted((r.item_id, r.tokens) for r in items.collect())
    sent = queries.sparkSession.sparkContext.broadcast(held)

    def score(parts):
        ids = np.array([i for i, _ in sent.value], np.int64)
        place = {i: n for n, i in enumerate(ids.tolist())}
        words, weight = _weights(sent.value)
        for p in parts:
            out = []
            for doc, found, refs, allowed in zip(p[key], p["tokens"], p["refs"], p["allowed"]):
                rows = [words[w] for w in found if w in words]
                s = np.round(weight[rows].sum(axis=0), 6) if rows else np.zeros(len(ids))
                for r in refs:
                    if r in place:
                        s[place[r]] = np.round(s[place[r]] + s.max() * PRIOR_SHARE + PRIOR, 6)
                among = [place[a] for a in set(allowed) if a in place]
                if among:
                    only = np.full(len(ids), -np.inf)
                    only[among] = s[among]
                    s = only
                out += [(doc, ids[i], n, s[i]) for n, i in enumerate(np.lexsort((ids, -s))[:k], 1) if s[i] > 0]
            yield pd.DataFrame(out, columns=[key, "item_id", "rank", "score"]).astype({key: "int64", "item_id": "int64", "rank": "int64", "score": "float64"})

    return queries.mapInPandas(score, f"{key} bigint, item_id bigint, rank bigint, score double")


def _by_words(queries: DataFrame, items: DataFrame, key: str, k: int) -> DataFrame:
    bags = items.select("item_id", F.explode("tokens").alias("w"))
    tf = bags.groupBy("item_id", "w").agg(F.count("*").alias("n"))
    size = bags.groupBy("item_id").agg(F.count("*").alias("size"))
    n_items, mean = items.count(), size.agg(F.sum("size")).first()[0] or 0
    mean = max(mean / max(1, n_items), 1e-9)
    idf = tf.groupBy("w").agg((F.log(n_items - F.count("*") + 0.5) - F.log(F.count("*") + 0.5)).alias("idf"))
    floor = EPSILON * (idf.agg(F.avg("idf")).first()[0] or 0.0)
    weight = tf.join(idf, "w").join(size, "item_id").select("w", "item_id", (F.when(F.col("idf") >= 0, F.col("idf")).otherwise(floor) * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("size") / mean))).alias("s"))
    counted = queries.select(key, F.explode("tokens").alias("w")).groupBy(key, "w").agg(F.count("*").alias("_k"))
    scored = counted.join(weight, "w").groupBy(key, "item_id").agg(F.round(F.sum(F.col("_k") * F.col("s")), 6).alias("score"))
    named = queries.where("size(refs) > 0").select(key, F.posexplode("refs").alias("pos", "item_id")).join(items.select("item_id"), "item_id", "left_semi")
    base = named.join(scored, [key, "item_id"], "left").join(scored.groupBy(key).agg(F.max("score").alias("_top")), key, "left")
    # as many entries as the query names items
    lists = base.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", F.coalesce("score", F.lit(0.0)).alias("score")))).alias("_named"), F.first(F.coalesce("_top", F.lit(0.0))).alias("_top"))

    @F.pandas_udf("array<struct<item_id:bigint,score:double>>")
    def raised(named: pd.Series, top: pd.Series) -> pd.Series:
        out = []
        for ns, best in zip(named, top):
            s = {n["item_id"]: n["score"] for n in ns}
            for n in ns:
                i = n["item_id"]
                s[i] = round(s[i] + max(best, *s.values()) * PRIOR_SHARE + PRIOR, 6)
            out.append([{"item_id": i, "score": x} for i, x in s.items()])
        return pd.Series(out)

    lifted = lists.select(key, F.explode(raised("_named", "_top")).alias("r")).select(key, "r.*")
    scored = scored.join(lifted.select(key, "item_id"), [key, "item_id"], "left_anti").unionByName(lifted)
    among = queries.where("size(allowed) > 0").select(key, F.explode(F.array_distinct("allowed")).alias("item_id")).join(items.select("item_id"), "item_id", "left_semi")
    bound = among.select(key).distinct().withColumn("_bound", F.lit(True))
    scored = scored.join(bound, key, "left").join(among.withColumn("_in", F.lit(True)), [key, "item_id"], "left").where("_bound is null or _in")
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("item_id"))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(f"rank <= {k} and score > 0").select(key, "item_id", "rank", "score")


def overlap(queries: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, item_id, score): share of a query's tokens, repeats included, that an item has; pairs without one are absent."""
    has = items.select("item_id", F.explode(F.array_distinct("tokens")).alias("w"))
    asked = queries.where("size(tokens) > 0").select(key, F.size("tokens").alias("_n"), F.explode("tokens").alias("w")).groupBy(key, "_n", "w").agg(F.count("*").alias("_k"))
    return asked.join(has, "w").groupBy(key, "_n", "item_id").agg(F.sum("_k").alias("_hit")).select(key, "item_id", F.round(F.col("_hit") / F.col("_n"), 6).alias("score"))
