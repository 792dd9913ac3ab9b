"""Texts into containers of fixed capacity (problem 7).

The plan is made over the histogram of lengths, not over documents: best fit takes
the longest length that is left and fills its container with the longest lengths that
still fit, and a filling that recurs is planned once with its number of repeats. Documents
then take the planned slots by joining on their rank within their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.mailids import is_blank
from quaystone.operators.ranking import spread_row_number
from quaystone.session import cut

#: The public vocabulary that measures texts, if the caller names no other: ranks, or a tokenizer in JSON.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabularies split a text before pairs are merged.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text is encoded in pieces of about this many characters, cut between words, so that long ones need little memory.
PIECE_CHARS = 20_000
#: Runs of a plan that are broadcast; a longer plan is joined on the length by a shuffle.
BROADCAST_RUNS = 500_000


def _pieces(text: str) -> list[str]:
    """The text cut before spaces; a byte-level tokenizer encodes the pieces as it does the whole."""
    if len(text) <= PIECE_CHARS:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + PIECE_CHARS
        if end < len(text):
            cut_at = end
            while cut_at < len(text) and not (text[cut_at] == " " and not text[cut_at - 1].isspace() and cut_at + 1 < len(text) and text[cut_at + 1].isalnum()):
                cut_at += 1
            end = cut_at
        out.append(text[at:end])
        at = end
    return out


def counter(tokenizer: str) -> Callable[[str], int]:
    """A function that counts the tokens of a text; strings of special tokens in it are ordinary text."""
    if tokenizer.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: len(encode(text))
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every text that is neither null nor blank."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(tokenizer)
        for texts in batches:
            yield pd.Series([sum(map(of, _pieces(x))) for x in texts], dtype="int64")

    spoken = documents.where(~is_blank(F.col("text")))
    return spoken.select(F.col("doc_id").cast("long").alias("doc_id"), count("text").alias("n_tokens")).where("n_tokens > 0")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first container, items in each container) of runs of equal fillings.

    Ranks and containers count from 0. Work and output grow with the number of lengths,
    at most the capacity, not with the number of items.
    """
    import bisect

    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    used = dict.fromkeys(left, 0)
    runs, box = [], 0
    while lengths:
        room, filling = capacity, []
        hi = len(lengths)
        while room > 0:
            k = bisect.bisect_right(lengths, room, 0, hi) - 1
            if k < 0:
                break
            n = lengths[k]
            fit = min(left[n], room // n)
            filling.append((n, fit))
            room -= n * fit
            hi = k if fit == left[n] or room < n else k + 1
            hi = min(hi, k)
        repeats = min(left[n] // fit for n, fit in filling)
        for n, fit in filling:
            runs.append((n, used[n], used[n] + fit * repeats - 1, box, fit))
            used[n] += fit * repeats
            left[n] -= fit * repeats
            if not left[n]:
                del lengths[bisect.bisect_left(lengths, n)]
        box += repeats
    return runs


def pack(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, n_tokens, doc_tokens) of every piece of every non-blank text.

    A text that fits its container is one piece with number 0; a longer one is cut to
    pieces of the capacity and a rest. Containers count from 0 within a spec. Specs with null or no capacity are
    ignored; equal rows of documents are placed each on its own. The histogram that reaches
    the driver has at most one row for each length up to the capacity.
    """
    spark = documents.sparkSession
    sized = cut(token_counts(documents, tokenizer))
    wanted = [(r.spec_id, r.capacity_tokens) for r in specs.where("capacity_tokens > 0 and spec_id is not null").select("spec_id", "capacity_tokens").distinct().collect()]
    out = None
    for spec, capacity in sorted(wanted):
        rest = F.col("n_tokens") % capacity
        full = F.floor(F.col("n_tokens") / capacity).cast("long")
        cuts = F.concat(F.transform(F.when(full > 0, F.sequence(F.lit(0).cast("long"), full - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct(i.alias("piece_no"), F.lit(capacity).cast("long").alias("n"))), F.when(rest > 0, F.array(F.struct(full.alias("piece_no"), rest.alias("n")))).otherwise(F.array().cast("array<struct<piece_no:bigint,n:bigint>>")))
        pieces = sized.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode(cuts).alias("c")).select("doc_id", "doc_tokens", F.col("c.piece_no").alias("piece_no"), F.col("c.n").alias("n_tokens"))
        histogram = {r.n_tokens: r.n for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
        runs = plan(histogram, capacity)
        if not runs:
            continue
        slots = spark.createDataFrame(pd.DataFrame(runs, columns=["_len", "_lo", "_hi", "_box", "_fit"]))
        ranked = spread_row_number(pieces, ["n_tokens"], [F.col("doc_id"), F.col("piece_no")], "_rank")
        at = F.col("_rank") - 1
        placed = ranked.join(F.broadcast(slots) if len(runs) <= BROADCAST_RUNS else slots, (F.col("n_tokens") == F.col("_len")) & (at >= F.col("_lo")) & (at <= F.col("_hi")))
        one = placed.select(F.lit(spec).cast("long").alias("spec_id"), (F.col("_box") + F.floor((at - F.col("_lo")) / F.col("_fit"))).cast("long").alias("container_id"), "doc_id", "piece_no", "n_tokens", "doc_tokens")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "spec_id long, container_id long, doc_id long, piece_no long, n_tokens long, doc_tokens long")
    return out
