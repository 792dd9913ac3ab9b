import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from quaystone.llm import leaks, packing, repetition

D = "doc_id long, text string, n_tokens long, item_id long"


def _share(text, n=8):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    seen, mark = set(), [False] * len(words)
    for i in range(len(words) - n + 1):
        run = tuple(words[i : i + n])
        if run in seen:
            mark[i : i + n] = [True] * n
        seen.add(run)
    return sum(mark), len(words)


def test_repetition_equals_brute_force(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice("abé1") for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", "  \n", "x " * 100_000, "A-b_c, " * 30]
    m = repetition.measure(pd.Series(texts))
    for k, t in enumerate(texts):
        for n in repetition.LENGTHS:
            assert (m[f"repeated_{n}"][k], m["n_words"][k]) == _share(t, n)
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)], D)
    want = {i for i, t in enumerate(texts) if _share(t)[1] and _share(t)[0] / _share(t)[1] >= 0.30}
    assert {r.doc_id for r in repetition.repetitive(df).collect()} == want
    assert repetition.repetitive(spark.createDataFrame([], D)).count() == 0


def test_share_of_exactly_the_threshold_counts(spark):
    words = [f"w{i}" for i in range(12)]
    rows = [(n, " ".join(words + [f"x{i}" for i in range(n)] + words), 1, 1) for n in (15, 16, 17)]
    assert _share(rows[1][1]) == (12, 40)
    assert {r.doc_id for r in repetition.repetitive(spark.createDataFrame(rows, D)).collect()} == {15, 16}


def test_plan_places_every_length_once():
    rng = random.Random(1)
    for capacity in (7, 50, 512):
        lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(3000)]
        seen, fill = Counter(), Counter()
        for n, lo, hi, box, fit in packing.plan(dict(Counter(lengths)), capacity):
            assert lo == seen[n]
            seen[n] = hi + 1
            for k in range(lo, hi + 1):
                fill[box + (k - lo) // fit] += n
        assert seen == Counter(lengths) and max(fill.values()) <= capacity
        assert len(fill) <= 1.02 * sum(lengths) / capacity + 1
    assert packing.plan({}, 10) == []


def test_pack_round_trip(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["audit", "ledger", "x"]) for _ in range(rng.randrange(1, 90))) for _ in range(150)] + ["same words"] * 60 + [None, "", " \n", "long " * 6000]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)], D)
    specs = spark.createDataFrame([(1, 64), (2, 512), (3, None), (4, 0)], "spec_id long, capacity_tokens long")
    got = packing.pack(docs, specs).collect()
    sizes = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect()}
    assert set(sizes) == set(range(210)) | {213}
    for spec, capacity in ((1, 64), (2, 512)):
        rows = [r for r in got if r.spec_id == spec]
        parts, fill = defaultdict(list), Counter()
        for r in rows:
            parts[r.doc_id].append((r.piece_no, r.n_tokens))
            fill[r.container_id] += r.n_tokens
        assert set(parts) == set(sizes) and max(fill.values()) <= capacity
        for doc, pieces in parts.items():
            pieces.sort()
            assert sum(n for _, n in pieces) == sizes[doc] and [p for p, _ in pieces] == list(range(len(pieces)))
            assert len(pieces) == -(-sizes[doc] // capacity) and all(n == capacity for _, n in pieces[:-1])
        assert len(fill) == max(fill) + 1 <= 1.1 * sum(sizes.values()) / capacity + 1
    assert {r.spec_id for r in got} == {1, 2}
    assert packing.pack(spark.createDataFrame([], D), specs).count() == 0


def test_pieces_of_a_long_text_count_as_the_whole_in_either_library():
    text = " ".join(random.Random(3).choice(["Prüfung", "ledger,", "12.5", "it's", "\n\n", "  x"]) for _ in range(20_000))
    pieces = packing._pieces(text)
    assert len(pieces) > 3 and "".join(pieces) == text
    counts = [f(text) for f in (packing.counter(packing.TOKENIZER), packing.counter(packing.TOKENIZER.replace(".tiktoken", ".json")))]
    assert counts[0] == counts[1] == sum(map(packing.counter(packing.TOKENIZER), pieces))


def _item(rng, n):
    return [f"v{rng.randrange(10**6)}" for _ in range(n)]


def test_leaks_of_each_kind(spark):
    rng = random.Random(4)
    items = {i: _item(rng, 48 + i) for i in range(6)}
    noise = lambda k: [f"n{rng.randrange(500)}" for _ in range(k)]
    altered = list(items[1])
    for k in range(4, 48, 8):
        altered[k] = altered[k] + "x"
    gapped = items[2][:20] + noise(300) + items[2][20:]
    twice = items[3][:12] + noise(30) + items[3][12:24] + noise(30) + items[3][24:36]
    spoiled = [w if k % 5 else "zz" for k, w in enumerate(items[4])]
    moved = items[5][25:39] + noise(4) + items[5][:14]
    docs = {
        1: noise(40) + items[0] + noise(10), 2: noise(5) + altered, 3: gapped, 4: twice, 5: spoiled, 6: noise(30) + items[0][5:20], 7: noise(30) + items[0][5:19] + noise(9), 8: moved, 9: items[0] + items[1],
    }
    rows = [(d, " ".join(w), 1, 1) for d, w in docs.items()] + [(10, None, 1, 1), (11, "", 1, 1), (12, "<p>" + "&nbsp;".join(w.upper() for w in items[2]) + "</p>", 1, 1), (13, '{"q": "' + "\\n".join(items[3]) + '"}', 1, 1), (14, " ".join(noise(60_000) + items[1]), 1, 1)]
    it = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items.items()] + [(90, None, "x"), (91, "", "x")], "item_id long, text string, doc_id string")
    want = {(1, 0), (2, 1), (3, 2), (6, 0), (9, 0), (9, 1), (12, 2), (13, 3), (14, 1)}
    df = spark.createDataFrame(rows, D)
    assert {tuple(r) for r in leaks.leaked_items(df, it).collect()} == want
    assert {tuple(r) for r in leaks.leaked_items(df, it, block_words=60).collect()} == want
    assert leaks.leaked_items(spark.createDataFrame([], D), it).count() == 0


def test_tiles_are_longest_first_and_apart():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 3, 60), rng.integers(0, 3, 40)
        at, of = map(np.array, zip(*[(i, j) for i in range(56) for j in range(36) if (a[i : i + 5] == b[j : j + 5]).all()] or [(0, 0)]))
        if not (a[at[0] : at[0] + 5] == b[of[0] : of[0] + 5]).all():
            continue
        marked = leaks.tiles(at, of)
        used_a, used_b = np.zeros(60, int), np.zeros(40, int)
        for n, p, q in marked:
            assert n >= 5 and (a[p : p + n] == b[q : q + n]).all()
            used_a[p : p + n] += 1
            used_b[q : q + n] += 1
        assert used_a.max() == used_b.max() == 1
        assert [n for n, _, _ in marked] == sorted((n for n, _, _ in marked), reverse=True)


@pytest.mark.parametrize("gap", [0, 1, 30])
def test_edits_around_gap_against_brute_force(gap):
    rng = random.Random(gap)

    def edit(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            now = [row[0] + 1]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    for _ in range(12):
        item = [rng.randrange(4) for _ in range(5)]
        doc = [rng.randrange(4) for _ in range(7)]
        best = 99
        spans = [(i, j) for i in range(len(doc) + 1) for j in range(i, len(doc) + 1)]
        for k in range(len(item) + 1):
            for i, j in spans:
                for p, q in spans:
                    if p >= j:
                        best = min(best, edit(item[:k], doc[i:j]) + edit(item[k:], doc[p:q]))
        assert leaks.edits_around_gap(np.array(item), np.array(doc)) == best


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 19, 23, 24, 32, 39, 40, 41, 48, 56, 64, 102])
def test_evenly_spread_edits_and_one_insertion_are_found(size):
    rng = random.Random(size)
    item = _item(rng, size)
    known = leaks.Items([(1, " ".join(item))])
    for trial in range(60):
        words = list(item)
        edits = size // 8
        places = sorted(rng.sample(range(size), edits)) if trial % 2 else [(k + 1) * size // (edits + 1) for k in range(edits)]
        for p in reversed(places):
            kind = rng.choice("adx")
            words[p : p + 1] = {"a": ["other"], "d": [], "x": [words[p], "added"]}[kind]
        gap = rng.randrange(0, len(words) + 1)
        text = ["n1", "n2"] + words[:gap] + [f"g{rng.randrange(99)}" for _ in range(rng.randrange(40))] + words[gap:] + ["n3"]
        assert known.leaks(pd.Series([" ".join(text)]))[1].tolist() == [1], (places, gap)


def test_coverage_catches_reordered_passages(spark):
    rng = random.Random(6)
    item = _item(rng, 48)
    docs = [(1, " ".join(item[24:36] + ["x"] * 9 + item[:12] + ["y"] + item[36:]), 1, 1), (2, " ".join(item[:14]), 1, 1), (3, None, 1, 1), (4, " ".join(item), 1, 1), (4, " ".join(item), 1, 1)]
    items = spark.createDataFrame([(7, " ".join(item), 1), (8, None, 1)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): (r.n_tiles, r.longest_tile, r.coverage) for r in leaks.covered_items(spark.createDataFrame(docs, D), items).collect()}
    assert got == {(1, 7): (3, 12, 0.75), (4, 7): (1, 48, 1.0)}
    assert leaks.leaked_items(spark.createDataFrame(docs[:3], D), items).count() == 0
