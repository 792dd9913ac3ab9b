import random
from itertools import combinations

from quaystone.llm import names

A = "addr_id long, engagement_id string, display_name string, email string, label string, node string"
E_ = "entity_id long, engagement_id string, entity_name string, id string"


def _edit(a, b, swap):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if swap and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distance_and_pigeonhole_against_brute_force():
    rng = random.Random(2)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(150)]
    for a, b in combinations(pool, 2):
        assert names.damerau(a, b, 2) == min(3, _edit(a, b, True))
        if _edit(a, b, False) <= names.K:
            assert set(names.index_keys(a)) & names.probe_keys(b)


def test_segment_join_loses_no_pair(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "".join(rng.choice("ab") for _ in range(rng.randrange(3, 9)))) for i in range(120)]
    df = spark.createDataFrame(rows, "node long, scope string, text string")
    got = {tuple(sorted((r.l_node, r.r_node))) for r in names.segment_join(df, df, ["node"]).collect()}
    assert got == {(a, b) for (a, s, x), (b, t, y) in combinations(rows, 2) if s == t and _edit(x, y, False) <= 2}


def test_swaps_are_candidates_as_the_verifier_counts_them(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randrange(10))) for _ in range(160)]
    for text in ["joequiiwickham", "theodoreforstfields", "richnrdsteldelow", "abcdefghijkl"]:
        for _ in range(30):
            x = list(text)
            for _ in range(2):
                i = rng.randrange(len(x) - 1)
                x[i : i + 2] = rng.choice([[x[i + 1], x[i]], [x[i + 1], x[i]], [x[i]], [x[i], "q", x[i + 1]], ["z", x[i + 1]]])
            pool.append("".join(x))
        pool.append(text)
    near = {(i, j) for (i, a), (j, b) in combinations(enumerate(pool), 2) if names.damerau(a, b, 2) <= 2}
    for i, j in near:
        assert set(names.index_keys(pool[i])) & names.probe_keys(pool[j], swaps=True) and set(names.index_keys(pool[j])) & names.probe_keys(pool[i], swaps=True)
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(pool)], "node long, scope string, text string")
    got = {(r.l_node, r.r_node) for r in names.segment_join(df, df, ["node"], swaps=True).collect()}
    assert near <= got


def test_swap_and_another_edit_or_two_swaps_link(spark):
    rows = ["Joe Quiiwickham", "Joe Quilwikcham", "Theodore Forstfields", "Thheodore Frostfields", "Richnrd Steldelow", "Richard Setldelow", "Margaret Oslandez", "Magraret Osladnez"]
    df = spark.createDataFrame([(i, "e", n, None, "", "") for i, n in enumerate(rows)], A)
    got = {(r.id_a, r.id_b) for r in names.same_name_pairs(df, spark.createDataFrame([], E_)).collect()}
    assert got == {(0, 1), (2, 3), (4, 5), (6, 7)}


def test_people(spark):
    rows = [
        "Thomas Grimdottir", "GRIMDOTTIR THOMAS", "Hr. Thomas Grimdottir", "Tommy J Grimdottir", "T Grimdittir", "Thoomas Grimdottir", "Thomas Grimdottir (Audit Senior)",
        "Yasmin van der Jorovich", "'Yasmin van der Jorovich'", "Yasmin vna der Jorovich", "yasmin.vanderjorovich",
        "Jennifer Oakström", "José Oakström", "J. Oakström", "Noémie Oakström", "N. Oakstrom", None, "  ", "Accounts Payable", "Accounts Payable",
    ]
    df = spark.createDataFrame([(i, "e", n, None, "x", "y") for i, n in enumerate(rows)] + [(100, "f", "Thomas Grimdottir", None, "x", "y"), (101, None, "Thomas Grimdottir", None, "x", "y")], A)
    got = {(r.id_a, r.id_b) for r in names.same_name_pairs(df, spark.createDataFrame([], E_)).collect()}
    want = set(combinations(range(7), 2)) | set(combinations(range(7, 11), 2)) | {(14, 15)}
    assert got == want


def test_email_decides_between_relatives(spark):
    df = spark.createDataFrame([(1, "e", "Jennifer Oakström", None, "", ""), (2, "e", "José Oakström", None, "", ""), (3, "e", "J. Oakström", "jennifer.oakstrom@h", "", ""), (4, "e", "Jose Oakstrom", "shared@h", "", "")], A)
    assert {(r.id_a, r.id_b) for r in names.same_name_pairs(df, spark.createDataFrame([], E_)).collect()} == {(1, 3), (2, 4)}


def test_initials_that_fit_several_keep_their_copies_and_a_class(spark):
    names_ = [("Jennifer Oakström", None), ("José Oakström", None), ("J. Oakström", None), ("Oakstrom, J.", None), ("J. Oakstrom", "box@h"), ("J. Oakstrom", "Box@h"), ("J. Oakstorm", "box@h"), ("J. Oakstrom", "desk@h")]
    rows = [(i, "e", n, m, "", "") for i, (n, m) in enumerate(names_)] + [(20, None, "Jennifer Oakström", None, "", ""), (21, None, "Jennifer Oakström", None, "", "")]
    df, none = spark.createDataFrame(rows, A), spark.createDataFrame([], E_)
    assert {(r.id_a, r.id_b) for r in names.same_name_pairs(df, none).collect()} == {(2, 3), (4, 5), (4, 6), (5, 6)}
    classes = {r.id: (r.class_id, r.n_links) for r in names.same_name_classes(df, none).collect()}
    assert classes == {0: (0, 0), 1: (1, 0), 2: (2, 1), 3: (2, 1), 4: (4, 2), 5: (4, 2), 6: (4, 2), 7: (7, 0), 20: (20, 0), 21: (21, 0)}


def test_copies_of_a_typing_error_are_no_name_of_their_own(spark):
    none = spark.createDataFrame([], E_)
    pairs = lambda rows: {(r.id_a, r.id_b) for r in names.same_name_pairs(spark.createDataFrame([(i, e, n, None, "", "") for i, (e, n) in enumerate(rows)], A), none).collect()}
    rows = [("e", "Thomas Grimdittir")] * 4 + [("e", "Thomas Grimdottir")] * 12
    assert pairs(rows) == set(combinations(range(16), 2))
    # two given names that mostly stand without each other are not linked, however many tables of this kind lie together
    apart = ["Daniel Oakmere", "Daniele Oakmere"], ["Daniel Thorquist"], ["Daniel Veloretti"], ["Daniele Peldottir"], ["Daniele Fenakis"]
    for times in (1, 3):
        assert pairs([(f"e{k}-{c}", n) for c in range(times) for k, group in enumerate(apart) for n in group]) == set()
    # two errors for one frequent name are none of their own
    errors = ["Thoomas Oakmere", "Thmas Oakmere"], *([f"{x} {y}", f"Thomas {y}"] for x, y in (("Thoomas", "Thorquist"), ("Thoomas", "Veloretti"), ("Thmas", "Peldottir"), ("Thmas", "Fenakis"))), *([f"Thomas {c * 6}"] for c in "bcdfghjklmnp")
    assert (0, 1) in pairs([(f"e{k}", n) for k, group in enumerate(errors) for n in group])
    # two spellings that always stand together are one name, at every size
    together = ["Daniel Oakmere", "Daniele Oakmere"], ["Daniel Thorquist", "Daniele Thorquist"]
    for times in (1, 3):
        got = pairs([(f"e{k}-{c}", n) for c in range(times) for k, group in enumerate(together) for n in group])
        assert got == {(i, i + 1) for i in range(0, 4 * times, 2)}


def test_organisations(spark):
    rows = ["Larkmere Refrigeration, LLC", "Refrigeration Larkmere", "Larkmere-Refrigeration LLC", "The Larkmere Refrig. L.L.C.", "LR LLC", "Larkmree Refrigeration", "Larkmere Industries Co.", "LI Co.", "Larkmere Ind.", "Driftmere Foods", None, ""]
    df = spark.createDataFrame([(i, "e", n, "c") for i, n in enumerate(rows)], E_)
    got = {(r.id_a, r.id_b) for r in names.same_name_pairs(spark.createDataFrame([], A), df).collect()}
    assert got == set(combinations(range(6), 2)) | set(combinations(range(6, 9), 2))
    classes = {r.id: (r.class_id, r.n_links) for r in names.same_name_classes(spark.createDataFrame([], A), df).collect()}
    assert classes[4] == (0, 5) and classes[9] == (9, 0) and 10 not in classes


def test_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], A), spark.createDataFrame([], E_)
    assert names.same_name_pairs(*none).count() == 0
    twice = spark.createDataFrame([(1, "e", "Ann Thorquist", None, "", "")] * 3 + [(2, "e", "x" * 5000 + " y" * 3000, None, "", "")], A)
    assert names.same_name_pairs(twice, none[1]).count() == 0


def test_carried_columns_keep_every_digit_beside_nulls(spark):
    big = [None if i % 2 else -2018570118285295009 - i for i in range(40)]
    rows = [("s", f"name{i:02d}xyz", i, big[i]) for i in range(40)]
    df = spark.createDataFrame(rows, "scope string, text string, node long, label long").coalesce(1)
    got = {(r.l_node, r.l_label) for r in names.segment_join(df, df, ["node", "label"]).collect()}
    assert got == {(i, big[i]) for i in range(40)}
