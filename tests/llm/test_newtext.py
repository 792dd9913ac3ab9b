import random

from quaystone.llm import newtext
from quaystone.llm.newtext import new_lines, own_lines

SCHEMA = "delivery_id long, message_id string, in_reply_to string, ref_ids array<string>, sender struct<display_name:string,email:string>, body_text string, own string, _key string"
ANN = ("Ann Thorquist", "athorquist@h.example")
LONG = "The automated guarantee moved from Larkmere Services to Wrenfield Materials\nand was rejected there by the regional controller. The reclassified ledger\nand the unbilled meter were rejected pending counsel's reply. Between\n2025-06-12 and July 14, 2025 the debenture team traced 4 convertible\nnarrative items as the lender requested. Invoice 79-5769 was estimated."


def _own(body, who=ANN):
    lines = body.split("\n")
    return [lines[i].strip() for i in own_lines(body, *who)[0]]


def test_forms():
    assert _own("Hi Bob,\n\nnew text\n\nKind regards\nAnn Thorquist\nAudit Manager\n\nOn Mon, Jan 6, 2025 at 6:51 AM, b@h.example wrote:\n> old\n> old two") == ["Hi Bob,", "new text"]
    assert _own("[EXTERNAL] careful.\n\nnew\n-- \nAnn\n\nCONFIDENTIALITY NOTICE: the\ncontents are private.") == ["new"]
    assert _own("new one\n\n-----Original Message-----\nFrom: B <b@h>\nSent: x\n\nold") == ["new one"]
    assert _own("new one\n\n________________________________\nold") == ["new one"]
    assert _own("On Mon, Jan 6, 2025 at 6:51 AM Bob\n<b@h.example> wrote:\n> old\n\nanswer one\n\n> old\n> older\n\nanswer two\n\nCheers\nAnn") == ["answer one", "answer two"]
    assert _own("text\r\n\r\nAnn Thorquist\r\nHalden-Audit\r\n+1 555") == ["text"]
    assert _own("Sent from my mobile") == [] and _own("") == [] and _own(" \n\t") == []


def test_look_alikes_stay():
    for line in ("On Friday our counsel wrote: we reject the premium.", "The disclaimer in last year's debenture was rejected, please keep it out.", "From: the rebate file, To: the option binder - please confirm the path.", "-- see also the approved provision --", "Original message to the lender: keep the trustee."):
        assert _own(f"Team,\n\nfirst words here\n{line}\n\nmore") == ["Team,", "first words here", line, "more"]
    assert _own("first words here\n> 90 days past due totals $1 at year end.\n\nmore") == ["first words here", "> 90 days past due totals $1 at year end.", "more"]


def test_unmarked_history_is_known_from_its_ancestor(spark):
    rewrapped = LONG.replace("\n", " ").replace("controller. ", "controller.\n").replace("counsel's", "\ncounsel's")
    n_old = len(rewrapped.split("\n"))
    rows = [
        (1, "<a@h>", None, None, None, f"Team,\n\n{LONG}\n\nBob", None, None),
        (2, "b@h", "a@H", ["<a@h>"], None, f"Our own words come first and they are quite long enough to be told.\n\nTeam,\n\n{rewrapped}\n\nBob", None, None),
        (3, "c@h", "missing@h", None, None, f"Team,\n\n{LONG}", None, None),
        (4, None, "a@h", None, None, None, None, None),
        (5, "loop@h", "loop@h", ["loop@h"], None, f"Team,\n\n{LONG}", None, None),
        (1, "<a@h>", None, None, None, f"Team,\n\n{LONG}\n\nBob", None, None),
    ]
    got = {}
    for r in new_lines(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.delivery_id, []).append(r.line_no)
    assert n_old > 1 and sorted(got[2]) == [0]
    assert len(got[1]) == len(got[3]) == len(got[5]) == 1 + len(LONG.split("\n"))
    assert 4 not in got


def test_empty_table_and_long_body(spark):
    assert new_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    body = "\n".join(f"line {i} of a very long mail" for i in range(60_000))
    assert new_lines(spark.createDataFrame([(1, "a@h", None, None, None, body, None, None)], SCHEMA)).count() == 60_000


def _lines_new(spark, rows):
    got = {}
    for r in new_lines(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.delivery_id, set()).add(r.line_no)
    return got


def test_inherited_paragraphs_of_any_length_from_six_words(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, want = [], {}
    for n in (6, 7, 8, 10, 16, 40):
        old = [" ".join(word() for _ in range(n)) for _ in range(4)]
        rows.append((n * 10, f"a{n}@h", None, None, None, "\n\n".join(old), None, None))
        new = " ".join(word() for _ in range(9))
        rows.append((n * 10 + 1, f"b{n}@h", f"a{n}@h", None, None, "\n\n".join([new, *old]), None, None))
        rows.append((n * 10 + 2, f"c{n}@h", f"b{n}@h", None, None, "\n\n".join([" ".join(word() for _ in range(9)), old[2], old[0]]), None, None))  # its grandparent's, in another order
        want |= {n * 10: {0, 2, 4, 6}, n * 10 + 1: {0}, n * 10 + 2: {0}}
    assert _lines_new(spark, rows) == want


def test_changed_places_and_glued_lines(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "red green blue white black brown pink grey gold silver beige violet"
    rows = [
        (1, "a@h", None, None, None, f"{a}\n{b}", None, None),
        (2, "b@h", "a@h", None, None, f"{b}\n{a}", None, None),  # one paragraph, its passages swapped
        (3, "c@h", "a@h", None, None, f"we have never written anything like these words before today ourselves\n{a}\nand this is what we make of it ourselves for now", None, None),
    ]
    assert _lines_new(spark, rows) == {1: {0, 1}, 3: {0, 2}}


def test_a_second_letter_is_judged_by_its_ancestors(spark):
    second = "Tom,\nplease note that the lease was signed by all parties last week"
    body = f"Hi Anna,\n\nour first part has quite a few words of its own here\n\nHi {second}\n\nRegards\nAnn Thorquist"
    rows = [
        (1, "a@h", None, None, None, "an unrelated earlier mail with words of its own kind", None, None),
        (2, "b@h", "a@h", None, ANN, body, None, None),  # the ancestor is there and has none of it: two people greeted
        (3, "c@h", "lost@h", None, ANN, body, None, None),  # the ancestor is missing
        (4, "d@h", None, None, None, f"Hi {second}", None, None),
        (5, "e@h", "d@h", None, ANN, body, None, None),  # pasted
    ]
    assert _lines_new(spark, rows) == {1: {0}, 2: {0, 2, 4, 5}, 3: {0, 2}, 4: {0, 1}, 5: {0, 2}}


def test_ancestors_of_ancestors_and_loops(spark):
    rows = [(1, 2), (2, 3), (3, 4), (4, 2), (9, 9)]
    known, found = newtext.ancestors(spark.createDataFrame(rows, "_node long, _above long"))
    assert {tuple(r) for r in known.collect()} == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (3, 2), (4, 2), (4, 3)}
    assert {tuple(r) for r in found.collect()} == {(1, 3), (1, 4), (2, 4), (3, 2), (4, 3)}


def test_chain_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(12))], [rng.randrange(6) for _ in range(rng.randrange(12))]
        met = [k for k in range(len(a)) if a[k] in b]
        chain = newtext._chain(met, [[j for j, y in enumerate(b) if y == a[k]] for k in met])
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(chain) == table[-1][-1] and chain == sorted(set(chain))


def test_in_a_loop_the_row_that_opens_with_a_text_wrote_it(spark):
    old, new = "one two three four five six seven eight nine ten", "red green blue white black brown pink grey gold silver"
    rows = [(1, "a@h", "b@h", None, None, old, None, None), (2, "b@h", "a@h", None, None, f"{new}\n\n{old}", None, None)]
    assert _lines_new(spark, rows) == {1: {0}, 2: {0}}
