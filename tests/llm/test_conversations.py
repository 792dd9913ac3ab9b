import random
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from quaystone.llm import conversations
from quaystone.llm.conversations import disentangled, sound_conversations
from quaystone.session import table

SCHEMA = "delivery_id long, received_at timestamp, engagement_id string, message_id string, in_reply_to string, ref_ids array<string>, subject string, sender struct<display_name:string,email:string>, date_raw string, mailbox_tz string, body_text string, at string, root string"
ENG = "engagement_id string, portal_email string, auditor_domain string"
T0 = datetime(2025, 1, 1)
A, C = "ann@audit.example", "cli@client.example"


def _row(i, mid, irt=None, refs=None, email=A, date="2025-01-06T10:00:00Z", body="text"):
    return (i, T0, "e", mid, irt, refs, "s", ("x", email), date, None, body, "clash", "clash")


def _run(spark, rows):
    e = spark.createDataFrame([("e", "Portal@p.example", "AUDIT.example")], ENG)
    return sorted(tuple(r) for r in sound_conversations(spark.createDataFrame(rows, SCHEMA), e).collect())


def test_turns_roles_and_order(spark):
    rows = [
        _row(1, "<a@h>"), _row(2, "b@h", "a@H", email=C, date="2025-01-06T09:00:00Z"), _row(3, "c@h", None, ["<a@h> <b@h>"], email="portal@p.example", date="unreadable"), _row(4, None, "b@h", ["a@h"], email=None, date="2025-01-06T12:00:00Z"),
    ]
    assert _run(spark, rows) == [(1, 1, 1, "auditor"), (1, 2, 2, "client"), (1, 3, 3, "system"), (1, 4, 4, "unknown")]


def test_unsound_ones_are_dropped(spark):
    rows = [
        _row(1, "a1@h"), _row(2, "a2@h", "gone@h", email=C),  # parent missing; the root alone
        _row(3, "b1@h"), _row(4, "b2@h", "b1@h", email=C, body=" \n"),  # blank
        _row(5, "c1@h"), _row(6, "c2@h", "c1@h"),  # no client
        _row(7, "d1@h"), _row(8, "d2@h", "d1@h", email=C), _row(9, "d3@h", email=C), _row(10, "d4@h", "d3@h", ["d1@h"]),  # two roots
        _row(11, "e1@h", "e2@h"), _row(12, "e2@h", "e1@h", email=C),  # loop
        _row(13, "f1@h"), _row(14, "f2@h", "f1@h", ["lost@h"], email=C),  # a reference missing
        _row(15, "g1@h"), _row(16, "g2@h", "g1@h", email=C), _row(17, "g3@h", "nowhere@h", ["g1@h"]),  # a broken row names it
        _row(18, "h1@h"), _row(19, "h2@h", "h1@h", email=C),  # sound
    ]
    assert {r[0] for r in _run(spark, rows)} == {18}


def test_redelivered_and_repeated_rows_count_once(spark):
    rows = [_row(1, "a@h"), _row(2, "<a@h>"), _row(3, "b@h", "a@h", email=C), _row(4, None, "a@h", email=C), _row(4, None, "a@h", email=C)]
    assert [(r[1], r[2]) for r in _run(spark, rows)] == [(1, 1), (2, 3), (3, 4)]
    assert _run(spark, []) == []


def test_long_chain_and_wide_tree(spark):
    rng = random.Random(1)
    n = 300
    rows = [_row(0, "m0@h", date="2025-01-06T10:00:00Z")]
    for i in range(1, n):
        parent = i - 1 if i < 150 else 0
        rows.append(_row(i, f"m{i}@h", f"m{parent}@h", email=C, date=f"2025-01-{rng.randrange(1, 28):02d}T10:00:00Z"))
    instants, dist = {}, {}
    for i, r in enumerate(rows):
        own = int(r[8][8:10])
        parent = None if i == 0 else int(r[4][1:].split("@")[0])
        instants[i] = own if parent is None else max(own, instants[parent])
        dist[i] = 0 if parent is None else dist[parent] + 1
    want = [(0, k, i) for k, i in enumerate(sorted(range(n), key=lambda i: (instants[i], dist[i], i)), 1)]
    assert [r[:3] for r in _run(spark, rows)] == want


def test_a_body_of_white_space_alone_is_blank(spark):
    rows = [_row(1, "a@h"), _row(2, "b@h", "a@h", email=C, body="\xa0\u2003\n"), _row(3, "c@h"), _row(4, "d@h", "c@h", email=C, body="\xa0.")]
    assert {r[0] for r in _run(spark, rows)} == {3}


def _mail(i, mid, day, who, subject, body, irt=None, refs=None, eng="e"):
    return (i, datetime(2025, 1, day), eng, mid, irt, refs, subject, (who, f"{who.split()[0]}@h"), f"2025-01-{day:02d}T10:00:00Z", None, body, "clash", "clash")


def test_links_that_headers_leave_open_are_inferred(spark):
    told = "Please send the signed lease and the bank letter today."
    rows = [
        _mail(1, "a@h", 1, "Ann Oak", "lease", told), _mail(2, "b@h", 2, "Bob Elm", "lease", "Other business, nothing else."),
        _mail(3, "c@h", 2, "Cy Ash", "RE: lease", f"Dear Ann Oak, attached.\n> {told}"),  # no headers: repeats a line, names its writer
        _mail(4, "d@h", 3, "Ann Oak", "RE: lease", "Fine.", irt="c@h", refs=["a@h", "c@h"]),  # stated outweighs the rest
        _mail(5, "e@h", 4, "Bob Elm", "RE: lease", "Thanks Ann Oak, signed lease and bank letter.", irt="gone@h"),  # its stated parent is missing
        _mail(6, "f@h", 4, "Eve Fir", None, None), _mail(7, None, 5, "Eve Fir", "x", "Nobody else writes this.", eng=None),
        _mail(8, "g@h", 6, "Zed Yew", "loop", "round", irt="h@h"), _mail(9, "h@h", 6, "Zed Yew", "loop", "round", irt="g@h"),
    ]
    got = {r.delivery_id: (r.parent_id, r.root_id, r.depth, r.link) for r in disentangled(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == (1, 1, 1, "inferred") and got[4] == (3, 1, 2, "stated") and got[5] == (4, 1, 3, "inferred")
    assert got[6] == (None, 6, 0, "root") and got[7] == (None, 7, 0, "root")
    assert got[8] == (9, None, None, "stated") and got[9] == (8, None, None, "stated")
    assert disentangled(spark.createDataFrame([], SCHEMA)).count() == 0


def test_inferred_parents_against_hidden_headers(spark):
    """Of replies whose headers are hidden, a fixed share gets the parent that the headers state."""
    nodes = conversations._nodes(table(spark, "/root/testdata/sf0.01", "messages"))
    links = conversations.reply_links(nodes)
    known = conversations.likeliest_parents(links.where("target is not null and target <> child"), nodes).withColumnRenamed("child", "id")
    asked = known.where("id % 5 = 0").select("id")
    told = conversations.inferred_parents(nodes, asked).withColumnRenamed("child", "id").withColumnRenamed("parent", "guess")
    r = asked.join(known, "id").join(told, "id", "left").selectExpr("count(*) n", "count(guess) told", "count_if(guess = parent) good").first()
    print("hidden", r.n, "told", r.told, "good", r.good)
    assert r.good >= 0.6 * r.told and r.told >= 0.5 * r.n


def _by_every_pair(nodes, asking):
    """inferred_parents by the scores of all pairs of an engagement."""
    asks = nodes.join(asking, "id", "left_semi").selectExpr("engagement_id", "id as child", "seen as asked")
    posts = nodes.selectExpr("engagement_id", "id as target", "seen as posted")
    pairs = asks.join(posts, "engagement_id").where("posted < asked or (posted = asked and target < child)").selectExpr("child", "target", "0 as stated")
    best = {}
    for r in conversations._scored(pairs, nodes).where(F.col("score") >= conversations.LEAST).collect():
        best[r.child] = max(best.get(r.child, (0.0, 0)), (r.score, -r.target))
    return {child: -t for child, (_, t) in best.items()}


def test_an_earlier_row_outscores_the_latest_of_each_key(spark):
    lines = "Please send the signed lease and the bank letter today.", "The deed of the house goes to the town hall."
    rows = [
        _mail(1, "a@h", 1, "Ann Oak", "lease of the house", "\n".join(lines)),  # subject, writer and both lines
        _mail(2, "b@h", 8, "Bob Elm", "lease of the house", "Nothing."), _mail(3, "c@h", 8, "Ann Oak", "x", "Nothing."),
        _mail(4, "d@h", 8, "Cy Ash", "y", lines[0]), _mail(5, "e@h", 8, "Cy Ash", "z", lines[1]),  # later, with one of these each
        _mail(6, "f@h", 9, "Eve Fir", "RE: lease of the house", "Dear Ann Oak, as asked.\n" + "\n".join(lines)),
    ]
    got = {r.delivery_id: r.parent_id for r in disentangled(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[6] == 1


def test_inferred_parents_are_those_of_every_pair(spark, monkeypatch):
    """Several blocks of an engagement, rows at one instant, equal rows, rows without words, ids that recur, rows that ask for nothing."""
    rng = random.Random(3)
    people, subjects = ["Ann Oak", "Bob Elm", "Cy Ash Oak"], ["lease of the house", "RE: lease of the house", "house", "Q1", None, "bank letter"]
    told = [f"line {i} tells of the {w} and all that belongs to it" for i, w in enumerate(["lease", "deed", "bank", "house"])]
    texts = [*told, "Dear Ann Oak", "Thanks, Bob", "", "the bank letter", "no"]
    rows = []
    for i in range(150):
        row = list(_mail(i, f"m{i}@h", rng.choice([1, 2, 2, 3, 9, 28]), rng.choice(people), rng.choice(subjects), "\n".join(rng.sample(texts, rng.randrange(4))), eng=rng.choice(["e", "e", "e", "f", None])))
        row[8] = row[8] if rng.random() < 0.9 else None
        rows.append(tuple(row))
    rows += [(*r[:3], f"again{r[0]}@h", *r[4:]) for r in rows[:150:15]]  # the same delivery_id under another message_id
    nodes = conversations.cut(conversations._nodes(spark.createDataFrame(rows, SCHEMA)))
    asking = nodes.where("id % 4 <> 1").select("id")
    want = _by_every_pair(nodes.dropDuplicates(["id"]), asking)
    for size in (4, 1024):
        monkeypatch.setattr(conversations, "BLOCK", size)
        got = [tuple(r) for r in conversations.inferred_parents(nodes, asking).collect()]
        assert len(got) == len(want) > 50 and dict(got) == want


def test_common_values_are_counted_in_any_portion(monkeypatch):
    rng = random.Random(4)
    sets = lambda n: [set(rng.sample(range(9), rng.randrange(6))) for _ in range(n)]
    a, b = sets(20), sets(13)
    read = lambda x: conversations._sets(pa.table({"x": pa.array([list(v) for v in x], pa.list_(pa.int32()))}), "x")
    for most in (13, 40, 10_000):
        monkeypatch.setattr(conversations, "MET", most)
        assert conversations._common(read(a), read(b)).tolist() == [[len(x & y) for y in b] for x in a]
        assert conversations._common(read([]), read(b)).shape == (0, 13) and conversations._common(read([set()]), read(b)).tolist() == [[0] * 13]
