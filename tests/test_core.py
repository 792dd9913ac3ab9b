import random
import zipfile
from email.message import EmailMessage
from email.policy import default
from io import BytesIO

from pyspark.sql import functions as F

from quaystone.operators import facts, gate, matching, segments, versions
from quaystone.operators.graph import components
from quaystone.operators.ranking import spread_row_number
from quaystone.operators.threads import thread_ids, threads
from quaystone.sources import containers, documents


def test_row_numbers_with_one_group_of_most_rows(spark):
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"g{i % 5}", i * 37 % 101, i) for i in range(3000)]
    got = spread_row_number(spark.createDataFrame(rows, "g string, v long, id long"), ["g"], [F.col("v"), F.col("id")], "rn").collect()
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((v, i) for h, v, i in rows if h == g), 1):
            want[r[1]] = k
    assert {r.id: r.rn for r in got} == want


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(range(300)) + list(range(400, 481))
    for n in nodes:
        find(n)
    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "x long, y long"))
    assert {r.node: r.label for r in got.collect()} == {n: find(n) for n in nodes}
    assert components(spark.createDataFrame([], "node long"), spark.createDataFrame([], "x long, y long")).count() == 0


def test_threads_by_ids_and_subjects(spark):
    rows = [(1, "e", "<a@h>", None, None, "Budget"), (2, "e", None, "a@H", [], "x"), (3, "e", "c@h", None, ["<a@h> <z@h>"], None), (4, "e", "d@h", None, ["z@h"], ""), (5, "e", None, None, None, "RE: Fwd: budget"), (6, "f", None, None, None, "Budget"), (7, "e", None, None, None, None)]
    df = spark.createDataFrame(rows, "delivery_id long, engagement_id string, message_id string, in_reply_to string, ref_ids array<string>, subject string")
    assert {r.delivery_id: r.thread_key for r in threads(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7}


def _mail(body, parts=()):
    m = EmailMessage(policy=default)
    m["Message-ID"], m["Subject"], m["From"], m["Date"] = "<m@h>", "s", "Ann <ann@h.example>", "Mon, 6 Jan 2025 10:00:00 +0100"
    m.set_content(body)
    for name, data in parts:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m.as_bytes()


def _zip(*files):
    b = BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in files:
            z.writestr(n, d)
    return b.getvalue()


def test_mailbox_is_read_and_expanded(spark, tmp_path):
    inner = _mail("The total is $922,400.00", [("conf.pdf", b"%PDF-1.4 x")])
    outer = _mail("see attached", [("AP.zip", _zip(("dir/Invoice_A.pdf", b"%PDF a"), ("Invoice_B.pdf", b"%PDF b"), ("n.zip", _zip(("deep.txt", b"t"))))), ("FWD.eml", inner), ("date.csv", b"date: x")])
    (tmp_path / "b.eml").write_bytes(outer)
    (tmp_path / "a.eml").write_bytes(_mail("plain"))
    (tmp_path / "broken.eml").write_bytes(b"\xff\xfe\x00")
    files = containers.read_mail_files(spark, str(tmp_path))
    assert sorted(r.source_path for r in files.select("source_path").collect()) == ["a.eml", "b.eml", "broken.eml"]
    m = {r.source_path: r for r in containers.parse_messages(files).collect()}
    assert m["a.eml"].message_id == "m@h" and m["a.eml"].sender.email == "ann@h.example" and m["a.eml"].sent_at.hour == 9 and m["a.eml"].body_text.strip() == "plain"
    chains = [(" > ".join(r.container_chain), r.sniffed_type) for r in containers.expand(files).orderBy("message_source", "occ_no").collect()]
    assert chains == [
        ("b.eml > AP.zip", "archive"), ("b.eml > AP.zip > Invoice_A.pdf", "pdf"), ("b.eml > AP.zip > Invoice_B.pdf", "pdf"), ("b.eml > AP.zip > n.zip", "archive"), ("b.eml > AP.zip > n.zip > deep.txt", "text"),
        ("b.eml > FWD.eml", "email"), ("b.eml > FWD.eml > (body)", "email_body"), ("b.eml > FWD.eml > conf.pdf", "pdf"), ("b.eml > date.csv", "email"),
    ]


def test_mbox_is_split(spark, tmp_path):
    (tmp_path / "x.mbox").write_bytes(b"From a Mon Jan  6\n" + _mail("one") + b"\nFrom b Mon Jan  6\n" + _mail("two") + b"\n")
    files = containers.read_mail_files(spark, str(tmp_path / "x.mbox"))
    got = {r.source_path: r.body_text.strip() for r in containers.parse_messages(files).collect()}
    assert got == {"x.mbox#0": "one", "x.mbox#1": "two"}


def test_workbook_with_hidden_sheet():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = _zip(
        ("[Content_Types].xml", "<x/>"),
        ("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Summary" sheetId="1" r:id="r1"/><sheet name="Adj" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'),
        ("xl/sharedStrings.xml", f"<sst {ns}><si><t>Total</t></si></sst>"),
        ("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>12.5</v></c></row><row/></sheetData></worksheet>'),
        ("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>Secret AJE</t></is></c></row></sheetData></worksheet>'),
    )
    assert containers.sniff(book, "mystery.bin") == "xlsx" and containers.sniff(_zip(("a", b"")), "x") == "archive"
    assert documents.workbook_text(documents.read_workbook(book)) == "# Sheet: Summary\nTotal\t12.5\n\n# Sheet: Adj [hidden]\nSecret AJE"
    assert documents.read_workbook(b"nothing") == []


def test_pdf_text():
    import base64
    import zlib

    page = zlib.compress(rb"BT (Hello \(all\)) Tj (caf\351 \226 x) Tj ET")
    assert documents.read_pdf(b"%PDF stream\n" + base64.a85encode(page) + b"~>\nendstream") == "Hello (all)\ncafé - x"
    assert documents.read_pdf(b"stream\njunk\nendstream") == ""


def test_facts(spark):
    t = "As of June 30, 2026 and 2026-02-31. Total $7,700,000.00 or $, under ASC 842-10. /s/ David 6/30/2026"
    df = spark.createDataFrame([(1, t), (2, "MANAGEMENT LETTER (DRAFT)\n/s/ [TO BE SIGNED]"), (3, None), (4, "")], "id long, t string")
    r = {x.id: x for x in df.select("id", facts.dates(F.col("t")).alias("d"), facts.amounts(F.col("t")).alias("a"), facts.standards(F.col("t")).alias("s"), facts.signatures(F.col("t")).alias("g")).collect()}
    assert [str(x.value) for x in r[1].d] == ["2026-06-30", "2026-06-30"] and r[1].a == [7700000.0] and r[1].s == ["ASC 842"] and r[1].g[0].signed
    assert all(x.draft and not x.signed for x in r[2].g) and r[3].d == [] and r[4].a == []
    placed = facts.placed_facts(df, "id", "t").where("kind = 'money'").collect()
    assert t[placed[0].start_pos :].startswith("$7,700,000.00")
    assert df.select(facts.claimed_count(F.lit("sample of 30 invoices, 22 invoices"), "invoice").alias("n")).first().n == 30
    assert df.select(facts.has_phrase(F.lit("The Lease schedule"), F.lit("lease of schedule")).alias("n")).first().n


def test_gate(spark):
    df = spark.createDataFrame([(1, "SSN 123-45-6789 acct 1234567 DOB: 1/2/1990"), (2, None), (3, "")], "id long, t string")
    assert {(r.pii_type, r.masked) for r in gate.scan(df, "id", "t").collect()} == {("SSN", "***6789"), ("bank_account", "***4567"), ("DOB", "***1990")}
    assert df.select(gate.redact(F.col("t")).alias("x")).first().x == "SSN [REDACTED-SSN] [REDACTED-bank_account] [REDACTED-DOB]"
    assert gate.summary(gate.scan(df, "id", "t"), "id").first().summary == "DOB×1, SSN×1, bank_account×1"


def _tokens(df, key):
    return df.withColumn("tokens", matching.tokens(F.col("text"))).drop("text")


def test_bm25_ways_agree(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    items = _tokens(spark.createDataFrame([(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(12, "")], "item_id long, text string"), "item_id")
    texts = [(i, " ".join(rng.choices(words, k=15)), rng.choices(range(14), k=rng.randrange(3)) if i % 3 else None, [1, 5, 7] if i % 4 == 0 else [99] if i % 4 == 1 else None) for i in range(30)]
    docs = _tokens(spark.createDataFrame(texts + [(30, None, [3, 3], None), (31, "", None, None)], "doc_id long, text string, refs array<long>, allowed array<long>"), "doc_id")
    for asked in (docs, docs.drop("refs"), docs.drop("allowed", "refs")):
        one, two = (sorted(map(tuple, matching.best_items(asked, items, "doc_id", 3, cells=c).collect())) for c in (10**9, 0))
        assert one and [r[:3] for r in one] == [r[:3] for r in two] and all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(one, two))
    named = {(r.doc_id, r.rank): (r.item_id, r.score) for r in matching.best_items(docs, items, "doc_id", 1).collect()}
    assert named[(30, 1)] == (3, 1.125)  # a half, then a half and a quarter of that
    assert all(i in (1, 5, 7) for (d, _), (i, _) in named.items() if d % 4 == 0 and d < 30)


def test_queries_of_documents(spark):
    row = spark.range(1).select(
        matching.expanded(matching.tokens(F.lit("Adjusted_TB.xlsx"))).alias("a"), matching.evidence_tokens(F.lit("AR lease"), F.lit("PBC-10"), F.array(F.lit("ASC 842"))).alias("b"), matching.expanded(matching.tokens(F.lit(None).cast("string"))).alias("c")
    ).first()
    assert row.a == ["adjusted", "tb", "xlsx", "trial", "balance"] and row.c == []
    assert row.b == ["ar", "lease", "accounts", "receivable", "lease"] * 3 + ["pbc", "10", "asc", "842"]
    q = spark.createDataFrame([(1, ["a", "b", "a", "x"]), (2, [])], "k long, tokens array<string>")
    assert [tuple(r) for r in matching.overlap(q, spark.createDataFrame([(7, ["a", "a"]), (8, ["z"])], "item_id long, tokens array<string>"), "k").collect()] == [(1, 7, 0.5)]


def test_versions(spark):
    f = spark.createDataFrame([("a", "Financials_Draft.xlsx"), ("b", "Financials_v2.xlsx"), ("c", "Financials_Final_v3_REAL.xlsx"), ("c", "Financials_Final_v3_REAL.xlsx"), ("d", "TB 2026.xlsx"), ("e", "Final.pdf"), ("f", "Draft.pdf"), ("g", None)], "doc_id string, filename string")
    r = {x.doc_id: x for x in versions.version_groups(f).collect()}
    assert [(r[d].version_no, r[d].is_latest, r[d].n_versions) for d in "abc"] == [(1, False, 3), (2, False, 3), (3, True, 3)] and r["d"].version_key == "tb2026"
    assert r["e"].is_latest and r["f"].is_latest and set(r) == set("abcdef")  # names of version words only are not pooled


def test_entities_of_a_scope_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(facts, "BLOCK", 3)
    e = spark.createDataFrame([("s", i, f"Name{i:02d} Foods LLC") for i in range(10)] + [("s", 11, None), (None, 12, "Name01 Foods LLC")], "scope string, entity_id long, entity_name string")
    t = spark.createDataFrame([("s", 1, "of NAME01 Foods and name07 foods llc"), ("s", 2, None), ("t", 3, "name01 foods"), (None, 4, "name01 foods")], "scope string, id long, t string")
    got = sorted(tuple(r) for r in facts.entity_mentions(t, e, "scope", "id", "t").collect())
    assert got == [(1, 1, "name01 foods"), (1, 7, "name07 foods llc")]


def test_dates_put_off_and_caveats(spark):
    t = [(1, "We expect PBC-7 by March 3, sorry.", 2026), (2, "PBC 12 instead of Monday: 2026-02-31", 2026), (3, "Nothing about PBC-3", 2026), (4, None, 2026), (5, "The lease is still outstanding. PBC-4 remains outstanding!\nIt is still pending but immaterial.", 2026)]
    df = spark.createDataFrame(t, "id long, t string, fy int")
    assert {(r.id, r.request, str(r.expected_by)) for r in facts.reschedules(df, "id", "t", "fy").collect()} == {(1, "PBC-07", "2026-03-03"), (2, "PBC-12", "None")}
    assert [(r.id, r.ord, r.request) for r in facts.caveats(df, "id", "t").orderBy("id", "ord").collect()] == [(5, 0, None), (5, 1, "PBC-04")]


def test_segments(spark):
    schema = "doc_id string, sniffed_type string, text string, pages array<string>, sheets array<struct<name:string,text:string>>"
    rows = [("a", "xlsx", "t", ["t"], [("S1", "x"), ("S2", None)]), ("b", "pdf", "t", ["p1", "p2"], None), ("c", "image", "t", ["t"], []), ("d", "text", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in segments.segments(df).orderBy("doc_id", "seg_no").collect()]
    assert got == [("a", 0, "sheet 'S1'", "x"), ("a", 1, "sheet 'S2'", None), ("b", 0, "page 1", "p1"), ("b", 1, "page 2", "p2"), ("c", 0, "photo", "t"), ("d", 0, "body", None)]
    assert [r.locator for r in segments.segments(df, any_pages=True).where("doc_id = 'c'").collect()] == ["page 1"]


def test_thread_ids(spark):
    m = spark.createDataFrame([(1, "in/Thread07_msg01.eml"), (2, "in/thread07_msg02.eml"), (3, "x/thread1_a.eml"), (4, "x/thread2_b.eml"), (5, None)], "delivery_id long, source_path string")
    t = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "delivery_id long, thread_key long")
    assert {r.thread_key: r.thread_id for r in thread_ids(m, t).collect()} == {1: "thread07", 3: "thread02", 5: "thread03"}


def test_nothing_outside_llm_imports_it():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for p in (root / "quaystone").rglob("*.py"):
        if "llm" not in p.parts:
            assert "quaystone.llm" not in p.read_text()
