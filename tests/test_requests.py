from datetime import date

from quaystone.operators import assessment
from quaystone.sources import requests

LIST = """Request list
PBC-3 [Receivables] Priority: high
Aged listing of all
customers.
Acceptance: as_of=2026-06-30, buckets=[Current, 31-60, ">90"],
entity=consolidated, signed=true
Confidential - page 1
Expected documents: XLSX
ignored
PBC-14 [Debt] Priority: urgent
Loan agreements
Acceptance: sample_size=30, standard=ASC 606"""


def _lines(spark, text, name):
    return spark.createDataFrame([("x", i, line) for i, line in enumerate(text.split("\n"))], f"{name} string, line_no int, line string")


def test_request_list(spark):
    got = {r.item_id: r for r in requests.request_items(_lines(spark, LIST, "list")).collect()}
    assert got["PBC-03"].description == "Aged listing of all customers." and got["PBC-03"].priority == "High" and got["PBC-03"].formats == "XLSX"
    assert got["PBC-03"].acceptance.endswith("entity=consolidated, signed=true") and got["PBC-14"].priority == "Medium" and got["PBC-14"].category == "Debt"
    kinds = [(r.item_id, r.ordinal, r.kind) for r in requests.criteria(requests.request_items(_lines(spark, LIST, "list"))).orderBy("item_id", "ordinal").collect()]
    assert kinds == [("PBC-03", 0, "period"), ("PBC-03", 1, "bucket"), ("PBC-03", 2, "entity"), ("PBC-03", 3, "signature"), ("PBC-14", 0, "count"), ("PBC-14", 1, "standard")]


def test_clauses():
    one = requests.read_clauses("period_start=2025-07-01, period_end=2026-06-30, must_include=[a, 'b, c'], signed_by=CFO, horizon_months=12, nonsense=1, min_customers=10")
    assert [c["kind"] for c in one] == ["period", "include", "signature", "horizon", "count"] and one[0]["period_kind"] == "RANGE" and one[1]["labels"] == ["a", "b, c"]
    assert requests.split_clauses("a=it's, b=2") == ["a=it's, b=2"] and requests.read_clauses(None) == []
    assert requests.read_clauses("sample_size=15 before + 15 after")[0]["number"] == 1515


def test_profile(spark):
    text = "Client: Northwind\nFiscal Year End: 2026-06-30\nConsolidated entities\nNorthwind Beverages, Inc. (parent)\nCascade Cold Brew LLC (sub)\nAudit team\nPartner: Ann Lee, CPA"
    got = {(r.section, r.key): r.value for r in requests.profile_rows(_lines(spark, text, "profile")).collect()}
    assert got == {("fields", "client"): "Northwind", ("fields", "fiscal year end"): "2026-06-30", ("entities", "Northwind Beverages, Inc."): "parent", ("entities", "Cascade Cold Brew LLC"): "sub", ("audit", "partner"): "Ann Lee"}


ENTITIES = [("e", 1, "Northwind Beverages, Inc.", True), ("e", 2, "Northwind Distribution LLC", False), ("e", 3, "Cascade Cold Brew LLC", None)]


def _run(spark, clause, *texts, names=("a.pdf",), engagement="e"):
    """Outcomes by ordinal, the assessment, and the details."""
    years = spark.createDataFrame([("e", date(2025, 7, 1), date(2026, 6, 30)), ("other", date(2020, 1, 1), date(2020, 12, 31))], "engagement_id string, fy_start date, fy_end date")
    entities = spark.createDataFrame(ENTITIES, "engagement_id string, entity_id long, entity_name string, is_parent boolean")
    items = spark.createDataFrame([("i", clause)], "item_id string, acceptance string")
    evidence = spark.createDataFrame([(engagement, "i", k, names[k % len(names)], t) for k, t in enumerate(texts)], "engagement_id string, item_id string, doc_id long, filename string, text string")
    checked = assessment.checks(requests.criteria(items), evidence, years, entities)
    rows = checked.orderBy("ordinal").collect()
    done = assessment.assess(evidence, checked).collect()
    return [r.outcome for r in rows], done[0] if done else None, [r.detail for r in rows]


def test_outcomes(spark):
    run = lambda *a, **k: _run(spark, *a, **k)
    outcomes, done, _ = run("as_of=2026-06-30", "Balance as of June 30, 2026.")
    assert outcomes == ["pass"] and (done.status, done.confidence, done.n_open) == ("Complete", 1.0, 0)
    outcomes, done, detail = run("as_of=2026-06-30", "Consolidated balances as of June 30, 2025.", names=("TB_FY26.pdf",))
    assert outcomes == ["fail"] and done.status == "Insufficient" and "2025" in done.reasoning and "2026" in done.reasoning
    outcomes, done, detail = run("entity=consolidated", "Trial balance for Cascade Cold Brew LLC as of 2026-06-30.")
    assert outcomes == ["fail"] and done.status == "Insufficient" and detail == ["missing 2 entities, first Northwind Beverages, Inc."]
    assert run("entity=consolidated", "Northwind Beverages, Inc. and Northwind Distribution", "Cascade Cold Brew LLC")[0] == ["pass"]
    assert run("entity=consolidated", "Northwind Beverages and subsidiaries")[0] == ["pass"] and run("entity=consolidated", "nobody")[0] == ["unverifiable"]
    assert run("entity=Cascade Cold Brew LLC", "cascade cold brew")[0] == ["pass"] and run("entity=Somebody Else", "x")[0] == ["pass"]
    outcomes, done, _ = run("signed=true", "Representation letter (DRAFT). /s/ [TO BE SIGNED]", names=("MgmtRep_signed_FINAL.pdf",))
    assert outcomes == ["fail"] and done.status == "Under review" and "DRAFT" in done.reasoning
    assert run("signed=true", "no mark")[1].status == "Insufficient" and run("signed=true", "Sincerely,\n/s/ David Okafor, CFO")[0] == ["pass"]
    assert run("buckets=[Current, 31-60], standard=ASC 606, reconciles_to_gl=true, threshold_usd=5", "current 31-60, ASC 606; variance = 0")[0] == ["pass", "pass", "pass", "unverifiable"]
    assert run("period=FY2026, must_include=[lease schedule], horizon_months=12", "fiscal year lease; schedule, 12-month", None)[0] == ["pass", "pass", "pass"]
    assert run("must_include=[lease schedule]", "a lease", "the schedule")[0] == ["pass"] and run("must_include=[lease schedule]", "a lease")[2] == ["could not confirm: lease schedule"]


def test_periods_counts_and_names(spark):
    run = lambda *a, **k: _run(spark, *a, **k)
    assert run("as_of=2026-06-30", "nothing", names=("TB_2026-06-30.xlsx",))[0] == ["pass"] and run("as_of=2026-06-30", "dated 2025-09-01")[0] == ["pass"]
    assert run("as_of=report_date", "2026-06-30")[0] == ["unverifiable"] and run("as_of=2026-06-30", "dated 2019-01-01")[0] == ["unverifiable"]
    assert run("period=FY2026", "dated 2024-09-01")[0] == ["fail"] and run("period=FY2026", "x", names=("gl_fy26.pdf", "gl fy26.pdf"))[0] == ["unverifiable"] and run("period=FY2026", "x", names=("gl fy26.pdf",))[0] == ["pass"]
    assert run("period_start=2026-01-01, period_end=2026-03-31", "paid 2026-02-01")[0] == ["pass"] and run("period_start=2026-01-01, period_end=2026-03-31", "paid 2025-02-01")[0] == ["fail"]
    outcomes, done, detail = run("sample_size=30", "This is a sample of 30 items", *["item"] * 21)
    assert outcomes == ["fail"] and done.status == "Under review" and "8 missing" in detail[0]
    assert run("min_customers=3", "a", "b")[0] == ["fail"] and run("min_customers=2", "a", "b")[0] == ["pass"] and run("must_cover_all_accounts=true", "a")[0] == ["pass"]
    assert _run(spark, "as_of=2026-06-30", "as of June 30, 2026", engagement="nowhere")[0] == []
    assert run("", "text")[1][:5] == ("e", "i", 1, "Received", 0.5) and run("signed=true") == ([], None, [])
    assert run("threshold_usd=5000, standard=ASC 842, horizon_months=12, signed=true", "/s/ Ann")[1].confidence == 0.62  # half to even


def test_layers_and_scores(spark):
    done = spark.createDataFrame([("e", "i", 1.0), ("e", "j", 0.5)], "engagement_id string, item_id string, confidence double")
    ev = spark.createDataFrame([("e", "i", 1), ("e", "i", 2), ("e", "j", 3)], "engagement_id string, item_id string, doc_id long")
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "doc_id long")
    latest = spark.createDataFrame([(1, False), (2, True)], "doc_id long, is_latest boolean")
    got = {r.item_id: (r.n_superseded, r.n_findings, r.n_anomalies, r.needs_review) for r in assessment.with_layers(done, ev, ids(), ids(), latest).collect()}
    assert got == {"i": (1, 0, 0, False), "j": (0, 0, 0, True)}
    got = {r.item_id: (r.n_findings, r.n_anomalies, r.needs_review) for r in assessment.with_layers(done, ev, ids(1, 1), ids(3), latest).collect()}
    assert got == {"i": (2, 0, True), "j": (0, 1, True)}
    s = lambda rows: spark.createDataFrame(rows, "k int, status string")
    r = assessment.scores(s([(1, "Complete"), (2, "Insufficient"), (3, "Under review"), (4, "Complete")]), s([(1, "Complete"), (2, "Under review"), (4, "Insufficient")]), ["k"]).first()
    assert tuple(r) == (4, 1, 0.25, 0.5, 0.5, 0.5, 3)
    assert tuple(assessment.scores(s([]), s([]), ["k"]).first()) == (0, 0, None, 1.0, 1.0, 1.0, 0)


def test_the_list_of_the_plans_reads_as_its_lines():
    from quaystone.plans.assessment import CLAUSES, TITLES, request_lines

    assert len(TITLES) == 30 and sum("Acceptance:" in x[2] for x in request_lines()) == sum(bool(CLAUSES[i % 10]) for i in range(30))
