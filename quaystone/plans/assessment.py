"""Queries of request lists, matching and assessment over the test tables, with the SQL they are held against.

The test tables hold no request list, so one is given here as text. Documents are the evidence of the item that they refer to, in the
engagement of their data room's number modulo twenty, under a file name made of their kind and a year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.mailids import path_key
from quaystone.operators import assessment, facts, gate, matching, segments, threads, versions
from quaystone.plans import evidence
from quaystone.session import table
from quaystone.sources import requests

# what is asked for: ten clauses that the items of the list take in turn
CLAUSES = (
    "entity=consolidated, as_of=2026-06-30, standard=ASC 606",
    "period=FY2026, reconciles_to_gl=true",
    "period_start=2026-01-01, period_end=2026-06-30, must_include=[bank reconciliation, statements]",
    "signed_by=CFO, as_of=report_date",
    "buckets=[current, 31-60, over 90], threshold_usd=5000",
    "min_customers=40, standard=ASC 842",
    "sample_size=30, signed=true",
    "entity=all subsidiaries, must_cover_all_accounts=true, horizon_months=12",
    "must_include=[lease schedule], reconciles_to_tb=true, as_of=2025-12-31",
    "",
)
TITLES = (
    "Trial balance|General", "Bank reconciliations|Cash", "Accounts receivable aging|Receivables", "Allowance memo|Receivables", "Inventory count sheets|Inventory", "Fixed asset register|Fixed assets", "Depreciation schedule|Fixed assets", "Lease schedule|Leases", "Accounts payable listing|Payables", "Accrual support|Payables",
    "Payroll register|Payroll", "Officer compensation|Payroll", "Loan agreement|Debt", "Covenant certificate|Debt", "Revenue contracts|Revenue", "Cutoff testing|Revenue", "Sales tax returns|Tax", "Income tax provision|Tax", "Board minutes|Governance", "Representation letter|Governance",
    "Legal letters|Legal", "Insurance certificates|Legal", "Related party listing|Governance", "Equity rollforward|Equity", "Stock plan|Equity", "Journal entry listing|General", "Budget to actual|General", "Vendor master file|Payables", "Retainer confirmations|Cash", "Subsequent events|General",
)


def request_lines() -> list[tuple[str, int, str]]:
    """The request list as lines of text, in the form that sources.requests reads."""
    out: list[str] = []
    for i, title in enumerate(TITLES):
        what, category = title.split("|")
        out += [f"PBC-{i + 1} [{category}] Priority: {('High', 'Medium', 'Low')[i % 3]}", f"{what} for the year.", "Confidential - do not forward"]
        if CLAUSES[i % len(CLAUSES)]:
            out.append(f"Acceptance: {CLAUSES[i % len(CLAUSES)]}")
    return [("list", n, line) for n, line in enumerate(out)]


def _items(spark: SparkSession) -> DataFrame:
    return requests.request_items(spark.createDataFrame(request_lines(), "list string, line_no int, line string"))


def _criteria(spark: SparkSession) -> DataFrame:
    return requests.criteria(_items(spark))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    room = F.substring("source", 10, 9).try_cast("int")
    docs = table(spark, d, "documents").where("item_ref is not null")
    return docs.select(F.concat(F.lit("ENG-00-"), F.lpad((room % 20).cast("string"), 5, "0")).alias("engagement_id"), F.col("item_ref").alias("item_id"), "doc_id", F.concat("doc_kind", F.when(F.col("doc_id") % 3 == 0, F.lit("_FY26_final.txt")).otherwise(F.lit(".txt"))).alias("filename"), "text")


def _years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "engagements").select("engagement_id", F.date_add(F.add_months("fiscal_year_end", -12), 1).alias("fy_start"), F.col("fiscal_year_end").alias("fy_end"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("engagement_id", "entity_id", "entity_name", (F.col("entity_role") == "parent").alias("is_parent"))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return assessment.checks(_criteria(spark), _evidence(spark, d), _years(spark, d), _entities(spark, d))


def criteria_parsed(spark: SparkSession, d: str) -> DataFrame:
    """The clauses of the request list, read from its text."""
    return _criteria(spark).select("item_id", F.col("ordinal").cast("long").alias("ordinal"), "kind", "raw")


def criteria_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _criteria(spark).groupBy("kind").agg(F.count("*").alias("n"))


def assess_checks(spark: SparkSession, d: str) -> DataFrame:
    return _checks(spark, d).select("engagement_id", "item_id", F.col("ordinal").cast("long").alias("ordinal"), "kind", "outcome", "hard")


def assess_items(spark: SparkSession, d: str) -> DataFrame:
    docs = _evidence(spark, d)
    return assessment.assess(docs.join(_years(spark, d), "engagement_id", "left_semi"), _checks(spark, d)).select("engagement_id", "item_id", "n_docs", "status", "confidence", "n_open")


def assess_reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Assessed items with their superseded versions, personal numbers and names that content belies."""
    docs = _evidence(spark, d).join(_years(spark, d), "engagement_id", "left_semi")
    found = gate.scan(docs, "doc_id", "text")
    stale = docs.where(F.col("filename").rlike(versions.FINAL_WORDS) & facts.is_draft(F.col("text"))).select("doc_id")
    order = versions.version_groups(docs.select("doc_id", "filename"))
    done = assessment.with_layers(assessment.assess(docs, _checks(spark, d)), docs, found, stale, order)
    return done.select("engagement_id", "item_id", "n_superseded", "n_findings", "n_anomalies", "needs_review")


def assess_states(spark: SparkSession, d: str) -> DataFrame:
    """Items of the list in each state, states and items without evidence included."""
    dim = spark.createDataFrame([(s,) for s in ("Not started", "Received", "Complete", "Under review", "Insufficient")], "status string")
    due = table(spark, d, "engagements").select("engagement_id", F.explode(F.array(*[F.lit(f"PBC-{i + 1:02d}") for i in range(len(TITLES))])).alias("item_id"))
    n = due.join(assess_items(spark, d), ["engagement_id", "item_id"], "left").groupBy(F.coalesce("status", F.lit("Not started")).alias("status")).agg(F.count("*").alias("n"))
    return dim.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def assess_scores(spark: SparkSession, d: str) -> DataFrame:
    """The assessed states against labels: every item of an odd number is said to be complete, every other insufficient."""
    got = assess_items(spark, d)
    labels = got.select("engagement_id", "item_id", F.when(F.substring("item_id", 5, 2).cast("int") % 2 == 1, "Complete").otherwise("Insufficient").alias("status"))
    return assessment.scores(labels, got, ["engagement_id", "item_id"])


def report_items(spark: SparkSession, d: str) -> DataFrame:
    """One JSON line for each assessed item: its state, confidence, and checks in order."""
    docs = _evidence(spark, d).join(_years(spark, d), "engagement_id", "left_semi")
    checked = _checks(spark, d)
    listed = checked.groupBy("engagement_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "outcome"))).alias("cs"))
    j = assessment.assess(docs, checked).join(listed, ["engagement_id", "item_id"], "left")
    checks = F.coalesce(F.transform("cs", lambda c: F.concat_ws(":", c["kind"], c["outcome"])), F.array().cast("array<string>"))
    return j.select("engagement_id", "item_id", F.to_json(F.struct(F.col("item_id").alias("id"), "status", F.col("n_docs").alias("documents"), checks.alias("checks"))).alias("report"))


def match_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The item that the name of each distinct file belongs to, if one scores enough."""
    files = table(spark, d, "occurrences").where("filename is not null").select("filename").distinct().select(F.xxhash64("filename").alias("file_key"), "filename")
    items = _items(spark).select(F.substring("item_id", 5, 2).cast("long").alias("item_id"), matching.tokens(F.concat_ws(" ", "category", "description", "acceptance")).alias("tokens"))
    best = matching.best_items(files.select("file_key", matching.evidence_tokens(F.col("filename")).alias("tokens")), items, "file_key", 1)
    return best.where(F.col("score") >= matching.LEAST_SCORE).join(files, "file_key").select("filename", "item_id", "score")


def match_named(spark: SparkSession, d: str) -> DataFrame:
    """The best item for the text of each span that names requests, which count for it, among the first twenty items only."""
    said = F.transform(facts.request_refs(F.col("snippet")), lambda r: F.substring(r, 5, 2).cast("long"))
    asked = table(spark, d, "spans").where(F.size(said) > 0).select("span_id", matching.tokens(F.col("snippet")).alias("tokens"), said.alias("refs"), F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long")).alias("allowed"))
    items = _items(spark).select(F.substring("item_id", 5, 2).cast("long").alias("item_id"), matching.tokens(F.concat_ws(" ", "category", "description")).alias("tokens"))
    return matching.best_items(asked, items, "span_id", 1).select("span_id", "item_id")


def match_overlap(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "occurrences").where("filename is not null").select("filename").distinct().select("filename", matching.tokens(F.col("filename")).alias("tokens"))
    items = _items(spark).select("item_id", matching.tokens(F.concat_ws(" ", "category", "description")).alias("tokens"))
    return matching.overlap(files, items, "filename")


def sheet_places(spark: SparkSession, d: str) -> DataFrame:
    return segments.sheet_segments(table(spark, d, "sheets")).select("sheet_id", "seg_no", "locator")


def gate_places(spark: SparkSession, d: str) -> DataFrame:
    """Personal numbers in sheets with the place they stand in."""
    s = segments.sheet_segments(table(spark, d, "sheets"))
    return gate.scan(s, "sheet_id", "text").join(s.select("sheet_id", "doc_id", "locator"), "sheet_id").groupBy("doc_id", "locator", "pii_type").agg(F.count("*").alias("n"))


def fact_order(spark: SparkSession, d: str) -> DataFrame:
    """Facts of spans in the order in which they count: dates by form, amounts, standards."""
    text = F.col("snippet")
    kind = lambda no, xs: F.transform(xs, lambda x, i: F.struct(F.lit(no).alias("kind_no"), (i + 1).cast("long").alias("ord"), x.alias("value")))
    found = F.concat(kind(1, F.transform(facts.dates(text), lambda f: f["value"].cast("string"))), kind(2, F.transform(facts.amounts(text), lambda v: v.cast("decimal(20,2)").cast("string"))), kind(3, facts.standards(text)))
    return table(spark, d, "spans").select("span_id", "locator", F.explode(found).alias("f")).select("span_id", "locator", "f.*")


def fact_reschedules(spark: SparkSession, d: str) -> DataFrame:
    """The day to which each request of an engagement was last put off in its mail."""
    m = table(spark, d, "messages").join(table(spark, d, "engagements").select("engagement_id", F.year("fiscal_year_end").alias("fy")), "engagement_id")
    put = facts.reschedules(m.select("delivery_id", "body_text", "fy"), "delivery_id", "body_text", "fy").where("expected_by is not null")
    j = put.join(m.select("delivery_id", "engagement_id"), "delivery_id")
    return versions.last_per_key(j, ["engagement_id", "request"], ["delivery_id"], "expected_by").select("engagement_id", "request", F.col("expected_by").cast("string").alias("expected_by"))


def fact_caveats(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of mail that call something open, with a request of the list that they name."""
    asked = spark.createDataFrame([(f"PBC-{i + 1:02d}",) for i in range(len(TITLES))], "request string")
    found = facts.caveats(table(spark, d, "messages"), "delivery_id", "body_text")
    return found.join(asked.withColumn("known", F.lit(True)), "request", "left").groupBy("delivery_id").agg(F.count("*").alias("n_open"), F.count("known").alias("n_named"))


def thread_names(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    return threads.thread_ids(m, evidence.thread_components(spark, d))


def thread_of_files(spark: SparkSession, d: str) -> DataFrame:
    """The thread that brought each attachment, `?` where its mail isn't there."""
    m = table(spark, d, "messages")
    place = evidence.thread_components(spark, d)
    named = threads.thread_ids(m, place).join(place, "thread_key").join(m.select("delivery_id", path_key(F.col("source_path")).alias("p")), "delivery_id").where("p is not null").groupBy("p").agg(F.min("thread_id").alias("thread_id"))
    o = table(spark, d, "occurrences").select("occ_id", path_key(F.col("message_source")).alias("p"))
    return o.join(named, "p", "left").select("occ_id", F.coalesce("thread_id", F.lit("?")).alias("thread_id"))


def anomaly_entity_name(spark: SparkSession, d: str) -> DataFrame:
    """Files named for an entity of the engagement that sent them of which none of their spans speaks."""
    squash = lambda c: F.regexp_replace(F.lower(c), "[_ -]", "")
    sent = table(spark, d, "messages").select(path_key(F.col("source_path")).alias("p"), "engagement_id").where("p is not null and engagement_id is not null").distinct()
    files = table(spark, d, "occurrences").where("filename is not null").select("doc_id", "filename", path_key(F.col("message_source")).alias("p")).join(sent, "p").select("doc_id", "filename", "engagement_id").distinct()
    short = F.array_sort(facts.aliases(F.col("entity_name")), lambda a, b: F.length(a) - F.length(b))
    known = table(spark, d, "entities").where("entity_name is not null").select("engagement_id", "entity_id", F.regexp_replace(F.get(short, 0), " ", "").alias("alias")).where("length(alias) >= 8")
    hit = files.join(known, "engagement_id").where(F.contains(squash(F.col("filename")), F.col("alias"))).groupBy("doc_id", "filename", "engagement_id").agg(F.min(F.struct("entity_id", "alias")).alias("e"))
    said = table(spark, d, "spans").select("doc_id", squash(F.col("snippet")).alias("s"))
    near = hit.join(said, "doc_id", "left").groupBy("doc_id", "filename", F.col("e.entity_id").alias("entity_id")).agg(F.count("s").alias("n_spans"), F.coalesce(F.bool_or(F.contains("s", F.col("e.alias"))), F.lit(False)).alias("said"))
    return near.where("n_spans > 0 and not said").select("doc_id", "filename", "entity_id")


QUERIES = {
    f.__name__: f
    for f in (
        criteria_parsed, criteria_kinds, assess_checks, assess_items, assess_reviewed, assess_states, assess_scores, report_items, match_evidence, match_named, match_overlap, sheet_places, gate_places, fact_order,
        fact_reschedules, fact_caveats, thread_names, thread_of_files, anomaly_entity_name,
    )
}

_ITEMS = ", ".join(f"({i + 1}, '{t.split('|')[1]}', '{t.split('|')[0]} for the year.', '{CLAUSES[i % len(CLAUSES)]}')" for i, t in enumerate(TITLES))
_LIST = f"it AS (SELECT i, 'PBC-' || lpad(i::VARCHAR, 2, '0') AS item_id, category, description, acceptance FROM (VALUES {_ITEMS}) t(i, category, description, acceptance))"
# the criteria of the ten clauses: turn, ordinal, kind, raw
_READ = """(VALUES (1, 0, 'period', 'as_of=2026-06-30'), (1, 1, 'entity', 'entity=consolidated'), (1, 2, 'standard', 'standard=ASC 606'), (2, 0, 'period', 'period=FY2026'), (2, 1, 'reconciles', 'reconciles_to_gl=true'),
 (3, 0, 'period', 'period'), (3, 1, 'include', 'must_include=[bank reconciliation, statements]'), (4, 0, 'period', 'as_of=report_date'), (4, 1, 'signature', 'signed_by=CFO'), (5, 0, 'bucket', 'buckets=[current, 31-60, over 90]'), (5, 1, 'threshold', 'threshold_usd=5000'),
 (6, 0, 'count', 'min_customers=40'), (6, 1, 'standard', 'standard=ASC 842'), (7, 0, 'count', 'sample_size=30'), (7, 1, 'signature', 'signed=true'), (8, 0, 'entity', 'entity=all subsidiaries'), (8, 1, 'count', 'must_cover_all_accounts=true'), (8, 2, 'horizon', 'horizon_months=12'),
 (9, 0, 'period', 'as_of=2025-12-31'), (9, 1, 'include', 'must_include=[lease schedule]'), (9, 2, 'reconciles', 'reconciles_to_tb=true')) c(turn, ordinal, kind, raw)"""
_CRIT = f"cr AS (SELECT item_id, turn, ordinal::BIGINT AS ordinal, kind, raw FROM it JOIN {_READ} ON turn = (i - 1) % 10 + 1)"
_DOCS = r"""
ev AS (SELECT 'ENG-00-' || lpad((try_cast(substr(source, 10) AS INT) % 20)::VARCHAR, 5, '0') AS engagement_id, item_ref AS item_id, doc_id, doc_kind || CASE WHEN doc_id % 3 = 0 THEN '_FY26_final.txt' ELSE '.txt' END AS filename, text FROM documents WHERE item_ref IS NOT NULL),
fy AS (SELECT engagement_id, ((fiscal_year_end - INTERVAL 12 MONTH)::DATE + 1) AS a, fiscal_year_end AS b FROM engagements)"""
_CHECKS = rf"""
dd AS (SELECT doc_id, value AS v FROM ({evidence._DATES.format(key='doc_id', text='text', table='documents')}) WHERE value IS NOT NULL),
dy AS (SELECT doc_id, engagement_id, bool_or(v = DATE '2026-06-30') AS e1, bool_or(v = DATE '2025-12-31') AS e9, bool_or(v BETWEEN a AND b) AS fyd, bool_or(v BETWEEN (a - INTERVAL 12 MONTH)::DATE AND (b - INTERVAL 12 MONTH)::DATE) AS pr, bool_or(v BETWEEN DATE '2026-01-01' AND DATE '2026-06-30') AS rg FROM dd JOIN ev USING (doc_id) JOIN fy USING (engagement_id) GROUP BY ALL),
tx AS (SELECT engagement_id, item_id, doc_id, filename, coalesce(text, '') AS x, lower(coalesce(text, '')) AS low FROM ev JOIN fy USING (engagement_id)),
st AS (SELECT *, regexp_extract(low, '{assessment.AS_OF}', 1) AS ao FROM tx),
sd AS (SELECT *, coalesce(try_strptime(regexp_extract(ao, '\d{{4}}-\d{{2}}-\d{{2}}'), '%Y-%m-%d'), CASE WHEN regexp_matches(ao, '(?i)^(?:{facts.MONTH})\b') THEN try_strptime(regexp_replace(regexp_replace(ao, '[.,]', ' ', 'g'), '\s+', ' ', 'g'), '%B %d %Y') END, try_strptime(regexp_extract(ao, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}'), '%m/%d/%Y'))::DATE AS stated FROM st),
ag AS (SELECT engagement_id, item_id, count(DISTINCT doc_id) AS units, coalesce(bool_or(e1), false) AS e1, coalesce(bool_or(e9), false) AS e9, coalesce(bool_or(fyd), false) AS fyd, coalesce(bool_or(pr), false) AS pr, coalesce(bool_or(rg), false) AS rg, arg_min(stated, doc_id) FILTER (stated IS NOT NULL) AS stated,
  bool_or(contains(low, '2026-06-30') OR contains(low, '6/30/2026') OR contains(low, 'june 30, 2026')) AS r1, bool_or(contains(low, '2025-12-31') OR contains(low, '12/31/2025') OR contains(low, 'december 31, 2025')) AS r9,
  bool_or(regexp_matches(low, '{assessment.FISCAL}')) AS fw, bool_or(regexp_matches(lower(filename), '{assessment.NAME_PERIOD}')) AS fn, bool_or(regexp_matches(low, '{assessment.GROUP}')) AS gw, bool_or(regexp_matches(low, '{assessment.RECONCILED}')) AS rc,
  bool_or(regexp_matches(x, '{facts.SIGNED}') AND NOT regexp_matches(x, '(?i){evidence._DRAFT}')) AS sg, bool_or(regexp_matches(x, '(?i){evidence._DRAFT}')) AS dr,
  bool_or(contains(low, 'current')) AND bool_or(contains(low, '31-60')) AND bool_or(contains(low, 'over 90')) AS bk, bool_or(contains(low, 'bank')) AND bool_or(contains(low, 'reconciliation')) AND bool_or(contains(low, 'statements')) AS i3, bool_or(contains(low, 'lease')) AND bool_or(contains(low, 'schedule')) AS i9,
  bool_or(regexp_matches(x, '(?i)\bASC\s?606\b')) AS s1, bool_or(regexp_matches(x, '(?i)\bASC\s?842\b')) AS s6, bool_or(regexp_matches(low, '12[\s-]?month|12 months|twelve[\s-]?month')) AS hz,
  max(list_max(list_transform(list_concat(regexp_extract_all(low, '(\d+)\s+customers?\b', 1), regexp_extract_all(low, '(?:sample of|top)\s+(\d+)', 1)), lambda n: try_cast(n AS BIGINT)))) AS c6, max(list_max(list_transform(list_concat(regexp_extract_all(low, '(\d+)\s+items?\b', 1), regexp_extract_all(low, '(?:sample of|top)\s+(\d+)', 1)), lambda n: try_cast(n AS BIGINT)))) AS c7
  FROM sd LEFT JOIN dy USING (doc_id, engagement_id) GROUP BY ALL),
ea AS (SELECT engagement_id, entity_id, entity_role, unnest({evidence._ALIASES}) AS al FROM entities WHERE entity_name IS NOT NULL),
em AS (SELECT DISTINCT t.engagement_id, t.item_id, entity_id FROM tx t JOIN ea ON t.engagement_id = ea.engagement_id AND al <> '' AND contains(t.low, al)),
en AS (SELECT engagement_id, count(DISTINCT entity_id) AS want FROM entities WHERE entity_id IS NOT NULL GROUP BY ALL),
ef AS (SELECT engagement_id, item_id, count(DISTINCT entity_id) AS have, bool_or(coalesce(entity_role = 'parent', false)) AS par FROM em JOIN entities USING (engagement_id, entity_id) GROUP BY ALL),
al AS (SELECT ag.*, coalesce(want, 0) AS want, coalesce(have, 0) AS have, coalesce(par, false) AS par FROM ag LEFT JOIN en USING (engagement_id) LEFT JOIN ef USING (engagement_id, item_id)),
ck AS (SELECT engagement_id, al.item_id, ordinal, kind, CASE
  WHEN turn = 1 AND kind = 'period' THEN CASE WHEN e1 THEN 'pass' WHEN year(stated) <> 2026 THEN 'fail' WHEN r1 OR fyd THEN 'pass' ELSE 'unverifiable' END
  WHEN turn = 9 AND kind = 'period' THEN CASE WHEN e9 THEN 'pass' WHEN year(stated) <> 2025 THEN 'fail' WHEN r9 OR fyd THEN 'pass' ELSE 'unverifiable' END
  WHEN turn = 2 AND kind = 'period' THEN CASE WHEN fyd OR fw THEN 'pass' WHEN pr THEN 'fail' WHEN fn THEN 'pass' ELSE 'unverifiable' END
  WHEN turn = 3 AND kind = 'period' THEN CASE WHEN rg THEN 'pass' WHEN pr THEN 'fail' ELSE 'unverifiable' END
  WHEN turn = 4 AND kind = 'period' THEN 'unverifiable'
  WHEN turn = 1 AND kind = 'entity' THEN CASE WHEN want = 0 OR have = want OR (par AND gw) THEN 'pass' WHEN have > 0 THEN 'fail' ELSE 'unverifiable' END
  WHEN kind = 'entity' THEN CASE WHEN want = 0 OR have > 0 THEN 'pass' ELSE 'unverifiable' END
  WHEN kind = 'standard' THEN CASE WHEN (turn = 1 AND s1) OR (turn = 6 AND s6) THEN 'pass' ELSE 'unverifiable' END
  WHEN kind = 'reconciles' THEN CASE WHEN rc THEN 'pass' ELSE 'unverifiable' END
  WHEN kind = 'include' THEN CASE WHEN (turn = 3 AND i3) OR (turn = 9 AND i9) THEN 'pass' ELSE 'unverifiable' END
  WHEN kind = 'signature' THEN CASE WHEN sg THEN 'pass' ELSE 'fail' END
  WHEN kind = 'bucket' THEN CASE WHEN bk THEN 'pass' ELSE 'fail' END
  WHEN kind = 'threshold' THEN 'unverifiable'
  WHEN kind = 'horizon' THEN CASE WHEN hz THEN 'pass' ELSE 'unverifiable' END
  WHEN turn = 6 THEN CASE WHEN c6 > units OR units < 40 THEN 'fail' ELSE 'pass' END
  WHEN turn = 7 THEN CASE WHEN c7 > units THEN 'fail' ELSE 'pass' END
  ELSE 'pass' END AS outcome, dr FROM al JOIN cr ON cr.item_id = al.item_id),
ch AS (SELECT engagement_id, item_id, ordinal, kind, outcome, outcome = 'fail' AND (kind IN ('entity', 'bucket', 'period') OR kind = 'signature' AND NOT dr) AS hard FROM ck),
ai AS (SELECT engagement_id, item_id, units AS n_docs, CASE WHEN coalesce(nh, 0) > 0 THEN 'Insufficient' WHEN nf > 0 THEN 'Under review' WHEN np > 0 THEN 'Complete' ELSE 'Received' END AS status, CASE WHEN n IS NULL THEN 0.5::DOUBLE ELSE round_even(0.5 + 0.5 * np / n, 2) END AS confidence, coalesce(n - np, 0) AS n_open
  FROM ag LEFT JOIN (SELECT engagement_id, item_id, count(*) AS n, count_if(outcome = 'pass') AS np, count_if(outcome = 'fail') AS nf, count_if(hard) AS nh FROM ch GROUP BY ALL) USING (engagement_id, item_id))"""
_ASSESSED = f"{_LIST}, {_CRIT}, {_DOCS}, {_CHECKS}"
_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_SHORT = ", ".join(f"('{k}', '{v}')" for k, v in matching.SHORTHANDS.items())


def _bm25(items: str, asked: str) -> str:
    """Scores of asked (k, w, n) against items (i, w)."""
    return f"""b AS ({items}), tf AS (SELECT i, w, count(*) AS n FROM b GROUP BY ALL), sz AS (SELECT i, count(*) AS size FROM b GROUP BY i), m AS (SELECT avg(size) AS mean, count(*) AS items FROM sz),
idf AS (SELECT w, ln(items - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, m GROUP BY w, items), fl AS (SELECT 0.25 * avg(idf) AS floor FROM idf),
wt AS (SELECT w, i, (CASE WHEN idf >= 0 THEN idf ELSE floor END) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * size / mean)) AS s FROM tf JOIN idf USING (w) JOIN sz USING (i), m, fl),
q AS ({asked}), sc AS (SELECT k, i, round(sum(n * s), 6) AS score FROM q JOIN wt USING (w) GROUP BY ALL)"""


SQL = {
    "criteria_parsed": f"WITH {_LIST}, {_CRIT} SELECT item_id, ordinal, kind, raw FROM cr",
    "criteria_kinds": f"WITH {_LIST}, {_CRIT} SELECT kind, count(*) AS n FROM cr GROUP BY kind",
    "assess_checks": f"WITH {_ASSESSED} SELECT engagement_id, item_id, ordinal, kind, outcome, hard FROM ch",
    "assess_items": f"WITH {_ASSESSED} SELECT engagement_id, item_id, n_docs, status, confidence, n_open FROM ai",
    "assess_states": f"WITH {_ASSESSED}, n AS (SELECT coalesce(status, 'Not started') AS status, count(*) AS k FROM (SELECT engagement_id, item_id FROM engagements, it) LEFT JOIN ai USING (engagement_id, item_id) GROUP BY ALL) SELECT s AS status, coalesce(k, 0) AS n FROM (VALUES ('Not started'), ('Received'), ('Complete'), ('Under review'), ('Insufficient')) t(s) LEFT JOIN n ON n.status = s",
    "assess_scores": f"""WITH {_ASSESSED}, l AS (SELECT *, CASE WHEN substr(item_id, 5, 2)::INT % 2 = 1 THEN 'Complete' ELSE 'Insufficient' END AS want FROM ai),
c AS (SELECT count(*) AS labeled, count_if(want = status) AS correct, count_if(want = 'Insufficient' AND status IN ('Under review', 'Insufficient')) AS tp, count_if(want <> 'Insufficient' AND status IN ('Under review', 'Insufficient')) AS fp, count_if(want = 'Insufficient' AND status NOT IN ('Under review', 'Insufficient')) AS fn FROM l),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS r FROM c)
SELECT labeled, correct::BIGINT AS correct, CASE WHEN labeled > 0 THEN round(correct / labeled, 3) END AS accuracy, round(p, 3) AS precision, round(r, 3) AS recall, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE round(2 * p * r / (p + r), 3) END AS f1, (labeled - correct)::BIGINT AS mismatched FROM p""",
    "report_items": f"""WITH {_ASSESSED}, l AS (SELECT engagement_id, item_id, list(kind || ':' || outcome ORDER BY ordinal) AS cs FROM ch GROUP BY ALL)
SELECT engagement_id, item_id, to_json({{'id': item_id, 'status': status, 'documents': n_docs, 'checks': coalesce(cs, [])}})::VARCHAR AS report FROM ai LEFT JOIN l USING (engagement_id, item_id)""",
    "assess_reviewed": rf"""WITH {_ASSESSED}, r AS (SELECT doc_id, filename, {evidence._KEY} AS key, CASE WHEN regexp_matches(lower(filename), 'final|real') THEN 2 WHEN lower(filename) LIKE '%draft%' THEN -1 ELSE 0 END AS level, coalesce(try_cast(regexp_extract(filename, '(?i)v(?:ersion)?\s*(\d+)', 1) AS INT), 0) AS number FROM tx),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY key ORDER BY level, number, filename, doc_id) < count(*) OVER (PARTITION BY key) AS old FROM r),
p AS (SELECT doc_id, {" + ".join(f"len(regexp_extract_all(x, '{q}'))" for _, q in gate.PATTERNS)} AS f, regexp_matches(filename, '{versions.FINAL_WORDS}') AND regexp_matches(x, '(?i){evidence._DRAFT}') AS a FROM tx),
g AS (SELECT engagement_id, item_id, count_if(old)::BIGINT AS n_superseded, sum(f)::BIGINT AS n_findings, count_if(a)::BIGINT AS n_anomalies FROM tx JOIN o USING (doc_id) JOIN p USING (doc_id) GROUP BY ALL)
SELECT engagement_id, item_id, n_superseded, n_findings, n_anomalies, n_findings > 0 OR n_anomalies > 0 OR confidence < 0.6 AS needs_review FROM g JOIN ai USING (engagement_id, item_id)""",
    "match_evidence": f"""WITH {_LIST}, sh AS (SELECT * FROM (VALUES {_SHORT}) t(w, long)), f AS (SELECT DISTINCT filename FROM occurrences WHERE filename IS NOT NULL), t AS (SELECT filename AS k, unnest({_WORDS.format('filename')}) AS w FROM f),
{_bm25(f"SELECT i, unnest({_WORDS.format(chr(39).join(['category || ', ' ', ' || description || ', ' ', ' || acceptance']))}) AS w FROM it", f"SELECT k, w, 3 * count(*) AS n FROM (SELECT k, w FROM t UNION ALL SELECT k, unnest({_WORDS.format('long')}) FROM t JOIN sh USING (w)) GROUP BY ALL")}
SELECT k AS filename, i::BIGINT AS item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, i) AS r FROM sc) WHERE r = 1 AND score >= 1.5""",
    "match_overlap": f"""WITH {_LIST}, h AS (SELECT DISTINCT item_id, unnest({_WORDS.format("category || ' ' || description")}) AS w FROM it), t AS (SELECT filename, {_WORDS.format('filename')} AS ws FROM (SELECT DISTINCT filename FROM occurrences WHERE filename IS NOT NULL)), u AS (SELECT filename, len(ws) AS n, unnest(ws) AS w FROM t)
SELECT filename, item_id, round(count(*) / n, 6) AS score FROM u JOIN h USING (w) GROUP BY filename, item_id, n""",
    "sheet_places": "SELECT sheet_id, row_number() OVER (PARTITION BY doc_id ORDER BY sheet_id) - 1 AS seg_no, 'sheet ''' || coalesce(sheet_name, '') || '''' AS locator FROM sheets",
    "gate_places": f"SELECT doc_id, 'sheet ''' || coalesce(sheet_name, '') || '''' AS locator, pii_type, count(*) AS n FROM ({evidence._GATE}) JOIN sheets USING (sheet_id) GROUP BY ALL",
    "fact_order": rf"""WITH d AS (SELECT span_id, pat_no, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM (SELECT span_id, 1 AS pat_no, list_transform(regexp_extract_all(coalesce(snippet, ''), '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1), lambda x: try_strptime(x, '%Y-%m-%d')) AS v FROM spans
UNION ALL SELECT span_id, 2, list_transform(regexp_extract_all(coalesce(snippet, ''), '(?i)\b((?:{facts.MONTH})\.?\s+\d{{1,2}},?\s+\d{{4}})\b', 1), lambda x: try_strptime(regexp_replace(regexp_replace(x, '[.,]', ' ', 'g'), '\s+', ' ', 'g'), '%B %d %Y')) FROM spans
UNION ALL SELECT span_id, 3, list_transform(regexp_extract_all(coalesce(snippet, ''), '\b(\d{{1,2}}/\d{{1,2}}/\d{{4}})\b', 1), lambda x: try_strptime(x, '%m/%d/%Y')) FROM spans)),
f AS (SELECT span_id, 1 AS kind_no, row_number() OVER (PARTITION BY span_id ORDER BY pat_no, k) AS ord, x::DATE::VARCHAR AS value FROM d WHERE x IS NOT NULL
UNION ALL SELECT span_id, 2, generate_subscripts(a, 1), unnest(a)::DECIMAL(20,2)::VARCHAR FROM (SELECT span_id, {evidence._AMOUNTS.replace('text', 'snippet')} AS a FROM spans)
UNION ALL SELECT span_id, 3, generate_subscripts(s, 1), 'ASC ' || unnest(s) FROM (SELECT span_id, regexp_extract_all(coalesce(snippet, ''), '{facts.STANDARD}', 1) AS s FROM spans))
SELECT span_id, locator, kind_no, ord, value FROM f JOIN spans USING (span_id)""",
    "fact_reschedules": rf"""WITH m AS (SELECT delivery_id, engagement_id, year(fiscal_year_end) AS fy, coalesce(body_text, '') AS x FROM messages JOIN engagements USING (engagement_id)),
t AS (SELECT *, 'PBC-' || lpad(regexp_extract(x, '{facts.REQUEST}', 1)::INT::VARCHAR, 2, '0') AS request, regexp_extract(x, '{facts.DAY_PHRASE}', 1) AS p FROM m WHERE regexp_matches(x, '{facts.RESCHEDULED}') AND regexp_matches(x, '{facts.REQUEST}') AND regexp_matches(x, '{facts.DAY_PHRASE}')),
u AS (SELECT *, CASE WHEN regexp_matches(p, '\d{{4}}-') THEN try_strptime(p, '%Y-%m-%d') ELSE try_strptime(regexp_replace(p, '\s+', ' ', 'g') || ' ' || fy, '%B %d %Y') END::DATE AS day FROM t)
SELECT engagement_id, request, arg_max(day, delivery_id)::VARCHAR AS expected_by FROM u WHERE day IS NOT NULL GROUP BY ALL""",
    "fact_caveats": rf"""WITH s AS (SELECT delivery_id, unnest(string_split(regexp_replace(coalesce(body_text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS s FROM messages),
o AS (SELECT delivery_id, regexp_extract(s, '{facts.REQUEST}', 1) AS r FROM s WHERE trim(s) <> '' AND ({" OR ".join(f"contains(lower(s), '{p}')" for p in facts.OPEN_PHRASES)}) AND NOT ({" OR ".join(f"contains(lower(s), '{p}')" for p in facts.RESOLVED_PHRASES)}))
SELECT delivery_id, count(*) AS n_open, count(CASE WHEN try_cast(r AS INT) BETWEEN 1 AND {len(TITLES)} THEN 1 END) AS n_named FROM o GROUP BY delivery_id""",
    "thread_names": rf"""WITH RECURSIVE {evidence._THREADS}, h AS (SELECT thread_key, min(hint) AS lo, max(hint) AS hi FROM (SELECT thread_key, nullif(lower(regexp_extract(source_path, '(?i)(thread\d+)', 1)), '') AS hint FROM messages JOIN thread USING (delivery_id)) GROUP BY ALL)
SELECT thread_key, CASE WHEN lo = hi THEN lo ELSE 'thread' || CASE WHEN n < 10 THEN '0' ELSE '' END || n END AS thread_id FROM (SELECT *, row_number() OVER (ORDER BY thread_key) AS n FROM h)""",
    "thread_of_files": rf"""WITH RECURSIVE {evidence._THREADS}, h AS (SELECT thread_key, min(hint) AS lo, max(hint) AS hi FROM (SELECT thread_key, nullif(lower(regexp_extract(source_path, '(?i)(thread\d+)', 1)), '') AS hint FROM messages JOIN thread USING (delivery_id)) GROUP BY ALL),
i AS (SELECT thread_key, CASE WHEN lo = hi THEN lo ELSE 'thread' || CASE WHEN n < 10 THEN '0' ELSE '' END || n END AS thread_id FROM (SELECT *, row_number() OVER (ORDER BY thread_key) AS n FROM h)),
p AS (SELECT {evidence._PATH.format('source_path')} AS p, min(thread_id) AS thread_id FROM messages JOIN thread USING (delivery_id) JOIN i USING (thread_key) WHERE source_path IS NOT NULL GROUP BY 1)
SELECT occ_id, coalesce(thread_id, '?') AS thread_id FROM occurrences LEFT JOIN p ON p.p = {evidence._PATH.format('message_source')}""",
    "anomaly_entity_name": rf"""WITH s AS (SELECT DISTINCT {evidence._PATH.format('source_path')} AS p, engagement_id FROM messages WHERE source_path IS NOT NULL AND engagement_id IS NOT NULL),
f AS (SELECT DISTINCT doc_id, filename, engagement_id, regexp_replace(lower(filename), '[_ -]', '', 'g') AS sq FROM occurrences JOIN s ON s.p = {evidence._PATH.format('message_source')} WHERE filename IS NOT NULL),
a AS (SELECT engagement_id, entity_id, arg_min(al, length(al)) AS al FROM (SELECT engagement_id, entity_id, unnest({evidence._ALIASES}) AS al FROM entities WHERE entity_name IS NOT NULL) WHERE al <> '' GROUP BY ALL),
h AS (SELECT f.doc_id, f.filename, arg_min(a.entity_id, a.entity_id) AS entity_id, arg_min(replace(al, ' ', ''), a.entity_id) AS al FROM f JOIN a ON a.engagement_id = f.engagement_id AND length(replace(al, ' ', '')) >= 8 AND contains(sq, replace(al, ' ', '')) GROUP BY f.doc_id, f.filename, f.engagement_id),
n AS (SELECT h.doc_id, filename, entity_id, count(snippet) AS k, coalesce(bool_or(contains(regexp_replace(lower(snippet), '[_ -]', '', 'g'), al)), false) AS said FROM h LEFT JOIN spans USING (doc_id) GROUP BY ALL)
SELECT doc_id, filename, entity_id FROM n WHERE k > 0 AND NOT said""",
}
