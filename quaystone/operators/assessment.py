"""Declared criteria held against the evidence of an item, and what follows for the item.

Each document answers once for all criteria of its item, with flags of the JVM; an item's answer folds those flags, so
neither texts nor the documents of an item are ever put together. Everything is keyed by engagement and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.operators import facts

# Phrases by which a text states its date, names its period, a group, a reconciliation.
AS_OF = r"(?:as\s+of|as\s+at|period\s+end(?:ed|ing)|year\s+end(?:ed|ing)|balance\s+as\s+of)\s+([a-z]+\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})"
FISCAL = r"\bfy\s?\d{2,4}\b|fiscal year"
NAME_PERIOD = r"\bfy\s?\d{2,4}\b|\b20\d\d[-_]?\d\d[-_]?\d\d"
GROUP = r"subsidiar|consolidat"
RECONCILED = r"reconcil|variance|tie[\s-]?out"
NO_VARIANCE = r"variance[^0-9]{0,20}(0|0\.00|zero)"
ALL_ENTITIES = ("consolidated", "all", "all entities", "all subsidiaries")
HARD_KINDS = ("entity", "bucket", "period")
LEAST_CONFIDENCE = 0.6

_FIELDS = ("ordinal", "kind", "raw", "period_kind", "start", "end", "end_is_report_date", "scope_word", "signer_role", "number", "unit", "labels", "target")


def _rendered(day: Column) -> Column:
    """The ways in which a day is written, in lower case."""
    return F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "M/d/yyyy"), F.lower(F.date_format(day, "MMMM d, yyyy")))


def stated_day(low: Column) -> Column:
    """The day of the first `as of` phrase of a text in lower case, null if there is none or it is impossible."""
    return F.get(facts.dates(F.regexp_extract(low, AS_OF, 1)), 0)["value"]


def _phrase_words(labels: Column) -> Column:
    """Words of more than two letters of all phrases."""
    return F.array_distinct(F.flatten(F.transform(labels, lambda p: F.filter(F.regexp_extract_all(F.lower(p), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 2))))


def flags(criteria: DataFrame, evidence: DataFrame, years: DataFrame) -> DataFrame:
    """(engagement_id, item_id, doc_id, c, flags of each document for each criterion c of its item).

    criteria as sources.requests gives them, gathered by item: as many as one acceptance text has.
    """
    gathered = criteria.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("cs"))
    low, name = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("filename", F.lit("")))
    days = F.transform(facts.dates(F.col("text")), lambda s, i: F.struct(i.alias("i"), s["value"].alias("v")))
    sig = facts.signatures(F.col("text"))
    docs = evidence.select("engagement_id", "item_id", "doc_id", low.alias("low"), name.alias("name"), days.alias("days"), F.exists(sig, lambda s: s["signed"]).alias("signed"), F.exists(sig, lambda s: s["draft"]).alias("draft"), facts.standards(F.col("text")).alias("standards"))
    docs = docs.join(years, "engagement_id").join(gathered, "item_id").withColumn("stated", stated_day(F.col("low")))
    first = lambda ok: F.get(F.filter("days", lambda d: ok(d["v"])), 0)
    between = lambda a, b: lambda v: v.between(a, b)
    start, end = F.col("fy_start"), F.col("fy_end")

    def told(c: Column) -> Column:
        months = F.coalesce(c["number"].cast("int").cast("string"), F.lit("0"))
        stem = F.regexp_replace(F.coalesce(c["unit"], F.lit("item")), "s+$", "")
        return F.struct(
            c.alias("c"),
            F.coalesce(F.exists("days", lambda d: d["v"] == c["end"]), F.lit(False)).alias("exact"),
            first(between(start, end)).alias("in_fy"),
            first(between(F.add_months(start, -12), F.add_months(end, -12))).alias("prior"),
            first(between(F.coalesce(c["start"], start), F.coalesce(c["end"], end))).alias("in_range"),
            F.coalesce(F.exists(_rendered(c["end"]), lambda x: F.contains(F.col("low"), x)), F.lit(False)).alias("rendered"),
            F.coalesce(F.exists(_rendered(c["end"]), lambda x: F.contains(F.col("name"), x)), F.lit(False)).alias("in_name"),
            F.coalesce(F.filter(c["labels"], lambda x: F.contains(F.col("low"), F.lower(x))), F.array().cast("array<string>")).alias("held"),
            F.coalesce(F.filter(_phrase_words(c["labels"]), lambda w: F.contains(F.col("low"), w)), F.array().cast("array<string>")).alias("words"),
            F.coalesce(F.exists("standards", lambda s: F.upper(F.regexp_replace(s, " ", "")) == F.upper(F.regexp_replace(c["target"], " ", ""))), F.lit(False)).alias("standard"),
            F.regexp_like("low", F.concat(months, F.lit(r"[\s-]?month|"), months, F.lit(r" months|twelve[\s-]?month"))).alias("horizon"),
            facts.claimed_count(F.col("low"), stem).alias("claimed"),
        )

    rows = docs.select(
        "engagement_id", "item_id", "doc_id", "signed", "draft", F.when(F.col("stated").isNotNull(), F.struct("doc_id", F.col("stated").alias("v"))).alias("stated"),
        F.col("low").rlike(FISCAL).alias("fy_word"), F.col("name").rlike(NAME_PERIOD).alias("fy_name"), F.col("low").rlike(GROUP).alias("group_word"),
        F.col("low").rlike(RECONCILED).alias("reconciled"), F.col("low").rlike(NO_VARIANCE).alias("no_variance"), F.explode(F.transform("cs", told)).alias("t"),
    )
    return rows.select(*[c for c in rows.columns if c != "t"], "t.*")


def _entities_told(folded: DataFrame, evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """(engagement_id, item_id, ordinal, n_required, n_missing, first_missing, n_found, parent) of each criterion of entities."""
    met = facts.entity_mentions(evidence, entities, "engagement_id", "doc_id", "text").select("doc_id", "entity_id")
    met = evidence.select("engagement_id", "item_id", "doc_id").join(met, "doc_id").select("engagement_id", "item_id", "entity_id").distinct().withColumn("met", F.lit(1))
    asked = folded.where(F.col("c.kind") == "entity").select("engagement_id", "item_id", F.col("c.ordinal").alias("ordinal"), F.lower(F.trim(F.col("c.scope_word"))).alias("scope"))
    known = entities.where("entity_id is not null").select("engagement_id", "entity_id", "entity_name", F.coalesce("is_parent", F.lit(False)).alias("is_parent"), facts.aliases(F.col("entity_name")).alias("names"))
    j = asked.join(known, "engagement_id").join(met, ["engagement_id", "item_id", "entity_id"], "left")
    wanted = F.col("scope").isin(*ALL_ENTITIES) | F.array_contains("names", F.col("scope"))
    lost = wanted & F.col("met").isNull()
    return j.groupBy("engagement_id", "item_id", "ordinal").agg(
        F.count_if(wanted).alias("n_required"), F.count_if(lost).alias("n_missing"), F.min(F.when(lost, F.col("entity_name"))).alias("first_missing"), F.count("met").alias("n_found"), F.coalesce(F.bool_or(F.col("is_parent") & F.col("met").isNotNull()), F.lit(False)).alias("parent")
    )


def checks(criteria: DataFrame, evidence: DataFrame, years: DataFrame, entities: DataFrame) -> DataFrame:
    """(engagement_id, item_id, ordinal, kind, raw, outcome, hard, detail) of each criterion of an item that has evidence.

    evidence: (engagement_id, item_id, doc_id, filename, text); years: (engagement_id, fy_start, fy_end); entities:
    (engagement_id, entity_id, entity_name, is_parent). Evidence of an engagement without years has no rows, nor has an unknown kind. A
    null text or name holds nothing. A count that a text claims is read within a text, not across two.
    """
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    earliest = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("doc_id", F.col(f"{c}.i").alias("i"), F.col(f"{c}.v").alias("v"))))["v"].alias(c)
    folded = (
        flags(criteria, evidence, years)
        .groupBy("engagement_id", "item_id", F.col("c.ordinal").alias("ordinal"))
        .agg(
            F.first("c").alias("c"), *[any_(c) for c in ("exact", "rendered", "in_name", "signed", "draft", "standard", "horizon", "fy_word", "fy_name", "group_word", "reconciled", "no_variance")],
            *[earliest(c) for c in ("in_fy", "prior", "in_range")], F.min("stated")["v"].alias("stated"), F.max("claimed").alias("claimed"), F.count_distinct("doc_id").alias("units"),
            F.array_distinct(F.flatten(F.collect_set("held"))).alias("held"), F.array_distinct(F.flatten(F.collect_set("words"))).alias("words"),
        )
    )
    j = folded.join(_entities_told(folded, evidence, entities), ["engagement_id", "item_id", "ordinal"], "left")
    c = lambda x: F.col(f"c.{x}")
    say = lambda o, *parts: F.struct(F.lit(o).alias("outcome"), F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts]).alias("detail"))
    ok, bad, open_ = "pass", "fail", "unverifiable"

    as_of = (
        F.when(F.col("exact"), say(ok, "as of ", c("end")))
        .when(F.year("stated") != F.year(c("end")), say(bad, "states 'as of ", F.col("stated"), "', but the request is as of ", c("end")))
        .when(F.col("rendered"), say(ok, "as of ", c("end")))
        .when(F.col("in_fy").isNotNull(), say(ok, "within fiscal year (e.g. ", F.col("in_fy"), ")"))
        .when(F.col("in_name"), say(ok, "period per document label"))
        .otherwise(say(open_, "period not confirmable from content"))
    )
    a_range = F.when(F.col("in_range").isNotNull(), say(ok, "within period (e.g. ", F.col("in_range"), ")")).when(F.col("prior").isNotNull(), say(bad, "dated ", F.col("prior"), " (prior year)")).otherwise(say(open_, "period not confirmable from content"))
    fiscal = (
        F.when(F.col("in_fy").isNotNull(), say(ok, "within FY (e.g. ", F.col("in_fy"), ")"))
        .when(F.col("fy_word"), say(ok, "fiscal-year reference present"))
        .when(F.col("prior").isNotNull(), say(bad, "content is prior-year"))
        .when(F.col("fy_name"), say(ok, "fiscal-year period per document label"))
        .otherwise(say(open_, "fiscal year not confirmable"))
    )
    before = F.when(F.col("prior").isNotNull(), say(ok, "prior-year content confirmed")).otherwise(say(open_, "prior year not confirmable"))
    report_date = F.coalesce(c("end_is_report_date"), F.lit(False))
    period = (
        F.when((c("period_kind") == "AS_OF") & c("end").isNotNull() & ~report_date, as_of)
        .when(c("period_kind") == "RANGE", a_range)
        .when(c("period_kind") == "FISCAL_YEAR", fiscal)
        .when(c("period_kind") == "PRIOR_YEAR", before)
        .when(report_date, say(open_, "as of report date, to be confirmed at issuance"))
        .otherwise(say(open_, "period not evaluated"))
    )
    none = lambda x: F.coalesce(F.col(x), F.lit(0))
    consolidated = F.lower(F.trim(c("scope_word"))) == "consolidated"
    entity = (
        F.when(none("n_required") == 0, say(ok, "no specific entity required"))
        .when(none("n_missing") == 0, say(ok, "all ", none("n_required"), " entities present"))
        .when(consolidated & F.col("parent") & F.col("group_word"), say(ok, "parent and consolidated subsidiaries referenced"))
        .when(consolidated & (none("n_found") > 0), say(bad, "missing ", none("n_missing"), " entities, first ", F.col("first_missing")))
        .when(consolidated, say(open_, "consolidated entities not explicitly named in the documents"))
        .when(none("n_found") > 0, say(ok, "entity reference present"))
        .otherwise(say(open_, "entity not explicitly named"))
    )
    signature = F.when(F.col("signed"), say(ok, "signature detected")).when(F.col("draft"), say(bad, "marked DRAFT or not executed, signature required")).otherwise(say(bad, "no signature detected but one is required"))
    short = F.array_except(c("labels"), F.col("held"))
    bucket = F.when(F.size(short) == 0, say(ok, "aging buckets present: ", F.array_join(c("labels"), ", "))).otherwise(say(bad, "missing buckets: ", F.array_join(short, ", ")))
    unseen = F.filter(c("labels"), lambda p: F.size(F.array_except(_phrase_words(F.array(p)), F.col("words"))) > 0)
    include = F.when(F.size(unseen) == 0, say(ok, "required elements present")).otherwise(say(open_, "could not confirm: ", F.array_join(unseen, ", ")))
    standard = F.when(F.col("standard"), say(ok, c("target"), " referenced")).otherwise(say(open_, c("target"), " not explicitly found"))
    need = c("number").cast("long")
    count = (
        F.when(c("target") == "cover_all", say(ok, F.col("units"), " ", c("unit"), " present"))
        .when(F.col("claimed") > F.col("units"), say(bad, F.col("units"), " ", c("unit"), " present but ", F.col("claimed"), " indicated, ", F.col("claimed") - F.col("units"), " missing"))
        .when((c("target") == "minimum") & (F.col("units") < need), say(bad, "only ", F.col("units"), " of the required ", need, " ", c("unit")))
        .otherwise(say(ok, F.col("units"), " ", c("unit"), " present"))
    )
    threshold = say(open_, "per-item support for amounts over $", F.format_number(c("number"), 0), " should be confirmed")
    reconciles = F.when(F.col("reconciled") & F.col("no_variance"), say(ok, "reconciliation present (variance = 0)")).when(F.col("reconciled"), say(ok, "reconciliation present")).otherwise(say(open_, "tie-out to ", c("target"), " not confirmed"))
    horizon = F.when(F.col("horizon"), say(ok, need, "-month horizon present")).otherwise(say(open_, need, "-month horizon not confirmed"))
    by_kind = {"period": period, "entity": entity, "signature": signature, "bucket": bucket, "include": include, "standard": standard, "count": count, "threshold": threshold, "reconciles": reconciles, "horizon": horizon}
    result = F.lit(None).cast("struct<outcome:string,detail:string>")
    for kind, told in by_kind.items():
        result = F.when(c("kind") == kind, told).otherwise(result)
    hard = (F.col("r.outcome") == bad) & (c("kind").isin(*HARD_KINDS) | (c("kind") == "signature") & ~F.col("draft"))
    return j.withColumn("r", result).where("r is not null").select("engagement_id", "item_id", "ordinal", c("kind").alias("kind"), c("raw").alias("raw"), F.col("r.outcome").alias("outcome"), F.coalesce(hard, F.lit(False)).alias("hard"), F.col("r.detail").alias("detail"))


def assess(evidence: DataFrame, checked: DataFrame) -> DataFrame:
    """(engagement_id, item_id, n_docs, status, confidence, n_open, open_items, reasoning) of each item with evidence.

    Status and confidence are functions of the checks alone: a hard failure is Insufficient, another Under review, any pass Complete,
    nothing told Received. Confidence is rounded half to even. The lists hold as many entries as an item has criteria.
    """
    docs = evidence.groupBy("engagement_id", "item_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    one = F.struct("ordinal", "kind", "outcome", "detail")
    n = checked.groupBy("engagement_id", "item_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "pass").alias("n_pass"), F.count_if(F.col("outcome") == "fail").alias("n_fail"), F.count_if("hard").alias("n_hard"), F.array_sort(F.collect_list(one)).alias("all"),
    )
    j = docs.join(n, ["engagement_id", "item_id"], "left")
    status = F.when(F.col("n_hard") > 0, "Insufficient").when(F.col("n_fail") > 0, "Under review").when(F.col("n_pass") > 0, "Complete").otherwise("Received")
    confidence = F.coalesce(F.bround(0.5 + 0.5 * F.col("n_pass") / F.col("n"), 2), F.lit(0.5))
    listed = lambda outcome, shape, joint: F.array_join(F.transform(F.filter("all", lambda x: x["outcome"] == outcome), shape), joint)
    dash = lambda x: F.concat(x["kind"], F.lit(" - "), x["detail"])
    part = lambda head, text: F.when(F.length(text) > 0, F.concat(F.lit(head), text, F.lit(".")))
    reasoning = F.when(F.col("n").isNull(), F.concat(F.lit("Evidence received for "), F.col("item_id"), F.lit("; no acceptance criteria to check."))).otherwise(
        F.concat_ws(" ", F.concat(status, F.lit(".")), part("Verified ", listed("pass", lambda x: F.concat(x["kind"], F.lit(" ("), x["detail"], F.lit(")")), "; ")), part("Failed ", listed("fail", dash, "; ")), part("Open ", listed("unverifiable", dash, "; ")))
    )
    open_items = F.coalesce(F.transform(F.filter("all", lambda x: x["outcome"] != "pass"), lambda x: F.concat(x["kind"], F.lit(": "), x["detail"])), F.array().cast("array<string>"))
    return j.select("engagement_id", "item_id", "n_docs", status.alias("status"), confidence.alias("confidence"), F.size(open_items).cast("long").alias("n_open"), open_items.alias("open_items"), reasoning.alias("reasoning"))


def with_layers(assessed: DataFrame, evidence: DataFrame, findings: DataFrame, anomalies: DataFrame, versions: DataFrame) -> DataFrame:
    """assessed with n_superseded, n_findings, n_anomalies and needs_review.

    findings, anomalies: rows with doc_id, one for each personal number found and each name that content belies; versions:
    (doc_id, is_latest). Any finding or anomaly asks for a review, and so does a confidence below LEAST_CONFIDENCE; a superseded version does not.
    """
    keys = ["engagement_id", "item_id"]
    held = evidence.select(*keys, "doc_id").distinct()
    per_doc = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    j = held.join(per_doc(findings, "f"), "doc_id", "left").join(per_doc(anomalies, "a"), "doc_id", "left").join(versions.groupBy("doc_id").agg(F.bool_and(~F.col("is_latest")).alias("old")), "doc_id", "left")
    n = j.groupBy(*keys).agg(F.count_if("old").alias("n_superseded"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_findings"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_anomalies"))
    return assessed.join(n, keys).withColumn("needs_review", (F.col("n_findings") > 0) | (F.col("n_anomalies") > 0) | (F.col("confidence") < LEAST_CONFIDENCE))


def scores(expected: DataFrame, got: DataFrame, keys: list[str], incomplete: tuple[str, ...] = ("Under review", "Insufficient")) -> DataFrame:
    """One row: labeled, correct, accuracy, precision, recall, f1, mismatched, of got.status against expected.status.

    The positive class is an incomplete item. An empty denominator gives 1, accuracy over nothing is null, F1 without both is 0.
    """
    j = expected.select(*keys, F.col("status").alias("want")).join(got.select(*keys, F.col("status").alias("have")), keys, "left")
    want, have = F.col("want").isin(*incomplete), F.coalesce(F.col("have").isin(*incomplete), F.lit(False))
    same = F.coalesce(F.col("want") == F.col("have"), F.lit(False))
    n = j.agg(F.count("*").alias("labeled"), F.count_if(same).alias("correct"), F.count_if(want & have).alias("tp"), F.count_if(~want & have).alias("fp"), F.count_if(want & ~have).alias("fn"))
    share = lambda a, b: F.when(a + b == 0, F.lit(1.0)).otherwise(a / (a + b))
    p, r = share(F.col("tp"), F.col("fp")), share(F.col("tp"), F.col("fn"))
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return n.select("labeled", "correct", F.round(F.when(F.col("labeled") > 0, F.col("correct") / F.col("labeled")), 3).alias("accuracy"), F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f1, 3).alias("f1"), (F.col("labeled") - F.col("correct")).alias("mismatched"))
