"""Queries of the mail and document operators over the test tables, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.operators import facts, gate, matching, threads, versions
from quaystone.operators.ranking import spread_last, spread_row_number
from quaystone.session import table

_MONTHS = facts.MONTH


def thread_subjects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("delivery_id", threads.plain_subject(F.col("subject")).alias("plain_subject"))


def thread_components(spark: SparkSession, d: str) -> DataFrame:
    return threads.threads(table(spark, d, "messages"))


def thread_sizes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").select("delivery_id", "received_at")
    placed = threads.thread_order(m, thread_components(spark, d), "received_at")
    return placed.groupBy("thread_key").agg(F.max("place").alias("n_messages"), F.min(F.when(F.col("place") == 1, F.col("delivery_id"))).alias("first_delivery"))


def dedup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return versions.first_seen(table(spark, d, "occurrences"))


def dedup_reused(spark: SparkSession, d: str) -> DataFrame:
    return versions.first_seen(table(spark, d, "occurrences")).where("n_sources > 1").select("doc_id", "n_sources", "n_occurrences")


def container_chains(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("container_chain")
    return table(spark, d, "occurrences").select("occ_id", F.array_join(c, " > ").alias("chain"), F.size(c).cast("long").alias("depth"), F.element_at(c, -1).alias("leaf"), F.lower(F.element_at(F.split("filename", r"\."), -1)).alias("suffix"))


def container_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("container_chain")
    middle = F.slice(c, F.lit(2), F.greatest(F.size(c) - 2, F.lit(0)))
    inside = lambda s: F.exists(middle, lambda x: F.endswith(F.lower(x), F.lit(s)))
    return table(spark, d, "occurrences").agg(
        F.count("*").alias("n_occurrences"), F.count_distinct("doc_id").alias("n_documents"), F.count_if("is_top_level_attachment").alias("n_top"),
        F.count_if(F.size(c) > 2).alias("n_nested"), F.count_if(inside(".eml")).alias("n_in_mail"), F.count_if(inside(".zip")).alias("n_in_zip"),
    )


def ordered_documents(spark: SparkSession, d: str) -> DataFrame:
    """The distinct documents that each mail brought, in the order in which they first came."""
    first = table(spark, d, "occurrences").where("message_source is not null").groupBy("message_source", "doc_id").agg(F.min("occ_id").alias("o"))
    return spread_row_number(first, ["message_source"], [F.col("o"), F.col("doc_id")], "place").select("message_source", "doc_id", F.col("place").cast("long").alias("place"))


def fact_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(facts.dates(F.col("text"))).alias("f")).groupBy("doc_id", F.col("f.pat_no").alias("pat_no"), F.col("f.value").cast("string").alias("value")).agg(F.count("*").alias("n"))


def fact_amounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", facts.amounts(F.col("text")).alias("a")).where("size(a) > 0").select("doc_id", F.size("a").cast("long").alias("n"), F.array_max("a").alias("largest"), F.element_at("a", 1).alias("first_amount"))


def fact_standards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(facts.standards(F.col("text"))).alias("standard")).groupBy("doc_id", "standard").agg(F.count("*").alias("n"))


def fact_signatures(spark: SparkSession, d: str) -> DataFrame:
    s = facts.signatures(F.col("snippet"))
    return table(spark, d, "spans").select("span_id", F.size(s).cast("long").alias("n_marks"), F.exists(s, lambda x: x["signed"]).alias("signed"), F.exists(s, lambda x: x["draft"]).alias("draft")).where("n_marks > 0")


def fact_entities(spark: SparkSession, d: str) -> DataFrame:
    return facts.entity_mentions(table(spark, d, "messages"), table(spark, d, "entities"), "engagement_id", "delivery_id", "body_text")


def fact_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(facts.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def fact_requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("delivery_id", F.explode(facts.request_refs(F.col("body_text"))).alias("request")).groupBy("delivery_id", "request").agg(F.count("*").alias("n"))


def fact_filename_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occurrences").select("occ_id", F.array_join(facts.filename_years(F.col("filename")).cast("array<string>"), ",").alias("years")).where("years <> ''")


def fact_places(spark: SparkSession, d: str) -> DataFrame:
    return facts.placed_facts(table(spark, d, "documents"), "doc_id", "text")


def gate_findings(spark: SparkSession, d: str) -> DataFrame:
    return gate.scan(table(spark, d, "sheets"), "sheet_id", "text").groupBy("sheet_id", "pii_type", "masked").agg(F.count("*").alias("n"))


def gate_redacted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sheets").select("sheet_id", gate.redact(F.col("text")).alias("redacted"))


def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    return gate.summary(gate.scan(table(spark, d, "sheets"), "sheet_id", "text"), "sheet_id")


def bm25_best(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "documents").select("doc_id", matching.tokens(F.col("text")).alias("tokens"))
    return matching.best_items(asked, table(spark, d, "eval_items").select("item_id", matching.tokens(F.col("text")).alias("tokens")), "doc_id", 3)


def version_groups(spark: SparkSession, d: str) -> DataFrame:
    return versions.version_groups(table(spark, d, "occurrences"))


def anomaly_final_draft(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "occurrences").where(F.col("filename").rlike(versions.FINAL_WORDS)).select("doc_id", "filename").distinct()
    drafts = table(spark, d, "spans").where(facts.is_draft(F.col("snippet"))).select("doc_id").distinct()
    return named.join(drafts, "doc_id", "left_semi")


def anomaly_stale_period(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "spans").select("doc_id", F.explode(facts.dates(F.col("snippet"))).alias("f")).groupBy("doc_id").agg(F.max(F.year("f.value")).cast("long").alias("content_year"))
    named = table(spark, d, "occurrences").select("doc_id", "filename", F.array_min(facts.filename_years(F.col("filename"))).cast("long").alias("name_year")).where("name_year is not null").distinct()
    return named.join(years, "doc_id").where("content_year < name_year")


def check_entities(spark: SparkSession, d: str) -> DataFrame:
    """Relational division: which engagements have all their entities named in their mail."""
    asked = table(spark, d, "entities").groupBy("engagement_id").agg(F.count_distinct("entity_id").alias("n_required"))
    found = table(spark, d, "messages").select("delivery_id", "engagement_id").join(fact_entities(spark, d), "delivery_id").groupBy("engagement_id").agg(F.count_distinct("entity_id").alias("n_found"))
    return asked.join(found, "engagement_id", "left").select("engagement_id", "n_required", F.coalesce("n_found", F.lit(0)).alias("n_found"), (F.coalesce("n_found", F.lit(0)) == F.col("n_required")).alias("covered"))


def check_period(spark: SparkSession, d: str) -> DataFrame:
    """Per engagement: dates in its mail within the fiscal year, before it, and exactly at its end."""
    e = table(spark, d, "engagements").select("engagement_id", "fiscal_year_end", F.date_add(F.add_months("fiscal_year_end", -12), 1).alias("fy_start"))
    f = table(spark, d, "messages").select("engagement_id", F.explode(facts.dates(F.col("body_text"))).alias("f")).select("engagement_id", F.col("f.value").alias("v"))
    j = f.join(e, "engagement_id")
    inside = F.col("v").between(F.col("fy_start"), F.col("fiscal_year_end"))
    return j.groupBy("engagement_id").agg(F.count_if(inside).alias("n_inside"), F.count_if(F.col("v") < F.col("fy_start")).alias("n_before"), F.bool_or(F.col("v") == F.col("fiscal_year_end")).alias("exact"))


def agg_dense_states(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.createDataFrame([("visible",), ("hidden",), ("veryHidden",), ("unknown",)], "sheet_state string")
    n = table(spark, d, "sheets").groupBy("sheet_state").agg(F.count("*").alias("k"))
    return dim.join(n, "sheet_state", "left").select("sheet_state", F.coalesce("k", F.lit(0)).alias("n"))


def agg_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spans").groupBy("field_kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").cube("lang", "doc_kind").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level"))


def agg_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of one label against another: mail from the portal told by its subject."""
    e = table(spark, d, "engagements").select("engagement_id", "portal_email")
    m = table(spark, d, "messages").join(F.broadcast(e), "engagement_id").select((F.lower("sender.email") == F.lower("portal_email")).alias("truth"), F.coalesce(F.col("subject").rlike("(?i)^pbc-"), F.lit(False)).alias("told"))
    c = m.agg(F.count_if(F.expr("truth and told")).alias("tp"), F.count_if(F.expr("told and not coalesce(truth, false)")).alias("fp"), F.count_if(F.expr("truth and not told")).alias("fn"))
    ratio = lambda a, b: F.when(F.col(b) + F.col(a) == 0, 1.0).otherwise(F.round(F.col(a) / (F.col(a) + F.col(b)), 3))
    return c.select("tp", "fp", "fn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def window_running_budget(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return versions.running_below(o, ["o_custkey"], ["o_orderkey"], "price", 200000.0).groupBy("o_custkey").agg(F.count("*").alias("n_within"))


def window_last_write(spark: SparkSession, d: str) -> DataFrame:
    return versions.last_per_key(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


def window_fill_forward(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("opens"))
    return spread_last(e, ["user_id"], ["ts", "event_id"], "opens", "section").select("event_id", F.coalesce("section", F.lit(-1)).alias("section"))


def window_row_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return spread_row_number(rows, ["source"], [F.col("n_chars").desc_nulls_last(), F.col("doc_id")], "place").where("place <= 3").select("source", "doc_id", F.col("place").cast("long").alias("place"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the book that write mail, that only receive it, and that are in neither."""
    book = table(spark, d, "addresses").select(F.lower("email").alias("email")).where("email is not null").distinct()
    m = table(spark, d, "messages")
    sent = m.select(F.lower("sender.email").alias("email")).where("email is not null").distinct()
    got = m.select(F.explode(F.concat("to_addrs", "cc_addrs")).alias("a")).select(F.lower("a.email").alias("email")).where("email is not null").distinct()
    tag = lambda df, t: df.select("email", F.lit(t).alias("part"))
    return tag(book.intersect(sent), "writes").unionByName(tag(book.intersect(got.subtract(sent)), "receives")).unionByName(tag(book.subtract(sent.union(got)), "silent"))


def file_types(spark: SparkSession, d: str) -> DataFrame:
    """Distinct documents by the type that their first name tells."""
    low = F.lower(F.coalesce(F.col("filename"), F.lit("")))
    kind = F.when(low.rlike(r"\.xls[xm]$"), "xlsx").when(low.endswith(".pdf"), "pdf").when(low.rlike(r"\.(jpe?g|png)$"), "image").when(low.endswith(".zip"), "archive").when(low.rlike(r"\.(txt|csv)$"), "text").otherwise("unknown")
    return versions.first_seen(table(spark, d, "occurrences")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("n_occurrences").alias("n_occurrences"))


def join_documents_of_mail(spark: SparkSession, d: str) -> DataFrame:
    """Mail with its attachments: exploded ids, semi-joined to those that exist, counted with an outer default."""
    m = table(spark, d, "messages").select("delivery_id", F.explode_outer("document_ids").alias("doc_id"))
    there = table(spark, d, "occurrences").select("doc_id").distinct().withColumn("known", F.lit(1))
    return m.join(there, "doc_id", "left").groupBy("delivery_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct(F.when(F.col("known") == 1, F.col("doc_id"))).alias("n_known"))


def join_discovered(spark: SparkSession, d: str) -> DataFrame:
    """People of the address book without an email, and the one last seen with their name in the same engagement."""
    a = table(spark, d, "addresses").select("addr_id", "engagement_id", F.lower(F.trim("display_name")).alias("who"), F.lower("email").alias("email")).where("who is not null and who <> ''")
    seen = a.where("email is not null").groupBy("engagement_id", "who").agg(F.max_by("email", "addr_id").alias("found"))
    return a.where("email is null").join(seen, ["engagement_id", "who"], "left").select("addr_id", F.coalesce("found", F.lit("?")).alias("email"))


def report_json(spark: SparkSession, d: str) -> DataFrame:
    """One JSON report for each engagement: its counts and its entities, sorted by id."""
    e = table(spark, d, "engagements").select("engagement_id", "client_name")
    n = table(spark, d, "messages").groupBy("engagement_id").agg(F.count("*").alias("n_messages"))
    x = table(spark, d, "entities").groupBy("engagement_id").agg(F.array_sort(F.collect_list(F.struct(F.col("entity_id").alias("id"), F.col("entity_name").alias("name")))).alias("entities"))
    j = e.join(n, "engagement_id", "left").join(x, "engagement_id", "left")
    return j.select("engagement_id", F.to_json(F.struct(F.col("client_name").alias("client"), F.coalesce("n_messages", F.lit(0)).alias("messages"), F.coalesce(F.transform("entities", lambda i: i["id"]), F.array().cast("array<bigint>")).alias("entities"))).alias("report"))


def olap_pricing(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    dec = lambda c: F.col(c).cast("decimal(18,2)")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(dec("l_quantity")).cast("double").alias("sum_qty"), F.sum(dec("l_extendedprice")).cast("double").alias("sum_base"), F.count("*").alias("n"))


def olap_nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.count_distinct("c_custkey").alias("n_customers"))


QUERIES = {
    f.__name__: f
    for f in (
        thread_subjects, thread_components, thread_sizes, dedup_first_seen, dedup_reused, container_chains, container_counts, ordered_documents, fact_dates, fact_amounts, fact_standards, fact_signatures,
        fact_entities, fact_sentences, fact_requests, fact_filename_years, fact_places, gate_findings, gate_redacted, gate_summary, bm25_best, version_groups, anomaly_final_draft, anomaly_stale_period, check_entities,
        check_period, agg_dense_states, agg_histogram, agg_cube, agg_confusion, window_running_budget, window_last_write, window_fill_forward, window_row_numbers, set_operations, file_types, join_documents_of_mail, join_discovered,
        report_json, olap_pricing, olap_nation_revenue,
    )
}

_PATH = r"""regexp_replace(regexp_replace(regexp_replace(replace(trim({}), '\', '/'), '/{{2,}}', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '')"""
_PLAIN = r"trim(lower(regexp_replace(coalesce(subject, ''), '(?i)^(\s*(re|fw|fwd)\s*:\s*)+', '')))"
_ID = r"""regexp_replace({0}, '^[\s\x{{A0}}<]+|[\s\x{{A0}}>]+$', '', 'g')"""
_FOLD = "CASE WHEN {0} = '' THEN NULL WHEN contains({0}, '@') THEN regexp_extract({0}, '^(.*@)([^@]*)$', 1) || lower(regexp_extract({0}, '^(.*@)([^@]*)$', 2)) ELSE {0} END"
_THREADS = rf"""
ids AS (
  SELECT delivery_id, engagement_id, message_id AS raw FROM messages
  UNION ALL SELECT delivery_id, engagement_id, in_reply_to FROM messages
  UNION ALL SELECT delivery_id, engagement_id, unnest(regexp_split_to_array(x, '[\s\x{{A0}},;]+')) FROM (SELECT delivery_id, engagement_id, unnest(ref_ids) AS x FROM messages)),
keys AS (
  SELECT delivery_id AS id, coalesce(engagement_id, '') || '|i:' || {_FOLD.format("b")} AS k FROM (SELECT delivery_id, engagement_id, {_ID.format("raw")} AS b FROM ids WHERE raw IS NOT NULL) WHERE b <> ''
  UNION SELECT delivery_id, coalesce(engagement_id, '') || '|s:' || s FROM (SELECT delivery_id, engagement_id, {_PLAIN} AS s FROM messages) WHERE s <> ''),
reach AS (SELECT delivery_id AS id, delivery_id AS peer FROM messages UNION SELECT r.id, b.id FROM reach r JOIN keys a ON a.id = r.peer JOIN keys b ON b.k = a.k),
thread AS (SELECT id AS delivery_id, min(peer) AS thread_key FROM reach GROUP BY id)
"""
_DATES = rf"""
SELECT {{key}}, 1 AS pat_no, try_strptime(unnest(regexp_extract_all({{text}}, '\b(\d{{{{4}}}}-\d{{{{2}}}}-\d{{{{2}}}})\b', 1)), '%Y-%m-%d')::DATE AS value FROM {{table}}
UNION ALL SELECT {{key}}, 2, try_strptime(regexp_replace(regexp_replace(unnest(regexp_extract_all({{text}}, '(?i)\b((?:{_MONTHS})\.?\s+\d{{{{1,2}}}},?\s+\d{{{{4}}}})\b', 1)), '[.,]', ' ', 'g'), '\s+', ' ', 'g'), '%B %d %Y')::DATE FROM {{table}}
UNION ALL SELECT {{key}}, 3, try_strptime(unnest(regexp_extract_all({{text}}, '\b(\d{{{{1,2}}}}/\d{{{{1,2}}}}/\d{{{{4}}}})\b', 1)), '%m/%d/%Y')::DATE FROM {{table}}
""".replace("{{{{", "{{").replace("}}}}", "}}")
_AMOUNTS = r"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '\$\s?(-?[\d,]+(?:\.\d{2})?)', 1), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)), lambda v: v IS NOT NULL)"
_DRAFT = facts.DRAFT.replace("(?i)", "")
_ALIASES = r"list_distinct([lower(trim(entity_name)), trim(regexp_replace(lower(trim(entity_name)), '(?i),?\s+(?:inc|llc|l\.l\.c|corp|co)\.?$', ''))])"
_MENTIONS = f"""
e AS (SELECT engagement_id, entity_id, unnest({_ALIASES}) AS a FROM entities WHERE entity_name IS NOT NULL),
mention AS (SELECT m.delivery_id, m.engagement_id, e.entity_id, arg_max(e.a, length(e.a)) AS alias FROM messages m JOIN e ON m.engagement_id = e.engagement_id AND e.a <> '' AND contains(lower(m.body_text), e.a) GROUP BY ALL)
"""
_YEARS = r"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(lower(filename), '\b(20\d\d)\b', 1), lambda y: y::INT), list_transform(regexp_extract_all(lower(filename), 'fy\s?(\d{2,4})', 1), lambda y: CASE WHEN length(y) = 2 THEN y::INT + 2000 ELSE y::INT END))))"
_GATE = " UNION ALL ".join(f"SELECT sheet_id, '{n}' AS pii_type, unnest(regexp_extract_all(coalesce(text, ''), '{p}', 0)) AS x FROM sheets" for n, p in gate.PATTERNS)
_REDACT = "text"
for _n, _p in gate.PATTERNS:
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '[REDACTED-{_n}]', 'g')"
_KEY = r"regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(filename, '\.[^.]*$', ''), '[_\-]+', ' ', 'g'), '(?i)\b(v\d+|version\s*\d+|final|real|draft|copy|updated|revised|rev\d*|clean)\b', ' ', 'g')), '[^a-z0-9]+', '', 'g')"

SQL = {
    "thread_subjects": f"SELECT delivery_id, {_PLAIN} AS plain_subject FROM messages",
    "thread_components": f"WITH RECURSIVE {_THREADS} SELECT delivery_id, thread_key FROM thread",
    "thread_sizes": f"WITH RECURSIVE {_THREADS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_key ORDER BY received_at NULLS LAST, delivery_id) AS place FROM messages JOIN thread USING (delivery_id)) SELECT thread_key, max(place) AS n_messages, min(CASE WHEN place = 1 THEN delivery_id END) AS first_delivery FROM r GROUP BY thread_key",
    "dedup_first_seen": "SELECT doc_id, arg_min(filename, occ_id) AS filename, count(*) AS n_occurrences, count(DISTINCT message_source) AS n_sources FROM occurrences GROUP BY doc_id",
    "dedup_reused": "SELECT doc_id, count(DISTINCT message_source) AS n_sources, count(*) AS n_occurrences FROM occurrences GROUP BY doc_id HAVING count(DISTINCT message_source) > 1",
    "container_chains": r"SELECT occ_id, array_to_string(container_chain, ' > ') AS chain, len(container_chain) AS depth, container_chain[-1] AS leaf, lower(string_split(filename, '.')[-1]) AS suffix FROM occurrences",
    "container_counts": "SELECT count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_documents, count_if(is_top_level_attachment)::BIGINT AS n_top, count_if(len(container_chain) > 2)::BIGINT AS n_nested, count_if(len(list_filter(container_chain[2:-2], lambda x: lower(x) LIKE '%.eml')) > 0)::BIGINT AS n_in_mail, count_if(len(list_filter(container_chain[2:-2], lambda x: lower(x) LIKE '%.zip')) > 0)::BIGINT AS n_in_zip FROM occurrences",
    "ordered_documents": "SELECT message_source, doc_id, row_number() OVER (PARTITION BY message_source ORDER BY o, doc_id) AS place FROM (SELECT message_source, doc_id, min(occ_id) AS o FROM occurrences WHERE message_source IS NOT NULL GROUP BY ALL)",
    "fact_dates": f"SELECT doc_id, pat_no, value::VARCHAR AS value, count(*) AS n FROM ({_DATES.format(key='doc_id', text='text', table='documents')}) WHERE value IS NOT NULL GROUP BY ALL",
    "fact_amounts": f"SELECT doc_id, len(a) AS n, list_max(a) AS largest, a[1] AS first_amount FROM (SELECT doc_id, {_AMOUNTS} AS a FROM documents) WHERE len(a) > 0",
    "fact_standards": r"SELECT doc_id, 'ASC ' || s AS standard, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\bASC\s?(606|842|8\d\d|\d{3})\b', 1)) AS s FROM documents) GROUP BY ALL",
    "fact_signatures": rf"WITH s AS (SELECT span_id, len(regexp_extract_all(coalesce(snippet, ''), '{facts.SIGNED}', 1)) AS k, regexp_matches(coalesce(snippet, ''), '(?i){_DRAFT}') AS d FROM spans) SELECT span_id, CASE WHEN k = 0 THEN 1 ELSE k END AS n_marks, k > 0 AND NOT d AS signed, d AS draft FROM s WHERE k > 0 OR d",
    "fact_entities": f"WITH {_MENTIONS} SELECT delivery_id, entity_id, alias FROM mention",
    "fact_sentences": r"SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s) <> '')) AS n_sentences FROM documents",
    "fact_requests": r"SELECT delivery_id, 'PBC-' || lpad(n::INT::VARCHAR, 2, '0') AS request, count(*) AS n FROM (SELECT delivery_id, unnest(regexp_extract_all(body_text, '(?i)pbc[-\s]?(\d{1,2})', 1)) AS n FROM messages) GROUP BY ALL",
    "fact_filename_years": f"SELECT occ_id, array_to_string(y, ',') AS years FROM (SELECT occ_id, {_YEARS} AS y FROM occurrences) WHERE len(y) > 0",
    "gate_findings": f"SELECT sheet_id, pii_type, '***' || CASE WHEN length(x) > 4 THEN right(x, 4) ELSE '' END AS masked, count(*) AS n FROM ({_GATE}) GROUP BY ALL",
    "gate_redacted": f"SELECT sheet_id, {_REDACT} AS redacted FROM sheets",
    "gate_summary": f"SELECT sheet_id, string_agg(pii_type || '×' || n, ', ' ORDER BY pii_type || '×' || n) AS summary FROM (SELECT sheet_id, pii_type, count(*) AS n FROM ({_GATE}) GROUP BY ALL) GROUP BY sheet_id",
    "bm25_best": """
WITH b AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM eval_items),
tf AS (SELECT item_id, w, count(*) AS n FROM b GROUP BY ALL), sz AS (SELECT item_id, count(*) AS size FROM b GROUP BY item_id),
p AS (SELECT count(*) AS items FROM eval_items), m AS (SELECT avg(size) AS mean FROM sz),
idf AS (SELECT w, ln(items - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, p GROUP BY w, items), fl AS (SELECT 0.25 * avg(idf) AS floor FROM idf),
wt AS (SELECT w, item_id, (CASE WHEN idf >= 0 THEN idf ELSE floor END) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * size / mean)) AS s FROM tf JOIN idf USING (w) JOIN sz USING (item_id), m, fl),
q AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY ALL),
sc AS (SELECT doc_id, item_id, round(sum(k * s), 6) AS score FROM q JOIN wt USING (w) GROUP BY ALL)
SELECT doc_id, item_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM sc) WHERE rank <= 3 AND score > 0""",
    "version_groups": rf"""
WITH f AS (SELECT DISTINCT doc_id, filename FROM occurrences WHERE filename IS NOT NULL),
r AS (SELECT doc_id, filename, CASE WHEN {_KEY} = '' THEN '|' || filename || '|' || doc_id ELSE {_KEY} END AS version_key, CASE WHEN regexp_matches(lower(filename), 'final|real') THEN 2 WHEN lower(filename) LIKE '%draft%' THEN -1 ELSE 0 END AS level, coalesce(try_cast(regexp_extract(filename, '(?i)v(?:ersion)?\s*(\d+)', 1) AS INT), 0) AS number FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY version_key ORDER BY level, number, filename, doc_id) AS version_no, count(*) OVER (PARTITION BY version_key) AS n_versions FROM r)
SELECT version_key, doc_id, filename, version_no, n_versions, version_no = n_versions AS is_latest FROM o""",
    "anomaly_final_draft": rf"SELECT DISTINCT doc_id, filename FROM occurrences WHERE regexp_matches(filename, '{versions.FINAL_WORDS}') AND doc_id IN (SELECT doc_id FROM spans WHERE regexp_matches(coalesce(snippet, ''), '(?i){_DRAFT}'))",
    "anomaly_stale_period": f"WITH y AS (SELECT doc_id, max(year(value)) AS content_year FROM ({_DATES.format(key='doc_id', text='snippet', table='spans')}) WHERE value IS NOT NULL GROUP BY doc_id), n AS (SELECT DISTINCT doc_id, filename, list_min({_YEARS}) AS name_year FROM occurrences) SELECT doc_id, filename, name_year, content_year FROM n JOIN y USING (doc_id) WHERE content_year < name_year",
    "check_entities": f"WITH {_MENTIONS}, a AS (SELECT engagement_id, count(DISTINCT entity_id) AS n_required FROM entities GROUP BY ALL), f AS (SELECT engagement_id, count(DISTINCT entity_id) AS k FROM mention GROUP BY ALL) SELECT engagement_id, n_required, coalesce(k, 0) AS n_found, coalesce(k, 0) = n_required AS covered FROM a LEFT JOIN f USING (engagement_id)",
    "check_period": f"WITH v AS (SELECT engagement_id, value AS v FROM ({_DATES.format(key='engagement_id', text='body_text', table='messages')}) WHERE value IS NOT NULL) SELECT engagement_id, count_if(v BETWEEN (fiscal_year_end - INTERVAL 12 MONTH)::DATE + 1 AND fiscal_year_end)::BIGINT AS n_inside, count_if(v < (fiscal_year_end - INTERVAL 12 MONTH)::DATE + 1)::BIGINT AS n_before, bool_or(v = fiscal_year_end) AS exact FROM v JOIN engagements USING (engagement_id) GROUP BY engagement_id",
    "agg_dense_states": "SELECT s AS sheet_state, count(sheet_id) AS n FROM (VALUES ('visible'), ('hidden'), ('veryHidden'), ('unknown')) t(s) LEFT JOIN sheets ON sheet_state = s GROUP BY s",
    "agg_histogram": "SELECT field_kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM spans GROUP BY field_kind",
    "agg_cube": "SELECT lang, doc_kind, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping_id(lang, doc_kind) AS level FROM documents GROUP BY CUBE (lang, doc_kind)",
    "agg_confusion": """
WITH m AS (SELECT lower(sender.email) = lower(portal_email) AS truth, coalesce(regexp_matches(subject, '(?i)^pbc-'), false) AS told FROM messages JOIN engagements USING (engagement_id)),
c AS (SELECT count_if(truth AND told)::BIGINT AS tp, count_if(told AND NOT coalesce(truth, false))::BIGINT AS fp, count_if(truth AND NOT told)::BIGINT AS fn FROM m)
SELECT tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE round(tp / (tp + fp), 3) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE round(tp / (tp + fn), 3) END AS recall FROM c""",
    "window_running_budget": "SELECT o_custkey, count(*) AS n_within FROM (SELECT o_custkey, coalesce(sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) WHERE b < 200000 GROUP BY o_custkey",
    "window_last_write": "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "window_fill_forward": "SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS section FROM events",
    "window_row_numbers": "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents) WHERE place <= 3",
    "set_operations": """
WITH b AS (SELECT DISTINCT lower(email) AS email FROM addresses WHERE email IS NOT NULL), s AS (SELECT DISTINCT lower(sender.email) AS email FROM messages WHERE sender.email IS NOT NULL),
g AS (SELECT DISTINCT lower(a.email) AS email FROM (SELECT unnest(list_concat(to_addrs, cc_addrs)) AS a FROM messages) WHERE a.email IS NOT NULL)
SELECT email, 'writes' AS part FROM (SELECT * FROM b INTERSECT SELECT * FROM s) UNION ALL SELECT email, 'receives' FROM (SELECT * FROM b INTERSECT (SELECT * FROM g EXCEPT SELECT * FROM s)) UNION ALL SELECT email, 'silent' FROM (SELECT * FROM b EXCEPT (SELECT * FROM s UNION SELECT * FROM g))""",
    "file_types": r"""
SELECT CASE WHEN regexp_matches(lower(f), '\.xls[xm]$') THEN 'xlsx' WHEN lower(f) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(f), '\.(jpe?g|png)$') THEN 'image' WHEN lower(f) LIKE '%.zip' THEN 'archive' WHEN regexp_matches(lower(f), '\.(txt|csv)$') THEN 'text' ELSE 'unknown' END AS kind, count(*) AS n, sum(k)::BIGINT AS n_occurrences
FROM (SELECT doc_id, coalesce(arg_min(filename, occ_id), '') AS f, count(*) AS k FROM occurrences GROUP BY doc_id) GROUP BY ALL""",
    "join_documents_of_mail": "WITH x AS (SELECT delivery_id, unnest(document_ids) AS doc_id FROM messages) SELECT m.delivery_id, count(DISTINCT x.doc_id) AS n_docs, count(DISTINCT o.doc_id) AS n_known FROM messages m LEFT JOIN x ON x.delivery_id = m.delivery_id LEFT JOIN (SELECT DISTINCT doc_id FROM occurrences) o ON o.doc_id = x.doc_id GROUP BY m.delivery_id",
    "join_discovered": "WITH a AS (SELECT addr_id, engagement_id, lower(trim(display_name)) AS who, lower(email) AS email FROM addresses WHERE display_name IS NOT NULL AND trim(display_name) <> ''), s AS (SELECT engagement_id, who, arg_max(email, addr_id) AS found FROM a WHERE email IS NOT NULL GROUP BY ALL) SELECT addr_id, coalesce(found, '?') AS email FROM a LEFT JOIN s USING (engagement_id, who) WHERE a.email IS NULL",
    "report_json": """
WITH n AS (SELECT engagement_id, count(*) AS k FROM messages GROUP BY ALL), x AS (SELECT engagement_id, list(entity_id ORDER BY entity_id, entity_name) AS ids FROM entities GROUP BY ALL)
SELECT engagement_id, to_json({'client': client_name, 'messages': coalesce(k, 0), 'entities': coalesce(ids, [])})::VARCHAR AS report FROM engagements LEFT JOIN n USING (engagement_id) LEFT JOIN x USING (engagement_id)""",
    "olap_pricing": "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "olap_nation_revenue": "SELECT n_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue, count(DISTINCT c_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
}
