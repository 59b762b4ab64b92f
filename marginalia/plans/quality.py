"""Queries on metrics, prompts and evidence; each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import evidence as V
from ..operators import prompts as P
from ..operators import quality as Q
from .common import table


def _events(spark, sf):
    return Q.quality_events(table(spark, sf, "events"))


EVENTS = """ev AS (SELECT event_id, ts, event_type AS intent, 'L' || (user_id % 3 + 1) AS depth, coalesce(value, 0) > 20 AS minimum_ok, coalesce(value, 0) > 35 AS evidence_ok, event_id % 4 > 0 AS evidence_required,
 coalesce(value, 0) > 50 AS has_limits, least(coalesce(value, 0) / 100, 1.0) AS coverage, trunc(coalesce(value, 0) * 10)::INT AS char_count FROM events)"""


def answer_summary(spark, sf):
    return Q.answer_summary(_events(spark, sf))


SUMMARY_SQL = f"""WITH {EVENTS} SELECT coalesce(intent, '*') AS intent, coalesce(depth, '*') AS depth, count(*) AS n, round(avg(minimum_ok::INT::DOUBLE), 3) AS minimum_ok, round(avg(evidence_ok::INT::DOUBLE), 3) AS evidence_ok, round(avg(coverage), 3) AS coverage,
 round(avg(CASE WHEN evidence_required THEN evidence_ok::INT::DOUBLE END), 3) AS required_ok FROM ev GROUP BY GROUPING SETS ((), (intent), (depth))"""


def failure_reasons(spark, sf):
    return Q.failure_reasons(_events(spark, sf))


REASONS_SQL = f"""WITH {EVENTS}, r AS (SELECT unnest([CASE WHEN NOT minimum_ok THEN 'short' END, CASE WHEN evidence_required AND NOT evidence_ok THEN 'no_evidence' END, CASE WHEN NOT has_limits THEN 'no_limits' END, CASE WHEN coverage < 0.25 THEN 'low_coverage' END]) AS reason FROM ev)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1"""


def evaluation_kpis(spark, sf):
    runs = table(spark, sf, "events").select("event_type", F.when(F.col("event_type") == "error", "error").otherwise("done").alias("status"), (F.col("value") * 100).alias("latency_ms"))
    return Q.kpis(runs, "event_type")


KPI_SQL = """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS done, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(CASE WHEN value * 100 > 0 THEN value * 100 END), 3) AS mean_ms,
 quantile_disc(CASE WHEN value * 100 > 0 THEN value * 100 END, 0.95) AS p95_ms FROM events GROUP BY 1"""


def stage_percentiles(spark, sf):
    return Q.percentiles(table(spark, sf, "events").where("value is not null"), "value", "event_type")


def ring_buffer(spark, sf):
    return Q.last_n(_events(spark, sf), 800, [F.desc("ts"), F.desc("event_id")]).select("event_id", "intent", "depth", "char_count")


GATES = [("minimum_ok", 0.5, None), ("evidence_ok", 0.6, None), ("coverage", None, 0.9)]


def gate_report(spark, sf):
    e = _events(spark, sf)
    long = e.groupBy("intent").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in ("minimum_ok", "evidence_ok", "coverage")])
    metrics = long.unpivot("intent", ["minimum_ok", "evidence_ok", "coverage"], "metric", "value").withColumnRenamed("intent", "scope")
    return Q.gates(metrics, spark.createDataFrame(GATES, "metric string, low double, high double"))


GATE_SQL = f"""WITH {EVENTS}, m AS (SELECT intent AS scope, unnest(['minimum_ok', 'evidence_ok', 'coverage']) AS metric, unnest([avg(minimum_ok::INT::DOUBLE), avg(evidence_ok::INT::DOUBLE), avg(coverage)]) AS value FROM ev GROUP BY 1),
t(metric, low, high) AS (VALUES ('minimum_ok', 0.5, NULL), ('evidence_ok', 0.6, NULL), ('coverage', NULL, 0.9)), j AS (SELECT scope, metric, value >= coalesce(low, -1e300) AND value <= coalesce(high, 1e300) AS ok FROM m JOIN t USING (metric))
SELECT scope, bool_and(ok) AS passed, coalesce(string_agg(CASE WHEN NOT ok THEN metric END, ',' ORDER BY metric), '') AS failed FROM j GROUP BY 1"""


def queue_progress(spark, sf):
    return Q.queue_progress(table(spark, sf, "events"))


QUEUE_SQL = """SELECT event_id, user_id, (row_number() OVER w)::INT AS position, max(value) OVER w AS high, count(*) OVER (PARTITION BY user_id) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""

_EXTRA = ["", " please compare method A versus B", " see Fig. 3 and equation (2)", " list the references cited [3]", " give an overview of the main idea", " write the abstract", " reproduce the ablation experiment with 25 % error", " box 2 limitations and strengths"]


def _prompts(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    extra = F.array(*[F.lit(x) for x in _EXTRA])
    return t.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.element_at(extra, (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_EXTRA))) + 1).cast("int"))).alias("p"))


def prompt_classes(spark, sf):
    p = _prompts(spark, sf)
    return p.select("conv_id", "turn", P.prompt_family("p").alias("family"), P.answer_intent("p").alias("intent"), P.output_mode("p").alias("mode"), P.answer_depth("p").alias("depth"), P.claim_type("p").alias("claim"), text.prompt_locale("p").alias("locale"))


def _case(rules, default):
    return "CASE " + " ".join(f"WHEN regexp_matches(p, '{pattern}') THEN '{name}'" for name, pattern in rules) + f" ELSE '{default}' END"


_LIST = "[" + ", ".join("'" + x + "'" for x in _EXTRA) + "]"
PROMPT_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') || {_LIST}[(conv_id + turn) % {len(_EXTRA)} + 1] AS p FROM conversations),
k AS (SELECT *, len(regexp_extract_all(p, '\\S+')) AS words, len(regexp_extract_all(p, '(?i)\\b(derive|proof|theor|ablation|convergence|complexity)')) AS marks FROM c)
SELECT conv_id, turn, {_case(P.FAMILIES, '')} AS family, {_case(P.INTENTS, 'reading')} AS intent, {_case(P.MODES, 'fact_answer')} AS mode,
 CASE WHEN words > 60 OR marks >= 2 THEN 'L3' WHEN words > 20 OR marks = 1 THEN 'L2' ELSE 'L1' END AS depth, {_case(P.CLAIMS, 'statement')} AS claim, 'en' AS locale FROM k"""


def noise_flags(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", P.is_noise("t").alias("noise"), P.is_reference_list("t").alias("reference_list"), P.is_promising_reference("t").alias("promising"), P.bad_heading(F.split("t", "\n")[0]).alias("bad_heading"), text.shouty("t").alias("shouty"))


NOISE_SQL = """SELECT doc_id, regexp_matches(t, '(?i)(all rights reserved|copyright|creative commons|downloaded from|received \\d|accepted \\d)') OR (len(regexp_extract_all(t, ',')) >= 6 AND length(t) > 120 AND len(regexp_extract_all(t, '[.!?]')) <= 2) OR (length(t) > 80 AND regexp_matches(t, '(?i)\\b(university|department|institute|laboratory)\\b')) AS noise,
 regexp_matches(substr(t, 1, 160), '(?i)#*\\s*(references|bibliography)\\s*(\n|$)') OR len(regexp_extract_all(t, '\\[\\d{1,3}\\]')) >= 2 AS reference_list, length(t) BETWEEN 24 AND 420 AND regexp_matches(t, '(19|20)\\d{2}') AND len(regexp_extract_all(t, '[A-Za-z]{3,}')) >= 4 AS promising,
 length(h) > 90 OR regexp_matches(h, '(?i)(doi|issn|copyright|@|www\\.)') OR len(regexp_extract_all(h, '\\d')) >= 10 AS bad_heading, u + l > 0 AND u >= 0.75 * (u + l) AND l <= 0.20 * (u + l) AS shouty
 FROM (SELECT doc_id, t, string_split(t, chr(10))[1] AS h, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS u, length(regexp_replace(t, '[^a-z]', '', 'g')) AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


def ranking_pages(spark, sf):
    """Titles, links and tags of raw pages."""
    p = table(spark, sf, "pages")
    return p.select("page_id", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_count("html", F.lit("(?i)<a ")).alias("links"), F.regexp_count("html", F.lit("(?i)<p[ >]")).alias("paragraphs"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


PAGES_SQL = """SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a '))::INT AS links, len(regexp_extract_all(html, '(?i)<p[ >]'))::INT AS paragraphs, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages"""


def event_properties(spark, sf):
    """JSON properties decoded tolerantly, with a stable hash."""
    e = table(spark, sf, "events")
    keys = F.size(F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>")))
    return e.select("event_id", keys.alias("keys"), F.sha1(F.coalesce("props", F.lit("{}"))).alias("sha1"))


def answer_segments(spark, sf):
    """Documents as answers: segments grouped by kind, with the length of the first."""
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("answer_id"), "text")
    return V.claim_groups(V.segments(a))


SEGMENT_SQL = """WITH l AS (SELECT doc_id AS answer_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT answer_id, pos, CASE WHEN regexp_matches(trim(s), '^\\s*\\|') THEN 'table' WHEN regexp_matches(trim(s), '^\\s*>') THEN 'blockquote' WHEN regexp_matches(trim(s), '^\\s*([-*+]|\\d+\\.)\\s') THEN 'list_item' ELSE 'paragraph' END AS kind FROM l WHERE length(trim(s)) >= 10),
n AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS seg_no FROM k), g AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY answer_id ORDER BY seg_no) THEN 1 ELSE 0 END AS new FROM n),
r AS (SELECT *, sum(new) OVER (PARTITION BY answer_id ORDER BY seg_no)::BIGINT AS grp FROM g)
SELECT answer_id, grp, kind, count(*) AS segments, min(seg_no)::INT AS lead FROM r GROUP BY ALL"""


def name_similarity(spark, sf):
    """Similarity of consecutive customer names (needs the sequence ratio)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    other = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("next_name"))
    return c.join(other, "c_custkey").select("c_custkey", F.round(scoring.sequence_ratio("c_name", "next_name"), 6).alias("ratio"))


def text_keys(spark, sf):
    """Normal forms of the first line of each document."""
    d = table(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("h"))
    return d.select("doc_id", text.match_text("h").alias("match"), text.digit_mask("h").alias("mask"), text.suggestion_text("h").alias("suggest"), text.initials("h").alias("initials"), text.last_year("h").alias("year"), text.issn("h").alias("issn"))


KEYS_SQL = """SELECT doc_id, trim(regexp_replace(lower(h), '[\\s_]+', ' ', 'g')) AS match, trim(regexp_replace(regexp_replace(lower(h), '\\d+', '#', 'g'), '\\s+', ' ', 'g')) AS mask, trim(regexp_replace(lower(h), '[^a-z0-9]+', ' ', 'g')) AS suggest,
 coalesce(array_to_string(list_transform(regexp_extract_all(h, '[A-Za-z]+'), lambda w: upper(substr(w, 1, 1))), ''), '') AS initials, list_extract(regexp_extract_all(h, '(19\\d{2}|20\\d{2})', 1), -1)::INT AS year,
 CASE WHEN length(i) = 8 THEN substr(i, 1, 4) || '-' || substr(i, 5, 4) END AS issn FROM (SELECT doc_id, h, regexp_replace(upper(h), '[^0-9X]', '', 'g') AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS h FROM documents))"""

QUERIES = {f.__name__: f for f in (answer_summary, failure_reasons, evaluation_kpis, stage_percentiles, ring_buffer, gate_report, queue_progress, prompt_classes, noise_flags, ranking_pages, event_properties, answer_segments, name_similarity, text_keys)}
ORACLE_SQL = {
    "answer_summary": SUMMARY_SQL, "failure_reasons": REASONS_SQL, "evaluation_kpis": KPI_SQL,
    "stage_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events WHERE value >= 0 GROUP BY 1",
    "ring_buffer": f"WITH {EVENTS} SELECT event_id, intent, depth, char_count FROM ev ORDER BY ts DESC, event_id DESC LIMIT 800",
    "gate_report": GATE_SQL, "queue_progress": QUEUE_SQL, "prompt_classes": PROMPT_SQL, "noise_flags": NOISE_SQL, "ranking_pages": PAGES_SQL,
    "event_properties": "SELECT event_id, coalesce(len(json_keys(props)), 0)::INT AS keys, sha1(coalesce(props, '{}')) AS sha1 FROM events",
    "answer_segments": SEGMENT_SQL, "text_keys": KEYS_SQL,
}
