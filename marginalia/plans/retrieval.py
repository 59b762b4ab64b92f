"""Queries on ranking; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import retrieval as R
from .common import table

ASKED = [("q1", "oneren the nicht"), ("q2", "tion of the tion"), ("q3", "les para und"), ("q4", "zzzz")]
SECOND = [("q1", "thedeon und"), ("q2", "die der den"), ("q3", "zzzz"), ("q4", "thing")]
TOKENS_SQL = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[\\x{4e00}-\\x{9fff}]'), lambda x: lower(x))"


def _asked(spark, rows=None):
    return spark.createDataFrame(rows or ASKED, "query_id string, query string")


def _bm25_sql(asked: list[tuple[str, str]], suffix: str = "") -> str:
    values = ", ".join(f"('{i}', '{q}')" for i, q in asked)
    s = suffix
    return f"""
asked{s}(query_id, query) AS (VALUES {values}),
d{s} AS (SELECT doc_id, {TOKENS_SQL} AS toks FROM documents),
post{s} AS (SELECT doc_id, unnest(toks) AS term FROM d{s}),
df{s} AS (SELECT term, count(DISTINCT doc_id) AS df FROM post{s} GROUP BY term),
raw{s} AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM df{s}),
idf{s} AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw{s}) ELSE raw END AS idf FROM raw{s}),
q{s} AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_transform(regexp_extract_all(query, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS term FROM asked{s}) GROUP BY ALL),
tf{s} AS (SELECT doc_id, term, count(*) AS tf FROM post{s} GROUP BY ALL),
scored{s} AS (
  SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / (SELECT avg(len(toks)) FROM d{s})))), 6) AS score
  FROM q{s} JOIN tf{s} USING (term) JOIN idf{s} USING (term) JOIN d{s} USING (doc_id) GROUP BY ALL)"""


def bm25_top_k(spark, sf):
    return R.top_k(R.bm25(R.corpus(table(spark, sf, "documents")), _asked(spark)), 10).select("query_id", "doc_id", "score", "rank")


BM25_SQL = f"WITH {_bm25_sql(ASKED)} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM scored) WHERE rank <= 10 AND best > 0"


def term_statistics(spark, sf):
    docs = R.corpus(table(spark, sf, "documents"))
    return R.term_statistics(docs, "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


TERM_SQL = f"WITH {_bm25_sql(ASKED)} SELECT term, df, round(idf, 6) AS idf FROM idf JOIN df USING (term)"


def translated_choice(spark, sf):
    docs = R.corpus(table(spark, sf, "documents"))
    first, second = (R.bm25(docs, _asked(spark, rows)) for rows in (ASKED, SECOND))
    return R.top_k(R.choose_translation(first, second), 6).select("query_id", "doc_id", "score")


CHOICE_SQL = f"""WITH {_bm25_sql(ASKED)}, {_bm25_sql(SECOND, "2")},
pick AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(b.m, 0) > 1.25 * coalesce(a.m, 0) + 0.10 AS second
  FROM (SELECT query_id, max(score) AS m FROM scored GROUP BY 1) a FULL JOIN (SELECT query_id, max(score) AS m FROM scored2 GROUP BY 1) b USING (query_id)),
chosen AS (SELECT s.* FROM scored s JOIN pick USING (query_id) WHERE NOT second UNION ALL SELECT s.* FROM scored2 s JOIN pick USING (query_id) WHERE second)
SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM chosen) WHERE rank <= 6 AND best > 0"""


def evidence_groups(spark, sf):
    """Hits grouped by source with up to two distinct snippets (the first 80 characters, as a display shows them)."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    hits = R.bm25(R.corpus(docs), _asked(spark)).join(docs.select("doc_id", "source", F.substring("text", 1, 80).alias("snippet")), "doc_id").withColumnRenamed("doc_id", "ordinal")
    return R.group_by_source(hits, 5).select("query_id", "source", "score", "hits", "snippet_1", "snippet_2", "rank")


GROUP_SQL = f"""WITH {_bm25_sql(ASKED)},
h AS (SELECT query_id, source, substr(text, 1, 80) AS snippet, max(score) AS score, min(doc_id) AS ordinal, count(*) AS n FROM scored JOIN documents USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, ordinal) AS place FROM h),
g AS (SELECT query_id, source, max(score) AS score, sum(n)::BIGINT AS hits, max(CASE WHEN place = 1 THEN snippet END) AS snippet_1, max(CASE WHEN place = 2 THEN snippet END) AS snippet_2 FROM r GROUP BY ALL)
SELECT query_id, source, score, hits, snippet_1, snippet_2, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM g) WHERE rank <= 5 AND best > 0"""


def locked_source(spark, sf):
    """The source that a conversation's words decide on."""
    sources = table(spark, sf, "documents").groupBy(F.col("lang").alias("query_id"), "source").agg(F.count("*").alias("hits"), (F.max("n_chars") / 1000).alias("explicit"), (F.min("n_chars") / 100).alias("anchor"))
    return R.locked_source(sources)


LOCKED_SQL = """
WITH s AS (SELECT lang AS query_id, source, count(*) AS hits, max(n_chars) / 1000 AS explicit, min(n_chars) / 100 AS anchor FROM documents GROUP BY ALL),
t AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY query_id) AS n, coalesce(lead(hits) OVER w, 0) AS nh, coalesce(lead(explicit) OVER w, 0) AS ne, coalesce(lead(anchor) OVER w, 0) AS na
  FROM s WINDOW w AS (PARTITION BY query_id ORDER BY anchor DESC, explicit DESC, hits DESC, source)),
r AS (SELECT query_id, source, CASE WHEN n = 1 THEN 'single' WHEN anchor > 0 AND anchor >= greatest(1.0, na + 0.25) THEN 'anchor' WHEN explicit >= 6 AND explicit >= ne + 1.5 THEN 'explicit'
  WHEN hits >= greatest(2, 2 * nh) AND explicit >= greatest(4.0, ne) THEN 'hits' END AS reason FROM t WHERE place = 1)
SELECT * FROM r WHERE reason IS NOT NULL"""


def context_budget(spark, sf):
    """Documents of each source in order of size that fit a budget of characters."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("query_id"), "doc_id", "text", F.struct(F.length("text"), "doc_id").alias("rank"))
    return R.within_budget(docs).select("query_id", "doc_id", F.length("text").alias("chars"), "used")


BUDGET_SQL = """SELECT query_id, doc_id, length(text)::INT AS chars, used FROM (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used
 FROM (SELECT source AS query_id, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS rank FROM documents)) WHERE used <= 12000"""


def semantic_filter(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("query_id"), "doc_id", F.pmod("n_chars", F.lit(97)).cast("double").alias("score"))
    return R.keep_semantic(docs)


SEMANTIC_SQL = "WITH s AS (SELECT source AS query_id, doc_id, (n_chars % 97)::DOUBLE AS score FROM documents), k AS (SELECT *, score >= greatest(28, max(score) OVER (PARTITION BY query_id) - 35) AS keep FROM s) SELECT query_id, doc_id, score FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS found FROM k) WHERE keep OR NOT found"


def overlap_scores(spark, sf):
    """Each conversation turn against the first turn of its conversation, by three overlaps."""
    turns = table(spark, sf, "conversations")
    first = turns.where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("first_text"))
    pairs = turns.join(first, "conv_id")
    a, b = text.match_tokens("text"), text.match_tokens("first_text")
    return pairs.select("conv_id", "turn", F.round(scoring.geometric_overlap(a, b), 6).alias("geometric"), F.round(scoring.containment(a, b), 6).alias("containment"), F.round(scoring.jaccard(a, b), 6).alias("jaccard"), scoring.token_count(a, b).alias("token_count"))


OVERLAP_SQL = """
WITH f AS (SELECT conv_id, min(text) AS first_text FROM conversations WHERE turn = 0 GROUP BY 1),
p AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}') AS a, regexp_extract_all(lower(coalesce(first_text, '')), '[a-z0-9]{2,}') AS b FROM conversations JOIN f USING (conv_id)),
n AS (SELECT *, len(list_intersect(a, b)) AS common, len(list_distinct(a)) AS n, len(list_distinct(b)) AS m, len(list_distinct(list_concat(a, b))) AS u FROM p)
SELECT conv_id, turn, round(CASE WHEN n > 0 AND m > 0 THEN common / sqrt(n::DOUBLE * m) ELSE 0 END, 6) AS geometric, round(CASE WHEN n > 0 AND m > 0 THEN common / least(n, m) ELSE 0 END, 6) AS containment,
  round(CASE WHEN u > 0 THEN common / u ELSE 0 END, 6) AS jaccard, coalesce(list_sum(list_transform(b, lambda q: len(list_filter(a, lambda t: t = q)))), 0)::INT AS token_count FROM n"""


def score_calibration(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.coalesce("value", F.lit(0.0)).alias("v"), (F.pmod("event_id", F.lit(11)) / 2).alias("b"), (F.pmod("event_id", F.lit(7)) / 1.0).alias("d"), (F.pmod("event_id", F.lit(5)) - 2).cast("double").alias("t"), (F.pmod("event_id", F.lit(13)) - 6).cast("double").alias("a"))
    raw = F.least(F.col("v"), F.lit(100.0))
    return e.select(
        "event_id",
        F.round(scoring.calibrated_score(raw, F.col("b"), F.col("d"), F.col("t"), F.col("d"), F.col("b"), F.col("a"), F.col("event_id") % 2 == 0), 4).alias("calibrated"),
        F.round(scoring.combined_score(F.col("b"), F.col("d"), F.col("t"), F.col("a"), F.col("d"), F.col("a")), 4).alias("combined"),
        F.round(scoring.fallback_score(F.col("b"), F.col("d"), F.col("t"), F.col("d")), 4).alias("fallback"),
    )


CALIBRATION_SQL = """
WITH e AS (SELECT event_id, least(coalesce(value, 0), 100) AS raw, (event_id % 11) / 2 AS b, (event_id % 7)::DOUBLE AS d, (event_id % 5 - 2)::DOUBLE AS t, (event_id % 13 - 6)::DOUBLE AS a FROM events),
v AS (SELECT *, 100 * (0.34 * least(greatest((b - 0.5) / 6, 0), 1) + 0.18 * least(greatest(d / 4, 0), 1) + 0.16 * least(greatest((t + 1) / 5, 0), 1) + 0.22 * least(greatest(d / 10, 0), 1) + 0.10 * least(greatest(b / 10, 0), 1)) AS evidence,
  5.15 + 1.55 * tanh((b - 3) / 4) + 1.15 * tanh((d - 8) / 16) + 0.8 * tanh(t / 1.6) AS base FROM e),
s AS (SELECT *, 0.70 * raw + 0.30 * evidence + CASE WHEN event_id % 2 = 0 THEN 2 ELSE -4 END + CASE WHEN t < 0 THEN greatest(-12, 3 * t) ELSE 0 END AS s0 FROM v),
c AS (SELECT *, CASE WHEN b < 1 THEN least(s0, 60) WHEN b < 2 THEN least(s0, 68) ELSE s0 END AS s1 FROM s)
SELECT event_id, round(least(greatest(CASE WHEN a > 0 THEN greatest(s1, least(98, 82 + least(14, 0.8 * a))) ELSE s1 END, 0), 100), 4) AS calibrated,
  round(0.75 * b + 0.25 * (1.6 * pow(greatest(d, 0), 0.6)) + t + 1.5 * a + 1.15 * d + 0.35 * a, 4) AS combined,
  round(least(greatest(CASE WHEN d > 0 THEN 0.88 * base + 0.12 * d ELSE base END, 0), 10), 4) AS fallback FROM c"""

QUERIES = {"bm25_top_k": bm25_top_k, "term_statistics": term_statistics, "translated_choice": translated_choice, "evidence_groups": evidence_groups, "locked_source": locked_source, "context_budget": context_budget, "semantic_filter": semantic_filter, "overlap_scores": overlap_scores, "score_calibration": score_calibration}
ORACLE_SQL = {"bm25_top_k": BM25_SQL, "term_statistics": TERM_SQL, "translated_choice": CHOICE_SQL, "evidence_groups": GROUP_SQL, "locked_source": LOCKED_SQL, "context_budget": BUDGET_SQL, "semantic_filter": SEMANTIC_SQL, "overlap_scores": OVERLAP_SQL, "score_calibration": CALIBRATION_SQL}
