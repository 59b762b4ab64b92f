"""Queries on the library and conversation tables; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import library as L
from ..operators import references as X
from .common import table

VIEWS = """files AS (SELECT doc_id, sha1(text) AS sha1, '/lib/' || source || '/' || doc_id || '.pdf' AS path, lang, source, n_chars FROM documents),
meta AS (SELECT doc_id, 'q' || quality AS category, CASE WHEN toxic = 1 THEN 'skipped' WHEN doc_id % 3 = 0 THEN 'read' ELSE 'unread' END AS status FROM labels),
tags AS (SELECT doc_id, lang AS tag, 'user' AS origin FROM documents UNION ALL SELECT doc_id, source, 'suggested' FROM documents),
rec AS (SELECT f.*, coalesce(category, '') AS category, coalesce(status, 'unread') AS status FROM files f LEFT JOIN meta USING (doc_id))"""


def _views(spark, sf):
    return L.library_views(table(spark, sf, "documents"), table(spark, sf, "labels"))


def library_records(spark, sf):
    v = _views(spark, sf)
    return L.records(v["files"], v["meta"])


def category_frequency(spark, sf):
    return L.category_counts(_views(spark, sf)["meta"])


def tag_frequency(spark, sf):
    return L.tag_counts(_views(spark, sf)["tags"])


def category_tags(spark, sf):
    v = _views(spark, sf)
    return L.cooccurrence(v["meta"], v["tags"])


def category_cards(spark, sf):
    v = _views(spark, sf)
    return L.category_cards(L.records(v["files"], v["meta"]), v["tags"])


def facet_filter(spark, sf):
    v = _views(spark, sf)
    return L.faceted(L.records(v["files"], v["meta"]), v["tags"], category="q1", status="unread", tag="EN", keyword="src1").select("doc_id", "path", "category", "status")


def tag_lists(spark, sf):
    return L.tag_lists(_views(spark, sf)["tags"])


RULES = [("imaging", "edthe"), ("imaging", "the on"), ("learning", "und der"), ("learning", "tion"), ("optics", "les la"), ("survey", "in the"), ("survey", "is the and")]


def tag_suggestions(spark, sf):
    v = _views(spark, sf)
    docs = table(spark, sf, "documents")
    signals = docs.select("doc_id", F.lit("head").alias("signal"), F.lit(2.2).alias("weight"), text.suggestion_text(F.substring("text", 1, 200)).alias("text")).union(docs.select("doc_id", F.lit("body"), F.lit(1.1), text.suggestion_text("text")))
    return L.suggestions(spark.createDataFrame(RULES, "label string, phrase string"), signals, v["tags"]).select("doc_id", "label", "score", "place")


_RULES = ", ".join(f"('{a}', '{b}')" for a, b in RULES)
SUGGEST_SQL = f"""WITH {VIEWS}, rules(label, phrase) AS (VALUES {_RULES}),
sig AS (SELECT doc_id, 2.2 AS weight, trim(regexp_replace(lower(substr(text, 1, 200)), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents UNION ALL SELECT doc_id, 1.1, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) FROM documents),
sc AS (SELECT doc_id, label, round(sum(weight * (0.9 + 0.4 * (len(string_split(phrase, ' ')) - 1)))::DOUBLE, 6) AS score FROM sig JOIN rules ON contains(' ' || t || ' ', ' ' || phrase || ' ') GROUP BY ALL),
fr AS (SELECT sc.* FROM sc ANTI JOIN (SELECT doc_id, lower(tag) AS label FROM tags WHERE origin = 'user') u USING (doc_id, label) WHERE score >= 1.8)
SELECT doc_id, label, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS place FROM fr) WHERE place <= 6"""


def duplicate_files(spark, sf):
    return L.duplicates(_views(spark, sf)["files"]).select("doc_id", "sha1", "copies", "first_path")


def unconverted(spark, sf):
    """Files without a label row, and those with one among odd ids (anti joins)."""
    v = _views(spark, sf)
    stems = v["files"].select(text.stem("path").alias("stem"))
    done = v["meta"].select(F.col("doc_id").cast("string").alias("stem"))
    return L.missing_outputs(stems, done)


def upsert_meta(spark, sf):
    """Meta rows after changes from events: the last change of a document wins and empty fields keep their value."""
    v = _views(spark, sf)
    changes = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "view", "seen").alias("category"), F.when(F.col("event_type") == "click", "opened").alias("status"), F.struct("ts", "event_id").alias("at"))
    return L.upserted(v["meta"], changes, ["doc_id"], "at")


UPSERT_SQL = f"""WITH {VIEWS}, c AS (SELECT user_id AS doc_id, CASE WHEN event_type = 'view' THEN 'seen' END AS c2, CASE WHEN event_type = 'click' THEN 'opened' END AS s2 FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT coalesce(m.doc_id, c.doc_id) AS doc_id, coalesce(c2, category) AS category, coalesce(s2, status) AS status FROM meta m FULL JOIN c USING (doc_id)"""


def delete_cascade(spark, sf):
    v = _views(spark, sf)
    gone = v["files"].where("n_chars < 100")
    return L.deleted(v["tags"], gone, ["doc_id"]).groupBy("origin").agg(F.count("*").alias("n"))


def archive_overflow(spark, sf):
    conv = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns")).withColumn("project", F.pmod("conv_id", F.lit(5)))
    return L.archived(conv, 4, "project", [F.desc("turns"), F.desc("conv_id")])


def message_page(spark, sf):
    msgs = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role")
    return L.keyset_page(msgs, 20_000, 25)


def resolved_paths(spark, sf):
    v = _views(spark, sf)
    want = v["files"].select(F.col("doc_id").alias("want_id"), F.when(F.col("doc_id") % 3 == 0, F.upper("path")).when(F.col("doc_id") % 3 == 1, F.lit("/gone/x.pdf")).otherwise(F.concat(F.lit("C:\\other\\"), F.col("doc_id").cast("string"), F.lit(".en.pdf"))).alias("path"), F.when(F.col("doc_id") % 3 == 1, F.col("sha1")).otherwise("").alias("sha1"))
    want = want.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
    return X.resolve(want, v["files"])


RESOLVE_SQL = f"""WITH {VIEWS}, w AS (SELECT doc_id AS want_id, CASE WHEN doc_id % 3 = 0 THEN upper(path) WHEN doc_id % 3 = 1 THEN '/gone/x.pdf' ELSE 'C:/other/' || doc_id || '.en.pdf' END AS path, CASE WHEN doc_id % 3 = 1 THEN sha1 ELSE '' END AS sha1, doc_id FROM files),
p AS (SELECT lower(path) AS k, min(path) AS f FROM files GROUP BY 1), s AS (SELECT sha1 AS k, min(path) AS f FROM files GROUP BY 1), t AS (SELECT doc_id::VARCHAR AS k, min(path) AS f FROM files GROUP BY 1)
SELECT want_id, coalesce(p.f, s.f, t.f) AS found, CASE WHEN p.f IS NOT NULL THEN 'path' WHEN s.f IS NOT NULL THEN 'sha1' WHEN t.f IS NOT NULL THEN 'stem' ELSE 'none' END AS how
FROM w LEFT JOIN p ON p.k = lower(w.path) LEFT JOIN s ON s.k = w.sha1 LEFT JOIN t ON t.k = CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR WHEN doc_id % 3 = 1 THEN 'x' ELSE doc_id::VARCHAR END"""


def ordered_turns(spark, sf):
    """Conversations with their turns in order, as one string of roles, and the newest first."""
    t = table(spark, sf, "conversations")
    return t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]), ">").alias("roles"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def message_merge(spark, sf):
    """An older page and the current rows as one, each id once."""
    t = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    return t.where("id % 3 < 2").union(t.where("id % 3 > 0")).dropDuplicates(["id"])


def all_tags(spark, sf):
    tags = _views(spark, sf)["tags"]
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.min("tag").alias("label"), F.countDistinct("doc_id").alias("docs"))


def newest_files(spark, sf):
    """The largest files of each source (a listing's first page)."""
    f = _views(spark, sf)["files"]
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), F.lower("path")))
    return f.withColumn("place", place).where("place <= 5").select("source", "path", "n_chars", "place")


QUERIES = {f.__name__: f for f in (library_records, category_frequency, tag_frequency, category_tags, category_cards, facet_filter, tag_lists, tag_suggestions, duplicate_files, unconverted, upsert_meta, delete_cascade, archive_overflow, message_page, resolved_paths, ordered_turns, message_merge, all_tags, newest_files)}
ORACLE_SQL = {
    "library_records": f"WITH {VIEWS} SELECT * FROM rec",
    "category_frequency": f"WITH {VIEWS} SELECT category, count(*) AS n FROM meta GROUP BY 1",
    "tag_frequency": f"WITH {VIEWS} SELECT lower(tag) AS tag_norm, count(*) AS n, min(tag) AS label FROM tags GROUP BY 1",
    "category_tags": f"WITH {VIEWS} SELECT category, tag, count(*) AS n FROM meta JOIN tags USING (doc_id) WHERE origin = 'user' GROUP BY ALL",
    "category_cards": f"""WITH {VIEWS}, k AS (SELECT category, tag, count(*) AS k FROM rec JOIN tags USING (doc_id) GROUP BY ALL),
t AS (SELECT category, string_agg(tag, ',' ORDER BY place) AS top_tags FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY k DESC, tag) AS place FROM k) WHERE place <= 3 GROUP BY 1)
SELECT category, n, unread, chars, top_tags FROM (SELECT category, count(*) AS n, count(*) FILTER (WHERE status = 'unread') AS unread, sum(n_chars)::BIGINT AS chars FROM rec GROUP BY 1) LEFT JOIN t USING (category)""",
    "facet_filter": f"WITH {VIEWS} SELECT doc_id, path, category, status FROM rec WHERE category = 'q1' AND status = 'unread' AND contains(lower(path || ' ' || category), 'src1') AND doc_id IN (SELECT doc_id FROM tags WHERE lower(tag) = 'en')",
    "tag_lists": f"WITH {VIEWS} SELECT doc_id, origin, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY ALL",
    "tag_suggestions": SUGGEST_SQL,
    "duplicate_files": f"WITH {VIEWS} SELECT doc_id, sha1, copies, first_path FROM (SELECT *, count(*) OVER (PARTITION BY sha1) AS copies, min(path) OVER (PARTITION BY sha1) AS first_path FROM files) WHERE copies > 1",
    "unconverted": f"WITH {VIEWS} SELECT doc_id::VARCHAR AS stem FROM files ANTI JOIN meta USING (doc_id)",
    "upsert_meta": UPSERT_SQL,
    "delete_cascade": f"WITH {VIEWS} SELECT origin, count(*) AS n FROM tags WHERE doc_id NOT IN (SELECT doc_id FROM files WHERE n_chars < 100) GROUP BY 1",
    "archive_overflow": "SELECT *, row_number() OVER (PARTITION BY project ORDER BY turns DESC, conv_id DESC) > 4 AS archived FROM (SELECT conv_id, max(turn) AS turns, conv_id % 5 AS project FROM conversations GROUP BY 1)",
    "message_page": "WITH m AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role FROM conversations), p AS (SELECT * FROM m WHERE id < 20000 ORDER BY id DESC LIMIT 25) SELECT *, (SELECT count(*) FROM m WHERE id < 20000) > 25 AS has_more FROM p",
    "resolved_paths": RESOLVE_SQL,
    "ordered_turns": "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1",
    "message_merge": "SELECT DISTINCT conv_id * 1000 + turn AS id, role FROM conversations",
    "all_tags": f"WITH {VIEWS} SELECT lower(tag) AS tag, min(tag) AS label, count(DISTINCT doc_id) AS docs FROM tags GROUP BY 1",
    "newest_files": f"WITH {VIEWS} SELECT source, path, n_chars, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, lower(path)) AS place FROM files) WHERE place <= 5",
}
