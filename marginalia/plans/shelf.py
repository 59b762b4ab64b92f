"""Queries on conversations, projects, renders and cards; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shelf as S
from .common import table

#: The kinds of changes that the event types stand for.
KINDS = {"click": "create", "view": "touch", "signup": "archive", "purchase": "retitle", "error": "delete"}
_MAP = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"


def _changes(spark, sf):
    e = table(spark, sf, "events")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    title = F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(S.DEFAULT_TITLE)).otherwise(F.concat(F.lit(" talk\n"), F.repeat("event_type", 20), F.col("event_id").cast("string")))
    return e.select(F.concat(F.lit("c"), F.pmod("user_id", F.lit(500))).alias("conv_id"), kind.alias("kind"), title.alias("title"), F.concat(F.lit("p"), F.pmod("event_id", F.lit(40))).alias("project"), F.struct("ts", "event_id").alias("at"), "ts", "event_id")


CHANGES = f"""ch AS (SELECT 'c' || (user_id % 500) AS conv_id, {_MAP} AS kind, CASE WHEN event_id % 3 = 0 THEN '{S.DEFAULT_TITLE}' ELSE ' talk' || chr(10) || repeat(event_type, 20) || event_id END AS title, 'p' || (event_id % 40) AS project, {{'ts': ts, 'id': event_id}} AS ats FROM events)"""


def conversation_states(spark, sf):
    """Conversations after creates, titles, touches, archivings and deletions from the events."""
    return S.conversations(_changes(spark, sf)).select("conv_id", "title", "project", F.col("created.event_id").alias("created"), F.col("updated.event_id").alias("updated"), "archived")


CONVERSATIONS = f"""{CHANGES}, al AS (SELECT * FROM (SELECT *, max(ats) FILTER (WHERE kind = 'delete') OVER (PARTITION BY conv_id) AS gone FROM ch) WHERE gone IS NULL OR ats > gone),
ti AS (SELECT *, substr(trim(replace(title, chr(10), ' ')), 1, {S.TITLE_CHARS}) AS t FROM al),
cv AS (SELECT conv_id, min(ats) FILTER (WHERE kind = 'create') AS created, max(ats) FILTER (WHERE kind IN ('create', 'retitle', 'touch')) AS updated, max(ats) FILTER (WHERE kind = 'archive') AS arch,
  coalesce(arg_min(t, ats) FILTER (WHERE kind IN ('create', 'retitle') AND t <> '' AND t <> '{S.DEFAULT_TITLE}'), '{S.DEFAULT_TITLE}') AS title, arg_max(project, ats) FILTER (WHERE kind = 'create') AS project FROM ti GROUP BY 1 HAVING count(*) FILTER (WHERE kind = 'create') > 0)"""
CONVERSATION_SQL = f"WITH {CONVERSATIONS} SELECT conv_id, title, project, created.id AS created, updated.id AS updated, coalesce(arch > updated, false) AS archived FROM cv"


def project_states(spark, sf):
    """Conversations of the projects that are left, by name."""
    c = _changes(spark, sf)
    own = c.select("project", F.when(F.pmod("event_id", F.lit(5)) == 0, "delete").when(F.pmod("event_id", F.lit(5)) == 1, "rename").otherwise("create").alias("kind"), F.concat(F.lit("name "), "kind").alias("name"), "at")
    left, conv = S.projects(own, S.conversations(c))
    return conv.join(left, "project", "left").groupBy("project", "name").agg(F.count("*").alias("conversations"))


PROJECT_SQL = f"""WITH {CONVERSATIONS}, pe AS (SELECT project, CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'rename' ELSE 'create' END AS kind, 'name ' || {_MAP} AS name, ts, event_id FROM (SELECT *, 'p' || (event_id % 40) AS project FROM events)),
la AS (SELECT project, arg_max(kind, {{'t': ts, 'i': event_id}}) AS kind, arg_max(name, {{'t': ts, 'i': event_id}}) FILTER (WHERE kind <> 'delete') AS name FROM pe GROUP BY 1)
SELECT CASE WHEN la.kind = 'delete' THEN NULL ELSE cv.project END AS project, CASE WHEN la.kind = 'delete' THEN NULL ELSE name END AS name, count(*) AS conversations FROM cv LEFT JOIN la ON la.project = cv.project GROUP BY ALL"""


def render_states(spark, sf):
    """Renders of turns after changes that expect a signature."""
    refs = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("msg_id"), F.concat(F.lit("s"), F.pmod("conv_id", F.lit(3))).alias("sig"), F.lit("pending").alias("status"), F.lit(0).alias("attempts")).dropDuplicates(["msg_id"])
    e = table(spark, sf, "events")
    n = lambda k: F.pmod("event_id", F.lit(k))
    changes = e.select(
        (F.pmod("user_id", F.lit(60)) * 100 + n(6)).alias("msg_id"), F.when(n(2) == 0, F.concat(F.lit("s"), n(3))).alias("sig"), F.when(n(4) > 0, F.concat(F.lit("s"), n(3))).alias("expected_sig"),
        F.when(n(5) == 0, "ready").when(n(5) == 1, "failed").alias("status"), F.when(n(7) > 3, (n(7) - 5).cast("int")).alias("attempts"), F.struct("ts", "event_id").alias("at"),
    )
    return S.rendered(refs, changes)


RENDER_SQL = """WITH r AS (SELECT DISTINCT conv_id * 100 + turn AS msg_id, 's' || (conv_id % 3) AS sig FROM conversations),
c AS (SELECT (user_id % 60) * 100 + event_id % 6 AS msg_id, CASE WHEN event_id % 2 = 0 THEN 's' || (event_id % 3) END AS nsig, CASE WHEN event_id % 4 > 0 THEN 's' || (event_id % 3) END AS want, CASE event_id % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' END AS status, CASE WHEN event_id % 7 > 3 THEN event_id % 7 - 5 END AS attempts, {'t': ts, 'i': event_id} AS ats FROM events),
f AS (SELECT msg_id, arg_max(nsig, ats) FILTER (WHERE nsig IS NOT NULL) AS nsig, arg_max(status, ats) FILTER (WHERE status IS NOT NULL) AS status, arg_max(attempts, ats) FILTER (WHERE attempts IS NOT NULL) AS attempts FROM c JOIN r USING (msg_id) WHERE want IS NULL OR want = sig GROUP BY 1)
SELECT msg_id, coalesce(nsig, sig) AS sig, coalesce(status, 'pending') AS status, greatest(coalesce(attempts, 0), 0)::INT AS attempts FROM r LEFT JOIN f USING (msg_id)"""


def ensured_records(spark, sf):
    """Library records with one for each file whose content has none yet."""
    d = table(spark, sf, "documents").select(F.sha1(F.coalesce("text", F.lit(""))).alias("sha1"), F.concat_ws("/", F.lit("/lib"), "source", "doc_id").alias("path"), "doc_id")
    have = d.where("doc_id % 3 = 0").groupBy("sha1").agg(F.max("path").alias("path"))
    return S.ensured(have, d.select("sha1", "path"))


ENSURE_SQL = """WITH d AS (SELECT sha1(coalesce(text, '')) AS sha1, '/lib/' || source || '/' || doc_id AS path, doc_id FROM documents), h AS (SELECT sha1, max(path) AS path FROM d WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT * FROM h UNION ALL SELECT sha1, min(path) FROM d WHERE sha1 NOT IN (SELECT sha1 FROM h) GROUP BY 1"""


def card_flags(spark, sf):
    """Hits that no filter drops, terms that are only negated, and years, times and values of their records."""
    e = table(spark, sf, "events")
    n = lambda k: F.pmod("event_id", F.lit(k))
    surface = F.concat(F.when(n(4) == 0, "it works without any ").when(n(4) == 1, "not one but a real ").otherwise("the "), "event_type", F.when(n(6) == 0, F.concat(F.lit(" and "), "event_type")).otherwise(""))
    negated = None
    for t in KINDS:
        negated = F.when(F.col("event_type") == t, S.only_negated(t, surface)) if negated is None else negated.when(F.col("event_type") == t, S.only_negated(t, surface))
    work = F.concat(F.lit('{"'), F.when(n(3) == 0, "issued").when(n(3) == 1, "created").otherwise("other"), F.lit('": {"date-parts": [['), F.when(n(5) == 0, F.lit(93)).otherwise(n(60) + 1980), F.lit(']]}, "a": {"b": {"c": '), "event_id", F.lit("}}}"))
    return e.select(
        "event_id", S.force_kept(F.when(n(9) == 0, "Pending"), n(8).cast("double"), F.when(n(5) == 0, "figure"), (n(4) - 2).cast("double")).alias("kept"), negated.alias("negated"), S.published_year(work).alias("year"), S.metric_at(work, "a.b.c").alias("metric"),
        S.epoch(F.lit(1_700_000_000) + F.col("event_id") / 4).alias("at"), S.is_fresh(F.col("ts").cast("timestamp"), F.timestamp_seconds(F.col("ts").cast("timestamp").cast("long") + n(12)), F.when(n(3) > 0, n(40).cast("double") - 3)).alias("fresh"),
    )


FLAG_SQL = """WITH e AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'it works without any ' WHEN 1 THEN 'not one but a real ' ELSE 'the ' END || event_type || CASE WHEN event_id % 6 = 0 THEN ' and ' || event_type ELSE '' END AS s, epoch(ts) AS t FROM events)
SELECT event_id, event_id % 9 = 0 OR event_id % 8 >= 6 OR (event_id % 5 = 0 AND event_id % 4 - 2 > 0) AS kept, event_id % 4 < 2 AND event_id % 6 <> 0 AS negated,
 CASE WHEN event_id % 3 = 2 OR event_id % 5 = 0 THEN '' ELSE (event_id % 60 + 1980)::VARCHAR END AS year, event_id::VARCHAR AS metric, make_timestamp(1700000000000000 + event_id * 250000) AS at,
 (floor(t) + event_id % 12) - t <= CASE WHEN event_id % 3 = 0 THEN 6 ELSE least(greatest(event_id % 40 - 3, 0), 30) END AS fresh FROM e"""


def _items(spark, sf):
    d = table(spark, sf, "documents")
    tags = F.when(F.pmod("doc_id", F.lit(4)) > 0, F.array(F.initcap("lang"), "source")).otherwise(F.array().cast("array<string>"))
    return d.select(F.col("doc_id").alias("id"), tags.alias("tags"), F.when(F.pmod("doc_id", F.lit(6)) > 0, F.col("source")).otherwise(" ").alias("source"), F.when(F.pmod("doc_id", F.lit(5)) > 0, F.pmod("n_chars", F.lit(300))).alias("cited"))


def shelf_groups(spark, sf):
    return S.shelf_groups(_items(spark, sf))


GROUP_SQL = """WITH i AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 > 0 THEN upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) ELSE '未标记' END AS tag, CASE WHEN doc_id % 6 > 0 AND trim(source) <> '' THEN trim(source) ELSE '未知来源' END AS src FROM documents),
b AS (SELECT id, 'tag' AS mode, lower(tag) AS key, tag AS label FROM i UNION ALL SELECT id, 'source', src, src FROM i) SELECT mode, key, count(*) AS items, min(id) AS first, arg_min(label, id) AS label FROM b GROUP BY ALL"""


def shelf_pages(spark, sf):
    """The first page of the shelf of each source, by citations."""
    from pyspark.sql import Window

    i = _items(spark, sf)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.coalesce("cited", F.lit(0))), "id"))
    return i.withColumn("place", place).where("place <= 20").select("id", "source", "cited", "place")


PAGE_SQL = """WITH i AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 > 0 THEN source ELSE ' ' END AS source, CASE WHEN doc_id % 5 > 0 THEN n_chars % 300 END AS cited FROM documents)
SELECT id, source, cited, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(cited, 0) DESC, id) AS place FROM i) WHERE place <= 20"""


def label_candidates(spark, sf):
    """The best words of each language as labels, by how many documents have them."""
    d = table(spark, sf, "documents").select("lang", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)))).alias("label"))
    c = d.groupBy("lang", "label").agg(F.count("*").alias("n")).withColumn("score", F.floor(F.col("n") / 10).cast("double"))
    return S.ranked_labels(c, "lang", 18).select("lang", "label", "score", "n", "place")


LABEL_SQL = """WITH d AS (SELECT lang, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{4,}'))) AS label FROM documents), c AS (SELECT lang, label, count(*) AS n, floor(count(*) / 10)::DOUBLE AS score FROM d GROUP BY ALL)
SELECT lang, label, score, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, n DESC, lower(label), label) AS place FROM c) WHERE place <= 18"""


def library_counts(spark, sf):
    e = table(spark, sf, "events")
    n = lambda k: F.pmod("event_id", F.lit(k))
    return S.library_counts(e.select(F.when(n(2) == 0, "pending").otherwise("converted").alias("category"), F.when(n(5) == 0, "queued").when(n(5) == 1, "running").otherwise("idle").alias("state"), (n(3) == 0).alias("replaces")))


COUNT_SQL = "SELECT count(*) AS total, count(*) FILTER (WHERE event_id % 2 = 0) AS pending, count(*) FILTER (WHERE event_id % 2 = 1) AS converted, count(*) FILTER (WHERE event_id % 5 = 0) AS queued, count(*) FILTER (WHERE event_id % 5 = 1) AS running, count(*) FILTER (WHERE event_id % 3 = 0 AND event_id % 5 < 2) AS reconverting FROM events"


def selected_cases(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat(F.lit("paper"), F.pmod("conv_id", F.lit(4))).alias("paper_id"), F.concat_ws("-", F.lit("Case"), "conv_id", "turn").alias("case_id"), F.initcap("role").alias("family"), F.array(F.concat(F.lit("T"), F.pmod("turn", F.lit(3)))).alias("tags"))
    return S.selected_cases(c, ["paper1", "paper2"], ["t2", "USER", "case-1-0"]).select("paper_id", "case_id", "family")


CASE_SQL = """SELECT paper_id, case_id, family FROM (SELECT 'paper' || (conv_id % 4) AS paper_id, 'Case-' || conv_id || '-' || turn AS case_id, upper(substr(role, 1, 1)) || lower(substr(role, 2)) AS family, turn, role FROM conversations)
WHERE paper_id IN ('paper1', 'paper2') AND (lower(case_id) = 'case-1-0' OR lower(role) = 'user' OR turn % 3 = 2)"""

QUERIES = {f.__name__: f for f in (conversation_states, project_states, render_states, ensured_records, card_flags, shelf_groups, shelf_pages, label_candidates, library_counts, selected_cases)}
ORACLE_SQL = {
    "conversation_states": CONVERSATION_SQL, "project_states": PROJECT_SQL, "render_states": RENDER_SQL, "ensured_records": ENSURE_SQL, "card_flags": FLAG_SQL, "shelf_groups": GROUP_SQL, "shelf_pages": PAGE_SQL,
    "label_candidates": LABEL_SQL, "library_counts": COUNT_SQL, "selected_cases": CASE_SQL,
}
