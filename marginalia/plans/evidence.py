"""Queries on evidence: atoms, section maps, overviews, levels, tasks and merges; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as V
from ..operators import markdown as M
from .common import table
from .markdown import KIND_SQL, PATHS


def _blocks(spark, sf):
    return M.blocks(M.with_heading_path(M.synthetic_lines(table(spark, sf, "documents")))).withColumnRenamed("line", "text")


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 12)"


def evidence_atoms(spark, sf):
    """Atoms of the paragraphs of documents; some blocks begin boxes, and some name a figure."""
    b = _blocks(spark, sf).where("kind = 'paragraph'")
    n = F.col("order_index")
    b = b.withColumn("text", F.when(n % 9 == 2, F.concat(F.lit("Box "), (n % 4).cast("string"), F.lit(". "), F.col("text"))).when(n % 5 == 1, F.concat("text", F.lit(" See Fig. 3 there."))).otherwise(F.col("text")))
    a = V.atoms(b)
    return a.select("doc_id", "atom_id", F.sha1("sentence").alias("sha1"), F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"), "figure", "box")


ATOM_SQL = f"""WITH {PATHS}, {KIND_SQL}, p0 AS (SELECT doc_id, block_id, order_index, heading_path, CASE WHEN order_index % 9 = 2 THEN 'Box ' || (order_index % 4) || '. ' || line WHEN order_index % 5 = 1 THEN line || ' See Fig. 3 there.' ELSE line END AS line FROM bk WHERE kind = 'paragraph'),
p1 AS (SELECT *, nullif(regexp_extract(line, '(?i)^\\W*box\\s*(\\d{{1,2}})\\b', 1), '')::INT AS ob FROM p0), p2 AS (SELECT *, last_value(ob IGNORE NULLS) OVER w AS bn, last_value(CASE WHEN ob IS NOT NULL THEN order_index END IGNORE NULLS) OVER w AS bi, last_value(CASE WHEN ob IS NOT NULL THEN heading_path END IGNORE NULLS) OVER w AS bh FROM p1 WINDOW w AS (PARTITION BY doc_id ORDER BY order_index)),
p3 AS (SELECT *, CASE WHEN order_index - bi <= {V.BOX_BLOCKS} AND trim(regexp_replace(lower(heading_path), '[\\s_]+', ' ', 'g')) = trim(regexp_replace(lower(bh), '[\\s_]+', ' ', 'g')) THEN bn ELSE 0 END AS box, coalesce(nullif(regexp_extract(heading_path || chr(10) || substr(line, 1, 2400), '(?i)fig(?:ure)?s?\\.?\\s*(\\d{{1,3}})', 1), '')::INT, 0) AS figure FROM p2),
a AS (SELECT doc_id, block_id, figure, coalesce(box, 0) AS box, unnest(range(0, len(ss))) AS n, unnest(ss) AS s FROM (SELECT *, list_slice({_SENTENCES}, 1, 10) AS ss FROM p3)),
m AS (SELECT *, regexp_extract_all(s, '\\[(\\d{{1,4}}(?:-\\d{{1,4}})?)\\]', 1) AS marks FROM a),
r AS (SELECT *, list_distinct(flatten(list_transform(marks, lambda x: range(string_split(x, '-')[1]::INT, string_split(x, '-')[-1]::INT + 1)))) AS ns FROM m)
SELECT doc_id, block_id || '#' || n AS atom_id, sha1(s) AS sha1, array_to_string(list_sort(ns), ',') AS refs, figure, box FROM r"""


def section_map(spark, sf):
    return V.section_map(_blocks(spark, sf).where("kind = 'paragraph'")).select("doc_id", "heading_path", "order_index", F.sha1("sentence").alias("sha1"), "place")


MAP_SQL = f"""WITH {PATHS}, {KIND_SQL}, f AS (SELECT doc_id, heading_path, order_index, ({_SENTENCES})[1] AS s FROM bk WHERE kind = 'paragraph'),
g AS (SELECT doc_id, heading_path, arg_min(s, order_index) AS s, min(order_index) AS order_index FROM f WHERE s IS NOT NULL GROUP BY ALL)
SELECT doc_id, heading_path, order_index::INT AS order_index, sha1(s) AS sha1, (row_number() OVER (PARTITION BY doc_id ORDER BY order_index))::INT AS place FROM g"""


def overview_snippets(spark, sf):
    return V.overview(_blocks(spark, sf)).select("doc_id", "block_id", "score", "place")


OVERVIEW_SQL = f"""WITH {PATHS}, {KIND_SQL}, s AS (SELECT *, round((greatest(1.1 - 0.09 * order_index, 0) + least(0.6, length(line) / 1500))::DOUBLE, 6) AS score FROM bk WHERE length(line) >= 90),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, heading_path ORDER BY score DESC, order_index) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, order_index) = 1)
SELECT doc_id, block_id, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, order_index) AS place FROM b) WHERE place <= 3"""


def _hits(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_type", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("p_"), "event_id")).alias("block_id"), F.when(F.col("event_id") % 4 == 1, F.lit("a")).alias("anchor_id"), F.when(F.col("event_id") % 5 > 0, F.lit("H")).otherwise("").alias("heading"), (F.col("value") / 100).alias("score"))


_HITS = "h AS (SELECT event_type, CASE WHEN event_id % 3 > 0 THEN 'p_' || event_id END AS block_id, CASE WHEN event_id % 4 = 1 THEN 'a' END AS anchor_id, CASE WHEN event_id % 5 > 0 THEN 'H' ELSE '' END AS heading, value / 100 AS score FROM events)"


def hit_levels(spark, sf):
    h = _hits(spark, sf)
    return V.level_summary(h.withColumn("level", V.hit_level(F.col("block_id"), F.col("anchor_id"), F.col("heading"), F.col("score"))), "event_type")


LEVEL_SQL = f"""WITH {_HITS}, l AS (SELECT event_type, CASE WHEN anchor_id IS NOT NULL AND score >= 0.9 THEN 'exact' WHEN block_id IS NOT NULL THEN 'block' WHEN heading <> '' THEN 'heading' ELSE 'none' END AS level FROM h)
SELECT event_type, count(*) FILTER (WHERE level = 'exact') AS exact, count(*) FILTER (WHERE level = 'block') AS block, count(*) FILTER (WHERE level = 'heading') AS heading, count(*) FILTER (WHERE level = 'none') AS none, round(avg((level <> 'none')::INT::DOUBLE), 4) AS located FROM l GROUP BY 1"""


def strict_identity(spark, sf):
    return V.strict_identity(_hits(spark, sf), "event_type")


STRICT_SQL = f"""WITH {_HITS}, m AS (SELECT event_type, concat_ws('+', CASE WHEN block_id IS NULL THEN 'block_id' END, CASE WHEN anchor_id IS NULL THEN 'anchor_id' END, CASE WHEN heading = '' THEN 'heading' END) AS missing FROM h)
SELECT event_type, count(*) AS candidates, count(*) FILTER (WHERE missing = '') AS strict, coalesce(string_agg(DISTINCT nullif(missing, ''), ',' ORDER BY nullif(missing, '')), '') AS reasons FROM m GROUP BY 1"""


def file_tasks(spark, sf):
    """Documents with the last task of their file, by path or else by name."""
    files = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", F.lit(""), "source", "doc_id").alias("path"), F.concat(F.lit("n"), F.pmod("doc_id", F.lit(40))).alias("name"))
    tasks = table(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/src"), F.pmod("event_id", F.lit(20)), F.lit("/"), F.pmod("event_id", F.lit(500)))).alias("path"), F.concat(F.lit("n"), F.pmod("user_id", F.lit(60))).alias("name"), F.col("event_type").alias("state"), F.struct("ts", "event_id").alias("at"))
    return V.with_task(files, tasks)


TASK_SQL = """WITH f AS (SELECT doc_id, '/' || source || '/' || doc_id AS path, 'n' || (doc_id % 40) AS name FROM documents),
t AS (SELECT CASE WHEN event_id % 2 = 0 THEN '/src' || (event_id % 20) || '/' || (event_id % 500) END AS path, 'n' || (user_id % 60) AS name, event_type AS state, ts, event_id FROM events),
p AS (SELECT path, state FROM t WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1), n AS (SELECT name, state FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) = 1)
SELECT doc_id, f.path, f.name, coalesce(p.state, n.state, 'idle') AS state FROM f LEFT JOIN p ON p.path = f.path LEFT JOIN n ON n.name = f.name"""


def richer_titles(spark, sf):
    """The first line of a document or, where that is empty or much shorter, its second."""
    d = table(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    return d.select("doc_id", V.richer(F.get("l", F.lit(0)), F.get("l", F.lit(1))).alias("title"))


RICHER_SQL = "SELECT doc_id, CASE WHEN coalesce(l[1], '') = '' THEN l[2] WHEN length(l[2]) >= length(l[1]) + 12 THEN l[2] ELSE l[1] END AS title FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"

QUERIES = {f.__name__: f for f in (evidence_atoms, section_map, overview_snippets, hit_levels, strict_identity, file_tasks, richer_titles)}
ORACLE_SQL = {"evidence_atoms": ATOM_SQL, "section_map": MAP_SQL, "overview_snippets": OVERVIEW_SQL, "hit_levels": LEVEL_SQL, "strict_identity": STRICT_SQL, "file_tasks": TASK_SQL, "richer_titles": RICHER_SQL}
