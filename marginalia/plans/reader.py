"""Queries on what a reader sees; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import library as L
from ..operators import reader as R
from .answers import AFFINITY_SQL
from .common import PROMPTS, prompts, table
from .indices import RICH, blocks
from .library import VIEWS, _views
from .markdown import LINES, TAIL, _items, _md


def annotated_lines(spark, sf):
    """Lines with citations as links to the document's references."""
    refs = _items(spark, sf).select("doc_id", F.col("num").cast("int").alias("num"), F.substring(F.regexp_replace("text", "[\"\\s]+", " "), 1, 12).alias("label"))
    return R.annotated(_md(spark, sf), refs).where("known + unknown > 0")


ANNOTATED_SQL = f"""WITH {LINES}, {TAIL}, rf AS (SELECT doc_id, map_from_entries(list({{'k': num::INT, 'v': substr(regexp_replace(text, '["\\s]+', ' ', 'g'), 1, 12)}})) AS m FROM it GROUP BY 1),
c AS (SELECT md.*, m, string_split(regexp_replace(line, '({R.CITATION})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps FROM md LEFT JOIN rf USING (doc_id)),
n AS (SELECT *, list_transform(ps, lambda p: list_filter(flatten(list_transform(string_split(trim(p, '[]'), ','), lambda s: range(try_cast(trim(string_split(s, '-')[1]) AS INT), coalesce(try_cast(trim(string_split(s, '-')[2]) AS INT), try_cast(trim(string_split(s, '-')[1]) AS INT)) + 1))), lambda x: x IS NOT NULL)) AS ns FROM c),
l AS (SELECT *, list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN i % 2 = 0 AND len(ns[i]) > 0 THEN '[' || array_to_string(list_transform(ns[i], lambda x: CASE WHEN len(map_extract(m, x::INT)) > 0 THEN '[' || x || '](#ref-' || x || ' "' || map_extract(m, x::INT)[1] || '")' ELSE x::VARCHAR END), ', ') || ']' ELSE ps[i] END) AS made,
  list_distinct(flatten(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN i % 2 = 0 THEN ns[i] ELSE [] END))) AS nums FROM n),
k AS (SELECT *, len(list_filter(nums, lambda x: len(map_extract(m, x::INT)) > 0)) AS known FROM l)
SELECT doc_id, pos::INT AS pos, array_to_string(made, '') AS line, known::INT AS known, (len(nums) - known)::INT AS unknown FROM k WHERE len(nums) > 0"""


def resolved_markers(spark, sf):
    """Answers with markers for their evidence, resolved by slots of the conversation's turns."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("own"))
    n = F.pmod(F.col("turn"), F.lit(4))
    mark = F.concat(F.lit("[[SUPPORT:DOC-"), F.pmod(F.col("turn"), F.lit(3)).cast("string"), F.when(n > 0, F.concat(F.lit("-S"), n.cast("string"))).otherwise(""), F.lit("]]"))
    a = t.groupBy(F.col("conv_id").alias("answer_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("own", F.lit(" "), mark).alias("l")))), lambda r: r["l"]), "\n").alias("text"))
    slots = t.where("turn % 2 = 0").select(F.col("conv_id").alias("answer_id"), F.concat(F.lit("doc-"), F.pmod(F.col("turn"), F.lit(3)).cast("string"), F.when(n > 0, F.concat(F.lit("-s"), n.cast("string"))).otherwise("")).alias("marker"), F.concat(F.lit("id"), F.pmod("conv_id", F.lit(9)).cast("string")).alias("source"), F.slice(F.array(F.lit(7), F.lit(9)), 1, F.pmod(F.col("turn"), F.lit(5)).cast("int")).alias("refs"))
    return R.resolved_markers(a, slots)


MARKER_SQL = """WITH t AS (SELECT conv_id AS answer_id, turn, substr(coalesce(text, ''), 1, 60) AS own, 'DOC-' || (turn % 3) || CASE WHEN turn % 4 > 0 THEN '-S' || (turn % 4) ELSE '' END AS mk FROM conversations),
s AS (SELECT answer_id, mk, min(coalesce(array_to_string(list_transform([7, 9][1:turn % 5], lambda r: '[[CITE:id' || (answer_id % 9) || ':' || r || ']]'), ''), '')) AS token FROM t WHERE turn % 2 = 0 GROUP BY ALL),
j AS (SELECT t.*, coalesce(token, '') AS token FROM t LEFT JOIN s USING (answer_id, mk))
SELECT answer_id, string_agg(own || ' ' || token, chr(10) ORDER BY turn, own) AS text, count(*) FILTER (WHERE token <> '')::INT AS resolved, count(*) FILTER (WHERE token = '')::INT AS dropped FROM j GROUP BY 1"""


def bound_sources(spark, sf):
    """Hits of one bound source, by path and by name, and all others, by language."""
    h = table(spark, sf, "documents").select("lang", F.concat(F.lit("/Lib/"), "source", F.lit("/"), F.pmod("doc_id", F.lit(50)).cast("string"), F.lit(".en.md")).alias("path"))
    kept, rest = R.bound_hits(h, "\\lib\\src1\\7.EN.md", "11.pdf"), R.unbound_hits(h, "/lib/src1/7.en.md", "11.pdf")
    return kept.groupBy("lang").agg(F.count("*").alias("n")).withColumn("bound", F.lit(True)).unionByName(rest.groupBy("lang").agg(F.count("*").alias("n")).withColumn("bound", F.lit(False)))


BOUND_SQL = "SELECT lang, count(*) AS n, (source = 'src1' AND doc_id % 50 = 7) OR doc_id % 50 = 11 AS bound FROM documents GROUP BY ALL"


def figure_states(spark, sf):
    """Images of the text against the figure rows of pages."""
    b = blocks(spark, sf)
    own = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(9), F.lit(2))).alias("k"))
    rows = own.select("doc_id", F.concat(F.lit("f"), "k", F.lit(".png")).alias("asset"), (F.col("k") + F.pmod("doc_id", F.lit(3))).cast("int").alias("page"))
    return R.reconciled_figures(b.select("doc_id", "pos", "line"), rows)


STATE_SQL = f"""WITH {RICH}, l AS (SELECT doc_id, pos, string_split(unnest(regexp_extract_all(line, '!\\[[^\\]]*\\]\\(([^)]*)\\)', 1)), '/')[-1] AS asset FROM bk), g AS (SELECT doc_id, asset, min(pos)::INT AS pos, count(*) AS links FROM l GROUP BY ALL),
f AS (SELECT doc_id, 'f' || k || '.png' AS asset, (k + doc_id % 3)::INT AS page FROM (SELECT doc_id, unnest([1, 3, 5, 7, 9]) AS k FROM documents))
SELECT doc_id, asset, pos, links, page, CASE WHEN pos IS NULL THEN 'not shown' WHEN page IS NULL THEN 'not known' ELSE 'matched' END AS state FROM g FULL JOIN f USING (doc_id, asset)"""


def reader_documents(spark, sf):
    """The text and anchors of each document, with its image links rewritten."""
    from ..operators import indices as I

    b = blocks(spark, sf)
    d = R.reader_documents(b, I.anchors(b))
    return d.select("doc_id", F.sha1(R.asset_links("text", "/data/assets")).alias("text"), F.size("anchors").alias("anchors"), F.col("anchors")[0]["anchor_id"].alias("first"), F.element_at("anchors", -1)["block_id"].alias("last"))


READER_SQL = f"""WITH {RICH}, r AS (SELECT *, CASE WHEN kind = 'figure' THEN regexp_replace(line, '\\(assets/(f\\d+)\\.png\\)', '(/api/references/asset?path=%2Fdata%2Fassets%2Fassets%2F\\1.png)') ELSE line END AS made FROM bk)
SELECT doc_id, sha1(string_agg(made, chr(10) ORDER BY order_index)) AS text, count(*)::INT AS anchors, arg_min('a_' || block_id, order_index) AS first, arg_max(block_id, order_index) AS last FROM r GROUP BY 1"""


def prompt_focus(spark, sf):
    """The focus terms of each prompt, and how many of them the turns of the conversation name."""
    p = prompts(spark, sf)
    asked = p.where("turn = 0").select("conv_id", R.focus_terms(F.concat("text", F.lit(" and 'Deep Net' GAP-TV x2y"), F.when(F.pmod("conv_id", F.lit(2)) == 0, F.lit(" GAP-TV2")).otherwise(""))).alias("terms"))
    both = p.join(asked, "conv_id").select("conv_id", "turn", F.array_join("terms", "|").alias("terms"), R.focus_matches(F.col("terms"), F.concat("text", F.when(F.pmod("turn", F.lit(2)) == 0, F.lit(" gap tv of deep-net")).otherwise(""))).alias("n"))
    return both


_NORM = lambda x: f"trim(regexp_replace(regexp_replace(lower(trim({x})), '\\.pdf$', ''), '[^a-z0-9]+', ' ', 'g'))"
_FOCUS_STOP = "[" + ", ".join(f"'{w}'" for w in R.FOCUS_STOP) + "]"
FOCUS_SQL = f"""WITH {PROMPTS}, a AS (SELECT conv_id, text || ' and ''Deep Net'' GAP-TV x2y' || CASE WHEN conv_id % 2 = 0 THEN ' GAP-TV2' ELSE '' END AS x FROM pr WHERE turn = 0),
w AS (SELECT *, list_concat(regexp_extract_all(x, '["'']([^"'']{{2,80}})["'']', 1), list_filter(regexp_extract_all(x, '[A-Za-z][A-Za-z0-9_-]{{1,40}}'), lambda w: (regexp_matches(substr(w, 2), '[A-Z]') OR regexp_matches(w, '[0-9-]')) AND NOT list_contains({_FOCUS_STOP}, w))) AS raw FROM a),
n AS (SELECT *, list_filter(list_transform(raw, lambda t: {_NORM("t")}), lambda t: length(t) >= 3) AS ts FROM w), d AS (SELECT *, list_filter(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN list_position(ts, ts[i]) = i THEN ts[i] END), lambda t: t IS NOT NULL) AS di FROM n),
f AS (SELECT *, list_filter(di, lambda t: len(list_filter(di, lambda o: o <> t AND length(o) > length(t) AND contains(o, t) AND NOT regexp_matches(o, '\\b(?:and|vs|versus)\\b'))) = 0)[1:8] AS terms FROM d)
SELECT conv_id, turn, array_to_string(terms, '|') AS terms, len(list_filter(terms, lambda t: contains(' ' || {_NORM("text || CASE WHEN turn % 2 = 0 THEN ' gap tv of deep-net' ELSE '' END")} || ' ', ' ' || t || ' ')))::INT AS n FROM pr JOIN f USING (conv_id)"""


def category_suggestions(spark, sf):
    """Categories for documents without one, by the categories that their tags stand with; the half of them have dismissed one."""
    v = _views(spark, sf)
    user = v["tags"].where("origin = 'user'")
    scores = A.affinity(user.select("doc_id", "tag"), L.cooccurrence(v["meta"], v["tags"])).withColumn("score", F.col("score") + F.length("category") / 2 + F.pmod("doc_id", F.lit(3)) / 10)
    meta = v["files"].select("doc_id").join(v["meta"], "doc_id", "left").select("doc_id", F.when(F.pmod("doc_id", F.lit(4)) > 0, "").otherwise(F.coalesce("category", F.lit(""))).alias("category"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "q1").alias("dismissed"))
    return R.suggested_category(scores, meta)


CATEGORY_SQL = f"""WITH sc AS (SELECT doc_id, category, score + length(category) / 2 + (doc_id % 3) / 10 AS score FROM ({AFFINITY_SQL})), {VIEWS}, m AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN '' ELSE coalesce(category, '') END AS now, CASE WHEN doc_id % 2 = 0 THEN 'q1' END AS gone FROM files LEFT JOIN meta USING (doc_id))
SELECT doc_id, category, score FROM sc LEFT JOIN m USING (doc_id) WHERE coalesce(now, '') = '' AND category IS DISTINCT FROM gone AND score >= {R.CATEGORY_FLOOR} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lower(category), category) = 1"""

QUERIES = {f.__name__: f for f in (annotated_lines, resolved_markers, bound_sources, figure_states, reader_documents, prompt_focus, category_suggestions)}
ORACLE_SQL = {"annotated_lines": ANNOTATED_SQL, "resolved_markers": MARKER_SQL, "bound_sources": BOUND_SQL, "figure_states": STATE_SQL, "reader_documents": READER_SQL, "prompt_focus": FOCUS_SQL, "category_suggestions": CATEGORY_SQL}
