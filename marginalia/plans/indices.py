"""Queries on structured indices; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indices as I
from ..operators import intents as N
from ..operators import markdown as M
from .common import table
from .markdown import KIND_SQL, LINES, PATHS

_CASES = " ".join(
    f"WHEN pos % 20 = {n} THEN {form}"
    for n, form in {
        2: "'$$ E_{' || k || '} = \\sum ' || substr(line, 1, 12) || ' \\tag{' || k || '} $$'", 4: "'![fig](assets/f' || k || '.png)'", 5: "'**Figure ' || k || '.** ' || line", 8: "'| ' || line || ' | ' || k || ' |'",
        10: "'> ' || line", 11: "'- ' || line", 13: "'eq. (' || k || ') says ' || line", 16: "'see Fig. ' || k || ' ' || line",
    }.items()
)
_RAW = LINES[: LINES.index("md AS")]
RICH = f"""{_RAW}rk AS (SELECT *, pos % 9 + 1 AS k FROM raw), md AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 0 THEN '# ' || line WHEN pos % 3 = 0 THEN '## ' || line {_CASES} ELSE line END AS line FROM rk){PATHS[len(LINES):]}, {KIND_SQL},
nb AS (SELECT *, 'a_' || block_id AS anchor_id, kind = 'paragraph' AND regexp_matches(line, '{I.CAPTION}') AS is_caption FROM bk),
bn AS (SELECT *, CASE WHEN kind = 'equation' THEN coalesce(nullif(regexp_extract(line, '\\\\tag\\{{(\\d{{1,3}})\\}}', 1), '')::INT, nullif(regexp_extract(line, '(?i)eq(?:uation)?s?\\.?\\s*\\(?(\\d{{1,3}})\\)?', 1), '')::INT, 0)
  WHEN is_caption THEN coalesce(nullif(regexp_extract(line, '(?i)fig(?:ure)?s?\\.?\\s*(\\d{{1,3}})', 1), '')::INT, 0) ELSE 0 END AS number FROM nb)"""
_CLEAN = lambda x, n: f"substr(trim(regexp_replace({x}, '\\s+', ' ', 'g')), 1, {n})"


def blocks(spark, sf):
    return M.blocks(M.with_heading_path(M.rich_lines(table(spark, sf, "documents"))))


def anchor_index(spark, sf):
    return I.anchors(blocks(spark, sf)).select("doc_id", "anchor_id", "block_id", "kind", F.sha1("heading_path").alias("heading"), "order_index", F.sha1("text").alias("sha1"), "number")


ANCHOR_SQL = f"WITH {RICH} SELECT doc_id, anchor_id, block_id, kind, sha1(heading_path) AS heading, order_index::INT AS order_index, sha1({_CLEAN('line', 1200)}) AS sha1, number FROM bn"


def equation_index(spark, sf):
    e = I.equations(blocks(spark, sf))
    return e.select("doc_id", "block_id", "number", F.sha1("tex").alias("tex"), F.sha1("context_before").alias("before"), F.sha1("context_after").alias("after"))


EQUATION_SQL = f"""WITH {RICH}, c AS (SELECT *, CASE WHEN kind IN ('paragraph', 'list_item', 'blockquote') THEN {_CLEAN("line", 1000)} END AS prose FROM bn),
w AS (SELECT *, last_value(prose IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(prose IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY order_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM c)
SELECT doc_id, block_id, number, sha1({_CLEAN("line", 6000)}) AS tex, sha1(coalesce(b, '')) AS before, sha1(coalesce(a, '')) AS after FROM w WHERE kind = 'equation'"""


def figure_index(spark, sf):
    f = I.figures(blocks(spark, sf))
    return f.select("doc_id", "block_id", "asset", "number", F.sha1("caption").alias("caption"), "caption_block_id")


FIGURES = """fg AS (SELECT *, lead(is_caption) OVER w AS n, lead(line) OVER w AS nl, lead(block_id) OVER w AS ni, lead(number) OVER w AS nn FROM bn WINDOW w AS (PARTITION BY doc_id ORDER BY order_index)),
fi AS (SELECT doc_id, block_id, string_split(regexp_extract(line, '!\\[[^\\]]*\\]\\(([^)]*)\\)', 1), '/')[-1] AS asset, CASE WHEN n THEN nn ELSE 0 END AS number, CASE WHEN n THEN nl ELSE '' END AS caption, CASE WHEN n THEN ni ELSE '' END AS caption_block_id FROM fg WHERE kind = 'figure')"""
FIGURE_SQL = f"WITH {RICH}, {FIGURES} SELECT doc_id, block_id, asset, number, sha1(caption) AS caption, caption_block_id FROM fi"


def figure_captions(spark, sf):
    """The caption of a figure that is asked for in each document."""
    wanted = table(spark, sf, "documents").select("doc_id", (F.pmod("doc_id", F.lit(9)) + 1).cast("int").alias("number")).distinct()
    return I.caption_of(I.figures(blocks(spark, sf)), wanted)


CAPTION_SQL = f"WITH {RICH}, {FIGURES} SELECT doc_id, number, arg_min(caption, block_id) AS caption, min(caption_block_id) FILTER (WHERE true) AS caption_block_id FROM fi WHERE caption <> '' AND number = doc_id % 9 + 1 GROUP BY ALL"


def _segments(spark, sf):
    """Every fourth line without its first two words as a segment; some prefer a kind or ask for a number."""
    line = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).where("pos % 4 = 2")
    rest = F.array_join(F.slice(F.regexp_extract_all("line", F.lit("[^ \\t]+"), F.lit(0)), 3, 12), " ")
    kind = F.element_at(F.array(F.lit("figure"), F.lit("equation"), F.lit("")), F.pmod("pos", F.lit(3)).cast("int") + 1)
    formula = F.when(F.pmod("pos", F.lit(5)) == 2, F.concat(rest, F.lit(" $E_{3} = x$"))).otherwise(rest)
    return line.select("doc_id", F.col("pos").alias("seg_no"), formula.alias("segment"), F.when(F.pmod("pos", F.lit(8)) == 2, F.substring("line", 1, 30)).otherwise("").alias("heading"), kind.alias("prefer_kind"), F.when(F.pmod("pos", F.lit(16)) == 6, F.pmod("pos", F.lit(9)) + 1).otherwise(0).alias("number"))


def evidence_blocks(spark, sf):
    """All segments of each document against its blocks."""
    return I.match_blocks(_segments(spark, sf), I.numbered(blocks(spark, sf)), 1).select("doc_id", "seg_no", "block_id", "score")


_WORDS = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}'))"
_SIGNAL = lambda x: f"(contains({x}, '$$') OR contains(lower({x}), '\\begin{{equation') OR contains({x}, '\\[') OR regexp_matches({x}, '\\$[^$]{{1,280}}\\$') OR (regexp_matches({x}, '\\\\[a-zA-Z]{{2,}}') AND regexp_matches({x}, '[=^_]')))"
_FORMULA = lambda x: f"list_distinct(list_concat(list_concat(list_transform(regexp_extract_all({x}, '\\\\[a-zA-Z]{{2,}}'), lambda t: lower(t)), list_transform(regexp_extract_all({x}, '[A-Za-z](?:_[A-Za-z0-9]+)?(?:\\^[A-Za-z0-9]+)?'), lambda t: lower(t))), regexp_extract_all({x}, '\\b\\d{{1,4}}\\b')))"
_MATCH = lambda x: f"trim(regexp_replace(lower({x}), '[\\s_]+', ' ', 'g'))"
_OVER = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / sqrt(len({a})::DOUBLE * len({b})) ELSE 0 END"
_SAYS = lambda p: f"regexp_matches(lower(line), replace('{p}', 'N', wanted::VARCHAR))"
EVIDENCE_SQL = f"""WITH {RICH},
sl AS (SELECT doc_id, pos AS seg_no, line, array_to_string(regexp_extract_all(line, '[^ \\t]+')[3:14], ' ') AS rest FROM raw WHERE pos % 4 = 2),
sg AS (SELECT doc_id, seg_no, coalesce(rest, '') || CASE WHEN seg_no % 5 = 2 THEN ' $E_{{3}} = x$' ELSE '' END AS segment, CASE WHEN seg_no % 8 = 2 THEN substr(line, 1, 30) ELSE '' END AS heading, ['figure', 'equation', ''][seg_no % 3 + 1] AS prefer_kind, CASE WHEN seg_no % 16 = 6 THEN seg_no % 9 + 1 ELSE 0 END AS wanted FROM sl),
q AS (SELECT *, {_SIGNAL("segment")} AS q_eq, {_WORDS("segment")} AS qw, {_FORMULA("segment")} AS qf, {_MATCH("segment")} AS qm, {_MATCH("heading")} AS hm, {_WORDS("heading")} AS hw FROM sg),
b AS (SELECT *, {_SIGNAL("line")} AS b_eq, {_WORDS("line")} AS bw, {_FORMULA("line")} AS bf, {_MATCH("line")} AS bm, {_MATCH("heading_path")} AS bhm, {_WORDS("heading_path")} AS bhw FROM bn),
x AS (SELECT q.doc_id, seg_no, block_id, order_index, wanted, q_eq,
  CASE WHEN segment <> '' THEN {_OVER("qw", "bw")} + CASE WHEN qm <> '' AND contains(bm, qm) THEN {I.CONTAINED} ELSE 0 END + CASE WHEN length(substr(qm, 1, 72)) >= 20 AND contains(bm, substr(qm, 1, 72)) THEN {I.HEAD} ELSE 0 END ELSE 0 END
  + CASE WHEN segment <> '' AND (q_eq OR b_eq) THEN {I.FORMULA} * {_OVER("qf", "bf")} ELSE 0 END
  + CASE WHEN heading <> '' THEN {I.HEADING} * CASE WHEN hm <> '' AND bhm <> '' THEN CASE WHEN contains(hm, bhm) OR contains(bhm, hm) THEN 0.65 ELSE 0 END + {_OVER("hw", "bhw")} ELSE 0 END ELSE 0 END
  + CASE WHEN wanted <= 0 THEN 0 WHEN prefer_kind = 'figure' OR kind = 'figure' OR is_caption THEN CASE WHEN number = wanted THEN 1.08 + CASE WHEN is_caption THEN 0.12 ELSE 0 END WHEN {_SAYS("\\bfig(?:ure)?\\.?\\s*#?\\s*N\\b")} THEN 0.96 ELSE 0 END
    ELSE CASE WHEN number = wanted THEN 1.15 WHEN {_SAYS("\\(\\s*N\\s*\\)")} THEN 1.0 WHEN {_SAYS("\\beq(?:uation)?\\s*\\.?\\s*N\\b")} THEN 0.95 ELSE 0 END END
  + CASE WHEN prefer_kind = kind THEN {I.KIND} ELSE 0 END + CASE WHEN q_eq AND kind = 'equation' THEN {I.EQUATION} ELSE 0 END AS s
  FROM q JOIN b USING (doc_id)),
r AS (SELECT *, round(s::DOUBLE, 6) AS score FROM x)
SELECT doc_id, seg_no::INT AS seg_no, block_id, score FROM r WHERE score >= CASE WHEN wanted > 0 THEN {I.FLOOR_NUMBER} WHEN q_eq THEN {I.FLOOR_EQUATION} ELSE {I.FLOOR_TEXT} END QUALIFY row_number() OVER (PARTITION BY doc_id, seg_no ORDER BY score DESC, order_index) = 1"""


def backfilled_segments(spark, sf):
    """Segments that know their block, their anchor, or neither, filled from the anchor index."""
    a = I.anchors(blocks(spark, sf))
    n = F.col("order_index")
    known = a.select(
        "doc_id", n.alias("seg_no"), F.when(n % 3 == 0, F.col("block_id")).otherwise(F.when(n % 3 == 1, "").otherwise("gone")).alias("block_id"), F.when(n % 3 == 1, F.col("anchor_id")).otherwise("").alias("anchor_id"),
        F.when(n % 4 == 0, "own heading").otherwise("").alias("heading_path"), F.lit("").alias("anchor_kind"), F.when(n % 5 == 0, "own text").otherwise("").alias("anchor_text"), (n % 6 == 0).alias("hidden"),
    )
    out = I.backfilled(known, a)
    return out.select("doc_id", "seg_no", "block_id", "anchor_id", F.sha1("heading_path").alias("heading"), "anchor_kind", F.sha1("anchor_text").alias("text"))


BACKFILL_SQL = f"""WITH {RICH}, s AS (SELECT *, order_index::INT AS n, order_index % 3 < 2 AND order_index % 6 <> 0 AS f FROM bn)
SELECT doc_id, n AS seg_no, CASE WHEN f OR n % 3 = 0 THEN block_id WHEN n % 3 = 1 THEN '' ELSE 'gone' END AS block_id, CASE WHEN f OR n % 3 = 1 THEN anchor_id ELSE '' END AS anchor_id,
 sha1(CASE WHEN n % 4 = 0 THEN 'own heading' WHEN f THEN heading_path ELSE '' END) AS heading, CASE WHEN f THEN CASE WHEN kind IN ('equation', 'figure', 'blockquote') THEN kind ELSE 'sentence' END ELSE '' END AS anchor_kind,
 sha1(CASE WHEN n % 5 = 0 THEN 'own text' WHEN f THEN substr({_CLEAN("line", 1200)}, 1, 900) ELSE '' END) AS text FROM s"""


def anchor_snippets(spark, sf):
    """The blocks of each document that name an anchor which is asked for."""
    k = F.pmod("doc_id", F.lit(3)).cast("int") + 1
    wanted = table(spark, sf, "documents").select("doc_id", F.element_at(F.array(F.lit("figure"), F.lit("equation"), F.lit("table")), k).alias("kind"), (F.pmod("doc_id", F.lit(9)) + 1).cast("int").alias("number")).distinct()
    return I.anchor_snippets(blocks(spark, sf).drop("kind"), wanted).select("doc_id", "block_id", "score", "place")


_FORM = "replace(CASE k WHEN 'figure' THEN '(?i)" + "|".join(N.NUMBERED["figure"]) + "' WHEN 'equation' THEN '(?i)" + "|".join(N.NUMBERED["equation"]) + "' ELSE '(?i)" + "|".join(N.NUMBERED["table"]) + "' END, 'N', (doc_id % 9 + 1)::VARCHAR)"
SNIPPET_SQL = f"""WITH {RICH}, s AS (SELECT doc_id, block_id, order_index, trim(line) AS snippet, ['figure', 'equation', 'table'][doc_id % 3 + 1] AS k FROM bn WHERE length(trim(line)) >= 40),
n AS (SELECT *, len(regexp_extract_all(snippet, {_FORM})) AS hits FROM s),
c AS (SELECT *, (40 + 12 * hits + CASE WHEN regexp_matches(ltrim(lower(snippet)), '^(?:fig\\.|figure|图|table|表|equation|theorem|lemma|definition|proposition|corollary|定理|引理|定义|命题|推论)') THEN 8 ELSE 0 END)::DOUBLE AS score FROM n WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, snippet ORDER BY order_index) = 1)
SELECT doc_id, block_id, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, order_index) AS place FROM c) WHERE place <= 3"""


def formula_lines(spark, sf):
    """Which lines are formulas, and their tokens."""
    md = M.rich_lines(table(spark, sf, "documents"))
    return md.select("doc_id", "pos", I.equation_signal("line").alias("signal"), I.display_equation("line").alias("display"), F.size(F.array_distinct(I.formula_tokens("line"))).alias("tokens"))


FORMULA_SQL = f"""WITH {RICH} SELECT doc_id, pos::INT AS pos, {_SIGNAL("line")} AS signal, len({_FORMULA("line")})::INT AS tokens,
 regexp_matches(trim(line), '(?s)\\$\\$.+\\$\\$') OR ({_SIGNAL("trim(line)")} AND regexp_matches(line, '=|\\\\tag\\{{|\\\\(?:sum|int|frac|mathcal|mathbf)') AND len(regexp_extract_all(line, '[A-Za-z]{{3,}}')) <= 12) AS display FROM md"""

QUERIES = {f.__name__: f for f in (anchor_index, equation_index, figure_index, figure_captions, evidence_blocks, backfilled_segments, anchor_snippets, formula_lines)}
ORACLE_SQL = {"anchor_index": ANCHOR_SQL, "equation_index": EQUATION_SQL, "figure_index": FIGURE_SQL, "figure_captions": CAPTION_SQL, "evidence_blocks": EVIDENCE_SQL, "backfilled_segments": BACKFILL_SQL, "anchor_snippets": SNIPPET_SQL, "formula_lines": FORMULA_SQL}
