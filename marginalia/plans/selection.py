"""Queries on the choice of hits and atoms; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import intents as N
from ..operators import prompts as P
from ..operators import selection as S
from .common import PROMPTS, prompts, table
from .indices import RICH, blocks

#: Headings under which turns stand as hits, and words that they say.
HEADS = ["Paper / Abstract", "Paper / Results and resolution", "Paper / Materials and Methods / Setup", "Discussion", "Paper / References", "Figure captions", ""]
SAYS = ["we introduced the workflow [3]", "as shown in Fig. 3, open-pinhole", "\\tag{12} where x denotes y", "based on Fourier sampling [1, 2]", "good agreement, not stated", "# Title"]


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))).cast("int") + 1)


def _hits(spark, sf):
    """Turns as hits for the prompt of their conversation."""
    p = prompts(spark, sf)
    asked = p.where("turn = 0").select("conv_id", F.concat("text", F.when(F.pmod("conv_id", F.lit(3)) == 0, " which reference did they cite").when(F.pmod("conv_id", F.lit(3)) == 1, " method results").otherwise("")).alias("prompt"))
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("own"))
    n = F.col("conv_id") + 3 * F.col("turn")
    both = t.join(asked, "conv_id")
    return both.select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "prompt", F.concat(F.lit("d"), F.pmod("turn", F.lit(2))).alias("source"), _pick(HEADS, n).alias("heading"), F.concat(_pick(SAYS, n), F.lit("\n"), F.substring("own", 1, 300)).alias("body"),
        (F.pmod(F.length("own"), F.lit(17)) / 2.0).alias("score"), (F.pmod(n, F.lit(11)) == 0).alias("targeted"), _pick(["paragraph", "heading", "list_item", "equation"], F.col("turn")).alias("kind"), F.when(F.pmod(n, F.lit(4)) == 0, "equation").otherwise("").alias("anchor_kind"),
        F.when(F.pmod(n, F.lit(4)) == 0, 12).otherwise(0).alias("anchor_number"), F.concat(F.lit("b"), F.pmod("turn", F.lit(5))).alias("block_id"),
    )


_L = lambda values: "[" + ", ".join("'" + v + "'" for v in values) + "]"
HITS = f"""{PROMPTS}, ak AS (SELECT conv_id, text || CASE conv_id % 3 WHEN 0 THEN ' which reference did they cite' WHEN 1 THEN ' method results' ELSE '' END AS prompt FROM pr WHERE turn = 0),
hn AS (SELECT c.conv_id AS query_id, c.turn AS pos, prompt, 'd' || (c.turn % 2) AS source, c.conv_id + 3 * c.turn AS n, coalesce(c.text, '') AS own, c.turn FROM conversations c JOIN ak USING (conv_id)),
hi AS (SELECT query_id, pos, prompt, source, {_L(HEADS)}[n % {len(HEADS)} + 1] AS heading, {_L(SAYS)}[n % {len(SAYS)} + 1] || chr(10) || substr(own, 1, 300) AS body, (length(own) % 17) / 2.0 AS score, n % 11 = 0 AS targeted, ['paragraph', 'heading', 'list_item', 'equation'][turn % 4 + 1] AS kind,
  CASE WHEN n % 4 = 0 THEN 'equation' ELSE '' END AS anchor_kind, CASE WHEN n % 4 = 0 THEN 12 ELSE 0 END AS anchor_number, 'b' || (turn % 5) AS block_id FROM hn)"""


def _match(x):
    return f"trim(regexp_replace(lower({x}), '[\\s_]+', ' ', 'g'))"


def _words(x):
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}|[\\x{{4e00}}-\\x{{9fff}}]{{1,2}}'))"


def _over(a, b):
    return f"CASE WHEN len({_words(a)}) > 0 AND len({_words(b)}) > 0 THEN len(list_intersect({_words(a)}, {_words(b)})) / sqrt(len({_words(a)})::DOUBLE * len({_words(b)})) ELSE 0 END"


def _targets(x):
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({x}), '{p}') THEN '{n}' END" for n, p in N.SECTIONS) + "], lambda s: s IS NOT NULL)"


def _boxes(x):
    return f"regexp_extract_all(lower({x}), '\\bbox\\s*(\\d{{1,3}})\\b', 1)"


def _figure(x):
    return f"coalesce(nullif(regexp_extract({x}, '(?i)fig(?:ure)?s?\\.?\\s*(\\d{{1,3}})', 1), '')::INT, 0)"


def _on(x):
    return f"(len(list_intersect({_boxes('prompt')}, {_boxes(x)})) > 0 OR len(list_intersect({_targets('prompt')}, {_targets(x)})) > 0 OR ({_figure('prompt')} > 0 AND {_figure('prompt')} = {_figure(x)}))"


def _cues(x):
    return f"list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower({x}), '\\[\\[cite:[^\\]]+\\]\\]', ' ', 'g'), '{A.CITE_MARK}', ' ', 'g'), '[a-z0-9]{{3,}}'), lambda t: length(t) >= 4 OR regexp_matches(t, '\\d'))"


_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(prompt, '{p}') THEN '{n}'" for n, p in P.FAMILIES) + " ELSE '' END"
_CITES = lambda x: f"regexp_matches({x}, '\\[\\d{{1,4}}(?:\\s*[-,]\\s*\\d{{1,4}})*\\]')"
_SURFACE = {"heading": "hd", "text": "low", "raw": "body"}
_RULES = [f"CASE WHEN family = '{f}' AND regexp_matches({_SURFACE[s]}, '{p}') THEN {w} ELSE 0 END" for f, s, p, w in S.HIT_RULES] + [f"CASE WHEN regexp_matches(lower(prompt), '{p}') AND regexp_matches({_SURFACE[s]}, '{q}') THEN {w} ELSE 0 END" for p, s, q, w in S.PROMPT_RULES]
_STOPS = "[" + ", ".join(f"'{w}'" for w in S.CITE_STOP) + "]"
SCORED = f"""{HITS}, h1 AS (SELECT *, list_filter(string_split(heading, ' / '), lambda p: p <> '') AS parts, {_FAMILY} AS family FROM (SELECT * FROM hi QUALIFY row_number() OVER (PARTITION BY query_id, source, {_match("heading")}, substr(body, 1, 320) ORDER BY pos) = 1)),
h2 AS (SELECT *, list_filter(parts, lambda p: NOT regexp_matches({_match("p")}, '{S.GENERIC_HEADING}')) AS ow FROM h1),
h3 AS (SELECT *, CASE WHEN len(ow) > 0 THEN array_to_string(ow[greatest(len(ow) - 1, 1):], ' / ') ELSE coalesce(array_to_string(parts[greatest(len(parts) - 1, 1):], ' / '), '') END AS focus FROM h2),
h4 AS (SELECT *, {_match("CASE WHEN focus <> '' THEN focus ELSE heading END")} AS hd, {_match("substr(body, 1, 1600)")} AS low, {_match("prompt")} AS asked, {_match("heading")} AS wh, list_filter(list_transform(string_split(body, chr(10)), lambda v: trim(v)), lambda v: v <> '') AS ls,
  coalesce(nullif(regexp_extract(prompt, '(?i)eq(?:uation)?s?\\.?\\s*\\(?(\\d{{1,3}})\\)?', 1), '')::INT, 0) AS eq, list_filter({_targets("prompt")}, lambda s: s <> 'references') AS cited, {_CITES("body")} AS cites, regexp_matches(prompt, '{A.REFERENCE_LIST}') AS listing,
  lower(CASE WHEN contains(heading, ' / ') THEN substr(heading, strpos(heading, ' / ') + 3) ELSE heading END) AS leaf, lower(trim(body)) AS bl, list_distinct(list_filter({_cues("prompt")}, lambda t: NOT list_contains({_STOPS}, t))) AS tp FROM h3),
h5 AS (SELECT *, list_distinct(list_concat(tp, list_filter([CASE WHEN list_contains(tp, 'sampling') THEN 'sensing' END, CASE WHEN list_contains(tp, 'sensing') THEN 'sampling' END], lambda t: t IS NOT NULL))) AS topics, starts_with(ls[1], '# ') AND (len(ls) <= 2 OR (len(ls) = 3 AND (contains(ls[-1], '@') OR contains(ls[-1], '$^{{')))) AS bare FROM h4),
h6 AS (SELECT *, len(list_filter(topics, lambda t: contains(bl, t))) AS it, len(list_filter(topics, lambda t: NOT contains(bl, t) AND contains(leaf, t))) AS ih, list_contains({_targets("heading")}, 'references') OR regexp_matches(trim(body), '(?i)^(?:references\\b|\\[\\d{{1,4}}\\])') AS lst FROM h5),
h7 AS (SELECT *, least(12, 3.2 * it) + least(2.4, 0.8 * ih) + CASE WHEN cites THEN CASE WHEN it = 0 THEN -6 WHEN it >= 2 THEN 10 ELSE 4 END ELSE 0 END + CASE WHEN regexp_matches(body, '{S.ATTRIBUTION}') THEN CASE WHEN cites THEN 8 ELSE 3 END ELSE 0 END + CASE WHEN lst THEN CASE WHEN listing THEN 2 ELSE -5 END ELSE 0 END AS signal FROM h6),
hs AS (SELECT *, round((score + CASE WHEN {_on("heading")} OR {_on("body")} THEN 22 ELSE 0 END + CASE WHEN targeted THEN 10 ELSE 0 END + 1.8 * {_over("asked", "hd")} + 0.35 * {_over("asked", "substr(low, 1, 480)")} + CASE WHEN bare THEN -18 ELSE 0 END
  + CASE WHEN kind = 'heading' OR (string_split(focus, ' / ')[-1] <> '' AND {_match("body")} = {_match("string_split(focus, ' / ')[-1]")}) THEN -14 ELSE 0 END + CASE WHEN regexp_matches(trim(body), '(?i)^\\W*box\\s*\\d{{1,2}}\\b') AND length(trim(body)) <= 96 THEN -12 ELSE 0 END
  + CASE WHEN regexp_matches(wh, '{S.GENERIC_HEADING}') THEN -3.5 ELSE 0 END + CASE WHEN contains(hd, 'abstract') THEN -1.2 ELSE 0 END + CASE WHEN contains(hd, 'reference') THEN CASE WHEN regexp_matches(prompt, '(?i){S.DEEP}') AND regexp_matches(low, 'deep learning|neural|cnn') THEN -1 ELSE -7 END ELSE 0 END
  + {" + ".join(_RULES)}
  + CASE WHEN family = 'equation' THEN CASE WHEN anchor_kind = 'equation' THEN 8 ELSE 0 END + CASE WHEN eq > 0 AND anchor_number = eq THEN 10 ELSE 0 END + CASE WHEN eq > 0 AND (contains(body, '\\tag{{' || eq || '}}') OR contains(body, 'Equation (' || eq || ')')) THEN 8 ELSE 0 END ELSE 0 END
  + CASE WHEN family = 'citation_lookup' THEN CASE WHEN len(cited) > 0 THEN CASE WHEN len(list_filter(cited, lambda s: contains(wh, replace(s, '_', ' ')))) > 0 THEN 5 WHEN contains(wh, 'references') THEN -2.5 ELSE 0 END WHEN NOT listing AND contains(wh, 'references') THEN -3 ELSE 0 END + CASE WHEN cites THEN 4.5 ELSE 0 END + signal ELSE 0 END
  + CASE WHEN family = 'strength_limits' AND kind IN ('paragraph', 'list_item', 'blockquote') THEN 1.8 ELSE 0 END)::DOUBLE, 6) AS hit_score FROM h7)"""


def answer_hits(spark, sf):
    """The hits chosen for each conversation's prompt, in order, with their scores."""
    return S.answer_hits(_hits(spark, sf), 4).select("query_id", "pos", "source", "hit_score", "place")


ANSWER_SQL = f"""WITH {SCORED},
a1 AS (SELECT *, (len({_targets("prompt")}) > 0 OR len({_boxes("prompt")}) > 0 OR {_figure("prompt")} > 0) AND NOT (family = 'citation_lookup' AND NOT listing AND NOT (len(cited) > 0 OR len({_boxes("prompt")}) > 0 OR {_figure("prompt")} > 0)) AS asks, {_on("heading")} OR {_on("body")} OR targeted AS fits FROM hs),
a2 AS (SELECT *, bool_or(asks AND fits) OVER (PARTITION BY query_id) AS anyfit FROM a1), a3 AS (SELECT * FROM a2 WHERE (NOT anyfit OR fits) AND (regexp_matches(prompt, '(?i)\\breference\\b|\\bcitation\\b|\\bcite\\b|\\[\\d{{1,3}}\\]|参考文献|引用|引文') OR NOT contains({_match("focus")}, 'reference'))),
a4 AS (SELECT * FROM a3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hit_score DESC, pos) = 1 OR NOT bare),
a5 AS (SELECT * FROM a4 QUALIFY row_number() OVER (PARTITION BY query_id, source, CASE WHEN asks AND block_id <> '' THEN block_id ELSE {_match("focus")} END ORDER BY hit_score DESC, pos) = 1)
SELECT query_id, pos, source, hit_score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_score DESC, pos) AS place FROM a5) WHERE place <= 4"""


def _atoms(spark, sf):
    """Turns as atoms for a claim made of their conversation's first words."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("own"))
    n = F.col("conv_id") + 3 * F.col("turn")
    first = t.where("turn = 0").select("conv_id", F.concat(F.substring("own", 1, 120), F.when(F.pmod("conv_id", F.lit(2)) == 0, " phase correlation of the workflow").otherwise(" resolution")).alias("probe"))
    says = ["phase correlation and image registration", "at a resolution of the open pinhole", "transform domain", ""]
    return t.join(first, "conv_id").select(
        "conv_id", F.col("turn").alias("pos"), F.concat(_pick(says, n), F.lit(" "), F.substring("own", 1, 600)).alias("text"), _pick(HEADS, n).alias("heading"), _pick(["sentence", "caption_clause", "ref_span"], n).alias("atom_kind"), F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, F.pmod(n, F.lit(4)).cast("int")).alias("refs"),
        F.pmod(n, F.lit(3)).cast("int").alias("figure"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, F.pmod(n, F.lit(3)).cast("int")).alias("panels"), F.pmod(n, F.lit(2)).cast("int").alias("box"), "probe", F.lit("Setup").alias("probe_heading"),
        _pick(["citation_lookup", "box_only", "method", ""], F.col("conv_id")).alias("family"), _pick(["figure_panel", "method_detail", "prior_work", "compare_result", ""], F.col("conv_id")).alias("claim"), F.when(F.pmod("conv_id", F.lit(3)) == 0, 1).otherwise(0).alias("want_figure"),
        F.when(F.pmod("conv_id", F.lit(4)) == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("want_panels"), F.when(F.pmod("conv_id", F.lit(5)) == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("want_boxes"),
    )


def support_atoms(spark, sf):
    """The best atoms for each conversation's claim."""
    return S.support_atoms(_atoms(spark, sf), ["conv_id"]).select("conv_id", "pos", "atom_score", "in_scope", "place")


_PHRASES = " + ".join(f"CASE WHEN contains(asked, '{p}') AND contains(low, '{p}') THEN 1 ELSE 0 END" for p in S.PHRASES)
_STRONG = "[" + ", ".join(f"'{t}'" for t in S.STRONG_TOKENS) + "]"
_DISTINCT = lambda x: f"list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN list_position({x}, ({x})[i]) = i THEN ({x})[i] END), lambda t: t IS NOT NULL)[1:18]"
ATOM_SQL = f"""WITH f AS (SELECT conv_id, substr(coalesce(text, ''), 1, 120) || CASE WHEN conv_id % 2 = 0 THEN ' phase correlation of the workflow' ELSE ' resolution' END AS probe FROM conversations WHERE turn = 0),
a0 AS (SELECT c.conv_id, turn AS pos, coalesce(c.text, '') AS own, c.conv_id + 3 * turn AS n, probe FROM conversations c JOIN f USING (conv_id)),
a AS (SELECT *, ['phase correlation and image registration', 'at a resolution of the open pinhole', 'transform domain', ''][n % 4 + 1] || ' ' || substr(own, 1, 600) AS text, {_L(HEADS)}[n % {len(HEADS)} + 1] AS heading, ['sentence', 'caption_clause', 'ref_span'][n % 3 + 1] AS kind, n % 4 AS refs, n % 3 AS fig, ['a', 'b'][1:n % 3] AS panels, n % 2 AS box,
  ['citation_lookup', 'box_only', 'method', ''][conv_id % 4 + 1] AS family, ['figure_panel', 'method_detail', 'prior_work', 'compare_result', ''][conv_id % 5 + 1] AS claim, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS wf, CASE WHEN conv_id % 4 = 0 THEN ['a', 'b'] ELSE [] END AS wp, conv_id % 5 = 0 AS wb FROM a0),
b AS (SELECT *, 'Setup' || chr(10) || probe AS pq, heading || chr(10) || text AS ht, {_match("'Setup ' || probe")} AS asked, {_match("substr(text, 1, 1600)")} AS low FROM a), c0 AS (SELECT *, {_cues("pq")} AS q0, {_cues("ht")} AS t0 FROM b),
c AS (SELECT *, list_intersect({_DISTINCT("q0")}, {_DISTINCT("t0")}) AS shared FROM c0),
d AS (SELECT *, len(list_filter(shared, lambda t: list_contains({_STRONG}, t))) AS strong, {_PHRASES} AS phrases, claim IN ('method_detail', 'borrowed_tool') OR regexp_matches(pq, '{S.METHOD_DETAIL}') AS mt, claim = 'compare_result' OR regexp_matches(pq, '{S.COMPARE_DETAIL}') AS cm, len(list_intersect(wp, panels)) AS common, wb AND box = 1 AS ob FROM c),
e AS (SELECT *, (wf = 0 OR fig = wf) AND (len(wp) = 0 OR common > 0) AND (NOT wb OR ob) AS in_scope,
  CASE WHEN claim = 'figure_panel' THEN CASE kind WHEN 'caption_clause' THEN 2.35 WHEN 'sentence' THEN -0.35 ELSE 0 END WHEN family = 'citation_lookup' OR claim IN ('prior_work', 'borrowed_tool') THEN CASE WHEN kind = 'ref_span' THEN 2.2 WHEN kind = 'sentence' AND refs > 0 THEN 0.8 ELSE 0 END
   WHEN claim = 'method_detail' THEN CASE WHEN kind = 'sentence' THEN 0.85 ELSE 0 END + CASE WHEN mt AND regexp_matches(text, '{S.METHOD_DETAIL}') THEN 0.65 ELSE 0 END WHEN cm AND regexp_matches(text, '{S.COMPARE_DETAIL}') THEN 0.45
   WHEN family = 'box_only' THEN CASE kind WHEN 'sentence' THEN 0.9 WHEN 'ref_span' THEN -0.35 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\b(?:transform domain|optimization problem)') THEN 0.95 ELSE 0 END ELSE 0 END AS bc FROM d),
g AS (SELECT *, round((1.15 * {_over("probe", "text")} + 0.25 * {_over("pq", "ht")} + least(0.9, 0.18 * len(shared)) + least(0.72, 0.22 * strong) + least(1.0, 0.34 * phrases) + CASE kind WHEN 'caption_clause' THEN 0.22 WHEN 'sentence' THEN 0.1 ELSE 0.18 END + bc
  + CASE WHEN family = 'citation_lookup' THEN least(1.4, 0.44 * refs) ELSE least(0.45, 0.12 * refs) END + CASE WHEN wf > 0 OR len(wp) > 0 OR wb THEN CASE WHEN in_scope THEN 1.65 ELSE -1.05 END ELSE 0 END + CASE WHEN wf > 0 THEN CASE WHEN fig = wf THEN 1.15 ELSE -0.6 END ELSE 0 END
  + CASE WHEN len(wp) > 0 THEN CASE WHEN common > 0 THEN 1.8 + 0.24 * common + CASE WHEN common = len(wp) THEN 0.8 ELSE 0 END WHEN len(panels) > 0 THEN -0.85 WHEN claim = 'figure_panel' THEN -0.55 ELSE 0 END ELSE 0 END
  + CASE WHEN wb THEN CASE WHEN ob THEN 1.55 + CASE WHEN family = 'box_only' THEN 0.7 ELSE 0 END WHEN box > 0 THEN -0.95 ELSE 0 END ELSE 0 END + CASE WHEN length(text) <= 220 THEN 0.26 WHEN length(text) >= 540 THEN -0.18 ELSE 0 END)::DOUBLE, 6) AS atom_score FROM e WHERE text <> '')
SELECT conv_id, pos, atom_score, in_scope, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY atom_score DESC, in_scope DESC, (kind = 'caption_clause') DESC, (kind = 'ref_span') DESC, length(text) DESC, pos) AS place FROM g) WHERE place <= 4"""


def critical_facts(spark, sf):
    """Facts in the lines of documents: scores, panels and their clauses, and numbers as tokens of a source."""
    line = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "own"))
    add = _pick([" (a) left; (b) right, as in Fig. 3", " panels f and g, see eq. (4)", " $x_1 = 2$ [3-5] [2]", " Camera baseline [12].", ""], F.col("doc_id") + F.col("pos"))
    line = line.select("doc_id", "pos", F.concat("own", add).alias("x"))
    clauses = F.array_join(F.transform(S.panel_clauses("x"), lambda s: F.concat(s["letter"], F.lit(":"), s["clause"])), "|")
    return line.select("doc_id", "pos", F.round(S.critical_fact("x"), 4).alias("fact"), F.array_join(S.panel_letters(F.regexp_replace("x", "[.;:,]", " ")), "").alias("panels"), clauses.alias("clauses"), F.sha1(S.numbered_citations("x", F.lit("s1"))).alias("tokens"))


_IN = lambda found, p: f"flatten(list_transform({found}, lambda g: regexp_extract_all(g, '{p}')))"
_EACH = lambda p, k=1: f"regexp_extract_all(y, '{p}', {k})"
_LETTERS = [
    _EACH("(?i)\\b([a-z])\\s*/\\s*([a-z])\\b", 1), _EACH("(?i)\\b([a-z])\\s*/\\s*([a-z])\\b", 2), _IN(_EACH("(?i)panels?\\s*\\(([^)]+)\\)"), "(?i)\\b[a-z]\\b"), _IN(_EACH("(?i)\\bpanels?\\s+([a-g](?:\\s*(?:[/,&-]|\\band\\b)\\s*[a-g])*)(?:[^a-z]|$)"), "(?i)\\b[a-g]\\b"),
    _IN(_EACH("(?i)\\(([a-g](?:\\s*[/,&-]\\s*[a-g])*)\\)"), "(?i)[a-g]"), _EACH("(?m)(?:^|[.;:]\\s*)([A-Ga-g])\\s+[A-Z]"), _EACH("(?im)(?:^|[.;:]\\s*)([a-z])\\s*,"),
]
_PANELS = f"coalesce(array_to_string(list_sort(list_distinct(list_transform(flatten([{', '.join(_LETTERS)}]), lambda c: lower(c)))), ''), '')"
FACT_SQL = f"""WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS own FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, (doc_id + pos) % 5 AS k FROM l), x AS (SELECT *, own || [' (a) left; (b) right, as in Fig. 3', ' panels f and g, see eq. (4)', ' $x_1 = 2$ [3-5] [2]', ' Camera baseline [12].', ''][k + 1] AS x, regexp_replace(x, '[.;:,]', ' ', 'g') AS y FROM k),
p AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\\[\\[CITE:[^\\]]*\\]\\]', ' ', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]+>', ' ', 'g'), '[`*~]+', '', 'g'), '\\s+', ' ', 'g')), '\\[\\d{{1,3}}(?:\\s*[-,–—]\\s*\\d{{1,3}})*\\]', ' ', 'g'), '\\(\\s*\\d{{1,3}}(?:\\s*[-,–—]\\s*\\d{{1,3}})*\\s*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM x),
s AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE CASE WHEN length(t) >= 18 THEN 0.12 ELSE 0 END + CASE WHEN length(t) >= 32 THEN 0.12 ELSE 0 END + CASE WHEN length(t) >= 56 THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(t, '\\d') THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(t, '[A-Z][A-Za-z0-9+-]{{1,}}') THEN 0.08 ELSE 0 END
  + CASE WHEN contains(t, '$$') OR regexp_matches(t, '\\$[^$]{{1,280}}\\$') OR (regexp_matches(t, '\\\\[a-zA-Z]{{2,}}') AND regexp_matches(t, '[=^_]')) THEN 0.14 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)eq(?:uation)?s?\\.?\\s*\\(?(\\d{{1,3}})\\)?') THEN 0.12 ELSE 0 END + CASE WHEN regexp_matches(t, '{S.FIGURE_CLAIM}') THEN 0.12 ELSE 0 END
  + CASE WHEN regexp_matches(lower(t), '{S.EXPERIMENT_PROMPT}') THEN 0.10 ELSE 0 END + CASE WHEN regexp_matches(lower(t), '{S.METHOD_PROMPT}') THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(t, '{S.CRITICAL}') THEN 0.14 ELSE 0 END END AS fact FROM p)
SELECT doc_id, pos::INT AS pos, round(fact::DOUBLE, 4) AS fact, {_PANELS} AS panels, CASE k WHEN 0 THEN 'a:left|b:right, as in Fig. 3' ELSE '' END AS clauses,
 sha1(CASE k WHEN 2 THEN own || ' $x_1 = 2$ [[CITE:s1:3]][[CITE:s1:4]][[CITE:s1:5]] [[CITE:s1:2]]' WHEN 3 THEN own || ' Camera baseline [[CITE:s1:12]].' ELSE x END) AS tokens FROM s"""


def prompt_messages(spark, sf):
    """The messages of each conversation with the block of its best hits."""
    hits = S.answer_hits(_hits(spark, sf), 3).select("query_id", "place", "heading", F.substring("body", 1, 60).alias("text"))
    m = S.messages(table(spark, sf, "conversations"), S.context_block(hits).withColumnRenamed("query_id", "conv_id"), "Answer from the block.")
    return m.select("conv_id", "n", "role", F.sha1("content").alias("sha1"))


MESSAGE_SQL = f"""WITH ch AS ({ANSWER_SQL}), {HITS}, li AS (SELECT query_id, place, '[' || place || '] ' || CASE WHEN heading <> '' THEN heading || ': ' ELSE '' END || substr(body, 1, 60) AS line FROM ch JOIN hi USING (query_id, pos) WHERE place <= 3),
bl AS (SELECT query_id AS conv_id, string_agg(line, chr(10) ORDER BY place) AS block FROM li GROUP BY 1), ke AS (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS lt FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''),
kl AS (SELECT * FROM ke LEFT JOIN bl USING (conv_id) WHERE turn <= lt)
SELECT DISTINCT conv_id, 0 AS n, 'system' AS role, sha1('Answer from the block.') AS sha1 FROM kl UNION ALL
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT, role, sha1(CASE WHEN turn = lt AND block IS NOT NULL THEN text || chr(10) || chr(10) || block ELSE text END) FROM kl"""

def _wanted(spark, sf):
    """A prompt a document, that of the conversation of its number, with a place or topic to look for."""
    p = prompts(spark, sf).where("turn = 0")
    return p.select(F.col("conv_id").alias("doc_id"), F.concat("text", _pick([" figure 3", " box 4", " method hadamard", " cite the results", " overview", ""], F.col("conv_id"))).alias("prompt"))


def _rich(spark, sf):
    """Blocks of documents, some with headings of sections and boxes."""
    b = blocks(spark, sf)
    n = F.col("order_index")
    line = F.when(n % 11 == 3, F.concat(F.lit("Box "), F.pmod(n, F.lit(5)).cast("string"), F.lit(": "), F.col("line"))).when(n % 7 == 2, F.concat("line", F.lit(" camera hadamard workflow [3]"))).otherwise(F.col("line"))
    return b.select("doc_id", "block_id", "order_index", F.concat(_pick(HEADS, n), F.lit(" / "), F.substring("heading_path", 1, 20)).alias("heading_path"), line.alias("line"))


def targeted_blocks(spark, sf):
    """The best blocks of each document for its prompt."""
    return S.targeted_blocks(_rich(spark, sf), _wanted(spark, sf)).select("doc_id", "block_id", "score", "place")


_BLOCK_SURFACE = {"heading": "lower(heading)", "text": "lower(text)", "raw": "text"}
_BLOCK_RULES = " + ".join([f"CASE WHEN family = '{f}' AND regexp_matches({_BLOCK_SURFACE[s]}, '{p}') THEN {w} ELSE 0 END" for f, s, p, w in S.BLOCK_RULES] + [f"CASE WHEN contains(lower(prompt), '{x}') AND contains(lower(text), '{x}') THEN {w} ELSE 0 END" for x, w in S.SHARED_WORDS.items()])
TARGETED = f"""{RICH}, {PROMPTS}, wq AS (SELECT conv_id AS doc_id, text || {_L([" figure 3", " box 4", " method hadamard", " cite the results", " overview", ""])}[conv_id % 6 + 1] AS prompt FROM pr WHERE turn = 0),
rb AS (SELECT doc_id, block_id, order_index, {_L(HEADS)}[order_index % {len(HEADS)} + 1] || ' / ' || substr(heading_path, 1, 20) AS heading, trim(CASE WHEN order_index % 11 = 3 THEN 'Box ' || (order_index % 5) || ': ' || line WHEN order_index % 7 = 2 THEN line || ' camera hadamard workflow [3]' ELSE line END) AS text FROM bk),
rc AS (SELECT *, nullif(regexp_extract(text, '(?i)^\\W*box\\s*(\\d{{1,2}})\\b', 1), '')::INT AS ob FROM rb), rd AS (SELECT *, last_value(CASE WHEN ob IS NOT NULL THEN order_index END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY order_index) AS hi, last_value(ob IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY order_index) AS hn FROM rc),
t0 AS (SELECT *, {_FAMILY} AS family, heading || chr(10) || substr(text, 1, 800) AS cb, {_CITES("text")} AS cites, regexp_matches(prompt, '{A.REFERENCE_LIST}') AS listing, lower(CASE WHEN contains(heading, ' / ') THEN substr(heading, strpos(heading, ' / ') + 3) ELSE heading END) AS leaf, lower(trim(text)) AS bl, list_distinct({_cues("prompt")}) AS cq FROM rd JOIN wq USING (doc_id) WHERE text <> ''),
t1 AS (SELECT *, list_filter(cq, lambda t: NOT list_contains({_STOPS}, t)) AS tp, coalesce(list_contains(list_transform({_boxes("prompt")}, lambda b: b::INT), hn) AND order_index - hi <= {S.BOX_BLOCKS}, false) AS bx FROM t0),
t2 AS (SELECT *, bx OR {_on("cb")} AS fits, len({_targets("prompt")}) > 0 OR len({_boxes("prompt")}) > 0 OR {_figure("prompt")} > 0 AS asks, list_distinct(list_concat(tp, list_filter([CASE WHEN list_contains(tp, 'sampling') THEN 'sensing' END, CASE WHEN list_contains(tp, 'sensing') THEN 'sampling' END], lambda t: t IS NOT NULL))) AS topics FROM t1),
t3 AS (SELECT *, len(list_filter(topics, lambda t: contains(bl, t))) AS it, len(list_filter(topics, lambda t: NOT contains(bl, t) AND contains(leaf, t))) AS ih, list_contains({_targets("heading")}, 'references') OR regexp_matches(trim(text), '(?i)^(?:references\\b|\\[\\d{{1,4}}\\])') AS lst FROM t2 WHERE NOT asks OR family = 'citation_lookup' OR fits),
t4 AS (SELECT *, least(12, 3.2 * it) + least(2.4, 0.8 * ih) + CASE WHEN cites THEN CASE WHEN it = 0 THEN -6 WHEN it >= 2 THEN 10 ELSE 4 END ELSE 0 END + CASE WHEN regexp_matches(text, '{S.ATTRIBUTION}') THEN CASE WHEN cites THEN 8 ELSE 3 END ELSE 0 END + CASE WHEN lst THEN CASE WHEN listing THEN 2 ELSE -5 END ELSE 0 END AS signal FROM t3),
t5 AS (SELECT *, round((CASE WHEN fits THEN 32 ELSE 0 END + CASE WHEN bx THEN 14 ELSE 0 END + least(14, 2.0 * len(list_intersect(list_distinct({_cues("cb")}), CASE WHEN family = 'citation_lookup' THEN tp ELSE cq END))) + {_BLOCK_RULES} + CASE WHEN family = 'citation_lookup' THEN CASE WHEN cites THEN 8 ELSE 0 END + signal ELSE 0 END)::DOUBLE, 6) AS score FROM t4),
t6 AS (SELECT * FROM t5 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, heading, substr(text, 1, 1200) ORDER BY score DESC, order_index) = 1)"""
TARGET_SQL = f"WITH {TARGETED} SELECT doc_id, block_id, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, order_index) AS place FROM t6) WHERE place <= 4"


def rescued_hits(spark, sf):
    """Targeted hits, and the longest blocks of the documents in which there are none."""
    b, w = _rich(spark, sf), _wanted(spark, sf)
    hits = S.targeted_blocks(b, w).where("score >= 40")
    deep = b.join(w.select("doc_id"), "doc_id").select("doc_id", "block_id", F.when(F.length("line") > 60, F.length("line") / 100).otherwise(0.0).alias("score"))
    return S.rescued(hits, deep, "doc_id", 3)


RESCUE_SQL = f"""WITH {TARGETED}, h AS (SELECT doc_id, block_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, order_index) AS place FROM t6) WHERE place <= 4 AND score >= 40),
d AS (SELECT doc_id, block_id, CASE WHEN length(rw) > 60 THEN length(rw) / 100 ELSE 0 END::DOUBLE AS score FROM (SELECT b.doc_id, block_id, CASE WHEN order_index % 11 = 3 THEN 'Box ' || (order_index % 5) || ': ' || line WHEN order_index % 7 = 2 THEN line || ' camera hadamard workflow [3]' ELSE line END AS rw FROM bk b JOIN wq USING (doc_id)) WHERE doc_id NOT IN (SELECT doc_id FROM h)),
r AS (SELECT *, false AS fallback, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, block_id) AS place FROM h UNION ALL SELECT *, true, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, block_id) FROM d)
SELECT doc_id, block_id, CASE WHEN NOT fallback OR score > 0 THEN score ELSE greatest(0.01, 1.0 - (place - 1) * 0.1) END AS score, place::INT AS place, fallback FROM r WHERE place <= 3"""

_CLAIMS = ["a novel method outperforms all", "extensive experiments demonstrate it", "we propose a network", "nothing of note"]
_STATES = [" we propose this first", " where x denotes y", " our main contributions can be summarized as follows", " outperforms on static scenes", ""]


def summary_adjustments(spark, sf):
    """What the blocks of documents are worth for claims of something new or of a result."""
    b = blocks(spark, sf)
    n = F.col("doc_id") + F.col("order_index")
    line = b.select("doc_id", "block_id", F.concat(_pick(_CLAIMS, n), F.lit(" "), F.substring("line", 1, 30)).alias("segment"), F.concat("line", _pick(_STATES, n)).alias("text"), _pick(HEADS, F.col("order_index")).alias("heading"), "kind")
    return line.select("doc_id", "block_id", F.round(S.summary_adjustment(F.col("segment"), F.col("text"), F.col("heading"), F.col("kind")), 4).alias("adjustment"))


_SAYS = lambda c, p, w: f"CASE WHEN regexp_matches({c}, '{p}') THEN {w} ELSE 0 END"
SUMMARY_SQL = f"""WITH {RICH}, x AS (SELECT doc_id, block_id, kind, {_L(_CLAIMS)}[(doc_id + order_index) % {len(_CLAIMS)} + 1] || ' ' || substr(line, 1, 30) AS sg, line || {_L(_STATES)}[(doc_id + order_index) % {len(_STATES)} + 1] AS t, {_match(_L(HEADS) + f"[order_index % {len(HEADS)} + 1]")} AS h FROM bk),
f AS (SELECT *, regexp_matches(sg, '{S.NOVELTY}') AS nw, regexp_matches(sg, '{S.RESULT}') AS rs FROM x)
SELECT doc_id, block_id, round(CASE WHEN (nw OR rs) AND t <> '' THEN CASE kind WHEN 'heading' THEN -0.22 WHEN 'equation' THEN -0.36 ELSE 0 END
 + CASE WHEN nw THEN {_SAYS("t", S.CONTRIBUTION_BLOCK, "0.72 + CASE WHEN kind = 'list_item' THEN 0.18 ELSE 0 END + CASE WHEN contains(h, 'abstract') THEN 0.18 WHEN contains(h, 'introduction') THEN 0.10 ELSE 0 END")} + {_SAYS("t", S.DEFINITION_BLOCK, -0.88)} + {_SAYS("t", S.LEAD_IN, -0.14)} ELSE 0 END
 + CASE WHEN rs THEN {_SAYS("t", S.RESULT_BLOCK, f"0.58 + CASE WHEN kind = 'list_item' THEN 0.12 ELSE 0 END + CASE WHEN regexp_matches(h, '{S.EXPERIMENT_HEADING}') THEN 0.16 WHEN contains(h, 'abstract') THEN 0.08 ELSE 0 END")} + {_SAYS("t", S.DEFINITION_BLOCK, -0.46)} + {_SAYS("t", S.LEAD_IN, -0.10)} ELSE 0 END ELSE 0 END::DOUBLE, 4) AS adjustment FROM f"""

QUERIES = {f.__name__: f for f in (answer_hits, support_atoms, critical_facts, prompt_messages, targeted_blocks, rescued_hits, summary_adjustments)}
ORACLE_SQL = {"answer_hits": ANSWER_SQL, "support_atoms": ATOM_SQL, "critical_facts": FACT_SQL, "prompt_messages": MESSAGE_SQL, "targeted_blocks": TARGET_SQL, "rescued_hits": RESCUE_SQL, "summary_adjustments": SUMMARY_SQL}
