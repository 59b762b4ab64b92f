"""Queries on answers taken from documents; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extracts as E
from ..operators import indices as I
from ..operators import selection as S
from .common import PROMPTS, prompts, table
from .indices import FIGURES, RICH, blocks
from .markdown import LINES
from .selection import _CITES, TARGETED, _pick, _rich, _targets, _wanted

_WORDS = [" hadamard patterns, psnr of a spad", " snapshot camera system, tv solver", " training loss on a dataset", " lidar application, dark count, perovskite", " limitation; references"]
_ASKS = ["", " which detector jitter", " compare the metrics psnr", " mask coding"]


def hit_aspects(spark, sf):
    """What the turns of a conversation are about, for its prompt."""
    p = prompts(spark, sf)
    asked = p.where("turn = 0").select("conv_id", F.concat("text", _pick(_ASKS, F.col("conv_id"))).alias("prompt"))
    t = p.join(asked, "conv_id").select("conv_id", "turn", "prompt", F.concat("text", _pick(_WORDS, F.col("conv_id") + 2 * F.col("turn")), F.when(F.col("turn") % 2 == 0, _pick(_WORDS, F.col("turn"))).otherwise("")).alias("hit"))
    return t.select("conv_id", "turn", F.array_join(E.aspects(F.col("prompt"), F.col("hit")), "|").alias("aspects"))


_L = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_THERE = lambda a: f"CASE WHEN regexp_matches(low, '{a[1]}') THEN '{a[0]}' END"
_NAMES = lambda names: f"list_filter([{', '.join(f'CASE WHEN contains(low, {chr(39)}{k}{chr(39)}) THEN {chr(39)}{v}{chr(39)} END' for k, v in names)}], lambda n: n IS NOT NULL)[1:2]"
_SUFFIX = lambda c: f"CASE WHEN len({c}) > 0 THEN '（' || array_to_string({c}, '、') || '）' ELSE '' END"
ASPECT_SQL = f"""WITH {PROMPTS}, a AS (SELECT conv_id, text || {_L(_ASKS)}[conv_id % {len(_ASKS)} + 1] AS prompt FROM pr WHERE turn = 0),
h AS (SELECT conv_id, turn, lower(prompt) AS q, lower(text || {_L(_WORDS)}[(conv_id + 2 * turn) % {len(_WORDS)} + 1] || CASE WHEN turn % 2 = 0 THEN {_L(_WORDS)}[turn % {len(_WORDS)} + 1] ELSE '' END) AS low FROM pr JOIN a USING (conv_id)),
w AS (SELECT *, {", ".join(f"regexp_matches(q, '{p}') AS w_{k}" for k, p in E.WANTS.items())}, {_NAMES(E.DETECTOR_NAMES)} AS dn, {_NAMES(E.ENCODING_NAMES)} AS en FROM h),
g AS (SELECT *, list_filter([{", ".join(map(_THERE, E.DETECTOR_ASPECTS))}, CASE WHEN w_compare THEN {_THERE(E.DETECTOR_COMPARED)} END], lambda x: x IS NOT NULL) AS dt, list_filter([CASE WHEN w_encoding THEN {_THERE(E.ENCODING)} END, {", ".join(map(_THERE, E.ASPECTS))}], lambda x: x IS NOT NULL) AS ge FROM w),
r AS (SELECT *, CASE WHEN (w_metrics OR w_compare) AND list_contains(ge, '{E.RESULTS}') THEN list_concat(['{E.RESULTS}'], list_filter(ge, lambda x: x <> '{E.RESULTS}')) ELSE ge END AS g2 FROM g),
n AS (SELECT *, list_transform(g2, lambda x: CASE WHEN x = '{E.ENCODING[0]}' THEN x || {_SUFFIX("en")} ELSE x END) AS g3 FROM r)
SELECT conv_id, turn, coalesce(array_to_string((CASE WHEN w_detector THEN CASE WHEN len(dt) > 0 THEN list_concat([dt[1] || {_SUFFIX("dn")}], dt[2:]) ELSE dt END WHEN w_definition THEN list_concat(['{E.DEFINITION}'], g3) ELSE g3 END)[1:4], '|'), '') AS aspects FROM n"""


def exact_answers(spark, sf):
    """Equations, captions, cited places and methods as they stand, for a prompt a document."""
    b = blocks(spark, sf)
    n = F.pmod("doc_id", F.lit(9)) + 1
    w = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Explain eq. ("), n.cast("string"), F.lit(") and Fig. "), n.cast("string")).alias("prompt")).distinct()
    cited = b.withColumn("line", F.concat("line", F.when(F.col("order_index") % 6 == 1, F.lit(" based on sampling [4, 7]")).otherwise("")))
    asks = w.select("doc_id", F.lit("what is cited for sampling").alias("prompt"))
    parts = {"equation": E.exact_equations(w, I.equations(b)), "figure": E.exact_panels(w, I.figures(b)), "citation": E.exact_citations(asks, cited), "method": E.exact_methods(_wanted(spark, sf), S.targeted_blocks(_rich(spark, sf), _wanted(spark, sf)))}
    out = None
    for kind, df in parts.items():
        df = df.select("doc_id", F.lit(kind).alias("kind"), "block_id", F.sha1("answer").alias("sha1"))
        out = df if out is None else out.unionByName(df)
    return out


_CLEANED = lambda x, n: f"substr(trim(regexp_replace({x}, '\\s+', ' ', 'g')), 1, {n})"
_LABEL = lambda refs: f"array_to_string(list_transform({refs}[1:4], lambda n: '[' || n || ']'), ', ')"
_NUMBERS = lambda x: f"flatten(list_transform(regexp_extract_all({x}, '\\[(\\d{{1,4}}(?:\\s*[-,]\\s*\\d{{1,4}})*)\\]', 1), lambda m: list_transform(string_split(m, ','), lambda v: trim(v))))"
EXACT_SQL = f"""WITH {TARGETED}, {FIGURES}, eq AS (SELECT doc_id, number, min({{'b': block_id, 't': {_CLEANED("line", 6000)}, 'h': heading_path}}) AS e FROM bn WHERE kind = 'equation' AND number = doc_id % 9 + 1 GROUP BY ALL),
fx AS (SELECT fi.doc_id, number, min({{'b': fi.block_id, 'c': caption, 'h': bn2.heading_path}}) AS f FROM fi JOIN (SELECT doc_id, block_id, heading_path FROM bn) bn2 USING (doc_id, block_id) WHERE caption <> '' AND number = doc_id % 9 + 1 GROUP BY ALL),
c0 AS (SELECT doc_id, block_id, order_index, heading_path AS heading, {_CLEANED("line || CASE WHEN order_index % 6 = 1 THEN ' based on sampling [4, 7]' ELSE '' END", 1200)} AS body FROM bk),
c1 AS (SELECT *, lower(trim(body)) AS bl, lower(CASE WHEN contains(heading, ' / ') THEN substr(heading, strpos(heading, ' / ') + 3) ELSE heading END) AS leaf FROM c0 WHERE {_CITES("body")}),
c2 AS (SELECT *, len(list_filter(['sampling', 'sensing'], lambda t: contains(bl, t))) AS it, len(list_filter(['sampling', 'sensing'], lambda t: NOT contains(bl, t) AND contains(leaf, t))) AS ih FROM c1),
c3 AS (SELECT *, least(12, 3.2 * it) + least(2.4, 0.8 * ih) + CASE WHEN it = 0 THEN -6 WHEN it >= 2 THEN 10 ELSE 4 END + CASE WHEN regexp_matches(body, '{S.ATTRIBUTION}') THEN 8 ELSE 0 END + CASE WHEN list_contains({_targets("heading")}, 'references') OR regexp_matches(trim(body), '(?i)^(?:references\\b|\\[\\d{{1,4}}\\])') THEN -5 ELSE 0 END AS score FROM c2),
c4 AS (SELECT * FROM c3 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, order_index) = 1),
m AS (SELECT * FROM t6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, order_index) = 1)
SELECT doc_id, 'equation' AS kind, e.b AS block_id, sha1('Equation (' || number || ') is stated' || CASE WHEN e.h <> '' THEN ' in ' || e.h ELSE '' END || ':' || chr(10) || e.t) AS sha1 FROM eq
UNION ALL SELECT doc_id, 'figure', f.b, sha1('Figure ' || number || ' caption states:' || CASE WHEN f.h <> '' THEN chr(10) || 'Section: ' || f.h ELSE '' END || chr(10) || '> ' || f.c || CASE WHEN {_CITES("f.c")} THEN chr(10) || 'References in this clause: ' || {_LABEL(_NUMBERS("f.c"))} ELSE '' END) FROM fx
UNION ALL SELECT doc_id, 'citation', block_id, sha1('The paper cites ' || {_LABEL(_NUMBERS("body"))} || ' for this point.' || chr(10) || CASE WHEN heading <> '' THEN 'This is stated in ' || heading || ':' ELSE 'This is stated explicitly in the paper:' END || chr(10) || '> ' || body) FROM c4
UNION ALL SELECT doc_id, 'method', block_id, sha1(CASE WHEN heading <> '' THEN 'The paper states this explicitly in ' || heading || ':' ELSE 'The paper states this explicitly:' END || chr(10) || '> ' || text) FROM m"""


def reindex_hints(spark, sf):
    """Whether the index of each source's documents is behind them: the files are documents, the index rows events of their ids."""
    d = table(spark, sf, "documents").select(F.concat_ws("/", F.lit("/md"), "source", "doc_id").alias("path"), F.col("doc_id").cast("string").alias("stem"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("modified"))
    e = table(spark, sf, "events").select(F.pmod("event_id", F.lit(900)).cast("string").alias("stem"), F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("event_id", F.lit(450))).alias("modified")).groupBy("stem").agg(F.max("modified").alias("modified"))
    return E.reindex_hint(d, e, table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("stem")))


HINT_SQL = """WITH e AS (SELECT event_id % 900 AS stem, max(event_id % 450) AS at0 FROM events GROUP BY 1), j AS (SELECT d.doc_id, e.at0, d.doc_id IN (SELECT doc_id FROM labels) AS src FROM documents d LEFT JOIN e ON e.stem = d.doc_id)
SELECT count(*) AS files, count(*) FILTER (WHERE at0 IS NULL OR doc_id > at0) AS newer, count(*) FILTER (WHERE NOT src) AS orphans, count(*) FILTER (WHERE at0 IS NULL OR doc_id > at0) > 0 OR count(*) FILTER (WHERE NOT src) > 0 AS behind FROM j"""

def _titled(spark, sf):
    """Markdown of which some have an abstract: under a heading, behind a line of that word, or not at all."""
    from ..operators import markdown as M

    md = M.synthetic_lines(table(spark, sf, "documents"))
    k = F.pmod("doc_id", F.lit(4))
    line = F.when((F.col("pos") == 2) & (k == 0), "## Abstract").when((F.col("pos") == 1) & (k == 1), " ABSTRACT ").when((F.col("pos") == 4) & (k == 2), "摘要").otherwise(F.col("line"))
    return md.withColumn("line", line)


def document_abstracts(spark, sf):
    return E.abstracts(_titled(spark, sf)).select("doc_id", F.sha1("abstract").alias("sha1"), F.length("abstract").alias("chars"), "named")


ABSTRACT_SQL = f"""WITH {LINES}, x AS (SELECT doc_id, pos, CASE WHEN pos = 2 AND doc_id % 4 = 0 THEN '## Abstract' WHEN pos = 1 AND doc_id % 4 = 1 THEN ' ABSTRACT ' WHEN pos = 4 AND doc_id % 4 = 2 THEN '摘要' ELSE line END AS line FROM md),
b AS (SELECT *, min(pos) FILTER (WHERE regexp_matches(line, '{E.ABSTRACT_LINE}')) OVER (PARTITION BY doc_id) AS begun, regexp_matches(line, '^\\s*#{{1,6}}\\s+') AS hd FROM x), c AS (SELECT *, min(pos) FILTER (WHERE hd AND pos > begun + 1) OVER (PARTITION BY doc_id) AS stop, sum(hd::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS heads FROM b),
n AS (SELECT doc_id, substr(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g'), 1, {E.ABSTRACT_CHARS[1]}) AS abstract, true AS named FROM c WHERE pos > begun AND (stop IS NULL OR pos < stop) GROUP BY 1),
f AS (SELECT doc_id, substr(arg_min(trim(line), pos), 1, {E.ABSTRACT_CHARS[1]}) AS abstract, false AS named FROM c WHERE begun IS NULL AND NOT hd AND heads < 2 AND length(trim(line)) >= {E.ABSTRACT_CHARS[0]} GROUP BY 1)
SELECT doc_id, sha1(abstract) AS sha1, length(abstract)::INT AS chars, named FROM (SELECT * FROM n UNION ALL SELECT * FROM f) WHERE length(abstract) >= {E.ABSTRACT_CHARS[0]}"""


def broad_answers(spark, sf):
    """Extracts for prompts about strengths and limits, discussions and boxes."""
    from ..operators.intents import box_numbers
    from ..operators.prompts import prompt_family

    w = _wanted(spark, sf).select("doc_id", F.concat("prompt", _pick(_BROAD, F.col("doc_id"))).alias("prompt"))
    made = S.targeted_blocks(_rich(spark, sf), w)
    return E.broad_extracts(made, prompt_family("prompt"), box_numbers("prompt")).select("doc_id", "block_id", F.sha1("answer").alias("sha1"))


_BROAD = [" strengths and limits", " discussion section", " box 3", ""]
_BROAD_TARGETED = TARGETED.replace("[conv_id % 6 + 1] AS prompt FROM pr WHERE turn = 0", f"[conv_id % 6 + 1] || {_L(_BROAD)}[conv_id % {len(_BROAD)} + 1] AS prompt FROM pr WHERE turn = 0", 1)
BROAD_SQL = f"""WITH {_BROAD_TARGETED}, m AS (SELECT * FROM t6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, order_index) = 1),
o AS (SELECT *, coalesce(nullif(string_split(heading, ' / ')[-1], ''), 'target section') AS lf, regexp_extract_all(lower(prompt), '\\bbox\\s*(\\d{{1,3}})\\b', 1) AS bo FROM m),
a AS (SELECT doc_id, block_id, CASE WHEN family = 'box_only' AND len(bo) > 0 THEN 'From Box ' || bo[1]::INT || ', the paper states:' || chr(10) || '> ' || text WHEN family = 'strength_limits' THEN 'From the ' || lf || ' section, the paper describes this trade-off:' || chr(10) || '> ' || text WHEN family = 'discussion_only' THEN 'From the ' || lf || ' section, the paper states:' || chr(10) || '> ' || text END AS answer FROM o)
SELECT doc_id, block_id, sha1(answer) AS sha1 FROM a WHERE answer IS NOT NULL"""

QUERIES = {f.__name__: f for f in (hit_aspects, exact_answers, document_abstracts, broad_answers, reindex_hints)}
ORACLE_SQL = {"hit_aspects": ASPECT_SQL, "exact_answers": EXACT_SQL, "document_abstracts": ABSTRACT_SQL, "broad_answers": BROAD_SQL, "reindex_hints": HINT_SQL}
