"""Slots of evidence for the turns of conversations, their assignment to lines and the resolution of markers; with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import prompts as P
from ..operators import support as S
from .common import table
from .intents import NO_WORD

BY = ["conv_id", "turn"]
#: Cards of an answer.
CARDS = 6


def answers(spark, sf) -> DataFrame:
    """The assistant's turns as lines: conv_id, turn, pos and line."""
    turns = table(spark, sf, "conversations").where("role = 'assistant'")
    return turns.select(*BY, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


def cards(spark, sf) -> DataFrame:
    """For each answer the lines of the conversation's documents that share most cues with the prompt before it.  A conversation's documents are those whose id leaves its number as the remainder by the number of conversations."""
    turns = table(spark, sf, "conversations")
    many = F.broadcast(turns.agg((F.max("conv_id") + 1).alias("many")))  # a row
    docs = table(spark, sf, "documents").join(many).select(F.pmod("doc_id", "many").alias("conv_id"), "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "snippet"))
    blocks = docs.where(F.length(F.trim("snippet")) >= 24).withColumn("cue", F.explode(F.array_distinct(S.cues("snippet"))))
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), "text").join(turns.where("role = 'assistant'").select(*BY), BY)
    asked = asked.select(*BY, "text", F.explode(S.cues("text")).alias("cue"))
    hits = asked.select(*BY, "cue").join(blocks.select("conv_id", "cue", "doc_id", "place"), ["conv_id", "cue"]).groupBy(*BY, "doc_id", "place").agg(F.count("*").alias("shared"))
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("shared"), "doc_id", "place"))).where(F.col("n") <= CARDS)
    first = best.groupBy(*BY, "doc_id").agg(F.min("n").alias("first"))
    first = first.withColumn("doc_idx", F.row_number().over(Window.partitionBy(*BY).orderBy("first"))).drop("first")
    prompts = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), P.prompt_family("text").alias("family"))
    out = best.join(first, [*BY, "doc_id"]).join(docs.select("doc_id", "place", "snippet"), ["doc_id", "place"]).join(prompts, BY)
    name = F.col("doc_id").cast("string")
    return out.select(*BY, F.col("n").alias("place"), "doc_idx", F.substring(F.sha1(name), 1, 8).alias("sid"), name.alias("source"), F.lit("").alias("heading"), F.lit("").alias("cue"), "snippet", F.lit(None).cast("array<int>").alias("candidate_refs"), "family", F.col("place").alias("line_no"))


def _slots(spark, sf) -> DataFrame:
    return S.slots(cards(spark, sf), BY)


def support_slots(spark, sf):
    return _slots(spark, sf).select(*BY, "slot", "source", "line_no", "claim_type", "cite_policy", "support_id", F.array_join("cues", " ").alias("cues"), "figure_like", F.sha1("locate").alias("locate"), F.size("refs").alias("n_refs"))


def support_scores(spark, sf):
    return S.scores(answers(spark, sf), _slots(spark, sf), BY).select(*BY, "pos", "slot", "score", "floor")


def support_assignments(spark, sf):
    slot = _slots(spark, sf)
    return S.assignments(S.scores(answers(spark, sf), slot, BY), slot, BY)


def support_resolutions(spark, sf):
    """The markers of the assignments, and a second one of the same document without a slot's number, resolved."""
    slot, lines = _slots(spark, sf), answers(spark, sf)
    put = S.marked(lines, S.assignments(S.scores(lines, slot, BY), slot, BY), slot, BY)
    put = put.withColumn("line", F.regexp_replace("line", "(\\[\\[SUPPORT:DOC-\\d+)-S\\d+\\]\\]$", "$0 $1]]"))
    return S.resolved(put, slot, BY)


_CUES = lambda x: (
    f"list_filter(list_transform(range(1, len(({x})) + 1), lambda i: CASE WHEN list_position(({x}), ({x})[i]) = i THEN ({x})[i] END), lambda t: t IS NOT NULL)[1:{S.CUES}]"
)
_RAW = lambda x: (
    f"list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\[\\[cite:[^\\]]+\\]\\]', ' ', 'g'), '{S.CITE_MARK}', ' ', 'g'), '[a-z0-9]{{3,}}'), "
    f"lambda t: (length(t) >= 4 OR t IN {S.SHORT_CUES} OR regexp_matches(t, '[0-9]')) AND t NOT IN {S.NO_CUE})"
)
_TRIM = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substr({x}, 1, {n} - 3), ' ') || '...' END"


def _family(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(coalesce({x}, ''), '{pattern.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, pattern in P.FAMILIES) + " ELSE '' END"


#: Documents have neither headings nor citations, so a slot's claim and policy follow from the family and the words of its snippet.
_SLOTS = rf"""t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), many AS (SELECT max(conv_id) + 1 AS n FROM t),
dl AS (SELECT doc_id, doc_id % n AS conv_id, unnest(string_split(coalesce(text, ''), chr(10))) AS snippet, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS place FROM documents, many),
q0 AS (SELECT u.conv_id, u.turn + 1 AS turn, u.text, {_RAW('u.text')} AS raw FROM t u JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
q AS (SELECT conv_id, turn, {_family('text')} AS family, {_CUES('raw')} AS cs FROM q0), qc AS (SELECT conv_id, turn, unnest(cs) AS cue FROM q),
b0 AS (SELECT doc_id, conv_id, place, snippet, {_RAW('snippet')} AS raw FROM dl WHERE length(trim(snippet, ' ')) >= 24), bc AS (SELECT doc_id, conv_id, place, unnest({_CUES('raw')}) AS cue FROM b0),
h AS (SELECT conv_id, turn, doc_id, place, count(*) AS shared FROM qc JOIN bc USING (conv_id, cue) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY shared DESC, doc_id, place) AS n FROM h) WHERE n <= {CARDS}),
di AS (SELECT conv_id, turn, doc_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(n)) AS doc_idx FROM best GROUP BY conv_id, turn, doc_id),
c0 AS (SELECT conv_id, turn, n, doc_idx, doc_id::VARCHAR AS source, place AS line_no, family, trim(regexp_replace(snippet, '[ \t]+', ' ', 'g'), ' ') AS s FROM best JOIN di USING (conv_id, turn, doc_id) JOIN dl USING (conv_id, doc_id, place) JOIN q USING (conv_id, turn)),
c1 AS (SELECT *, {_TRIM('s', 420)} AS snippet FROM c0), c2 AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(snippet, '([.;:])\s+', '\1' || chr(10), 'g'), chr(10)), lambda p: trim(p, ' ')), lambda p: p <> '') AS fs FROM c1),
c3 AS (SELECT *, coalesce(list_filter(list_transform(fs, lambda p: {_TRIM('p', 220)}), lambda p: length(p) >= 24)[1], {_TRIM('snippet', 220)}) AS locate FROM c2),
c4 AS (SELECT *, snippet || ' ' || locate AS said, {_RAW("snippet || ' ' || locate")} AS raw FROM c3),
c5 AS (SELECT *, {_CUES('raw')} AS cues, regexp_matches(said, '{S.FIGURE_WORD}') OR regexp_matches(snippet, '(?i)fig(?:ure)?s?\.?\s*\d{{1,3}}') AS figure_like,
  CASE family WHEN 'abstract' THEN 'abstract_quote' WHEN 'method' THEN 'method_detail' WHEN 'compare' THEN 'compare_result' WHEN 'figure_walkthrough' THEN 'figure_panel' ELSE 'own_result' END AS claim_type FROM c4),
d1 AS (SELECT * FROM c5 QUALIFY row_number() OVER (PARTITION BY conv_id, turn, doc_idx, source, trim(regexp_replace(lower(locate), '[\s_]+', ' ', 'g')) ORDER BY n) = 1),
d2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) AS slot FROM d1),
slots AS (SELECT *, CASE WHEN claim_type = 'method_detail' THEN 'prefer_ref' WHEN claim_type IN ('abstract_quote', 'figure_panel', 'own_result') THEN 'locate_only' ELSE 'allow_none' END AS cite_policy,
  'DOC-' || doc_idx || CASE WHEN count(*) OVER (PARTITION BY conv_id, turn, doc_idx) > 1 THEN '-S' || row_number() OVER (PARTITION BY conv_id, turn, doc_idx ORDER BY slot) ELSE '' END AS support_id FROM d2 WHERE slot <= 4)"""

SLOT_SQL = f"""WITH {_SLOTS}
SELECT conv_id, turn, slot::INT AS slot, source, line_no::INT AS line_no, claim_type, cite_policy, support_id, array_to_string(cues, ' ') AS cues, figure_like, sha1(locate) AS locate, 0 AS n_refs FROM slots"""

_STRONG = "[" + ", ".join(f"'{t}'" for t in S.STRONG_TOKENS) + "]"
SCORE_SQL = rf"""WITH {_SLOTS},
l AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM t WHERE role = 'assistant'), lc0 AS (SELECT *, {_RAW('line')} AS raw FROM l), lc AS (SELECT *, {_CUES('raw')} AS own FROM lc0),
p AS (SELECT *, list_intersect(own, cues) AS shared, regexp_matches(line, '{S.FIGURE_WORD}') AS names FROM lc JOIN slots USING (conv_id, turn)
  WHERE line <> '' AND NOT contains(line, '[[SUPPORT:') AND NOT contains(line, '[[CITE:') AND NOT starts_with(line, '|') AND NOT regexp_matches(line, '{S.META_LINE}') AND NOT regexp_matches(line, '{S.HEADER_LINE}') AND family NOT IN ('abstract', 'compare', 'figure_walkthrough', 'overview', 'citation_lookup')),
s AS (SELECT *, len(list_intersect(shared, {_STRONG})) > 0 AS strong FROM p WHERE len(shared) > 0),
v AS (SELECT conv_id, turn, pos, slot, round((len(shared) + CASE WHEN strong THEN 0.45 ELSE 0 END + CASE WHEN cite_policy = 'prefer_ref' THEN 0.1 ELSE 0 END - CASE WHEN figure_like AND NOT names THEN 1.2 ELSE 0 END
  + CASE WHEN family = 'method' THEN 0.35 + CASE WHEN regexp_matches(line, '{S.METHOD_LINE}') THEN 0.45 ELSE 0 END ELSE 0 END)::DOUBLE, 6) AS score, CASE WHEN strong THEN 1.0 WHEN family = 'method' THEN 1.35 ELSE 2.0 END::DOUBLE AS floor FROM s)
SELECT conv_id, turn, pos::INT AS pos, slot::INT AS slot, score, floor FROM v WHERE score > 0"""

_ASSIGNED = rf"""{SCORE_SQL[5:SCORE_SQL.rindex("SELECT conv_id")].rstrip()}, k AS (SELECT conv_id, turn, pos, list({{'less': -score, 'slot': slot, 'floor': floor}} ORDER BY score DESC, slot) AS c, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS i FROM v WHERE score > 0 GROUP BY conv_id, turn, pos),
r AS (SELECT conv_id, turn, 0::BIGINT AS i, NULL::BIGINT AS pos, NULL::BIGINT AS slot, NULL::DOUBLE AS score, []::BIGINT[] AS used FROM (SELECT DISTINCT conv_id, turn FROM k)
  UNION ALL SELECT conv_id, turn, i, CASE WHEN takes THEN pos END, CASE WHEN takes THEN f.slot END, CASE WHEN takes THEN -f.less END, CASE WHEN takes THEN list_append(used, f.slot) ELSE used END
  FROM (SELECT *, coalesce(len(used) < 3 AND -f.less >= f.floor, false) AS takes FROM (SELECT k.conv_id, k.turn, k.i, k.pos, r.used, list_filter(k.c, lambda x: NOT list_contains(r.used, x.slot))[1] AS f FROM r JOIN k ON k.conv_id = r.conv_id AND k.turn = r.turn AND k.i = r.i + 1))),
assigned AS (SELECT conv_id, turn, pos, slot, score FROM r WHERE slot IS NOT NULL)"""
ASSIGNMENT_SQL = f"WITH RECURSIVE {_ASSIGNED} SELECT conv_id, turn, pos::INT AS pos, slot::INT AS slot, score FROM assigned"

#: Whether a line names panels (selection.panel_letters); claims about panels have no lines here, so that for every other claim a slot fits less.
_LETTER = f"(?i)(?:^|{NO_WORD})[a-z](?:{NO_WORD}|$)"
_LETTERS = "(" + " OR ".join([
    *[f"regexp_matches(m.line, '{p}')" for p in (
        f"(?i)(?:^|{NO_WORD})[a-z]\\s*/\\s*[a-z](?:{NO_WORD}|$)", f"(?i)(?:^|{NO_WORD})panels?\\s+[a-g](?:\\s*(?:[/,&-]|\\band\\b)\\s*[a-g])*(?:[^a-z]|$)", "(?i)\\([a-g](?:\\s*[/,&-]\\s*[a-g])*\\)",
        "(?m)(?:^|[.;:]\\s*)[A-Ga-g]\\s+[A-Z]", "(?im)(?:^|[.;:]\\s*)[a-z]\\s*,",
    )],
    f"len(list_filter(regexp_extract_all(m.line, '(?i)panels?\\s*\\(([^)]+)\\)', 1), lambda g: regexp_matches(g, '{_LETTER}'))) > 0",
]) + ")"
RESOLUTION_SQL = rf"""WITH RECURSIVE {_ASSIGNED},
m AS (SELECT a.conv_id, a.turn, a.pos, s.slot, s.support_id, s.doc_idx, s.cite_policy, lc.own, lc.line FROM assigned a JOIN slots s USING (conv_id, turn, slot) JOIN lc USING (conv_id, turn, pos)),
fit AS (SELECT m.conv_id, m.turn, m.pos, o.slot, o.support_id, o.cite_policy, list_intersect(m.own, o.cues) AS shared, len(m.own) AS n_own, o.claim_type = 'method_detail' AND regexp_matches(m.line, '{S.CONTEXT_METHOD}') AS fits, o.figure_like AND NOT regexp_matches(m.line, '{S.FIGURE_WORD}') AS away, {_LETTERS} AS letters
  FROM m JOIN slots o ON o.conv_id = m.conv_id AND o.turn = m.turn AND o.doc_idx = m.doc_idx WHERE contains(m.support_id, '-S')),
fs AS (SELECT *, round((len(shared) + CASE WHEN len(list_intersect(shared, {_STRONG})) > 0 THEN 0.45 ELSE 0 END + CASE WHEN fits THEN 0.3 ELSE 0 END - CASE WHEN letters THEN 0.65 WHEN away THEN 1.15 ELSE 0 END)::DOUBLE, 6) AS score FROM fit),
chosen AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY score DESC, slot) = 1)
SELECT conv_id, turn, pos::INT AS pos, n::INT AS n, support_id, slot::INT AS slot, score, NULL::INT AS num, CASE cite_policy WHEN 'locate_only' THEN 'locate_only' ELSE 'no_ref' END AS mode, '' AS replacement
FROM (SELECT conv_id, turn, pos, 0 AS n, support_id, slot, NULL::DOUBLE AS score, cite_policy FROM m UNION ALL SELECT conv_id, turn, pos, 1, support_id, slot, score, cite_policy FROM chosen)"""

QUERIES = {f.__name__: f for f in (support_slots, support_scores, support_assignments, support_resolutions)}
ORACLE_SQL = {"support_slots": SLOT_SQL, "support_scores": SCORE_SQL, "support_assignments": ASSIGNMENT_SQL, "support_resolutions": RESOLUTION_SQL}
