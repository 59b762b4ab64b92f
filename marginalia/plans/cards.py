"""Queries on reference cards; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cards as C
from ..operators import intents as N
from .common import PROMPTS, prompts, table
from .reader import _FOCUS_STOP, _NORM
from .selection import HEADS, _pick

_ASKS = [" Which paper defines GAP-TV?", " compare GAP-TV versus 'Deep Net'", " which papers mention Deep-Net", " and GAP-TV x2", " nothing", " GAP-TV"]
_TITLES = ["GAP-TV methods", "A comparison of deep net and gap tv", "Deep Net", "Other", ""]
_SAYS = ["we introduce gap tv, directly compared with deep net", "works without any gap tv", "related work on deep net", "x2 and gap tv versus deep net", "not mentioned", "gap tv is defined as a prior"]


def _hits(spark, sf):
    """Turns as hits for their conversation's prompt."""
    p = prompts(spark, sf)
    asked = p.where("turn = 0").select("conv_id", F.concat("text", _pick(_ASKS, F.col("conv_id"))).alias("prompt"))
    n = F.col("conv_id") + 3 * F.col("turn")
    own = F.substring(F.coalesce("text", F.lit("")), 1, 80)
    return table(spark, sf, "conversations").join(asked, "conv_id").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "prompt", _pick(_TITLES, n).alias("title"), _pick(HEADS, n).alias("heading"), F.concat(_pick(_SAYS, F.col("conv_id") + F.col("turn")), F.lit(". "), own).alias("text"), F.when(F.pmod(n, F.lit(6)) == 2, "not discussed there").otherwise("").alias("why")
    )


def focused_hits(spark, sf):
    """The hits that the focus of each conversation's prompt leaves, with their scores."""
    return C.focused(_hits(spark, sf)).select("query_id", "pos", "mode", "matches", "other_matches", "compare_score", "single_score")


_L = lambda v: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + "]"
_ACTION = "CASE " + " ".join(f"WHEN regexp_matches(lower(prompt), '{p}') THEN '{n}'" for n, p in N.ACTIONS) + " ELSE '' END"
_SCOPE = f"CASE WHEN regexp_matches(lower(prompt), '{N.MANY_PAPERS}') THEN 'list' WHEN regexp_matches(lower(prompt), '{N.ONE_PAPER}') THEN 'single' ELSE '' END"
_Q = lambda p: p.replace("'", "''")
_HEAD = "CASE " + " ".join(f"WHEN regexp_matches(hn, '{p}') THEN {w}" for p, w in C.HEADINGS) + " ELSE 0 END"
_ON = lambda t, s: f"contains(' ' || {s} || ' ', ' ' || {t} || ' ')"
_M = lambda p, w: f"CASE WHEN regexp_matches(sf, '{_Q(p)}') THEN {w} ELSE 0 END"
FOCUSED_SQL = f"""WITH {PROMPTS}, a AS (SELECT conv_id, text || {_L(_ASKS)}[conv_id % {len(_ASKS)} + 1] AS prompt FROM pr WHERE turn = 0),
h AS (SELECT conv_id AS query_id, turn AS pos, prompt, {_L(_TITLES)}[(conv_id + 3 * turn) % {len(_TITLES)} + 1] AS title, {_L(HEADS)}[(conv_id + 3 * turn) % {len(HEADS)} + 1] AS heading, {_L(_SAYS)}[(conv_id + turn) % {len(_SAYS)} + 1] || '. ' || substr(coalesce(c.text, ''), 1, 80) AS text, (conv_id + 3 * turn) % 6 = 2 AS neg FROM conversations c JOIN a USING (conv_id)),
w AS (SELECT *, list_concat(regexp_extract_all(prompt, '["'']([^"'']{{2,80}})["'']', 1), list_filter(regexp_extract_all(prompt, '[A-Za-z][A-Za-z0-9_-]{{1,40}}'), lambda w: (regexp_matches(substr(w, 2), '[A-Z]') OR regexp_matches(w, '[0-9-]')) AND NOT list_contains({_FOCUS_STOP}, w))) AS raw FROM h),
n AS (SELECT *, list_filter(list_transform(raw, lambda t: {_NORM("t")}), lambda t: length(t) >= 3) AS ts, {_NORM("title")} AS tn, {_NORM("heading")} AS hn, {_NORM("concat_ws(' ', heading, text)")} AS ow, {_NORM("concat_ws(' ', title, heading, text)")} AS al, concat_ws(' ', title, heading, text) AS sf FROM w),
d AS (SELECT *, list_filter(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN list_position(ts, ts[i]) = i THEN ts[i] END), lambda t: t IS NOT NULL) AS di FROM n),
f AS (SELECT *, list_filter(di, lambda t: len(list_filter(di, lambda o: o <> t AND length(o) > length(t) AND contains(o, t) AND NOT regexp_matches(o, '\\b(?:and|vs|versus)\\b'))) = 0)[1:8] AS terms FROM d),
g AS (SELECT *, list_filter(terms, lambda t: {_ON("t", "al")}) AS fd, list_filter(terms, lambda t: {_ON("t", "ow")}) AS fo, list_distinct(flatten(list_transform(terms, lambda t: list_filter(string_split(t, ' '), lambda x: length(x) >= 4)))) AS kw FROM f),
k AS (SELECT *, len(fd) AS matches, len(list_filter(fd, lambda t: tn = '' OR NOT (contains(tn, t) OR contains(t, tn)))) AS om, len(list_filter(terms, lambda t: {_ON("t", "tn")})) AS tm,
  len(fo) > 0 AND len(list_filter(fo, lambda t: len(regexp_extract_all(ow, '{C.NEGATION}' || t || '\\b')) < len(regexp_extract_all(ow, '\\b' || t || '\\b')))) = 0 AS neg_only, len(list_filter(kw, lambda x: contains(al, x))) AS ka, len(list_filter(kw, lambda x: contains(tn, x))) AS kt, len(list_filter(kw, lambda x: contains(hn, x))) AS kh, {_HEAD} AS hd, {_ACTION} AS action, {_SCOPE} AS scope FROM g),
s AS (SELECT *, round((2.2 * om + {_M(C.COMPARES, 2.0)} + CASE WHEN regexp_matches(title, '{C.COMPARES}') THEN 2.8 ELSE 0 END + CASE WHEN kt >= 2 THEN 2 ELSE 0 END + {_M(C.DIRECT, 0.8)} + {_M(C.NOT_COMPARED, -4.2)} + {_M(C.IN_PASSING, -1.2)} + CASE WHEN om >= 2 AND NOT regexp_matches(sf, '{C.COMPARES}') THEN -1.8 ELSE 0 END)::DOUBLE, 4) AS compare_score,
  CASE WHEN om = 0 AND tm = 0 AND kt = 0 THEN -1000.0 ELSE round((2.4 * om + 2.1 * tm + 1.6 * least(2, ka) + CASE WHEN kh > 0 THEN 0.8 ELSE 0 END + CASE WHEN kt >= 2 THEN 1.2 WHEN kt = 1 AND tm = 0 THEN 0.6 ELSE 0 END + hd + CASE WHEN tm > 0 AND om = 0 AND hd >= 0.8 THEN 1.8 ELSE 0 END
   + CASE WHEN action = 'define' THEN CASE WHEN regexp_matches(sf, '{C.DEFINES}') THEN 3.0 WHEN ka + kh + kt > 0 THEN 1.4 ELSE -1.8 END ELSE {_M(C.OWN_WORK, 1.4)} + {_M(C.EXPLAINS, 0.9)} END + {_M(C.OTHERS_WORK, -3.4)} + {_M(C.NEGATIVE, -4.4)}
   + CASE WHEN om > 0 AND tm = 0 AND kt <= 1 AND hd <= 0 AND NOT regexp_matches(sf, '{C.EXPLAINS}') AND NOT regexp_matches(sf, '{C.COMPARES}') THEN -0.6 ELSE 0 END)::DOUBLE, 4) END AS single_score FROM k),
r AS (SELECT *, CASE WHEN len(terms) = 0 THEN 'all' WHEN action = 'compare' THEN 'compare' WHEN scope = 'single' THEN 'single' WHEN scope = 'list' THEN 'list' WHEN len(terms) > 1 THEN 'terms' ELSE 'term' END AS mode FROM s WHERE len(terms) = 0 OR (NOT (neg AND matches = 0) AND NOT neg_only)),
o AS (SELECT *, row_number() OVER x AS n, lead(compare_score) OVER x AS nx FROM r WINDOW x AS (PARTITION BY query_id ORDER BY compare_score DESC, pos)),
t AS (SELECT *, count(*) FILTER (WHERE compare_score >= {C.COMPARE_FLOOR}) OVER (PARTITION BY query_id) AS direct, max(CASE WHEN n = 1 THEN compare_score - nx END) OVER (PARTITION BY query_id) AS ld, max(om) OVER (PARTITION BY query_id) AS mo, max(matches) OVER (PARTITION BY query_id) AS mm FROM o)
SELECT query_id, pos, mode, matches::INT AS matches, om::INT AS other_matches, compare_score, single_score FROM t
WHERE CASE mode WHEN 'all' THEN true WHEN 'compare' THEN compare_score >= {C.COMPARE_FLOOR} AND (NOT coalesce(direct >= 2 AND ld >= {C.COMPARE_LEAD}, false) OR n = 1) WHEN 'single' THEN single_score >= {C.SINGLE_FLOOR} WHEN 'list' THEN CASE WHEN mo > 0 THEN om > 0 WHEN mm > 0 THEN matches > 0 ELSE true END WHEN 'terms' THEN om > 0 ELSE matches > 0 END"""

QUERIES = {"focused_hits": focused_hits}
ORACLE_SQL = {"focused_hits": FOCUSED_SQL}
