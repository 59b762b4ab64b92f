"""Queries on what prompts ask for; each with its DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import intents as N
from .common import PROMPTS, prompts, table


def _case(column: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


def prompt_intents(spark, sf):
    """What each prompt asks for: retrieval or not, intents, sections, papers and topic."""
    t = F.col("text")
    flags = {f"wants_{k}": v for k, v in N.intent_flags("text").items()}
    return prompts(spark, sf).select(
        "conv_id", "turn", N.bypasses_retrieval(t).alias("bypass"), N.image_first(t).alias("image_first"), *[v.alias(k) for k, v in flags.items()],
        F.array_join(N.preferred_sections(t), " ").alias("preferred"), N.paper_scope(t).alias("scope"), N.focus_action(t).alias("action"), N.topic(t).alias("topic"),
        F.array_join(N.section_targets(t), ",").alias("targets"), F.array_join(N.box_numbers(t).cast("array<string>"), ",").alias("boxes"), F.array_join(N.keywords(t), "|").alias("keywords"),
    )


_TOKENS = lambda x: f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]'), lambda t: lower(t))"
_MATCH = lambda x: f"trim(regexp_replace(lower({x}), '[\\s_]+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in N.STOP) + "]"
_INFORMATIVE = lambda x, n=3: f"list_filter({_TOKENS(_MATCH(x))}, lambda t: length(t) >= {n} AND NOT list_contains({_STOP}, t))"
_ENDS = "(?:" + "|".join(sorted(N.SUFFIXES, key=len, reverse=True)) + ")$"
_TOPIC = " ".join(f"WHEN trim(regexp_extract(text, '{p}', 1)) <> '' THEN trim(regexp_replace(regexp_extract(text, '{p}', 1), '\\s+', ' ', 'g'))" for p in N.TOPICS)
INTENT_SQL = f"""WITH {PROMPTS}, l AS (SELECT *, lower(text) AS low,
  list_filter(flatten(list_transform(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), lambda p: regexp_split_to_array(regexp_replace(p, '{_ENDS}', ''), '{N.GLUE}'))), lambda p: length(p) >= 2) AS zh FROM pr)
SELECT conv_id, turn, regexp_matches(low, '{N.CODE}') AND NOT regexp_matches(low, '{N.ACADEMIC}') AS bypass, trim(low) = '' OR (regexp_matches(low, '{N.IMAGE}') AND NOT regexp_matches(low, '{N.DOCUMENT}')) AS image_first,
 {", ".join(f"regexp_matches(low, '{p}') AS wants_{k}" for k, p in N.INTENTS.items())},
 CASE {" ".join(f"WHEN regexp_matches(low, '{p}') THEN '{n}'" for p, n in N.PREFERRED)} ELSE '{N.PREFERRED_ELSE}' END AS preferred,
 CASE WHEN regexp_matches(low, '{N.MANY_PAPERS}') THEN 'list' WHEN regexp_matches(low, '{N.ONE_PAPER}') THEN 'single' ELSE '' END AS scope, {_case("low", N.ACTIONS, "")} AS action,
 CASE {_TOPIC} ELSE '' END AS topic, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{n}' END" for n, p in N.SECTIONS)}], lambda s: s IS NOT NULL), ',') AS targets,
 coalesce(array_to_string(list_transform(regexp_extract_all(low, '\\bbox\\s*(\\d{{1,3}})\\b', 1), lambda b: b::INT), ','), '') AS boxes,
 coalesce(array_to_string((CASE WHEN len(zh) > 0 THEN list_transform(range(1, len(zh) + 1), lambda i: CASE WHEN list_position(zh, zh[i]) = i THEN zh[i] END)
   ELSE list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END) END).list_filter(lambda k: k IS NOT NULL)[1:4], '|'), '') AS keywords
FROM (SELECT *, list_filter({_TOKENS("text")}, lambda t: length(t) > 2) AS w FROM l)"""

_ROMAN = "{" + ", ".join(f"'{k}': {v}" for k, v in N.ROMAN.items()) + "}"
_VALUE = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in N.ROMAN.items()) + " END"
_CN = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in N.CHINESE.items()) + " END"


def _number_sql(x: str) -> str:
    values = f"list_transform(string_split(lower({x}), ''), lambda c: {_VALUE('c')})"
    signed = f"list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN ({values})[i] < list_max(({values})[i + 1:]) THEN -({values})[i] ELSE ({values})[i] END))"
    left, right = f"string_split({x}, '十')[1]", f"string_split({x}, '十')[2]"
    return f"""CASE WHEN regexp_full_match({x}, '\\d+') THEN try_cast({x} AS INT) WHEN regexp_full_match(lower({x}), '[ivxlcdm]+') THEN {signed}::INT WHEN length({x}) = 1 THEN {_CN(x)}
 WHEN contains({x}, '十') THEN CASE WHEN {left} = '' THEN 10 + coalesce({_CN(right)}, 0) ELSE {_CN(left)} * 10 + CASE WHEN {right} = '' THEN 0 ELSE {_CN(right)} END END END"""


def anchor_hints(spark, sf):
    """The anchor of each prompt, its bonus and places in the conversation's turns, and the bonus of terms."""
    p = prompts(spark, sf).withColumn("anchor", N.anchor("text"))
    asked = p.where("turn = 0").select("conv_id", F.col("text").alias("prompt"), F.col("anchor.kind").alias("kind"), F.col("anchor.number").alias("number"))
    both = p.select("conv_id", "turn", "text").join(asked, "conv_id")
    t = F.col("text")
    return both.select(
        "conv_id", "turn", "kind", "number", F.round(N.anchor_bonus(t, F.col("kind"), F.col("number")), 4).alias("anchor_bonus"), N.anchor_hits(t, F.col("kind"), F.col("number")).alias("hits"),
        F.round(N.term_bonus(F.col("prompt"), t), 4).alias("term_bonus"),
    )


_KINDS = " ".join(f"WHEN coalesce(n{i}, 0) > 0 THEN {{'kind': '{kind}', 'number': n{i}}}" for i, (kind, _) in enumerate(N.ANCHORS))
#: DuckDB's \\b knows ASCII letters alone ("figure Ciónquebo" would have the number Ci); these stand for the border of a word in any script, as Spark and the reference have it.
NO_WORD = "[^\\p{L}\\p{Nd}\\p{Mn}_]"


def _bordered(p: str) -> str:
    head, rest = ("(?i)", p[4:]) if p.startswith("(?i)") else ("", p)
    return head + re.sub("^\\\\b", lambda _: f"(?:^|{NO_WORD})", rest).replace("\\b", f"(?:{NO_WORD}|$)")


_GROUPS = ", ".join(f"nullif(trim(regexp_extract(text, '{_bordered(p)}', 1)), '') AS g{i}" for i, (_, p) in enumerate(N.ANCHORS))
_NUMBERS = ", ".join(f"{_number_sql(f'g{i}')} AS n{i}" for i in range(len(N.ANCHORS)))
_FORMS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '(?i){'|'.join(_bordered(x.replace('N', '#')) for x in v)}'" for k, v in N.NUMBERED.items()) + " END"
_LABELS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{'|'.join(v)}'" for k, v in N.LABELS.items()) + " END"
_WANT = lambda t: f"regexp_matches({_MATCH('prompt')}, '{N.WANTED[t]}')"
_HAS = lambda t: f"regexp_matches({_MATCH('text')}, '{N.SHOWN[t]}')"
_BONUS = " + ".join(
    [f"CASE WHEN {_WANT(t)} THEN CASE WHEN {_HAS(t)} THEN {b} ELSE {N.MISSING.get(t, 0.0)} END ELSE 0 END" for t, b in N.BONUS.items()]
    + [f"CASE WHEN {_WANT(t)} AND {_HAS(r)} AND NOT {_HAS(t)} THEN {m} ELSE 0 END" for t, r, m in N.RIVALS]
)
#: A form may begin with the bracket or backslash that ended the one before it, so these stand twice where forms are counted.
ANCHOR_SQL = f"""WITH {PROMPTS}, g AS (SELECT *, {_GROUPS} FROM pr WHERE turn = 0), n AS (SELECT conv_id, text, {_NUMBERS} FROM g), a AS (SELECT conv_id, text AS prompt, CASE {_KINDS} END AS a FROM n),
b AS (SELECT p.conv_id, p.turn, p.text, a.prompt, a.a.kind AS kind, a.a.number AS number FROM pr p JOIN a USING (conv_id)),
f AS (SELECT *, replace({_FORMS}, '#', number::VARCHAR) AS form, {_LABELS} AS label, regexp_replace(text, '([(（\\\\])', '\\1\\1', 'g') AS twice FROM b)
SELECT conv_id, turn, kind, number::INT AS number, round(CASE WHEN kind IS NOT NULL AND text <> '' THEN CASE WHEN regexp_matches(lower(text), form) THEN 12 ELSE 0 END + CASE WHEN regexp_matches(lower(text), label) THEN 2 ELSE 0 END
  + CASE WHEN contains(lower(text), number::VARCHAR) THEN 1.2 ELSE 0 END ELSE 0 END::DOUBLE, 4) AS anchor_bonus,
 CASE WHEN len(regexp_extract_all(twice, form)) > 0 THEN 40 + 12 * len(regexp_extract_all(twice, form)) + CASE WHEN regexp_matches(ltrim(lower(text)), '^(?:fig\\.|figure|图|table|表|equation|theorem|lemma|definition|proposition|corollary|定理|引理|定义|命题|推论)') THEN 8 ELSE 0 END END::DOUBLE AS hits,
 round(({_BONUS})::DOUBLE, 4) AS term_bonus FROM f"""


def focus_scores(spark, sf):
    """Each turn of a conversation as a document (its first line as title) for the focus phrases of the first one's prompt."""
    p = prompts(spark, sf)
    asked = p.where("turn = 0").select("conv_id", F.col("text").alias("prompt"))
    body = p.join(table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("body")), ["conv_id", "turn"]).join(asked, "conv_id")
    title, text = F.substring("body", 1, 40), F.concat_ws(" ", "text", "body")
    return body.select("conv_id", "turn", F.array_join(N.focus_phrases("prompt"), "|").alias("phrases"), F.round(N.focus_score(F.col("prompt"), title, text), 4).alias("focus"), F.round(N.source_match(F.col("prompt"), F.concat(F.substring("text", 1, 30), F.lit(".pdf"))), 4).alias("named"))


_CLEAN = lambda s: _MATCH(f"regexp_replace(regexp_replace({s}, '(?i)^(?:the|a|an)\\s+', ''), '[?,;:!()\\[\\]{{}}\"“”‘’]', ' ', 'g')")
_OBJECTS = "list_filter([" + ", ".join(f"nullif(regexp_extract(prompt, '{p}', 1), '')" for p in N.FOCUS) + "], lambda o: o IS NOT NULL)"
_ON = lambda p, low, toks: f"(contains({low}, {p}) OR (len(list_distinct({_INFORMATIVE(p, 4)})) >= 2 AND len(list_intersect({_INFORMATIVE(p, 4)}, {toks})) >= 2))"
FOCUS_SQL = f"""WITH {PROMPTS}, a AS (SELECT conv_id, text AS prompt FROM pr WHERE turn = 0),
b AS (SELECT conv_id, turn, prompt, substr(coalesce(c.text, ''), 1, 40) AS title, pr.text || ' ' || coalesce(c.text, '') AS body, substr(pr.text, 1, 30) || '.pdf' AS name FROM pr JOIN conversations c USING (conv_id, turn) JOIN a USING (conv_id)),
o AS (SELECT *, {_OBJECTS} AS obj, {_MATCH("title")} AS tl, {_MATCH("body")} AS bl FROM b),
r AS (SELECT *, list_concat(regexp_extract_all(prompt, '{N.QUOTED}', 1), CASE WHEN regexp_matches(prompt, '{N.COMPARES}') THEN flatten(list_transform(obj, lambda x: list_concat([x], regexp_split_to_array(x, '(?i)\\b(?:and|versus|vs)\\b')))) ELSE obj END) AS raw FROM o),
c AS (SELECT *, list_transform(raw, lambda s: trim({_CLEAN("s")})) AS cl, {_TOKENS("tl")} AS tt, {_TOKENS("bl")} AS bt FROM r),
i AS (SELECT *, list_filter(cl, lambda s: len({_INFORMATIVE("s")}) >= 2 OR (len({_INFORMATIVE("s")}) = 1 AND (length(({_INFORMATIVE("s")})[1]) >= 6 OR regexp_matches(({_INFORMATIVE("s")})[1], '\\d')))) AS ok FROM c),
d AS (SELECT *, list_filter(list_transform(range(1, len(ok) + 1), lambda k: CASE WHEN list_position(ok, ok[k]) = k THEN ok[k] END), lambda k: k IS NOT NULL)[1:6] AS ph FROM i),
e AS (SELECT *, list_transform(ph, lambda p: {_ON("p", "tl", "tt")}) AS th, list_transform(ph, lambda p: {_ON("p", "bl", "bt")}) AS bh FROM d),
m AS (SELECT *, coalesce(list_sum(list_transform(range(1, len(ph) + 1), lambda k: CASE WHEN th[k] THEN 5.2 ELSE 0 END + CASE WHEN bh[k] THEN 4.1 ELSE 0 END + CASE WHEN bh[k] AND regexp_matches(prompt, '{N.DEFINES}') AND regexp_matches(body, '{N.EXPLAINS}') THEN 1.8 ELSE 0 END)), 0) AS s,
  len(list_filter(range(1, len(ph) + 1), lambda k: th[k] OR bh[k])) AS n, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM e),
w AS (SELECT *, list_distinct({_INFORMATIVE("name || ' ' || stem")}) AS own, {_INFORMATIVE("prompt")} AS pt FROM m)
SELECT conv_id, turn, coalesce(array_to_string(ph, '|'), '') AS phrases,
 round(least(s + CASE WHEN n >= 2 AND regexp_matches(prompt, '{N.COMPARES}') AND (regexp_matches(title, '{N.COMPARES}') OR regexp_matches(body, '{N.COMPARES}')) THEN 4.6 ELSE 0 END + CASE WHEN n >= 1 AND len(ph) = 1 THEN 1.2 ELSE 0 END, 18)::DOUBLE, 4) AS focus,
 round((CASE WHEN contains(lower(prompt), lower(name)) THEN CASE WHEN ends_with(lower(name), '.pdf') THEN 9 ELSE 8 END WHEN stem <> '' AND contains(lower(prompt), lower(stem)) THEN 8 ELSE 0 END
  + CASE WHEN len(list_intersect(own, pt)) >= 3 THEN 2 + least(3, 0.6 * len(list_intersect(own, pt))) + CASE WHEN len(list_intersect(own, pt)) / len(own) >= 0.55 THEN 2 ELSE 0 END ELSE 0 END)::DOUBLE, 4) AS named FROM w"""

QUERIES = {f.__name__: f for f in (prompt_intents, anchor_hints, focus_scores)}
ORACLE_SQL = {"prompt_intents": INTENT_SQL, "anchor_hints": ANCHOR_SQL, "focus_scores": FOCUS_SQL}
