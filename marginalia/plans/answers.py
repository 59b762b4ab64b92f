"""Queries on answers and prompts; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import intents as N
from ..operators import library as L
from ..operators import prompts as P
from .common import PROMPTS, prompts, table
from .library import VIEWS, _views

#: Forms of an answer around the words of a turn: text before the first six words, after them, and after the next six.
ANSWERS = [
    ("Conclusion: ", " [3]\n\nEvidence:\n1. ", "\n2. see Fig. 2\n\nNext Steps:\n1. read on"),
    ("结论：", "\n依据:\n- ", " [[CITE:abcd:4]]\n局限: not stated in the paper"),
    ("", " ", ""),
    ("Abstract text ", ", and then ", " [1]."),
    ("Conclusion:\n\nLimits: ", " cannot confirm ", "\nConclusion: yes\nLimits:"),
    ("Intro\n  conclusion : ", " Figure 3 panel b\n下一步建议: ", "\n1. one\n 2. two\n\n3. three"),
    ("Evidence: ", "\n10. ", " [[SUPPORT:x-1]]"),
]


def _answers(spark, sf):
    n = F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(len(ANSWERS))).cast("int") + 1
    part = lambda k: F.element_at(F.array(*[F.lit(a[k]) for a in ANSWERS]), n)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \\t\\n]+"), F.lit(0))
    text = F.concat(part(0), F.array_join(F.slice(words, 1, 6), " "), part(1), F.array_join(F.slice(words, 7, 6), " "), part(2))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))


def _quoted(k: int) -> str:
    return "[" + ", ".join("'" + a[k].replace("\n", "' || chr(10) || '") + "'" for a in ANSWERS) + "]"


_FORM = f"(conv_id * 3 + turn) % {len(ANSWERS)} + 1"
TURNS = f"""t AS (SELECT conv_id, turn, {_quoted(0)}[{_FORM}] || array_to_string(w[1:6], ' ') || {_quoted(1)}[{_FORM}] || array_to_string(w[7:12], ' ') || {_quoted(2)}[{_FORM}] AS text
 FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n]+') AS w FROM conversations))"""
_NAMES = "CASE lower(k) " + " ".join(f"WHEN '{n.lower()}' THEN '{key}'" for key, names in A.SECTIONS.items() for n in names) + " END"
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
PARTS = f"""pa AS (SELECT *, list_transform(string_split(regexp_replace(text, '{A.HEADER}', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:], lambda p: {{'k': string_split(p, chr(2))[1], 'b': {_STRIP("string_split(p, chr(2))[2]")}}}) AS ps FROM t),
pk AS (SELECT *, list_transform(ps, lambda p: CASE lower(p.k) {" ".join(f"WHEN '{n.lower()}' THEN '{key}'" for key, names in A.SECTIONS.items() for n in names)} END) AS keys FROM pa)"""


def answer_sections(spark, sf):
    """The sections of each answer, two of their bodies and the items of the next steps."""
    t = _answers(spark, sf)
    return t.select("conv_id", "turn", F.array_join(A.section_keys("text"), ",").alias("keys"), A.section("text", "conclusion").alias("conclusion"), A.section("text", "limits").alias("limits"), F.array_join(A.ordered_items(A.section("text", "next_steps")), "|").alias("steps"))


_BODY = lambda key: f"list_filter(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN keys[i] = '{key}' AND ps[i].b <> '' THEN ps[i].b END), lambda b: b IS NOT NULL)[-1]"
SECTION_SQL = f"""WITH {TURNS}, {PARTS}, s AS (SELECT *, {_BODY("next_steps")} AS steps FROM pk),
i AS (SELECT *, list_transform(regexp_split_to_array(coalesce(steps, ''), '(?m)^\\s*\\d+\\.\\s+'), lambda x: {_STRIP("x")}) AS it FROM s)
SELECT conv_id, turn, coalesce(array_to_string(list_filter(list_transform(range(1, len(keys) + 1), lambda i: CASE WHEN list_position(keys, keys[i]) = i THEN keys[i] END), lambda k: k IS NOT NULL), ','), '') AS keys,
 {_BODY("conclusion")} AS conclusion, {_BODY("limits")} AS limits, coalesce(array_to_string(list_filter(CASE WHEN len(it) > 1 THEN it[2:] ELSE it END, lambda x: x <> ''), '|'), '') AS steps FROM i"""


def _settings(t):
    k = F.col("conv_id") + F.col("turn")
    family = F.element_at(F.array(F.lit("abstract"), F.lit("figure_walkthrough"), F.lit("method")), F.pmod(k, F.lit(3)).cast("int") + 1)
    mode = F.element_at(F.array(F.lit("fact_answer"), F.lit("reading_guide")), F.pmod(F.col("turn"), F.lit(2)).cast("int") + 1)
    return t.select("*", (F.pmod(k, F.lit(4)) > 0).alias("has_hits"), (F.pmod(k, F.lit(5)) > 0).alias("contract_enabled"), mode.alias("output_mode"), (F.pmod(F.col("conv_id"), F.lit(2)) == 0).alias("paper_guide_mode"), family.alias("prompt_family"))


def answer_probe(spark, sf):
    return A.probe(_settings(_answers(spark, sf))).drop("text")


PROBE = f"""{TURNS}, {PARTS}, se AS (SELECT *, {_STRIP("text")} AS x, (conv_id + turn) % 4 > 0 AS has_hits, (conv_id + turn) % 5 > 0 AS contract_enabled, CASE turn % 2 WHEN 0 THEN 'fact_answer' ELSE 'reading_guide' END AS output_mode, conv_id % 2 = 0 AS paper_guide_mode,
  ['abstract', 'figure_walkthrough', 'method'][(conv_id + turn) % 3 + 1] AS prompt_family FROM pk),
h AS (SELECT *, length(x)::INT AS char_count, {", ".join(f"list_contains(keys, '{k}') AS has_{k}" for k in A.SECTIONS)}, regexp_matches(x, '{A.CITES}') AS has_citations, regexp_matches(x, '{A.LOCATES}') AS has_locate_hint, paper_guide_mode AND prompt_family = 'abstract' AS abs FROM se),
n AS (SELECT *, paper_guide_mode AND prompt_family = 'figure_walkthrough' AND has_hits AS locate_required, NOT abs OR (char_count >= 40 AND len(keys) = 0) AS abstract_style_ok, has_hits AND NOT abs AND contract_enabled AS evidence_required, output_mode <> 'fact_answer' AND NOT abs AND contract_enabled AS next_steps_required FROM h),
o AS (SELECT *, round((has_conclusion::INT + (evidence_required AND has_evidence)::INT + (next_steps_required AND has_next_steps)::INT) / (1 + evidence_required::INT + next_steps_required::INT)::DOUBLE, 3) AS core_section_coverage, NOT locate_required OR has_locate_hint AS locate_ok, NOT evidence_required OR has_evidence AS evidence_ok FROM n),
q AS (SELECT *, CASE WHEN abs THEN abstract_style_ok WHEN NOT contract_enabled THEN char_count >= 40 AND locate_ok ELSE has_conclusion AND evidence_ok AND (NOT next_steps_required OR has_next_steps) AND locate_ok END AS minimum_ok FROM o)"""
PROBE_SQL = f"WITH {PROBE} SELECT * EXCLUDE (text, ps, keys, x, abs) FROM q"


def rubric_marks(spark, sf):
    """Marks of the answers, with the probe's verdict and gates and hit levels by turn."""
    t = A.probe(_settings(_answers(spark, sf)))
    k = F.col("conv_id") + 2 * F.col("turn")
    level = F.element_at(F.array(*[F.lit(x) for x in ("exact", "block", "heading", "none", "")]), F.pmod(k, F.lit(5)).cast("int") + 1)
    t = t.select("conv_id", "turn", "text", "minimum_ok", level.alias("hit_level"), (F.pmod(k, F.lit(7)) == 0).alias("answer_failed"), ~F.col("evidence_ok").alias("e"), ~F.col("locate_ok").alias("l"))
    return A.rubric(t.toDF("conv_id", "turn", "text", "minimum_ok", "hit_level", "answer_failed", "citation_failed", "locate_failed")).drop("text", "minimum_ok", "hit_level", "answer_failed", "citation_failed", "locate_failed")


_DOUBT = " OR ".join("contains(lower(x), '" + d.replace("'", "''") + "')" for d in A.DISCLAIMERS)
RUBRIC_SQL = f"""WITH {PROBE}, l AS (SELECT *, ['exact', 'block', 'heading', 'none', ''][(conv_id + 2 * turn) % 5 + 1] AS hit, (conv_id + 2 * turn) % 7 = 0 AS af, NOT evidence_ok AS cf, NOT locate_ok AS lf, regexp_matches(x, '{A.RAW_MARKS}') AS raw, {_DOUBT} AS doubt FROM q),
m AS (SELECT *, CASE hit WHEN 'exact' THEN 5 WHEN 'block' THEN 4 WHEN 'heading' THEN 2.5 WHEN 'none' THEN 0.8 ELSE 1.2 END AS loc FROM l),
v AS (SELECT conv_id, turn, CASE WHEN char_count >= 80 AND minimum_ok AND NOT af THEN 5.0 WHEN char_count >= 80 THEN 3.2 ELSE 1.0 END::DOUBLE AS question_hit,
 greatest(CASE WHEN cf THEN 1.6 WHEN raw THEN 3.0 ELSE 5.0 END - CASE WHEN raw THEN 0.8 ELSE 0 END, 0)::DOUBLE AS evidence_consistency, CASE WHEN lf THEN least(loc, 2.0) ELSE loc END::DOUBLE AS locate_first_click,
 CASE WHEN hit IN ('heading', 'none') THEN CASE WHEN doubt THEN 4.5 ELSE 2.0 END ELSE CASE WHEN doubt THEN 3.4 ELSE 4.0 END END::DOUBLE AS uncertainty_handling,
 round(CASE WHEN x = '' THEN 0 ELSE least(greatest(2.2 + CASE WHEN char_count >= 220 THEN 1.2 ELSE 0 END + CASE WHEN char_count >= 600 THEN 0.6 ELSE 0 END + CASE WHEN contains(x, chr(10)) THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(x, '(?m)^\\s*(?:-|\\*|\\d+\\.)\\s+') THEN 0.5 ELSE 0 END - CASE WHEN raw THEN 0.8 ELSE 0 END, 0), 5) END::DOUBLE, 2) AS readability FROM m)
SELECT *, round((question_hit + evidence_consistency + locate_first_click + uncertainty_handling + readability) / 25 * 100, 1) AS overall FROM v"""


def retrieval_confidence(spark, sf):
    """The turns of a conversation as hits for its first prompt; every sixth was found by its target, every seventh as a fallback."""
    p = prompts(spark, sf)
    asked = p.where("turn = 0").select("conv_id", F.col("text").alias("prompt"), P.prompt_family("text").alias("family"))
    body = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.substring(F.coalesce("text", F.lit("")), 1, 400)).alias("body"))
    hits = p.join(body, ["conv_id", "turn"]).join(asked, "conv_id")
    hits = hits.select(
        F.col("conv_id").alias("query_id"), "prompt", "family", F.when(F.pmod(F.col("turn"), F.lit(3)) == 1, "References").otherwise(F.substring("text", 1, 24)).alias("heading"),
        F.when(F.col("turn") > 0, F.concat_ws(" ", "text", "body")).otherwise("").alias("text"), (F.pmod(F.length("body"), F.lit(23)) / 2.0).alias("score"),
        (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) == 5).alias("targeted"), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) == 6).alias("fallback"),
    )
    return A.retrieval_confidence(hits)


_CUES = lambda x: f"list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower({x}), '\\[\\[cite:[^\\]]+\\]\\]', ' ', 'g'), '{A.CITE_MARK}', ' ', 'g'), '[a-z0-9]{{3,}}'), lambda t: length(t) >= 4 OR regexp_matches(t, '\\d')))"
_TARGETS = lambda x: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({x}), '{p}') THEN '{n}' END" for n, p in N.SECTIONS) + "], lambda s: s IS NOT NULL)"
_BOXES = lambda x: f"regexp_extract_all(lower({x}), '\\bbox\\s*(\\d{{1,3}})\\b', 1)"
_FIGURE = lambda x: f"nullif(regexp_extract({x}, '(?i)fig(?:ure)?s?\\.?\\s*(\\d{{1,3}})', 1), '')::INT"
_ON = lambda x: f"(len(list_intersect({_BOXES('prompt')}, {_BOXES(x)})) > 0 OR len(list_intersect({_TARGETS('prompt')}, {_TARGETS(x)})) > 0 OR coalesce({_FIGURE('prompt')} > 0 AND {_FIGURE('prompt')} = {_FIGURE(x)}, false))"
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in P.FAMILIES) + " ELSE '' END"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
CONFIDENCE_SQL = f"""WITH {PROMPTS}, a AS (SELECT conv_id, text AS prompt, {_FAMILY} AS family FROM pr WHERE turn = 0),
b AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN substr(coalesce(text, ''), 1, 400) END AS body FROM conversations),
h AS (SELECT conv_id AS query_id, prompt, family, CASE WHEN turn % 3 = 1 THEN 'References' ELSE substr(pr.text, 1, 24) END AS heading, CASE WHEN turn > 0 THEN pr.text || ' ' || body ELSE '' END AS text, (length(body) % 23) / 2.0 AS score,
  (conv_id + turn) % 6 = 5 AS targeted, (conv_id + turn) % 7 = 6 AS fallback FROM pr JOIN b USING (conv_id, turn) JOIN a USING (conv_id)),
r AS (SELECT *, text <> '' AS there, targeted OR fallback AS sure, len({_TARGETS("prompt")}) > 0 OR len({_BOXES("prompt")}) > 0 OR coalesce({_FIGURE("prompt")} > 0, false) OR (family = 'method' AND regexp_matches(prompt, '{A.EXACT_METHOD}')) AS explicit, regexp_matches(prompt, '{A.REFERENCE_LIST}') AS listing,
  regexp_matches(heading, '{A.REFERENCE_HEADING}') OR regexp_matches(substr(text, 1, 160), '(?i)#*\\s*(references|bibliography)\\s*(\n|$)') OR len(regexp_extract_all(text, '\\[\\d{{1,3}}\\]')) >= 2 AS ref FROM h),
c AS (SELECT *, there AND NOT sure AND (NOT ref OR family = 'citation_lookup' OR listing) AS counted FROM r),
o AS (SELECT *, CASE WHEN counted THEN len(list_intersect({_CUES("heading || chr(10) || substr(text, 1, 1200)")}, {_CUES("prompt")})) ELSE 0 END AS overlap FROM c),
g AS (SELECT query_id, family, explicit, listing, count(*) FILTER (WHERE there) AS hit_count, count(*) FILTER (WHERE there AND targeted) AS targeted_hits, count(*) FILTER (WHERE there AND fallback) AS fallback_hits, count(*) FILTER (WHERE there AND NOT sure AND ref) AS reference_hits,
  bool_or(there AND (sure OR counted)) AS other_signal, bool_or(there AND (sure OR (counted AND (overlap >= 2 OR (overlap >= 1 AND length(text) >= 120))))) AS strong_signal, bool_or(there AND ({_ON("heading")} OR {_ON("text")})) AS on_target, max(overlap)::INT AS max_overlap, greatest(coalesce(max(CASE WHEN there THEN score END), 0), 0)::DOUBLE AS max_score
  FROM o GROUP BY ALL),
e AS (SELECT *, CASE WHEN hit_count = 0 THEN 'empty_hits' WHEN explicit AND NOT on_target THEN 'target_miss' WHEN family <> 'citation_lookup' AND NOT listing AND NOT other_signal THEN 'reference_only_hits' WHEN NOT strong_signal THEN 'weak_signal'
  WHEN family IN {_IN(A.TARGETED)} AND targeted_hits + fallback_hits = 0 THEN 'strict_family_without_targeted_support' ELSE '' END AS rescue FROM g)
SELECT *, CASE WHEN rescue <> '' THEN rescue WHEN targeted_hits + fallback_hits > 0 THEN '' WHEN family IN {_IN(A.STRICT)} AND max_overlap <= 1 AND max_score < 11 THEN 'strict_family_weak_overlap'
 WHEN family IN {_IN(A.STRICT)} AND hit_count < 3 AND max_overlap < 2 THEN 'strict_family_sparse_hits' WHEN family IN {_IN(A.BROAD)} AND max_overlap <= 1 AND max_score < 9.5 AND hit_count < 8 THEN 'broad_family_weak_overlap' ELSE '' END AS low FROM e"""


def keep_previous(spark, sf):
    """Customers whose first half of orders is better than their second, by three measures."""
    o = table(spark, sf, "orders")
    half = lambda k: o.where(F.pmod("o_orderkey", F.lit(2)) == k).groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("unresolved"), F.count("*").alias("doi"), F.round(F.max("o_totalprice"), 2).alias("title"))
    return A.keep_previous(half(0), half(1), "o_custkey", ["unresolved", "doi", "title"])


KEEP_SQL = """WITH h AS (SELECT o_custkey, o_orderkey % 2 AS k, -count(*) FILTER (WHERE o_orderstatus = 'O') AS u, count(*) AS d, round(max(o_totalprice), 2) AS t FROM orders GROUP BY ALL)
SELECT p.o_custkey, (p.u, p.d, p.t) > (c.u, c.d, c.t) AS keep FROM h p JOIN h c ON p.o_custkey = c.o_custkey AND p.k = 0 AND c.k = 1"""


def display_order(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("pos"), F.pmod("c_nationkey", F.lit(3)).alias("focus"), F.pmod("c_custkey", F.lit(2)).alias("boost"), F.round("c_acctbal", 0).alias("score"), F.pmod("c_nationkey", F.lit(5)).alias("anchor"), F.col("c_name").alias("name"))
    return A.display_order(c, "segment").select("segment", "pos", "place")


DISPLAY_SQL = "SELECT c_mktsegment AS segment, c_custkey AS pos, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey % 3 DESC, c_custkey % 2 DESC, round(c_acctbal, 0) DESC, c_nationkey % 5 DESC, c_name DESC, c_custkey))::INT AS place FROM customer"


def category_affinity(spark, sf):
    v = _views(spark, sf)
    user = v["tags"].where("origin = 'user'")
    return A.affinity(user.select("doc_id", "tag"), L.cooccurrence(v["meta"], v["tags"]))


AFFINITY_SQL = f"WITH {VIEWS}, c AS (SELECT category, tag, count(*) AS n FROM meta JOIN tags USING (doc_id) WHERE origin = 'user' GROUP BY ALL) SELECT doc_id, category, round(sum(least(2.4, 0.75 * n))::DOUBLE, 6) AS score FROM tags JOIN c USING (tag) WHERE origin = 'user' GROUP BY ALL"


def run_table(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.concat(F.lit("c"), F.pmod("user_id", F.lit(10))).alias("case"), (F.col("value") > 30).alias("ok"), F.col("value").alias("elapsed"))
    return A.run_table(e, "event_type", "case")


RUN_SQL = "SELECT event_type, 'c' || (user_id % 10) AS \"case\", count(*) AS runs, count(*) FILTER (WHERE value > 30) AS ok, count(*) FILTER (WHERE NOT value > 30) AS failed, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY ALL"

QUERIES = {f.__name__: f for f in (answer_sections, answer_probe, rubric_marks, retrieval_confidence, keep_previous, display_order, category_affinity, run_table)}
ORACLE_SQL = {"answer_sections": SECTION_SQL, "answer_probe": PROBE_SQL, "rubric_marks": RUBRIC_SQL, "retrieval_confidence": CONFIDENCE_SQL, "keep_previous": KEEP_SQL, "display_order": DISPLAY_SQL, "category_affinity": AFFINITY_SQL, "run_table": RUN_SQL}
