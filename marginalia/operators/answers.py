"""Answers: sections they have, probes, marks, confidence in their hits, and decisions between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _c, figure_number
from .intents import box_numbers, section_targets
from .prompts import is_reference_list

#: Names of the sections of an answer, and the patterns and phrases of the flags.
SECTIONS = {"conclusion": ("Conclusion", "结论"), "evidence": ("Evidence", "依据", "证据"), "limits": ("Limits", "边界", "限制", "局限"), "next_steps": ("Next Steps", "下一步建议", "下一步")}
HEADER = "(?im)^\\s*(" + "|".join(n for names in SECTIONS.values() for n in names) + ")\\s*[:：]"
CITES = "(?i)\\[\\d+\\]|\\[\\[CITE:"
LOCATES = "(?i)/api/references/asset|(?:^|\\b)(?:fig(?:ure)?\\.?\\s*\\d+|图\\s*\\d+|panel\\s*[a-z])"
RAW_MARKS = "\\[\\[(?:SUPPORT|CITE):[^\\]]+\\]\\]"
DISCLAIMERS = ("not stated", "not specified", "i can't find", "i cannot find", "i couldn't find", "not found in", "insufficient context", "cannot confirm", "unclear from the paper", "not mentioned")
EXACT_METHOD = "(?i)\\b(?:where|point me to|exact supporting part|exact supporting sentences?|exact sentence|exact method paragraph|which part of the paper|applied back|re-applied|shift vectors|implementation details?|training details?|network training|optimizer|learning rate|batch size|iterations?|epochs?|hyperparameters?|pytorch|adam)\\b"
REFERENCE_LIST = "(?i)\\b(?:reference\\s+list|works?\\s+cited|bibliography)\\b"
REFERENCE_HEADING = "(?i)\\b(?:references?|bibliography|works?\\s+cited|citation|appendi(?:x|ces)|supplementary|acknowledge?ments?)\\b"
CITE_MARK = "\\[\\d{1,4}(?:\\s*[-–—−,]\\s*\\d{1,4})*\\]"
#: Families of prompts by how strict a match they need.
STRICT, BROAD, TARGETED = ("citation_lookup", "method", "reproduce", "equation", "figure_walkthrough"), ("overview", "compare", "strength_limits", "abstract"), ("citation_lookup", "method", "figure_walkthrough", "reproduce")
_EDGE = "^\\s+|\\s+$"


def _parts(x: Column | str) -> Column:
    """Structs of key and body: what stands behind each section header up to the next."""
    parts = F.split(F.regexp_replace(F.coalesce(_c(x), F.lit("")), HEADER, "\x01$1\x02"), "\x01")
    table = F.create_map(*[F.lit(v) for key, names in SECTIONS.items() for n in names for v in (n.lower(), key)])
    return F.transform(F.slice(parts, 2, 1000), lambda p: F.struct(table[F.lower(F.split(p, "\x02")[0])].alias("key"), F.regexp_replace(F.split(p, "\x02")[1], _EDGE, "").alias("body")))


def section_keys(x: Column | str) -> Column:
    """The sections of an answer, each once, in order."""
    return F.array_distinct(F.transform(_parts(x), lambda p: p["key"]))


def section(x: Column | str, key: str) -> Column:
    """The body of a section, of the last one of that name that has any; null without one."""
    return F.try_element_at(F.filter(_parts(x), lambda p: (p["key"] == key) & (p["body"] != "")), F.lit(-1))["body"]


def ordered_items(x: Column | str) -> Column:
    """The items of a numbered list; a text without numbers is one item, an empty one has none."""
    parts = F.transform(F.split(F.coalesce(_c(x), F.lit("")), "(?m)^\\s*\\d+\\.\\s+"), lambda i: F.regexp_replace(i, _EDGE, ""))
    return F.filter(F.when(F.size(parts) > 1, F.slice(parts, 2, 1000)).otherwise(parts), lambda i: i != "")


def probe(answers: DataFrame, text: str = "text") -> DataFrame:
    """answers: text, has_hits, contract_enabled, output_mode, paper_guide_mode and prompt_family.  Adds what an answer has, what it needs, and
    whether it is good enough: a conclusion, and evidence, next steps and a place where they are asked for."""
    x = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _EDGE, "")
    out = answers.withColumn("_x", x).withColumn("_keys", section_keys("_x")).withColumn("char_count", F.length("_x"))
    out = out.withColumns({f"has_{k}": F.array_contains("_keys", k) for k in SECTIONS} | {"has_citations": F.col("_x").rlike(CITES), "has_locate_hint": F.col("_x").rlike(LOCATES)})
    abstract = F.col("paper_guide_mode") & (F.col("prompt_family") == "abstract")
    out = out.withColumns({
        "locate_required": F.col("paper_guide_mode") & (F.col("prompt_family") == "figure_walkthrough") & F.col("has_hits"),
        "abstract_style_ok": ~abstract | ((F.col("char_count") >= 40) & (F.size("_keys") == 0)),
        "evidence_required": F.col("has_hits") & ~abstract & F.col("contract_enabled"),
        "next_steps_required": (F.col("output_mode") != "fact_answer") & ~abstract & F.col("contract_enabled"),
    })
    number = lambda c: F.when(c, 1).otherwise(0)
    found = number(F.col("has_conclusion")) + number(F.col("evidence_required") & F.col("has_evidence")) + number(F.col("next_steps_required") & F.col("has_next_steps"))
    out = out.withColumn("core_section_coverage", F.round(found / (1 + number(F.col("evidence_required")) + number(F.col("next_steps_required"))), 3))
    out = out.withColumns({"locate_ok": ~F.col("locate_required") | F.col("has_locate_hint"), "evidence_ok": ~F.col("evidence_required") | F.col("has_evidence")})
    whole = F.col("has_conclusion") & F.col("evidence_ok") & (~F.col("next_steps_required") | F.col("has_next_steps")) & F.col("locate_ok")
    minimum = F.when(abstract, F.col("abstract_style_ok")).when(~F.col("contract_enabled"), (F.col("char_count") >= 40) & F.col("locate_ok")).otherwise(whole)
    return out.withColumn("minimum_ok", minimum).drop("_x", "_keys")


def readability(x: Column | str) -> Column:
    """0 to 5 from length, lines, lists, and marks that should have been replaced."""
    x = F.regexp_replace(F.coalesce(_c(x), F.lit("")), _EDGE, "")
    plus = lambda c, v: F.when(c, v).otherwise(0.0)
    score = 2.2 + plus(F.length(x) >= 220, 1.2) + plus(F.length(x) >= 600, 0.6) + plus(x.contains("\n"), 0.5) + plus(x.rlike("(?m)^\\s*(?:-|\\*|\\d+\\.)\\s+"), 0.5) - plus(x.rlike(RAW_MARKS), 0.8)
    return F.when(x == "", 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(5.0)))


def rubric(answers: DataFrame, text: str = "text") -> DataFrame:
    """answers: text, minimum_ok, hit_level, and whether the gates answer_failed, citation_failed and locate_failed.  Five marks of 0 to 5, and their share of 25 in percent."""
    x = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _EDGE, "")
    long, raw, doubt = F.length(x) >= 80, x.rlike(RAW_MARKS), F.exists(F.array(*[F.lit(d) for d in DISCLAIMERS]), lambda d: F.lower(x).contains(d))
    located = F.create_map(*[F.lit(v) for kv in {"exact": 5.0, "block": 4.0, "heading": 2.5, "none": 0.8}.items() for v in kv])[F.col("hit_level")]
    located = F.coalesce(located, F.lit(1.2))
    weak = F.col("hit_level").isin("heading", "none")
    out = answers.withColumns({
        "question_hit": F.when(long & F.col("minimum_ok") & ~F.col("answer_failed"), 5.0).when(long, 3.2).otherwise(1.0),
        "evidence_consistency": F.greatest(F.when(F.col("citation_failed"), 1.6).when(raw, 3.0).otherwise(5.0) - F.when(raw, 0.8).otherwise(0.0), F.lit(0.0)),
        "locate_first_click": F.when(F.col("locate_failed"), F.least(located, F.lit(2.0))).otherwise(located),
        "uncertainty_handling": F.when(weak, F.when(doubt, 4.5).otherwise(2.0)).otherwise(F.when(doubt, 3.4).otherwise(4.0)),
        "readability": readability(text),
    })
    marks = ("question_hit", "evidence_consistency", "locate_first_click", "uncertainty_handling", "readability")
    out = out.withColumns({m: F.round(m, 2) for m in marks})
    return out.withColumn("overall", F.round(sum((F.col(m) for m in marks[1:]), F.col(marks[0])) / 25 * 100, 1))


def cue_tokens(x: Column | str) -> Column:
    """Distinct words of four characters, or of three with a digit, outside of citation marks."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "\\[\\[cite:[^\\]]+\\]\\]", " "), CITE_MARK, " ")
    return F.array_distinct(F.filter(F.regexp_extract_all(plain, F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda t: (F.length(t) >= 4) | t.rlike("\\d")))


def matches_targets(prompt: Column, text: Column) -> Column:
    """Whether a text names a section, box or figure that the prompt asks for."""
    boxes = F.arrays_overlap(box_numbers(prompt), box_numbers(text))
    figure = (figure_number(prompt) > 0) & (figure_number(prompt) == figure_number(text))
    return boxes | F.arrays_overlap(section_targets(prompt), section_targets(text)) | F.coalesce(figure, F.lit(False))


def retrieval_confidence(hits: DataFrame) -> DataFrame:
    """hits: query_id, prompt, family, heading, text, score, targeted and fallback (how the hit was found); a row without text for a
    query without hits.  Per query: what its hits show, whether they are to be rescued or are weak, and why."""
    prompt, there = F.col("prompt"), F.coalesce("text", F.lit("")) != ""
    explicit = (F.size(section_targets(prompt)) > 0) | (F.size(box_numbers(prompt)) > 0) | F.coalesce(figure_number(prompt) > 0, F.lit(False)) | ((F.col("family") == "method") & prompt.rlike(EXACT_METHOD))
    listing = prompt.rlike(REFERENCE_LIST)
    sure = F.col("targeted") | F.col("fallback")
    reference = F.col("heading").rlike(REFERENCE_HEADING) | is_reference_list("text")
    counted = there & ~sure & (~reference | (F.col("family") == "citation_lookup") | listing)
    overlap = F.size(F.array_intersect(cue_tokens(F.concat_ws("\n", "heading", F.substring("text", 1, 1200))), cue_tokens(prompt)))
    overlap = F.when(counted, overlap).otherwise(0)
    rows = hits.select(
        "query_id", "family", "score", "targeted", "fallback", there.alias("there"), explicit.alias("explicit"), listing.alias("listing"), overlap.alias("overlap"),
        (there & ~sure & reference).alias("reference"), (there & (sure | counted)).alias("signal"),
        (there & (sure | (counted & ((overlap >= 2) | ((overlap >= 1) & (F.length("text") >= 120)))))).alias("strong"),
        (there & (matches_targets(prompt, F.col("heading")) | matches_targets(prompt, F.col("text")))).alias("on_target"),
    )
    out = rows.groupBy("query_id", "family", "explicit", "listing").agg(
        F.count_if("there").alias("hit_count"), F.count_if(F.col("there") & F.col("targeted")).alias("targeted_hits"), F.count_if(F.col("there") & F.col("fallback")).alias("fallback_hits"),
        F.count_if("reference").alias("reference_hits"), F.bool_or("signal").alias("other_signal"), F.bool_or("strong").alias("strong_signal"), F.bool_or("on_target").alias("on_target"),
        F.max("overlap").alias("max_overlap"), F.greatest(F.max(F.when(F.col("there"), F.col("score"))), F.lit(0.0)).alias("max_score"),
    )
    found = F.col("targeted_hits") + F.col("fallback_hits")
    rescue = (
        F.when(F.col("hit_count") == 0, "empty_hits")
        .when(F.col("explicit") & ~F.col("on_target"), "target_miss")
        .when((F.col("family") != "citation_lookup") & ~F.col("listing") & ~F.col("other_signal"), "reference_only_hits")
        .when(~F.col("strong_signal"), "weak_signal")
        .when(F.col("family").isin(*TARGETED) & (found == 0), "strict_family_without_targeted_support")
    )
    weak, strict = found == 0, F.col("family").isin(*STRICT)
    low = (
        F.when(weak & strict & (F.col("max_overlap") <= 1) & (F.col("max_score") < 11), "strict_family_weak_overlap")
        .when(weak & strict & (F.col("hit_count") < 3) & (F.col("max_overlap") < 2), "strict_family_sparse_hits")
        .when(weak & F.col("family").isin(*BROAD) & (F.col("max_overlap") <= 1) & (F.col("max_score") < 9.5) & (F.col("hit_count") < 8), "broad_family_weak_overlap")
    )
    return out.withColumn("rescue", F.coalesce(rescue, F.lit(""))).withColumn("low", F.coalesce(rescue, low, F.lit("")))


def keep_previous(previous: DataFrame, current: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Per key whether the previous run is better, by its measures in order (unresolved first, the fewer the better)."""
    order = lambda p: F.struct(*[(-F.col(f"{p}.{m}") if m == "unresolved" else F.col(f"{p}.{m}")).alias(m) for m in measures])
    joined = previous.alias("p").join(current.alias("c"), F.col(f"p.{key}") == F.col(f"c.{key}"))
    return joined.select(F.col(f"p.{key}").alias(key), (order("p") > order("c")).alias("keep"))


def display_order(cards: DataFrame, by: str) -> DataFrame:
    """cards: focus, boost, score, anchor, name, pos.  Their place on display within a group."""
    own = Window.partitionBy(by).orderBy(*[F.desc(c) for c in ("focus", "boost", "score", "anchor", "name")], "pos")
    return cards.withColumn("place", F.row_number().over(own))


def affinity(tags: DataFrame, pairs: DataFrame, most: float = 2.4, weight: float = 0.75) -> DataFrame:
    """tags: doc_id, tag.  pairs: category, tag, n.  Votes of a document's tags for categories they stand with."""
    votes = tags.join(pairs, "tag").select("doc_id", "category", F.least(F.lit(most), weight * F.col("n")).alias("vote"))
    return votes.groupBy("doc_id", "category").agg(F.round(F.sum("vote"), 6).alias("score"))


def run_table(runs: DataFrame, *by: str) -> DataFrame:
    """runs: ok, elapsed.  Counts and times of runs by profile."""
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.avg("elapsed"), 4).alias("mean"), F.min("elapsed").alias("low"), F.max("elapsed").alias("high"))
