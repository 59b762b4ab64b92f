"""Classifiers of prompts and claims as ordered CASE ladders, and filters of noisy text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import _c


def _ladder(x: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern that matches."""
    out = None
    for name, pattern in rules:
        out = F.when(x.rlike(pattern), name) if out is None else out.when(x.rlike(pattern), name)
    return out.otherwise(default)


#: Prompt families, intents and modes in the order in which they are tried.
FAMILIES = [
    ("box_only", "(?i)\\bbox\\s*\\d"),
    ("strength_limits", "(?i)(strength|advantage).*(limit|weakness)|(limit|weakness).*(strength|advantage)"),
    ("discussion_only", "(?i)\\bdiscussion\\b.*\\b(only|section)\\b"),
    ("figure_walkthrough", "(?i)\\b(fig(ure)?\\.?\\s*\\d|panel)"),
    ("citation_lookup", "(?i)\\b(cite[sd]?|citations?|references?|bibliography)\\b"),
    ("abstract", "(?i)\\babstract\\b"),
    ("equation", "(?i)\\b(equation|eq\\.|formula)"),
    ("reproduce", "(?i)\\b(reproduce|replicate|implementation)"),
    ("compare", "(?i)\\b(compare|versus|vs\\.?|difference)"),
    ("method", "(?i)\\b(method|approach|algorithm|pipeline)"),
    ("overview", "(?i)\\b(overview|summary|summari[sz]e|main)"),
]
INTENTS = [
    ("compare", "(?i)\\b(compare|versus|vs\\.?|difference|better)\\b"),
    ("idea", "(?i)\\b(idea|novel|inspire|brainstorm)"),
    ("experiment", "(?i)\\b(experiment|dataset|baseline|ablation|metric)"),
    ("troubleshoot", "(?i)\\b(error|fail|bug|issue|problem)"),
    ("writing", "(?i)\\b(write|draft|rewrite|polish|paragraph)"),
]
MODES = [("critical_review", "(?i)\\b(review|critique|weakness|limitation)"), ("reading_guide", "(?i)\\b(guide|explain|walk|overview|read)")]
CLAIMS = [("quote", "\"[^\"]{12,}\""), ("equation", "(?i)\\b(eq(uation)?\\.?\\s*\\(?\\d|formula)"), ("figure", "(?i)\\bfig(ure)?\\.?\\s*\\d"), ("number", "\\d+(\\.\\d+)?\\s*(%|dB|ms|x\\b)"), ("prior_work", "\\[\\d|(?i)et al\\.")]


def prompt_family(x: Column | str) -> Column:
    return _ladder(_c(x), FAMILIES, "")


def answer_intent(x: Column | str) -> Column:
    return _ladder(_c(x), INTENTS, "reading")


def output_mode(x: Column | str) -> Column:
    return _ladder(_c(x), MODES, "fact_answer")


def answer_depth(x: Column | str) -> Column:
    """L1 to L3 from the number of words and technical marks."""
    words = F.size(F.regexp_extract_all(_c(x), F.lit("\\S+"), F.lit(0)))
    marks = F.regexp_count(_c(x), F.lit("(?i)\\b(derive|proof|theor|ablation|convergence|complexity)"))
    return F.when((words > 60) | (marks >= 2), "L3").when((words > 20) | (marks == 1), "L2").otherwise("L1")


def claim_type(x: Column | str) -> Column:
    return _ladder(_c(x), CLAIMS, "statement")


def is_noise(x: Column | str) -> Column:
    """Boilerplate, author lists and affiliations."""
    x = _c(x)
    boiler = x.rlike("(?i)(all rights reserved|copyright|creative commons|downloaded from|received \\d|accepted \\d)")
    authors = (F.regexp_count(x, F.lit(",")) >= 6) & (F.length(x) > 120) & (F.regexp_count(x, F.lit("[.!?]")) <= 2)
    place = (F.length(x) > 80) & x.rlike("(?i)\\b(university|department|institute|laboratory)\\b")
    return boiler | authors | place


def is_reference_list(x: Column | str) -> Column:
    x = _c(x)
    return F.substring(x, 1, 160).rlike("(?i)#*\\s*(references|bibliography)\\s*(\n|$)") | (F.regexp_count(x, F.lit("\\[\\d{1,3}\\]")) >= 2)


def is_promising_reference(x: Column | str) -> Column:
    x = _c(x)
    return F.length(x).between(24, 420) & x.rlike("(19|20)\\d{2}") & (F.regexp_count(x, F.lit("[A-Za-z]{3,}")) >= 4)


def is_artifact(path: Column | str) -> Column:
    """Temporary or generated files, by the parts and the name of their path."""
    parts = F.split(F.lower(_c(path)), "/")
    temp = F.exists(parts, lambda p: p.isin("temp", "__pycache__") | p.rlike("^(__upload__|_tmp_|tmp_)"))
    name = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), "\\.[^.]*$", ""), "\\.en$", "")
    return temp | name.isin("quality_report", "assets_manifest", "output") | (F.coalesce(_c(path), F.lit("")) == "")


def bad_heading(x: Column | str) -> Column:
    x = _c(x)
    return (F.length(x) > 90) | x.rlike("(?i)(doi|issn|copyright|@|www\\.)") | (F.regexp_count(x, F.lit("\\d")) >= 10)
