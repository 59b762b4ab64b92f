"""Small relational operators on arrays, sets, JSON and headings that the larger ones share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _c, heading_parts

#: The weights by which a prompt's intent favours or disfavours a kind of heading.
HEADING_INTENTS = ("method", "result", "background", "limitation", "references", "none")
HEADING_KINDS = ("method", "result", "background", "discussion", "references", "other")
HEADING_WEIGHTS = {
    ("references", "references"): 3.2, ("references", "discussion"): -0.6,
    ("limitation", "discussion"): 2.8, ("limitation", "method"): 0.6, ("limitation", "result"): 0.8,
    ("method", "method"): 3.2, ("method", "background"): 1.1, ("method", "result"): 0.6, ("method", "discussion"): -4.0,
    ("result", "result"): 2.8, ("result", "method"): 1.0, ("result", "background"): 0.2, ("result", "discussion"): -1.5,
    ("background", "background"): 2.6, ("background", "method"): 0.9, ("background", "result"): 0.2, ("background", "discussion"): -2.4,
    ("none", "discussion"): -1.2,
}
REFERENCES_ELSEWHERE = -3.4

_HEADINGS = [("references", "(?i)\\b(references|bibliography)\\b"), ("method", "(?i)\\b(method|approach|model|algorithm|implementation)"), ("result", "(?i)\\b(result|experiment|evaluation|ablation)"), ("background", "(?i)\\b(introduction|background|related work|abstract)"), ("discussion", "(?i)\\b(discussion|conclusion|limitation|future work)")]
_INTENTS = [("references", "(?i)\\b(references?|cite|citation)\\b"), ("limitation", "(?i)\\b(limit|weakness|drawback)"), ("method", "(?i)\\b(method|how does|algorithm|implement)"), ("result", "(?i)\\b(result|performance|accuracy|how well)"), ("background", "(?i)\\b(background|motivation|why|introduction)")]


def _ladder(x: Column, rules: list[tuple[str, str]], default: str) -> Column:
    return F.coalesce(*[F.when(x.rlike(p), n) for n, p in rules], F.lit(default))


def heading_kind(x: Column | str) -> Column:
    return _ladder(_c(x), _HEADINGS, "other")


def heading_intent(x: Column | str) -> Column:
    return _ladder(_c(x), _INTENTS, "none")


def heading_bonus(intent: Column, kind: Column) -> Column:
    """The weight of a heading of a kind for an intent."""
    table = F.create_map(*[F.lit(x) for (a, b), w in HEADING_WEIGHTS.items() for x in (f"{a}|{b}", w)])
    base = F.coalesce(table[F.concat(intent, F.lit("|"), kind)], F.lit(0.0))
    return base + F.when((kind == "references") & (intent != "references"), REFERENCES_ELSEWHERE).otherwise(0.0)


def best_heading(headings: DataFrame, key: str) -> DataFrame:
    """headings: key, pos, heading, score.  The best heading of each key, the first of equals."""
    own = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    return headings.withColumn("_p", F.row_number().over(own)).where("_p = 1").select(key, "heading", "score")


def clean_path(x: Column | str, keep: int = 3) -> Column:
    """A heading path without repeated and numbering-only levels, of the last `keep` levels."""
    parts = F.filter(heading_parts(x), lambda p: ~p.rlike("^[0-9. ]*$"))
    distinct = F.array_distinct(parts)
    return F.array_join(F.slice(distinct, F.greatest(F.size(distinct) - keep + 1, F.lit(1)), F.lit(keep)), " / ")


def clean_tags(x: Column, most: int = 16, length: int = 40) -> Column:
    """Trimmed tags, each once whatever its case, in order of first sight."""
    cut = F.filter(F.transform(x, lambda t: F.substring(F.trim(F.regexp_replace(t, "\\s+", " ")), 1, length)), lambda t: t != "")
    first = F.filter(cut, lambda t, i: F.array_position(F.transform(cut, F.lower), F.lower(t)) == i + 1)
    return F.slice(first, 1, most)


def edited_tags(user: Column, add: Column, remove: Column) -> Column:
    """(user - remove) + add, by normal form."""
    low = F.transform(remove, F.lower)
    return clean_tags(F.concat(F.filter(user, lambda t: ~F.array_contains(low, F.lower(t))), add))


def patched(stored: Column, change: Column) -> Column:
    """A map with the entries of another put over it; entries changed to null go."""
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(change), k))
    return F.map_filter(F.map_concat(kept, change), lambda k, v: v.isNotNull())


def words_of_index(x: Column) -> Column:
    """A map of words to places as the text."""
    flat = F.flatten(F.transform(F.map_entries(x), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(flat), lambda r: r["w"]), " ")


def majority_year(years: DataFrame, key: str) -> DataFrame:
    """years: key, year.  The most frequent year of each key, the latest of equals."""
    counted = years.where("year is not null").groupBy(key, "year").agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.max_by("year", F.struct("n", "year")).alias("year"))


def islands(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Runs of rows whose places are at most `gap` apart: key, first, last, n."""
    own = Window.partitionBy(key).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(own) > gap, F.lit(True)).cast("int")
    return rows.withColumn("_run", F.sum(new).over(own)).groupBy(key, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_run")


def widest_gap(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The largest distance between neighbouring places of each key and where it starts, the first of equals."""
    own = Window.partitionBy(key).orderBy(at)
    gaps = rows.withColumn("gap", F.lead(at).over(own) - F.col(at)).where("gap is not null")
    return gaps.groupBy(key).agg(F.max_by(F.struct(F.col(at).alias("start"), "gap"), F.struct("gap", -F.col(at))).alias("g")).select(key, "g.start", "g.gap")


def table_to_markdown(cells: Column) -> Column:
    """An array of rows of cells as a Markdown table; empty rows go and short rows are filled."""
    rows = F.filter(cells, lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    body = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, 100_000)), "\n")


def overlap_area(a: Column, b: Column) -> Column:
    """The common area of two boxes x0, y0, x1, y1."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")


def issn_join(papers: DataFrame, journals: DataFrame) -> DataFrame:
    """papers: paper_id, issn, venue.  journals: issn, name, impact.  The impact of each paper's journal: by ISSN, else by name."""
    by_issn = journals.where("issn is not null").groupBy("issn").agg(F.max("impact").alias("by_issn"))
    by_name = journals.groupBy(F.lower("name").alias("_name")).agg(F.max("impact").alias("by_name"))
    return papers.join(by_issn, "issn", "left").join(by_name, F.lower("venue") == F.col("_name"), "left").select("paper_id", F.coalesce("by_issn", "by_name").alias("impact"))
