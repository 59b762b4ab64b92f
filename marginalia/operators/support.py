"""Support of answers: slots of evidence from cards, their assignment to the lines of an answer, and what the markers stand for.

A slot is a piece of evidence with a marker; an answer has a few.  Lines take slots one to one, from the top: each line takes the slot of the highest score that no line above has, if
that reaches the line's floor.  A marker is resolved to its slot, or to the slot of its document that fits the line best, and to the number of a reference where
the slot may be cited.  Null texts are empty; ties go to the earlier slot; an answer without slots stays as it is.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .answers import CITE_MARK
from .selection import COMPARE_DETAIL, METHOD_DETAIL, STRONG_TOKENS, _if, panel_letters

#: Words that are no cue, and words of three letters that are.
NO_CUE = (
    "this", "that", "these", "those", "with", "from", "using", "used", "into", "than", "then", "their", "there", "which", "where", "while", "when", "under", "through", "between", "based", "shows", "showing",
    "paper", "figure", "panel", "result", "results", "evidence", "conclusion",
)
SHORT_CUES = ("apr", "cnr", "nec", "psf", "ism", "rvt")
#: Lines that say something about the evidence instead of using it, headers, and lines that no marker goes to.
META_LINE = (
    "(?i)^(?:based on the retrieved (?:context|evidence|snippets)\\b|the retrieved context\\b|the retrieved evidence\\b|the provided (?:context|evidence|snippets)\\b|the discussion section is not present\\b"
    "|the paper does not (?:state|specify)\\b|the retrieved context does not (?:state|include|specify)\\b|all provided excerpts\\b|there is no discussion of\\b|therefore, per the instruction\\b"
    "|source\\s*:|caption anchor\\s*:|figure anchor\\s*:|reference locate\\s*:|参考定位\\s*:|specifically\\s*:|thus, based on the provided evidence\\s*:|no supporting (?:equation|figure|section)\\b|if the discussion section were available\\b)"
)
HEADER_LINE = "(?i)^(Conclusion|Evidence|Limits|Next Steps|Abstract text|Chinese translation)\\s*:?\\s*$"
SKIPPED_LINE = "(?i)(retrieved library snippets support this conclusion|check the cited section/figure|compare this result against one baseline paper)"
SIDE_LINE = "(?i)^\\s*(?:[-*+]\\s+)?(?:blue|green|red|cyan|magenta|yellow|left|right|top|bottom)\\s*:"
SUMMARY_LINE = (
    "(?i)\\b(?:in summary|overall|panel-by-panel walkthrough|walk me through|walkthrough|all claims are directly supported|grounded strictly in the retrieved context|supported by the figure caption|supported by the provided caption)\\b"
)
FIGURE_WORD = "(?i)\\b(?:figure|fig(?:ure)?\\.?|panel|caption)\\b"
TOOL = "(?i)\\b(?:library|tool|software|package|as detailed in|according to)\\b"
#: Words of a line that go with a family of prompts or a claim.
OVERVIEW_METHOD = "(?i)\\b(?:apr|implementation|algorithm|phase correlation|registration)\\b"
CITED = "(?i)\\b(?:reference|references|citation|cited|introduced|attributed|hadamard|fourier|wavelet|richardson|lucy)\\b"
METHOD_LINE = "(?i)\\b(?:implementation detail|phase correlation|registration|apr)\\b"
COMPARE_LINE = "(?i)\\b(?:open|closed|pinhole|cnr|nec|fwhm|resolution|noise)\\b"
FIGURE_LINE = "(?i)\\b(?:figure|fig|panel)\\b"
CONTEXT_METHOD = "(?i)\\b(?:apr|rvt|phase correlation|registration|shift|workflow|pipeline)\\b"
CONTEXT_COMPARE = "(?i)\\b(?:cnr|nec|fwhm|resolution|pinhole|trade[- ]?off)\\b"
MARKER = "\\[\\[\\s*(?i:SUPPORT)\\s*:\\s*((?i:DOC)-(\\d{1,3})(?:-(?i:S)(\\d{1,3}))?)\\s*\\]\\]"
#: An author of a citation in words, most telling form first; names that are none.
AUTHORS = ("(?i)\\b([A-Z][A-Za-z'`-]{1,40})\\s+et\\s+al\\.?\\b", "\\b([A-Z][A-Za-z'`-]{1,40})\\s*\\(\\s*(?:19|20)\\d{2}\\s*\\)", "\\b([A-Z][A-Za-z'`-]{1,40})\\s*,?\\s+(?:19|20)\\d{2}\\b")
NO_AUTHOR = ("the", "this", "that", "these", "those", "figure", "table", "section", "equation", "model", "method")
#: Cues of a text, references and spans of a slot.
CUES, REFS, SPANS = 12, 6, 4
_NO_INTS = "cast(array() as array<int>)"


def _text(x: Column | str) -> Column:
    return F.coalesce(text._c(x), F.lit(""))


def cues(x: Column | str, most: int = CUES) -> Column:
    """The first distinct cue words of a text."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(_text(x)), "\\[\\[cite:[^\\]]+\\]\\]", " "), CITE_MARK, " ")
    found = F.filter(F.regexp_extract_all(plain, F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda t: ((F.length(t) >= 4) | t.isin(*SHORT_CUES) | t.rlike("\\d")) & ~t.isin(*NO_CUE))
    return F.slice(F.array_distinct(found), 1, most)


def fragments(x: Column | str) -> Column:
    """A text's pieces up to a period, colon or semicolon, or the end of a line."""
    parts = F.split(_text(x), "(?<=[.;:])\\s+|\\n+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "[ \\t]+", " "))), lambda p: p != "")


def shortened(x: Column, most: int) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most - 3)), F.lit("...")))


def ref_spans(x: Column | str) -> Column:
    """Pieces with citations as structs of text, nums and cues, each once, the first SPANS of them."""
    spans = F.transform(fragments(x), lambda p: F.struct(shortened(p, 240).alias("text"), text.inline_citations(shortened(p, 240)).alias("nums")))
    first = F.slice(F.array_distinct(F.filter(spans, lambda s: F.size(s["nums"]) > 0)), 1, SPANS)
    return F.transform(first, lambda s: F.struct(s["text"].alias("text"), s["nums"].alias("nums"), cues(s["text"]).alias("cues")))


def locate_anchor(x: Column | str) -> Column:
    """The first piece of at least 24 characters, else the text."""
    pieces = F.transform(fragments(x), lambda p: shortened(p, 220))
    return F.coalesce(F.get(F.filter(pieces, lambda p: F.length(p) >= 24), F.lit(0)), shortened(F.trim(_text(x)), 220))


def claim_type(family: Column, heading: Column, snippet: Column, has_refs: Column) -> Column:
    both = F.lower(F.concat(heading, F.lit("\n"), snippet))
    low_heading, low = F.lower(heading), F.lower(snippet)
    borrowed = has_refs & F.when(family == "method", low.rlike(TOOL)).otherwise(both.rlike(TOOL))
    panels = F.size(panel_letters(F.concat(heading, F.lit("\n"), snippet))) > 0
    figure = F.when(panels, "figure_panel").when(both.rlike(METHOD_DETAIL), F.when(borrowed, "borrowed_tool").otherwise("method_detail")).when(both.rlike(COMPARE_DETAIL), "compare_result").otherwise("figure_panel")
    prior = has_refs & (low_heading.contains("reference") | low_heading.contains("background") | low.contains("prior") | (family == "strength_limits"))
    return (
        F.when(family == "abstract", "abstract_quote").when(family == "figure_walkthrough", figure).when(family == "method", F.when(borrowed, "borrowed_tool").otherwise("method_detail"))
        .when(family == "citation_lookup", F.when(has_refs, "prior_work").otherwise("own_result")).when(family == "compare", "compare_result").when(prior, "prior_work").otherwise("own_result")
    )


def cite_policy(claim: Column, family: Column) -> Column:
    return (
        F.when(claim.isin("prior_work", "borrowed_tool", "method_detail"), "prefer_ref").when(claim.isin("abstract_quote", "figure_panel", "own_result") | family.isin("abstract", "figure_walkthrough"), "locate_only").otherwise("allow_none")
    )


def slots(cards: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """cards: by, place (their order), doc_idx, sid, source, heading, cue, snippet, candidate_refs and family; further columns stay.  The first k cards with a source and a snippet, each place of a
    document once, as slots: with spans and numbers of references, claim_type, cite_policy, locate, figure_number, panels, figure_like, cues, support_id, support_example and cite_example."""
    out = cards.withColumns({c: F.trim(_text(c)) for c in ("sid", "source", "heading", "cue")} | {"snippet": shortened(F.trim(F.regexp_replace(_text("snippet"), "[ \\t]+", " ")), 420), "family": F.lower(F.trim(_text("family")))})
    out = out.where("snippet <> '' and source <> ''").withColumn("ref_spans", ref_spans(F.concat_ws("\n", "snippet", "cue")))
    own = F.flatten(F.transform("ref_spans", lambda s: s["nums"]))
    out = out.withColumn("refs", F.slice(F.filter(F.array_distinct(F.concat(own, F.coalesce("candidate_refs", F.expr(_NO_INTS)))), lambda n: n > 0), 1, REFS))
    out = out.withColumn("claim_type", claim_type(F.col("family"), F.col("heading"), F.col("snippet"), F.size("refs") > 0)).withColumn("cite_policy", cite_policy(F.col("claim_type"), F.col("family"))).withColumn("locate", locate_anchor("snippet"))
    out = out.withColumn("figure_number", F.coalesce(text.figure_number(F.concat("heading", F.lit("\n"), "snippet")), F.lit(0)))
    out = out.withColumn("_said", F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("cue", "heading", "snippet", "locate")]))
    said = F.col("_said")
    out = out.withColumn("panels", F.when(F.col("claim_type") == "figure_panel", panel_letters(said)).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("figure_like", (F.col("figure_number") > 0) | (F.size("panels") > 0) | said.rlike(FIGURE_WORD)).withColumn("cues", cues(said))
    same = Window.partitionBy(*by, "doc_idx", text.match_text("source"), text.match_text(F.substring("locate", 1, 240))).orderBy("place")
    order = Window.partitionBy(*by).orderBy("place")
    out = out.withColumn("_n", F.row_number().over(same)).where("_n = 1").withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= k).drop("_n", "_said")
    doc = Window.partitionBy(*by, "doc_idx")
    label = F.concat(F.lit("DOC-"), F.col("doc_idx").cast("string"))
    out = out.withColumn("support_id", F.when(F.count("*").over(doc) > 1, F.concat(label, F.lit("-S"), F.row_number().over(doc.orderBy("slot")).cast("string"))).otherwise(label))
    first_ref = F.get("refs", F.lit(0))
    return out.withColumn("support_example", F.concat(F.lit("[[SUPPORT:"), "support_id", F.lit("]]"))).withColumn("cite_example", F.when((F.col("sid") != "") & first_ref.isNotNull(), F.concat(F.lit("[[CITE:"), "sid", F.lit(":"), first_ref.cast("string"), F.lit("]]"))))


def _fits(family: Column, claim: Column, line: Column) -> Column:
    """Whether a claim goes with the family of the prompt."""
    overview = claim.isin("own_result", "prior_work") | (claim.isin("method_detail", "borrowed_tool") & line.rlike(OVERVIEW_METHOD))
    cited = claim.isin("prior_work", "borrowed_tool", "method_detail", "own_result") & line.rlike(CITED)
    return (
        F.when(family == "overview", overview).when(family == "method", claim != "figure_panel").when(family == "citation_lookup", cited)
        .when(family == "compare", claim.isin("compare_result", "own_result", "figure_panel", "method_detail")).when(family == "figure_walkthrough", claim.isin("figure_panel", "own_result", "compare_result")).otherwise(True)
    )


def open_line(line: Column, family: Column) -> Column:
    """Whether a line (trimmed) may get a marker."""
    summary = (family == "compare") & (line.rlike(SUMMARY_LINE) | line.rlike("(?i)^\\s*(?:thus|overall|in summary|the trade-off is)\\b")) | (family == "overview") & line.rlike(SUMMARY_LINE)
    figure = (family == "figure_walkthrough") & (line.rlike(SIDE_LINE) | line.rlike("(?i)^\\s*(?:in summary,\\s*)?figure\\s*\\d+\\s+(?:demonstrates|shows|establishes|illustrates|summarizes)\\b") | line.rlike("(?i)^\\s*in summary,\\s*figure\\s*\\d+\\b"))
    closed = line.contains("[[SUPPORT:") | line.contains("[[CITE:") | line.startswith("|") | line.rlike(META_LINE) | line.rlike(HEADER_LINE) | line.rlike(SKIPPED_LINE)
    return (line != "") & ~closed & ~summary & ~figure & (family != "abstract")


def scores(lines: DataFrame, slot: DataFrame, by: list[str]) -> DataFrame:
    """lines: by, pos and line.  slot: the slots, at most a few for each `by`.  by, pos, slot, score and floor of each line and slot that could go together."""
    own = slot.select(*by, "slot", "family", "claim_type", "cite_policy", "figure_like", "panels", "cues")
    out = lines.select(*by, "pos", F.trim(_text("line")).alias("line")).join(own, by).where(open_line(F.col("line"), F.col("family")))
    out = out.withColumn("letters", panel_letters("line")).withColumn("shared", F.array_intersect(cues("line"), "cues")).where(F.size("shared") > 0).where(_fits(F.col("family"), F.col("claim_type"), F.col("line")))
    family, claim, line = F.col("family"), F.col("claim_type"), F.col("line")
    strong, names_figure = F.size(F.filter("shared", lambda t: t.isin(*STRONG_TOKENS))) > 0, line.rlike(FIGURE_WORD)
    letters = F.col("letters")
    common = F.size(F.array_intersect(letters, "panels"))
    out = out.where(~((family == "overview") & F.col("figure_like") & ~names_figure))
    panel = F.when(claim == "figure_panel", 0.9 + F.when(F.size("panels") == 0, 0.0).when(common > 0, 1.35 + 0.2 * common).otherwise(-0.65)).otherwise(-0.75)
    parts = [
        F.size("shared").cast("double"), _if(strong, 0.45), _if(F.col("cite_policy") == "prefer_ref", 0.1), _if(F.col("figure_like") & ~names_figure, F.when(claim == "figure_panel", -2.2).otherwise(-1.2)),
        _if((family == "method") & (claim == "method_detail"), 0.35), _if((family == "method") & line.rlike(METHOD_LINE), 0.45), _if((family == "compare") & claim.isin("compare_result", "own_result"), 0.3), _if((family == "compare") & line.rlike(COMPARE_LINE), 0.45),
        _if((family == "figure_walkthrough") & (claim == "figure_panel"), 0.35), _if((family == "figure_walkthrough") & line.rlike(FIGURE_LINE), 0.45), _if((family == "figure_walkthrough") & (F.size(letters) > 0), panel),
        _if((family == "overview") & claim.isin("own_result", "prior_work"), 0.2),
    ]
    floor = F.when(family.isin("method", "compare", "figure_walkthrough"), 1.35).when(family == "overview", 2.2).otherwise(2.0)
    return out.select(*by, "pos", "slot", F.round(reduce(add, parts), 6).alias("score"), F.when(strong, F.least(floor, F.lit(1.0))).otherwise(floor).alias("floor"), "family").where("score > 0")


def assignments(scored: DataFrame, slot: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """by, pos, slot and score: from the top each line takes the best slot that is left, if it reaches the floor; at most so many lines of an answer (up to five where a figure is gone through)."""
    limit = F.when(F.col("family") == "figure_walkthrough", F.greatest(F.lit(most), F.least(F.lit(5), F.col("n_slots")))).otherwise(F.lit(most))
    each = scored.groupBy(*by, "pos").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "slot", "floor"))).alias("c"), F.first("family").alias("family"))
    each = each.join(slot.groupBy(*by).agg(F.count("*").cast("int").alias("n_slots")), by)
    folded = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("lines"), F.first(limit).alias("most"))  # of one answer, a few slots a line
    start = F.expr("cast(array() as array<struct<pos:int,slot:int,score:double>>)")

    def step(placed: Column, line: Column) -> Column:
        free = F.filter(line["c"], lambda c: ~F.exists(placed, lambda p: p["slot"] == c["slot"]))
        best = F.get(free, F.lit(0))
        takes = F.coalesce((F.size(placed) < F.col("most")) & (-best["less"] >= best["floor"]), F.lit(False))
        return F.when(takes, F.concat(placed, F.array(F.struct(line["pos"].alias("pos"), best["slot"].alias("slot"), (-best["less"]).alias("score"))))).otherwise(placed)

    return folded.select(*by, F.explode(F.aggregate("lines", start, step)).alias("p")).select(*by, "p.*")


def marked(lines: DataFrame, assigned: DataFrame, slot: DataFrame, by: list[str]) -> DataFrame:
    """lines with their markers behind them."""
    put = assigned.join(slot.select(*by, "slot", "support_example"), [*by, "slot"]).select(*by, "pos", "support_example")
    return lines.join(put, [*by, "pos"], "left").withColumn("line", F.when(F.col("support_example").isNotNull(), F.concat(F.rtrim("line"), F.lit(" "), "support_example")).otherwise(F.col("line"))).drop("support_example")


def surface(x: Column | str) -> Column:
    """A line without markers and markup, in lower case."""
    plain = F.regexp_replace(F.regexp_replace(_text(x), "\\[\\[\\s*(?i:CITE)\\s*:\\s*[A-Za-z0-9_-]{4,24}\\s*:\\s*\\d{1,4}\\s*\\]\\]", ""), MARKER, "")
    return F.trim(F.lower(text.strip_inline(plain)))


def _context_score(slot: Column) -> Column:
    """How well a slot fits a line (columns _low, _own and _letters) whose marker names no slot."""
    claim, letters, low, own = slot["claim_type"], F.col("_letters"), F.col("_low"), F.col("_own")
    shared = F.array_intersect(own, slot["cues"])
    panel = F.when(claim == "figure_panel", F.when(F.size(F.array_intersect(letters, slot["panels"])) > 0, 1.4).when(F.size(slot["panels"]) > 0, -0.5).otherwise(0.0)).otherwise(-0.65)
    by_claim = F.when(claim.isin("method_detail", "borrowed_tool") & low.rlike(CONTEXT_METHOD), 0.3).when((claim == "figure_panel") & low.rlike(FIGURE_LINE), 0.25).when((claim == "compare_result") & low.rlike(CONTEXT_COMPARE), 0.25).otherwise(0.0)
    figure = _if(~low.rlike(FIGURE_WORD) & slot["figure_like"], F.when(claim == "figure_panel", -2.0).otherwise(-1.15))
    score = F.size(shared).cast("double") + _if(F.size(F.filter(shared, lambda t: t.isin(*STRONG_TOKENS))) > 0, 0.45) + by_claim + F.when(F.size(letters) > 0, panel).otherwise(figure)
    return F.when(F.size(own) == 0, 0.0).otherwise(score)


def author_hint(x: Column) -> Column:
    """The last author of the most telling form of citation in words that a text has, in lower case; null without one."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(x, F.lit(p), F.lit(1)), F.lit(-1))
    found = F.lower(F.coalesce(*[last(p) for p in AUTHORS]))
    return F.when(~found.isin(*NO_AUTHOR), found)


def reference_number(slot: Column) -> Column:
    """num (null: none) and mode: which of a slot's references a line (columns line, _cues and _author) cites, and how that is known."""
    line, own, spans, refs = F.col("line"), F.col("_cues"), slot["ref_spans"], slot["refs"]
    explicit = F.get(F.filter(F.slice(text.inline_citations(line), 1, 4), lambda n: F.array_contains(refs, n)), F.lit(0))
    single = F.filter(spans, lambda s: F.size(s["nums"]) == 1)
    valued = F.transform(single, lambda s, i: F.struct((1.25 + F.when((F.size(own) > 0) & (F.size(s["cues"]) > 0), 0.55 * F.size(F.array_intersect(own, s["cues"]))).otherwise(0.2 * F.size(s["cues"]))).alias("v"), (-i).alias("i"), s["nums"][0].alias("n")))
    span = F.array_max(valued)["n"]
    hinted = (F.size(refs) > 0) & (text.doi(line).isNotNull() | (F.col("_author").isNotNull() & line.rlike("(?:19|20)\\d{2}")))
    one = lambda n, mode: F.struct(n.cast("int").alias("num"), F.lit(mode).alias("mode"))
    none = F.lit(None)
    return (
        F.when(slot["cite_policy"] == "locate_only", one(none, "locate_only")).when(explicit.isNotNull(), one(explicit, "context_explicit_ref")).when(span.isNotNull(), one(span, "slot_ref_span"))
        .when(F.size(refs) == 1, one(refs[0], "slot_candidate")).when(hinted, one(refs[0], "context_hint_candidate")).otherwise(one(none, "no_ref"))
    )


def resolved(lines: DataFrame, slot: DataFrame, by: list[str]) -> DataFrame:
    """lines: by, pos and line with markers.  A row a marker: by, pos, n (its place in the line), support_id, slot (null: missing), score where the line chose the slot, num, mode, and what replaces the marker.
    Markers of lines about the evidence have no row."""
    text_of = lines.select(*by, "pos", "line").where(F.col("line").rlike(MARKER)).withColumn("_low", surface("line")).where(~F.col("_low").rlike(META_LINE) & (F.col("_low") != ""))
    text_of = text_of.withColumns({"_own": cues("_low"), "_letters": panel_letters("line"), "_cues": cues("line"), "_author": author_hint(F.col("line"))})
    each = text_of.select("*", F.posexplode(F.regexp_extract_all("line", F.lit(MARKER), F.lit(1))).alias("n", "said")).withColumn("said", F.upper("said"))
    each = each.withColumn("doc_idx", F.regexp_extract("said", "DOC-(\\d+)", 1).cast("int"))
    kept = F.struct("slot", "support_id", "sid", "claim_type", "cite_policy", "cues", "panels", "figure_like", "ref_spans", "refs", "doc_idx")
    of = slot.groupBy(*by).agg(F.array_sort(F.collect_list(kept)).alias("slots"))  # a few
    out = each.join(of, by, "left")
    named = F.get(F.filter("slots", lambda s: s["support_id"] == F.col("said")), F.lit(0))
    fitting = F.array_max(F.transform(F.filter("slots", lambda s: s["doc_idx"] == F.col("doc_idx")), lambda s: F.struct(F.round(_context_score(s), 6).alias("score"), (-s["slot"]).alias("less"))))
    out = out.withColumn("_fit", F.when(named.isNull(), fitting)).withColumn("_slot", F.coalesce(named, F.get(F.filter("slots", lambda s: -s["slot"] == F.col("_fit.less")), F.lit(0))))
    out = out.withColumn("_ref", F.when(F.col("_slot").isNotNull(), reference_number(F.col("_slot"))))
    cited = F.when(F.col("_ref.num").isNotNull() & (F.col("_slot.sid") != ""), F.concat(F.lit("[[CITE:"), "_slot.sid", F.lit(":"), F.col("_ref.num").cast("string"), F.lit("]]"))).otherwise("")
    return out.select(*by, "pos", "n", F.coalesce("_slot.support_id", "said").alias("support_id"), F.col("_slot.slot").alias("slot"), F.col("_fit.score").alias("score"), F.col("_ref.num").alias("num"), F.coalesce("_ref.mode", F.lit("missing_slot")).alias("mode"), cited.alias("replacement"))


def with_citations(lines: DataFrame, resolution: DataFrame, by: list[str]) -> DataFrame:
    """lines with each marker replaced by its citation or nothing, and the gaps closed."""
    made = resolution.groupBy(*by, "pos").agg(F.map_from_entries(F.collect_list(F.struct("n", "replacement"))).alias("_made"))
    out = lines.join(made, [*by, "pos"], "left")
    parts = F.split(F.regexp_replace("line", MARKER, "\x01"), "\x01")
    filled = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.col("_made")[i - 1], F.lit("")), p))), "")
    closed = F.regexp_replace(F.rtrim(F.regexp_replace(filled, "[ \\t]{2,}", " ")), "\\s+([,.;:!?])", "$1")
    return out.withColumn("line", F.when(F.col("line").rlike(MARKER), closed).otherwise(F.col("line"))).drop("_made")
