"""Coverage of claims: what kind of claim a segment of an answer is, the block of its source that it is bound to, and which claims need a located block.

Claims have the columns of a key (an answer), seg_no, segment, kind, doc_id (the source), block_id and order_index of the block found so far (null: none) and mode
(`direct`: taken from the source).  Null texts are empty; claims without a source stay as they are; of equal candidates the earlier block is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from .indices import PROSE, display_equation, equation_signal, formula_tokens

#: Marks of quotations, of omissions in them and of the ends of sentences.
QUOTES = ("[\"“”]\\s*([^\"“”]{6,320}?)\\s*[\"“”]", "[‘’']\\s*([^‘’']{6,260}?)\\s*[‘’']", "[「」『』《》]\\s*([^「」『』《》]{6,320}?)\\s*[」』》]")
OMISSION = "\\[\\s*(?:\\.{3,}|…)\\s*\\]|\\.{3,}|…"
SENTENCE_END = "(?<=[。！？.!;:；：])\\s+"
#: Phrases of segments that say they aren't from the source, and headers that end such a passage.
NOT_FROM_SOURCE = (
    "通用知识", "非检索片段内容", "非检索内容", "外部常识补充", "未出现在本文检索片段中", "未出现在当前检索片段中", "未出现在检索片段中",
    "generic knowledge", "non-retrieved", "not present in retrieved context", "not in retrieved context", "not explicitly available in retrieved context",
)
NOT_SAID = "(?i)\\b(?:the retrieved (?:context|evidence)|the provided (?:context|evidence)|the discussion section)\\b.{0,80}\\b(?:does not|is not|not present|missing)\\b|\\b(?:the authors|the paper)\\b.{0,80}\\b(?:do not discuss|does not discuss|makes no statement|do not mention|does not mention)\\b"
BOUNDARY = "(?i)^---|^\\s{0,3}#{1,6}\\s+|^\\s*(?:结论|依据|边界|限制|下一步|note|notes|boundary|limitations?|conclusion|next steps?)\\s*[:：]"
#: Beginnings and words of sentences that explain a formula, and headings that its index counts for.
EXPLAINS_FIRST = "(?i)^\\s*(?:where|wherein|here|with|in which|式中|其中)(?:\\b|[,:])"
EXPLAINS = "(?i)\\bwhere\\b|\\bdenotes?\\b|\\brepresents?\\b|\\bstands?\\s+for\\b|\\bis\\s+the\\b|\\bare\\s+the\\b|\\bcorresponds?\\s+to\\b|表示|记为|定义为|代表|对应|指代"
FORMULA_HEADING = "(?i)method|background|equation|formula|derivation"
#: Floors of a quotation's block and of an explanation, and what a new block must be better by.
QUOTE_FLOOR, QUOTE_GAIN, EXPLANATION_FLOOR, CAPTION_FLOOR = 0.96, 0.12, 0.58, 0.18
QUOTED = ("quote_claim", "blockquote_claim")
#: Kinds of claims that are bound by their own marks.
MARKED = (*QUOTED, "formula_claim", "inline_formula_claim", "figure_claim")
INLINE = "(?<![\\\\$])\\$([^$]{1,280})\\$(?!\\$)"


def _text(x: Column | str) -> Column:
    return F.coalesce(text._c(x), F.lit(""))


def _plus(condition: Column, value: float | Column) -> Column:
    return F.when(condition, value).otherwise(0.0)


def quoted_spans(x: Column | str, least: int = 12, most: int = 6) -> Column:
    """What stands in quotation marks, of at least `least` characters, each once."""
    found = F.concat(*[F.regexp_extract_all(_text(x), F.lit(p), F.lit(1)) for p in QUOTES])
    return F.slice(F.array_distinct(F.transform(F.filter(found, lambda s: F.length(s) >= least), lambda s: F.substring(s, 1, 360))), 1, most)


def formula_key(x: Column | str) -> Column:
    """A formula for comparison: lower case, without dollars, tags, fonts, braces and blanks."""
    out = F.lower(_text(x))
    for p in ("\\$+", "\\\\tag\\{\\s*\\d{1,4}\\s*\\}", "\\\\(?:left|right|mathbf|mathrm|mathit|boldsymbol|operatorname)\\b", "[{}]", "\\\\[,;:!]", "\\s+"):
        out = F.regexp_replace(out, p, "")
    return F.substring(out, 1, 2000)


def formula_similarity(a: Column | str, b: Column | str) -> Column:
    """The sequence ratio of two formulas; 0 where one is empty."""
    a, b = formula_key(a), formula_key(b)
    return _plus((a != "") & (b != ""), scoring.sequence_ratio(a, b))


def _overlap(a: Column | str, b: Column | str) -> Column:
    return scoring.geometric_overlap(text.match_tokens(a), text.match_tokens(b))


def not_from_source(x: Column | str) -> Column:
    """A segment that says it isn't from the source, or that the source doesn't say something."""
    x = _text(x)
    hint = reduce(lambda a, b: a | b, [F.lower(x).contains(h) for h in NOT_FROM_SOURCE])
    return x.rlike(NOT_SAID) | (x.contains("补充说明") & (x.contains("检索片段") | F.lower(x).contains("retrieved context"))) | hint


def scoped(segments: DataFrame, by: list[str]) -> DataFrame:
    """Adds `outside`: the segment says that it isn't from the source, or stands below one that opens such a passage, up to the next header."""
    x = F.trim(_text("segment"))
    says = not_from_source("segment")
    opens = says & (x.rlike("[:：]$") | F.lower(F.substring(x, 1, 48)).contains("supplement") | F.substring(x, 1, 16).contains("说明"))
    event = F.when(opens, F.lit(True)).when(~says & x.rlike(BOUNDARY), F.lit(False))
    return segments.withColumn("outside", says | F.coalesce(F.last(event, ignorenulls=True).over(Window.partitionBy(*by).orderBy("seg_no")), F.lit(False)))


def claim_types(segments: DataFrame) -> DataFrame:
    """Adds claim_type, anchor_text and number: that of an equation or a figure that the segment names."""
    x = _text("segment")
    formula = F.regexp_extract(x, INLINE, 1)
    inline = (formula != "") & ~x.contains("$$") & ((F.length(formula) >= F.greatest(F.lit(16), 0.38 * F.length(x))) | (F.length(F.trim(F.regexp_replace(x, INLINE, " "))) <= 40))
    figure, spans = F.coalesce(text.figure_number(x), F.lit(0)), quoted_spans(x)
    kind = (
        F.when(not_from_source(x), F.when(F.col("block_id").isNotNull() & (F.col("mode") == "direct"), "evidence_note_claim").otherwise("shell_sentence"))
        .when(inline, "inline_formula_claim").when(display_equation(x), "formula_claim").when(figure > 0, "figure_claim").when(F.col("kind") == "blockquote", "blockquote_claim")
        .when(F.size(spans) > 0, "quote_claim").when(x.rlike("[:：]$") & (F.length(x) <= 33), "shell_sentence").otherwise("critical_fact_claim")
    )
    longest = F.array_max(F.transform(spans, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    anchor = F.when(F.col("claim_type") == "inline_formula_claim", formula).when(F.col("claim_type") == "quote_claim", longest).when(F.col("claim_type") == "shell_sentence", "").otherwise(F.substring(F.trim(x), 1, 900))
    number = F.when(F.col("claim_type") == "figure_claim", figure).when(equation_signal(x), F.coalesce(text.equation_number(x), F.lit(0))).otherwise(0)
    return segments.withColumn("claim_type", kind).withColumns({"anchor_text": anchor, "number": number})


def _first(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "seg_no").orderBy(*order))).where("_n = 1").drop("_n")


def equation_bindings(claims: DataFrame, equations: DataFrame, by: list[str]) -> DataFrame:
    """claims: with number and anchor_text.  equations: doc_id, block_id, anchor_id, heading_path, number and tex.  The equation of the source with the claim's number that is most like it: key, seg_no, block_id and score."""
    rows = equations.select("doc_id", "number", F.col("block_id").alias("bound"), "anchor_id", F.col("heading_path").alias("under"), "tex")
    pairs = claims.where((F.col("number") > 0) & (F.col("claim_type") != "figure_claim") & equation_signal("segment")).join(rows, ["doc_id", "number"])
    score = 12 + _plus(_text("anchor_id") != "", 0.6) + _plus(F.col("block_id") == F.col("bound"), 0.3) + 1.8 * scoring.geometric_overlap(formula_tokens("anchor_text"), formula_tokens("tex")) + 1.2 * formula_similarity("anchor_text", "tex") + _plus(_text("under").rlike(FORMULA_HEADING), 0.4)
    return _first(pairs.withColumn("score", F.round(score, 6)), by, F.desc("score"), "bound").select(*by, "seg_no", F.col("bound").alias("block_id"), "score")


def figure_bindings(claims: DataFrame, blocks: DataFrame, figures: DataFrame, by: list[str]) -> DataFrame:
    """claims: with number.  blocks: numbered.  figures: doc_id, block_id, number and caption_block_id.  The figure of the source with the claim's number, first the one that the claim has already, and the
    best of the blocks that name it as its caption: key, seg_no, figure_id and caption_id (null: none), one of them at least."""
    asked = claims.where((F.col("claim_type") == "figure_claim") & (F.col("number") > 0)).select(*by, "seg_no", "doc_id", "number", "block_id", "order_index")
    place = blocks.select("doc_id", F.col("block_id").alias("figure_id"), F.col("order_index").alias("figure_order"))
    known = figures.select("doc_id", "number", F.col("block_id").alias("figure_id"), "caption_block_id").join(place, ["doc_id", "figure_id"])
    asked = _first(asked.join(known, ["doc_id", "number"], "left"), by, F.when(F.col("figure_id") == F.col("block_id"), 0).otherwise(1), "figure_order").withColumn("at", F.coalesce("figure_order", "order_index"))
    # One row a block and number that it names first: a caption is a block of the figure's own number.
    named = blocks.where(F.col("kind").isin(*PROSE)).select("doc_id", text.figure_number("line").alias("number"), F.col("block_id").alias("caption_id"), F.col("order_index").alias("caption_order"), "is_caption", "line").where("number > 0")
    far = F.abs(F.col("caption_order") - F.col("at"))
    near = F.when(far == 1, 0.42).when(far == 0, 0.28).otherwise(F.greatest(F.lit(0.0), 0.18 - 0.04 * far))
    begins = F.regexp_like(F.lower("line"), F.concat(F.lit("^\\s*(?:fig(?:ure)?\\.?\\s*"), F.col("number").cast("string"), F.lit("\\b|图\\s*"), F.col("number").cast("string"), F.lit("\\b)")))
    score = _plus(F.col("caption_id") == F.col("caption_block_id"), 2.9) + _plus(F.col("is_caption"), 0.72) + _plus(begins, 1.3) + F.coalesce(near, F.lit(0.0))
    found = asked.join(named, ["doc_id", "number"], "left").withColumn("score", F.round(F.when(F.col("caption_id").isNotNull(), score), 6))
    best = _first(found, by, F.desc_nulls_last("score"), "caption_order")
    return best.select(*by, "seg_no", "figure_id", F.when(F.col("score") >= CAPTION_FLOOR, F.col("caption_id")).alias("caption_id")).where("figure_id is not null or caption_id is not null")


def in_order(quote: Column, body: Column) -> Column:
    """Points for the parts of a quotation with omissions that a text has one after another."""
    parts = F.transform(F.split(F.regexp_replace(quote, OMISSION, " … "), "\\s+…\\s+"), lambda p: F.regexp_replace(text.match_text(p), "^[\\s\"'`*\\[\\](){}]+|[\\s\"'`*\\[\\](){}]+$", ""))
    parts = F.slice(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 14)), 1, 4)
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("at"))

    def step(state: Column, part: Column) -> Column:
        found = F.position(part, body, F.greatest(state["at"], F.lit(1)))
        stop = (state["at"] == 0) | (found == 0)
        return F.struct(F.when(stop, state["n"]).otherwise(state["n"] + 1).alias("n"), F.when(stop, 0).otherwise(found + F.length(part)).alias("at"))

    n = F.aggregate(parts, start, step)["n"]
    return _plus((F.size(parts) >= 2) & (n > 0), 0.26 * n + _plus(n >= 2, 0.84) + _plus(n >= F.size(parts), 0.24))


def quote_bindings(claims: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """The block of the source that a quotation is from: key, seg_no, block_id and score, from the floor on, and better by a margin than the block that the claim has already.

    A quotation and a block of its source meet if they share a word; quotations of fewer than three words, whose words may be parts of others, meet all blocks of their source."""
    spans = quoted_spans("segment")
    whole = F.array(F.substring(text.strip_inline(F.regexp_replace(_text("segment"), "^\\s*>\\s*", "")), 1, 600))
    seeds = F.when(F.size(spans) > 0, spans).when(F.col("kind") == "blockquote", whole).otherwise(F.array().cast("array<string>"))
    asked = claims.where(F.col("claim_type").isin(*QUOTED) & (F.col("mode") == "direct")).select(*by, "seg_no", "doc_id", "block_id", F.posexplode(seeds).alias("seed_no", "seed")).where(F.trim("seed") != "")
    rows = blocks.select("doc_id", F.col("block_id").alias("bound"), F.col("order_index").alias("bound_order"), F.col("kind").alias("bound_kind"), F.col("heading_path").alias("under"), text.strip_inline("line").alias("body")).where("body <> ''")
    few = (F.size(F.array_distinct(F.regexp_extract_all(F.lower("seed"), F.lit("[a-z0-9]{2,}"), F.lit(0)))) < 3) & ~F.col("seed").rlike(f"[{text.CJK}]{{3}}")
    words = F.array_distinct(F.concat(text.match_tokens("seed"), F.when(few, F.array(F.lit("any word"))).otherwise(F.array().cast("array<string>"))))
    ours = asked.select(*by, "seg_no", "seed_no", "doc_id", F.explode(words).alias("word"))
    theirs = rows.select("doc_id", "bound", F.explode(F.array_distinct(F.concat(text.match_tokens("body"), F.array(F.lit("any word"))))).alias("word"))
    # Pairs of ids alone are made distinct; the texts join them afterwards.
    pairs = ours.join(theirs, ["doc_id", "word"]).select(*by, "seg_no", "seed_no", "doc_id", "bound").distinct()
    pairs = pairs.join(asked, [*by, "seg_no", "seed_no", "doc_id"]).join(rows, ["doc_id", "bound"])
    quote, body = text.match_text("seed"), text.match_text("body")
    pairs = pairs.withColumns({
        "whole": _plus(body.contains(quote), 1.54) + in_order(F.col("seed"), body) + 0.52 * _overlap("seed", "body") + 0.08 * _overlap("seed", _text("under")) + _plus(F.col("bound_kind").isin("paragraph", "blockquote"), 0.05),
        "ratio": scoring.sequence_ratio(F.substring(quote, 1, 520), F.substring(body, 1, 520)),
    })
    pairs = pairs.withColumn("sentence", F.explode(F.slice(F.filter(F.split("body", SENTENCE_END), lambda s: F.trim(s) != ""), 1, 16)))
    one = text.match_text("sentence")
    part = F.when(one == quote, 1.2).when(one.contains(quote) | quote.contains(one), 0.82).otherwise(0.0) + _overlap("seed", "sentence") + 0.28 * scoring.sequence_ratio(F.substring(quote, 1, 420), F.substring(one, 1, 420))
    scored = pairs.withColumn("part", part).groupBy(*by, "seg_no", "block_id", "bound", "bound_order", "bound_kind", "seed_no", "whole", "ratio").agg(F.max("part").alias("part"))
    scored = scored.groupBy(*by, "seg_no", "block_id", "bound", "bound_order", "bound_kind").agg(F.max(F.round(F.col("whole") + 0.34 * F.col("ratio") + 0.92 * F.col("part"), 6)).alias("score"))
    own = F.max(F.when(F.col("bound") == F.col("block_id"), F.col("score"))).over(Window.partitionBy(*by, "seg_no"))
    best = _first(scored.withColumn("own", own).where(F.col("bound_kind").isin(*PROSE)), by, F.desc("score"), "bound_order")
    better = F.col("own").isNull() | (F.col("own") <= 0) | (F.col("score") >= F.col("own") + QUOTE_GAIN)
    return best.where((F.col("score") >= QUOTE_FLOOR) & ((F.coalesce(F.col("bound") == F.col("block_id"), F.lit(False))) | better)).select(*by, "seg_no", F.col("bound").alias("block_id"), "score")


def bound_claims(claims: DataFrame, blocks: DataFrame, by: list[str], equation: DataFrame, figure: DataFrame, quote: DataFrame) -> DataFrame:
    """Claims with the block of their binding, where they have one, instead of the one found so far; a figure's claim goes to its caption, else to the figure.  Adds block_text, block_number and anchor_id of the block."""
    found = quote.select(*by, "seg_no", F.col("block_id").alias("bound")).unionByName(equation.select(*by, "seg_no", F.col("block_id").alias("bound"))).unionByName(figure.select(*by, "seg_no", F.coalesce("caption_id", "figure_id").alias("bound")))
    out = claims.join(found, [*by, "seg_no"], "left").withColumn("block_id", F.coalesce("bound", "block_id")).drop("bound", "order_index")
    return out.join(blocks.select("doc_id", "block_id", "order_index", "anchor_id", "heading_path", F.col("line").alias("block_text"), F.col("number").alias("block_number")), ["doc_id", "block_id"], "left")


def alignment(claim: Column | str, block: Column | str, numbers_agree: Column) -> Column:
    """How well a display formula of a claim agrees with its block."""
    same = text.match_text(claim) == text.match_text(block)
    score = _plus(same, 0.9) + 0.94 * scoring.geometric_overlap(formula_tokens(claim), formula_tokens(block)) + 0.78 * formula_similarity(claim, block) + 0.18 * _overlap(claim, block) + _plus(numbers_agree, 0.72)
    return _plus(display_equation(claim) & display_equation(block), score)


def explanation(x: Column | str, formula: Column | str, number: Column, distance: Column) -> Column:
    """How likely a segment explains the formula that stands `distance` blocks away."""
    x = text._c(x)
    score = _plus(x.rlike(EXPLAINS_FIRST), 0.6) + _plus(x.rlike(EXPLAINS), 0.42) + _plus(equation_signal(x) & ~display_equation(x), 0.22) + _plus((number > 0) & (text.equation_number(x) == number), 0.5)
    score = score + 0.58 * scoring.geometric_overlap(formula_tokens(x), formula_tokens(formula)) + 0.24 * formula_similarity(x, formula) + 0.16 * _overlap(x, formula)
    return score + F.when(distance == 1, 0.14).when(distance == 2, 0.06).otherwise(0.0)


def contract(claims: DataFrame, by: list[str]) -> DataFrame:
    """claims: bound_claims() with `outside`, `must_locate` and `align`.  Adds policy (required, optional or hidden), surface, origin and grp.

    Quotations, formulas and figures taken from the source are required, unless they stand outside it.  Formulas of one block are a bundle, whose best stands for it; the others are hidden.  Segments within two
    blocks that explain a formula join the first bundle they fit: required on the second surface, hidden where they have no block of their own.  Of equal quotations, or inline formulas, of a bundle the longest stays."""
    direct, kind = F.col("mode") == "direct", F.col("claim_type")
    marked = kind.isin(*MARKED) & direct & ~F.col("outside")
    policy = F.when(F.col("outside") | (kind == "shell_sentence"), "hidden").when(marked | F.col("must_locate"), "required").when(direct, "optional").otherwise("hidden")
    surface = F.when(policy != "required", "hidden").when(marked & (kind == "inline_formula_claim"), "secondary").otherwise("primary")
    origin = F.when(marked & (kind == "formula_claim"), "source").when(marked & (kind == "inline_formula_claim"), "explanation").otherwise("")
    bundle = F.coalesce("block_id", F.col("seg_no").cast("string"))
    group = F.when(marked & kind.isin(*QUOTED), F.concat(F.lit("quote:"), bundle)).when(marked & (kind != "figure_claim"), F.concat(F.lit("formula:"), bundle)).otherwise("")
    out = claims.withColumns({"policy": policy, "surface": surface, "origin": origin, "grp": group})

    formula = (F.col("claim_type") == "formula_claim") & (F.col("grp") != "")
    rank = F.row_number().over(Window.partitionBy(*by, "grp", formula).orderBy(F.desc("align"), F.desc(F.col("number") > 0), F.desc(F.length("anchor_text")), "seg_no"))
    lesser = formula & (F.col("_rank") > 1)
    first = F.min(F.when(formula, F.col("seg_no"))).over(Window.partitionBy(*by, "grp"))
    out = out.withColumns({"_rank": rank, "_first": first})
    out = out.withColumns({"policy": F.when(lesser, "hidden").otherwise(F.col("policy")), "surface": F.when(lesser, "hidden").otherwise(F.col("surface")), "origin": F.when(lesser, "derived").otherwise(F.col("origin"))})

    # Explanations: positions in the source where both have one, else in the answer.
    heads = out.where(formula & (F.col("_rank") == 1) & F.col("block_id").isNotNull()).select(*by, F.col("seg_no").alias("f_seg"), F.coalesce("order_index", F.lit(0)).alias("f_at"), F.col("block_id").alias("f_block"), F.col("anchor_text").alias("formula"), F.col("number").alias("f_number"), F.col("grp").alias("f_grp"), "_first")
    heads = heads.withColumn("step", F.explode(F.array(*[F.lit(d) for d in (-2, -1, 1, 2)])))
    loose = out.where(direct & ~kind.isin(*MARKED) & (kind != "shell_sentence") & (F.trim(_text("segment")) != "")).select(*by, "seg_no", "segment", "block_id", F.coalesce("order_index", F.lit(0)).alias("at"))
    near = loose.join(heads.where("f_at > 0").withColumn("at", F.col("f_at") + F.col("step")), [*by, "at"]).where("at > 0").drop("at")
    beside = loose.join(heads.withColumn("seg_no", F.col("f_seg") + F.col("step")), [*by, "seg_no"]).where("f_at = 0 or at = 0").drop("at")
    met = near.unionByName(beside.select(*near.columns)).withColumn("score", F.round(explanation("segment", "formula", F.col("f_number"), F.abs("step")), 6)).where(F.col("score") >= EXPLANATION_FLOOR)
    taken = _first(met, by, "_first").select(*by, "seg_no", F.lit(True).alias("explains"), F.col("f_grp"), (F.col("block_id").isNotNull() & (F.col("block_id") != F.col("f_block"))).alias("apart"))
    out = out.drop("_rank", "_first").join(taken, [*by, "seg_no"], "left")
    own = lambda yes, no, c: F.when(F.col("explains"), F.when(F.col("apart"), yes).otherwise(no)).otherwise(F.col(c))
    out = out.withColumns({
        "policy": own("required", "hidden", "policy"), "surface": own("secondary", "hidden", "surface"), "origin": F.when(F.col("explains"), "explanation").otherwise(F.col("origin")),
        "claim_type": F.when(F.col("explains"), "equation_explanation_claim").otherwise(F.col("claim_type")), "grp": F.when(F.col("explains"), F.col("f_grp")).otherwise(F.col("grp")),
    }).drop("explains", "apart", "f_grp")

    twin = (F.col("claim_type").isin(*QUOTED) | (F.col("claim_type") == "inline_formula_claim")) & (F.col("grp") != "")
    same = F.when(F.col("claim_type") == "inline_formula_claim", formula_key("anchor_text")).otherwise(text.match_text(_text("anchor_text")))
    key = F.when(twin, F.substring(same, 1, 420)).otherwise(F.col("seg_no").cast("string"))
    place = F.row_number().over(Window.partitionBy(*by, "grp", twin, F.col("claim_type") == "inline_formula_claim", "_key").orderBy(F.desc(F.length("anchor_text")), "seg_no"))
    out = out.withColumn("_key", key).withColumn("_place", place)
    again = twin & (F.col("_place") > 1)
    return out.withColumns({"policy": F.when(again, "hidden").otherwise(F.col("policy")), "surface": F.when(again, "hidden").otherwise(F.col("surface"))}).drop("_key", "_place")


def coverage(claims: DataFrame, by: list[str]) -> DataFrame:
    """claims: contract().  A row for each required claim: `located` with a block and an anchor, `degraded` with a block or a heading alone, or `missing`."""
    block = F.col("block_id").isNotNull()
    state = F.when(block & (_text("anchor_text") != ""), "located").when(block | (_text("heading") != ""), "degraded").otherwise("missing")
    return claims.where("policy = 'required'").select(*by, "seg_no", "claim_type", "surface", "block_id", state.alias("state"))
