"""Structured indices of documents: anchors, equations, figures and references as tables, and what is looked up in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from . import references as X
from .intents import anchor_hits

#: Kinds of blocks that explain an equation, and weights of a match of a segment with a block.
PROSE = ("paragraph", "list_item", "blockquote")
CONTAINED, HEAD, FORMULA, HEADING, KIND, EQUATION = 0.78, 0.24, 0.82, 0.34, 0.18, 0.24
FLOOR_NUMBER, FLOOR_EQUATION, FLOOR_TEXT = 0.28, 0.18, 0.22
CAPTION = "(?i)^\\W*fig(?:ure|\\.)"


def numbered(blocks: DataFrame) -> DataFrame:
    """blocks with anchor_id, is_caption and number: that of an equation's tag or mention, or of a caption's figure."""
    caption = (F.col("kind") == "paragraph") & F.col("line").rlike(CAPTION)
    number = F.when(F.col("kind") == "equation", F.coalesce(text.equation_number("line"), F.lit(0))).when(caption, F.coalesce(text.figure_number("line"), F.lit(0))).otherwise(0)
    return blocks.select("*", F.concat(F.lit("a_"), "block_id").alias("anchor_id"), caption.alias("is_caption"), number.alias("number"))


def _clean(x: Column | str, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(x, "\\s+", " ")), 1, most)


def anchors(blocks: DataFrame) -> DataFrame:
    """A row a block: what a reader jumps to."""
    return numbered(blocks).select("doc_id", "anchor_id", "block_id", "kind", "heading_path", "order_index", _clean("line", 1200).alias("text"), "number")


def equations(blocks: DataFrame) -> DataFrame:
    """A row an equation, with the nearest prose before and after it."""
    prose = F.when(F.col("kind").isin(*PROSE), _clean("line", 1000))
    own = Window.partitionBy("doc_id").orderBy("order_index")
    before = F.last(prose, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(prose, ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))
    out = numbered(blocks).withColumns({"context_before": F.coalesce(before, F.lit("")), "context_after": F.coalesce(after, F.lit(""))})
    return out.where("kind = 'equation'").select("doc_id", "block_id", "anchor_id", "heading_path", "number", _clean("line", 6000).alias("tex"), "context_before", "context_after")


def figures(blocks: DataFrame) -> DataFrame:
    """A row a figure, with its asset and the caption that follows it at once."""
    own = Window.partitionBy("doc_id").orderBy("order_index")
    rows = numbered(blocks)
    nxt = lambda c: F.when(F.lead("is_caption").over(own), F.lead(c).over(own))
    out = rows.withColumns({"caption": nxt("line"), "caption_block_id": nxt("block_id"), "figure_number": nxt("number")}).where("kind = 'figure'")
    asset = F.element_at(F.split(F.regexp_extract("line", "!\\[[^\\]]*\\]\\(([^)]*)\\)", 1), "/"), -1)
    return out.select("doc_id", "block_id", "anchor_id", "heading_path", asset.alias("asset"), F.coalesce("figure_number", F.lit(0)).alias("number"), F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce("caption_block_id", F.lit("")).alias("caption_block_id"))


def caption_of(figure: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: doc_id, number.  The first caption of that figure in its document."""
    found = figure.where("caption <> ''").join(wanted, ["doc_id", "number"])
    return found.groupBy("doc_id", "number").agg(F.min_by(F.struct("caption", "caption_block_id"), "block_id").alias("c")).select("doc_id", "number", "c.*")


def plausible_title(x: Column | str) -> Column:
    """Two to 32 words, 8 to 260 characters, and no venue, publisher or page range."""
    t = F.regexp_replace(text._c(x), "^[ .;:,]+|[ .;:,]+$", "")
    words = F.size(F.filter(F.split(t, "\\s+"), lambda w: w != ""))
    low = F.lower(t)
    venue = low.rlike("^(?:in:|in |proceedings|abstracts of|workshop|conference)") | low.rlike("\\b(?:pp?|vol|no)\\.?\\s*\\d") | low.rlike("\\b\\d+\\(\\d+\\)\\s*:\\s*\\d")
    venue = venue | ((words <= 8) & low.rlike("ieee|acm|springer|wiley|press|university|journal|transactions|proceedings|conference|workshop"))
    return F.length(t).between(8, 260) & words.between(2, 32) & ~venue & (F.regexp_count(t, F.lit("[A-Za-z\\x{4e00}-\\x{9fff}]{2,}")) >= 2)


def fallback_title(raw: Column | str) -> Column:
    """The title of a raw reference: quoted, or behind the year in brackets; '' where neither is plausible."""
    x = F.regexp_replace(F.regexp_replace(F.trim(text._c(raw)), "^\\[\\d{1,4}\\]\\s*", ""), "^\\d{1,4}\\.\\s*", "")
    found = [F.regexp_replace(F.regexp_extract(x, p, 1), "^[ .;:,]+|[ .;:,]+$", "") for p in ("[\"“]([^\"”]{6,260})[\"”]", "\\((?:19|20)\\d{2}\\)\\s*([^.]{6,260})\\.")]
    return F.coalesce(*[F.when((t != "") & plausible_title(t), F.substring(t, 1, 260)) for t in found], F.lit(""))


def reference_rows(entry: DataFrame) -> DataFrame:
    """entry: doc_id, num, raw.  A row a reference with what its text gives."""
    out = X.parsed(entry)
    return out.select("doc_id", "num", F.concat(F.lit("ref_"), F.lpad(F.col("num").cast("string"), 4, "0")).alias("entry_id"), fallback_title("raw").alias("title"), "author", "year", F.coalesce("doi", F.lit("")).alias("doi"), "confidence")


def backfilled(segments: DataFrame, anchor: DataFrame) -> DataFrame:
    """segments: doc_id, seg_no, block_id, anchor_id, heading_path, anchor_kind, anchor_text and hidden, empty where unknown.  What is empty is
    filled from the anchor of the segment's block, else from that of its anchor; hidden segments stay."""
    rows = anchor.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("block_id", "anchor_id", "kind", "heading_path", "text")])
    record = F.struct("_block_id", "_anchor_id", "_kind", "_heading_path", "_text")
    by = lambda key, name: rows.groupBy("doc_id", F.col(f"_{key}").alias(key)).agg(F.min(record).alias(name))
    out = segments.join(by("block_id", "_by_block"), ["doc_id", "block_id"], "left").join(by("anchor_id", "_by_anchor"), ["doc_id", "anchor_id"], "left")
    found = F.when(~F.col("hidden"), F.coalesce("_by_block", "_by_anchor"))
    kind = F.when(found["_kind"].isin("equation", "figure", "blockquote"), found["_kind"]).otherwise("sentence")
    fill = {"anchor_id": found["_anchor_id"], "heading_path": found["_heading_path"], "anchor_kind": F.when(found.isNotNull(), kind), "anchor_text": F.substring(found["_text"], 1, 900)}
    return out.select("doc_id", "seg_no", F.coalesce(found["_block_id"], "block_id").alias("block_id"), *[F.when(F.col(c) != "", F.col(c)).otherwise(F.coalesce(v, F.lit(""))).alias(c) for c, v in fill.items()])


def anchor_snippets(blocks: DataFrame, wanted: DataFrame, most: int = 3) -> DataFrame:
    """wanted: doc_id, kind, number of an anchor.  The blocks (of 40 characters or more) that name it, the best first, each text once."""
    rows = blocks.select("doc_id", "block_id", "order_index", F.trim("line").alias("snippet")).where(F.length("snippet") >= 40).join(wanted, "doc_id")
    scored = rows.withColumn("score", anchor_hits(F.col("snippet"), F.col("kind"), F.col("number"))).where("score is not null")
    first = F.row_number().over(Window.partitionBy("doc_id", "snippet").orderBy("order_index"))
    scored = scored.withColumn("_n", first).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "order_index"))
    return scored.withColumn("place", place).where(F.col("place") <= most)


def equation_signal(x: Column | str) -> Column:
    """Dollars, an environment, or a TeX command with =, ^ or _."""
    x = text._c(x)
    return x.contains("$$") | F.lower(x).contains("\\begin{equation") | x.contains("\\[") | x.rlike("\\$[^$]{1,280}\\$") | (x.rlike("\\\\[a-zA-Z]{2,}") & x.rlike("[=^_]"))


def display_equation(x: Column | str) -> Column:
    """A formula of its own: in display marks, or a short one of at most two lines and twelve words."""
    x = F.trim(text._c(x))
    marks = x.rlike("(?s)\\$\\$.+\\$\\$") | x.rlike("(?i)\\\\begin\\{(?:equation|align|gather|multline|eqnarray)\\*?\\}") | (x.contains("\\[") & x.contains("\\]"))
    lines = F.size(F.filter(F.split(x, "\n"), lambda line: F.trim(line) != ""))
    words = F.regexp_count(x, F.lit("[A-Za-z]{3,}")) + F.regexp_count(x, F.lit("[\\x{4e00}-\\x{9fff}]{2,}"))
    return marks | (equation_signal(x) & (lines <= 2) & x.rlike("=|\\\\tag\\{|\\\\(?:sum|int|frac|mathcal|mathbf)") & (words <= 12))


def formula_tokens(x: Column | str) -> Column:
    """TeX commands, letters with their indices, and numbers."""
    x = text._c(x)
    of = lambda p: F.regexp_extract_all(x, F.lit(p), F.lit(0))
    return F.concat(F.transform(of("\\\\[a-zA-Z]{2,}"), F.lower), F.transform(of("[A-Za-z](?:_[A-Za-z0-9]+)?(?:\\^[A-Za-z0-9]+)?"), F.lower), of("\\b\\d{1,4}\\b"))


def mentions(x: Column | str) -> Column:
    """The numbers that a text mentions in brackets, as equations and as figures."""
    low = F.lower(text._c(x))
    of = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(1))
    return F.struct(of("\\(\\s*(\\d+)\\s*\\)").alias("bracket"), of("\\beq(?:uation)?\\s*\\.?\\s*(\\d+)\\b").alias("equation"), of("\\bfig(?:ure)?\\.?\\s*#?\\s*(\\d+)\\b").alias("figure"))


def number_score(said: Column, figure: Column, is_caption: Column, number: Column, wanted: Column) -> Column:
    """How surely a block has the wanted number, as a figure or as an equation: its own, or one of the mentions() in its text."""
    n = wanted.cast("string")
    equation = F.when(number == wanted, 1.15).when(F.array_contains(said["bracket"], n), 1.0).when(F.array_contains(said["equation"], n), 0.95).otherwise(0.0)
    picture = F.when(number == wanted, 1.08 + F.when(is_caption, 0.12).otherwise(0.0)).when(F.array_contains(said["figure"], n), 0.96).otherwise(0.0)
    return F.when(wanted <= 0, 0.0).when(figure, picture).otherwise(equation)


def bag(words: Column) -> Column:
    """Words, each once, with their number."""
    own = F.array_distinct(words)
    return F.struct(own.alias("words"), F.size(own).alias("n"))


def _overlap(a: Column, b: Column) -> Column:
    """scoring.geometric_overlap() of two bags."""
    return F.when((a["n"] > 0) & (b["n"] > 0), F.size(F.array_intersect(a["words"], b["words"])) / F.sqrt(a["n"].cast("double") * b["n"])).otherwise(0.0)


def heading_overlap(a: Column, b: Column, words_a: Column, words_b: Column) -> Column:
    """Of two headings in normal form with the bags of their words."""
    inside = F.when(a.contains(b) | b.contains(a), 0.65).otherwise(0.0)
    return F.when((a != "") & (b != ""), inside + _overlap(words_a, words_b)).otherwise(0.0)


def _inner_word(x: Column) -> Column:
    """The longest word but the first and the last; null without one."""
    w = F.split(x, " ")
    return F.array_max(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), lambda v: F.struct(F.length(v).alias("n"), v.alias("w"))))["w"]


def block_pairs(seg: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, seg_no and block_id of the segments and blocks of a document that could match (match_blocks() doesn't use it any longer): they share a word, of the heading or of the text, or the number that is sought; or either is a formula, whose letters
    are compared; or one's heading contains the other's; or the block may contain the segment's beginning, so that it has the longest of its words but the first and the last (whose ends may lie within a word of the block).  Segments of one or two words, which have no
    such word, meet all blocks of their document."""
    mark = lambda c, p: F.transform(c, lambda t: F.concat(F.lit(p), t))
    only = lambda c, v: F.when(c, F.array(v)).otherwise(F.array().cast("array<string>"))
    inner = _inner_word(F.substring(text.match_text("segment"), 1, 72))
    sought = F.concat(F.lit("n:"), F.col("wanted").cast("string"))
    seg_keys = F.concat(
        mark("q_words", "w:"), mark(text.match_tokens("heading"), "h:"), only(F.col("wanted") > 0, sought), only(F.col("q_eq") | (inner.isNull() & (F.trim("segment") != "")), F.lit("any")), only(inner.isNotNull(), F.concat(F.lit("s:"), inner)), F.array(F.lit("formula")),
    )
    said = F.transform(F.regexp_extract_all("text", F.lit("\\d{1,3}"), F.lit(0)), lambda n: F.concat(F.lit("n:"), n.cast("int").cast("string")))
    row_keys = F.concat(
        mark("b_words", "w:"), mark(text.match_tokens("b_heading"), "h:"), said, only(F.col("number") > 0, F.concat(F.lit("n:"), F.col("number").cast("string"))), only(F.col("b_eq"), F.lit("formula")), mark(F.split(text.match_text("text"), " "), "s:"), F.array(F.lit("any")),
    )
    keyed = lambda df, name, keys: df.select("doc_id", name, F.explode(F.array_distinct(keys)).alias("key"))
    by_key = keyed(seg, "seg_no", seg_keys).join(keyed(rows, "block_id", row_keys), ["doc_id", "key"]).select("doc_id", "seg_no", "block_id")
    # A heading may stand in another one without a common word ("in." in "Thin. ..."): headings meet once each, by a word within the shorter one.
    own, theirs = seg.select("doc_id", "seg_no", text.match_text("heading").alias("a")).where("a <> ''"), rows.select("doc_id", "block_id", text.match_text("b_heading").alias("b")).where("b <> ''")
    within = lambda c, p: F.coalesce(F.concat(F.lit(p), _inner_word(c)), F.lit(p))
    words = lambda c, p: F.concat(mark(F.split(c, " "), p), F.array(F.lit(p)))
    a = keyed(own, "a", F.concat(F.array(within(F.col("a"), "a:")), words(F.col("a"), "b:"))).distinct()
    b = keyed(theirs, "b", F.concat(words(F.col("b"), "a:"), F.array(within(F.col("b"), "b:")))).distinct()
    nested = a.join(b, ["doc_id", "key"]).where(F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))).select("doc_id", "a", "b").distinct()
    by_heading = nested.join(own, ["doc_id", "a"]).join(theirs, ["doc_id", "b"]).select("doc_id", "seg_no", "block_id")
    return by_key.union(by_heading).distinct()


def match_blocks(segments: DataFrame, blocks: DataFrame, k: int = 3) -> DataFrame:
    """segments: doc_id, seg_no, segment, heading, prefer_kind and number (0: none).  blocks: numbered().  The k best blocks of its own document for
    each segment from a floor on, which depends on whether a number, a formula or text is sought.

    All pairs of a document are scored where its blocks are, and only what reaches its floor is kept: no pair is shuffled.  What is found in a segment or a block is made once, not once a pair."""
    once = lambda c: bag(text.match_tokens(c))
    seg = segments.select("doc_id", "seg_no", "prefer_kind", F.col("number").alias("wanted"), equation_signal("segment").alias("q_eq"), once("segment").alias("q_words"), bag(formula_tokens("segment")).alias("q_formula"), F.nullif(text.match_text("segment"), F.lit("")).alias("query"), text.match_text("heading").alias("heading"))
    head = F.substring("query", 1, 72)
    seg = seg.withColumns({"heading_words": once("heading"), "head": F.when(F.length(head) >= 20, head)})
    rows = blocks.select("doc_id", "block_id", "order_index", "kind", "is_caption", "number", equation_signal("line").alias("b_eq"), once("line").alias("b_words"), bag(formula_tokens("line")).alias("b_formula"), text.match_text("line").alias("body"), mentions("line").alias("said"), text.match_text("heading_path").alias("b_heading"))
    rows = rows.withColumn("b_heading_words", once("b_heading"))
    pairs = seg.join(rows, "doc_id")
    eq, body = F.col("q_eq"), F.col("body")
    plus = lambda c, v: F.when(c, v).otherwise(0.0)
    overlap = lambda a, b: _overlap(F.col(a), F.col(b))
    # Of an empty segment or heading all parts are 0.  Whole-stage code stays below the size from which the JVM doesn't compile a method.
    score = overlap("q_words", "b_words") + plus(body.contains(F.col("query")), CONTAINED) + plus(body.contains(F.col("head")), HEAD)
    score = score + plus(eq | F.col("b_eq"), FORMULA * overlap("q_formula", "b_formula"))
    score = score + HEADING * heading_overlap(*[F.col(c) for c in ("heading", "b_heading", "heading_words", "b_heading_words")])
    figure = (F.col("prefer_kind") == "figure") | (F.col("kind") == "figure") | F.col("is_caption")
    by_number = number_score(F.col("said"), figure, F.col("is_caption"), F.col("number"), F.col("wanted"))
    score = score + by_number + plus(F.col("prefer_kind") == F.col("kind"), KIND) + plus(eq & (F.col("kind") == "equation"), EQUATION)
    floor = F.when(F.col("wanted") > 0, FLOOR_NUMBER).when(eq, FLOOR_EQUATION).otherwise(FLOOR_TEXT)
    scored = pairs.select("doc_id", "seg_no", "block_id", "order_index", F.round(score, 6).alias("score"), floor.alias("floor")).where(F.col("score") >= F.col("floor"))
    place = F.row_number().over(Window.partitionBy("doc_id", "seg_no").orderBy(F.desc("score"), "order_index"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("doc_id", "seg_no", "block_id", "score", "place")
