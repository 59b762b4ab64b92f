"""Choice of hits and atoms for an answer: rule tables of weights, citation cues, critical facts, and the texts that a prompt is made of."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from .answers import REFERENCE_LIST, cue_tokens, matches_targets
from .indices import equation_signal
from .intents import box_numbers, section_targets
from .prompts import prompt_family

#: Fixed values: (family of the prompt, where, any of these words, weight) of a hit.
HIT_RULES = [
    ("abstract", "heading", "abstract", 6.5), ("abstract", "heading", "introduction", 1.2), ("abstract", "heading", "results|discussion|materials and methods|method|reference", -4.0),
    ("abstract", "text", "here we introduce|next generation technique|label free imaging inside live cells", 1.5),
    ("overview", "heading", "abstract|introduction|discussion|result", 3.8), ("overview", "heading", "materials and methods|microscope setup|hardware control|data acquisition", -1.8),
    ("overview", "text", "here, we introduce|in this work, we propose|our results establish|core contribution|opens new avenues", 2.0),
    ("compare", "heading", "results|resolution|discussion", 3.2), ("compare", "text", "cnr|nec|fwhm|open-pinhole|closed-pinhole|iism-apr|same incident illumination power", 3.0),
    ("figure_walkthrough", "heading", "figure|caption|legend|panel", 5.0), ("figure_walkthrough", "text", "figure 1|fig 1|fig\\. 1|panel|caption|line profiles|open-pinhole|closed-pinhole", 3.2), ("figure_walkthrough", "heading", "abstract|introduction|materials and methods", -1.6),
    ("reproduce", "heading", "materials and methods|microscope setup|hardware control|data acquisition|data analysis|software packages", 5.0), ("reproduce", "text", "cobolt|hamamatsu|picoquant|symphotime|dwell time|camera exposure|scan control", 3.0), ("reproduce", "heading", "abstract|discussion", -1.5),
    ("equation", "heading", "method|background|equation|formula|derivation", 4.0), ("equation", "raw", "\\\\tag\\{|\\$\\$|where |denotes|represents|is defined as", 4.5),
    ("citation_lookup", "heading", "references|acquisition and image reconstruction strategies|results|discussion", 4.0), ("citation_lookup", "text", "hadamard|fourier|richardson|lucy|attributed|introduced|reference list|works cited", 2.4),
    ("strength_limits", "heading", "discussion|results|resolution", 3.4), ("strength_limits", "text", "not stated|good agreement|remaining difference|could be improved|quantified", 2.0),
]
METHOD_PROMPT = "\\b(?:method|approach|pipeline|framework|architecture|module|network|input|output|render(?:ing)?|reconstruct(?:ion)?|prior)\\b|方法|流程|框架|输入|输出|重建|渲染"
EXPERIMENT_PROMPT = "\\b(?:experiment(?:al)?|setup|results?|ablation|baseline|comparison|ground[ -]?truth|pose|camera|train(?:ing)?|evaluation|dataset|metric|sota)\\b|实验|对比|基线|位姿|真值|训练|数据集|指标"
#: Fixed values: (pattern of the prompt, where, any of these words, weight).
PROMPT_RULES = [
    (METHOD_PROMPT, "heading", "method|approach|pipeline|framework|architecture|model|overview|algorithm", 4.5), (METHOD_PROMPT, "heading", "principle|setup|analysis|algorithm|adaptive", 2.2),
    (METHOD_PROMPT, "text", "we developed|we introduced|we modified|to adapt|workflow|algorithm|camera acquisition|illumination is provided", 1.8),
    (EXPERIMENT_PROMPT, "heading", "experiment|setup|results|ablation|evaluation|dataset|implementation|baseline|comparison", 3.0),
]
GENERIC_HEADING = "abstract|introduction|background|related work|preliminar|conclusion|discussion|reference"
DEEP = "深度学习|神经网络|卷积网络|cnn|deep\\s+learning|neural\\s+network"
ATTRIBUTION = "(?i)\\b(?:we use|we used|we invert|introduced(?: as)?|introducing|attributed to|akin to|as detailed in|as described in|cited as|performed using|using the .*? method|based on)\\b"
CITE_STOP = (
    "reference", "references", "citation", "cite", "cited", "paper", "prior", "work", "works", "where", "what", "which", "when", "they", "does", "with", "into", "from", "that", "stated", "exactly", "connection", "introduced", "introducing",
    "basis", "example", "examples", "section", "acquisition", "strategy", "list", "bibliography",
)
CRITICAL = "(?i)\\b(?:ground[ -]?truth|pose|camera|pipeline|baseline|training|input|output|dataset|metric|ablation|equation|formula|table|figure|fig|hardware|dmd|compression|snapshot|rendering|nerf|scinerf|pnp|ffdnet|gap-tv)\\b|位姿|相机|训练|输入|输出|流程|公式|变量|表|图|硬件|压缩比|真值|基线|对比|实验"
FIGURE_CLAIM = "(?i)\\bfig(?:ure)?\\.?\\s*\\d{1,3}\\b|(?:^|[^\\w])figure\\s*#?\\s*\\d{1,3}\\b|图\\s*\\d{1,3}\\b|第\\s*\\d{1,3}\\s*张图"
STRONG_TOKENS = ("apr", "rvt", "phase", "correlation", "registration", "pinhole", "closed", "open", "figure", "panel", "cnr", "nec", "ipsf", "iscat", "iism")
PHRASES = ("phase correlation", "image registration", "radial variance transform", "local degree of symmetry", "intensity only map", "interferogram", "shift vectors", "original iism dataset", "applied back", "central pixel image", "transform domain", "k log(n/k)", "optimization problem")
METHOD_DETAIL = "(?i)\\b(?:workflow|pipeline|radial variance transform|rvt|phase correlation|image registration|shift vectors?|reappl(?:y|ied)|applied back|central pixel image|off-axis raw images)\\b"
COMPARE_DETAIL = "(?i)\\b(?:cnr|nec|fwhm|resolution|open[- ]?pinhole|closed[- ]?pinhole|trade[- ]?off|noise(?:-equivalent)? contrast|contrast-to-noise)\\b"


def overlap(a: Column, b: Column) -> Column:
    """Common words (and pairs of CJK characters) over the root of the product of their numbers."""
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]{2,}|[\\x{4e00}-\\x{9fff}]{1,2}"), F.lit(0))
    return scoring.geometric_overlap(words(a), words(b))


def _if(condition: Column, weight) -> Column:
    return F.when(condition, weight).otherwise(0.0)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def citation_signal(prompt: Column, heading: Column, body: Column) -> Column:
    """How much a fragment answers what is cited for a prompt's topic: its topic words in text and heading, citations beside them, words of attribution, and no list of references."""
    topics = F.filter(cue_tokens(prompt), lambda t: ~t.isin(*CITE_STOP))
    swap = {"sampling": "sensing", "sensing": "sampling"}
    topics = _once(topics, lambda ts: F.array_distinct(F.concat(ts, F.filter(F.array(*[F.when(F.array_contains(ts, a), b) for a, b in swap.items()]), lambda t: t.isNotNull()))))
    low, leaf = F.lower(F.trim(body)), F.lower(F.when(heading.contains(" / "), F.substr(heading, F.instr(heading, " / ") + 3)).otherwise(heading))
    cites = F.size(text.inline_citations(body)) > 0
    listed = F.arrays_overlap(section_targets(heading), F.array(F.lit("references"))) | F.trim(body).rlike("(?i)^(?:references\\b|\\[\\d{1,4}\\])")
    within = lambda v: F.struct(F.size(F.filter(v["topics"], lambda t: v["low"].contains(t))).alias("in_text"), F.size(F.filter(v["topics"], lambda t: ~v["low"].contains(t) & v["leaf"].contains(t))).alias("in_heading"), v["cites"].alias("cites"))

    def points(v: Column) -> Column:
        score = F.least(F.lit(12.0), 3.2 * v["in_text"]) + F.least(F.lit(2.4), 0.8 * v["in_heading"]) + _if(v["cites"], F.when(v["in_text"] == 0, -6.0).when(v["in_text"] >= 2, 10.0).otherwise(4.0))
        return score + _if(body.rlike(ATTRIBUTION), F.when(v["cites"], 8.0).otherwise(3.0))

    known = _once(F.struct(topics.alias("topics"), low.alias("low"), leaf.alias("leaf"), cites.alias("cites")), lambda v: _once(within(v), points))
    return known + _if(listed, F.when(prompt.rlike(REFERENCE_LIST), 2.0).otherwise(-5.0))


def title_only(body: Column) -> Column:
    """A first-level heading with at most one line, or with two of which the last is of authors."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda v: F.trim(v)), lambda v: v != "")
    last = F.try_element_at(lines, F.lit(-1))
    return F.get(lines, F.lit(0)).startswith("# ") & ((F.size(lines) <= 2) | ((F.size(lines) == 3) & (last.contains("@") | last.contains("$^{"))))


def hit_score(hits: DataFrame) -> DataFrame:
    """hits: prompt, heading (a path), body, score, targeted, kind, anchor_kind and anchor_number.  Adds hit_score, by the family of the prompt."""
    prompt, path, body = F.col("prompt"), F.col("heading"), F.col("body")
    parts = text.heading_parts("heading")
    own = F.filter(parts, lambda p: ~text.match_text(p).rlike(GENERIC_HEADING))
    last = lambda a, n: F.array_join(F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n)), " / ")
    rows = hits.withColumn("_family", prompt_family("prompt")).withColumn("_focus", F.when(F.size(own) > 0, last(own, 2)).otherwise(last(parts, 2)))
    family = F.col("_family")
    heading = text.match_text(F.when(F.col("_focus") != "", F.col("_focus")).otherwise(path))
    low, asked, where = text.match_text(F.substring("body", 1, 1600)), text.match_text("prompt"), text.match_text("heading")
    surface = {"heading": heading, "text": low, "raw": body}
    leaf = F.try_element_at(F.split("_focus", " / "), F.lit(-1))
    number = text.equation_number("prompt")
    deep = prompt.rlike("(?i)" + DEEP) & low.rlike("deep learning|neural|cnn")
    cited = F.filter(section_targets("prompt"), lambda s: s != "references")
    in_cited = F.exists(cited, lambda s: where.contains(F.replace(s, F.lit("_"), F.lit(" "))))
    terms = [
        F.coalesce("score", F.lit(0.0)), _if(matches_targets(prompt, path) | matches_targets(prompt, body), 22.0), _if(F.col("targeted"), 10.0), 1.8 * overlap(asked, heading), 0.35 * overlap(asked, F.substring(low, 1, 480)),
        _if(title_only(body), -18.0), _if((F.col("kind") == "heading") | ((leaf != "") & (text.match_text("body") == text.match_text(leaf))), -14.0), _if(F.trim(body).rlike("(?i)^\\W*box\\s*\\d{1,2}\\b") & (F.length(F.trim(body)) <= 96), -12.0),
        _if(where.rlike(GENERIC_HEADING), -3.5), _if(heading.contains("abstract"), -1.2), _if(heading.contains("reference"), F.when(deep, -1.0).otherwise(-7.0)),
        *[_if((family == f) & surface[s].rlike(p), w) for f, s, p, w in HIT_RULES], *[_if(F.lower(prompt).rlike(p) & surface[s].rlike(words), w) for p, s, words, w in PROMPT_RULES],
        _if(family == "equation", _if(F.col("anchor_kind") == "equation", 8.0) + _if((number > 0) & (F.col("anchor_number") == number), 10.0) + _if((number > 0) & (body.contains(F.concat(F.lit("\\tag{"), number, F.lit("}"))) | body.contains(F.concat(F.lit("Equation ("), number, F.lit(")")))), 8.0)),
        _if(family == "citation_lookup", F.when(F.size(cited) > 0, F.when(in_cited, 5.0).when(where.contains("references"), -2.5).otherwise(0.0)).when(~prompt.rlike(REFERENCE_LIST) & where.contains("references"), -3.0).otherwise(0.0) + _if(F.size(text.inline_citations(body)) > 0, 4.5) + citation_signal(prompt, path, body)),
        _if((family == "strength_limits") & F.col("kind").isin("paragraph", "list_item", "blockquote"), 1.8),
    ]
    return rows.withColumn("hit_score", F.round(reduce(add, terms), 6)).drop("_family")


def answer_hits(hits: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """hits as in hit_score() with by, source, block_id and pos.  The hits of each answer in order: each source, heading and beginning once, then the best of each source and
    focus heading (or block, where the prompt asks for a place), only those at the place where any are, no references unless asked for, and a bare title only ahead of all others."""
    first = F.row_number().over(Window.partitionBy(by, "source", F.sha1(text.match_text("heading")), F.sha1(F.substring("body", 1, 320))).orderBy("pos"))
    rows = hit_score(hits.withColumn("_n", first).where("_n = 1").drop("_n"))
    prompt, body = F.col("prompt"), F.col("body")
    figure = F.coalesce(text.figure_number("prompt") > 0, F.lit(False))
    asks = (F.size(section_targets("prompt")) > 0) | (F.size(box_numbers("prompt")) > 0) | figure
    other = F.exists(section_targets("prompt"), lambda s: s != "references") | (F.size(box_numbers("prompt")) > 0) | figure
    asks = asks & ~((prompt_family("prompt") == "citation_lookup") & ~prompt.rlike(REFERENCE_LIST) & ~other)
    rows = rows.withColumns({"_asks": asks, "_fits": matches_targets(prompt, F.col("heading")) | matches_targets(prompt, body) | F.col("targeted")})
    any_fits = rows.groupBy(by).agg(F.bool_or(F.col("_asks") & F.col("_fits")).alias("_any"))
    rows = rows.join(any_fits, by).where("not _any or _fits")
    wants = prompt.rlike("(?i)\\breference\\b|\\bcitation\\b|\\bcite\\b|\\[\\d{1,3}\\]|参考文献|引用|引文")
    rows = rows.where(wants | ~text.match_text("_focus").contains("reference"))
    order = Window.partitionBy(by).orderBy(F.desc("hit_score"), "pos")
    rows = rows.withColumn("_place", F.row_number().over(order)).where((F.col("_place") == 1) | ~title_only(body))
    key = F.when(F.col("_asks") & (F.coalesce("block_id", F.lit("")) != ""), F.col("block_id")).otherwise(text.match_text("_focus"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by, "source", key).orderBy(F.desc("hit_score"), "pos"))).where("_n = 1")
    place = F.row_number().over(order)
    return rows.withColumn("place", place).where(F.col("place") <= k).drop("_asks", "_fits", "_any", "_place", "_n", "_focus")


def critical_fact(x: Column | str) -> Column:
    """How much a sentence states a fact that an answer must get right: length, figures, names, formulas, and words of the field."""
    x = text._c(x)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text.strip_inline(x), "\\[\\d{1,3}(?:\\s*[-,–—]\\s*\\d{1,3})*\\]", " "), "\\(\\s*\\d{1,3}(?:\\s*[-,–—]\\s*\\d{1,3})*\\s*\\)", " "), "\\s+", " "))

    def scored(plain: Column) -> Column:
        n = F.length(plain)
        terms = [_if(n >= 18, 0.12), _if(n >= 32, 0.12), _if(n >= 56, 0.08), _if(plain.rlike("\\d"), 0.08), _if(plain.rlike("[A-Z][A-Za-z0-9+-]{1,}"), 0.08), _if(equation_signal(plain), 0.14), _if(text.equation_number(plain) > 0, 0.12), _if(plain.rlike(FIGURE_CLAIM), 0.12), _if(F.lower(plain).rlike(EXPERIMENT_PROMPT), 0.10), _if(F.lower(plain).rlike(METHOD_PROMPT), 0.08), _if(plain.rlike(CRITICAL), 0.14)]
        return F.when(plain == "", 0.0).otherwise(reduce(add, terms))

    return F.transform(F.array(plain), scored)[0]  # the argument of a lambda is computed once, a column where it is used


def atom_score(atoms: DataFrame) -> DataFrame:
    """atoms: text, heading, atom_kind (sentence, caption_clause or ref_span), refs, figure, panels and box of an atom; probe, probe_heading, family, claim, figures wanted
    (want_figure, want_panels, want_boxes, empty where none).  Adds atom_score and in_scope."""
    body, kind, family, claim = F.col("text"), F.col("atom_kind"), F.col("family"), F.col("claim")
    probe = F.concat_ws("\n", "probe_heading", "probe")
    shared = F.array_intersect(F.slice(cue_tokens(probe), 1, 18), F.slice(cue_tokens(F.concat_ws("\n", "heading", "text")), 1, 18))
    strong = F.size(F.filter(shared, lambda t: t.isin(*STRONG_TOKENS)))
    asked, low = text.match_text(probe), text.match_text(F.substring("text", 1, 1600))
    phrases = reduce(add, [F.when(asked.contains(p) & low.contains(p), 1).otherwise(0) for p in PHRASES])
    refs = F.size("refs")
    method = claim.isin("method_detail", "borrowed_tool") | probe.rlike(METHOD_DETAIL)
    compare = (claim == "compare_result") | probe.rlike(COMPARE_DETAIL)
    sentence, span, clause = (kind == k for k in ("sentence", "ref_span", "caption_clause"))
    by_claim = (
        F.when(claim == "figure_panel", F.when(clause, 2.35).when(sentence, -0.35).otherwise(0.0))
        .when((family == "citation_lookup") | claim.isin("prior_work", "borrowed_tool"), F.when(span, 2.2).when(sentence & (refs > 0), 0.8).otherwise(0.0))
        .when(claim == "method_detail", _if(sentence, 0.85) + _if(method & body.rlike(METHOD_DETAIL), 0.65))
        .when(compare & body.rlike(COMPARE_DETAIL), 0.45)
        .when(family == "box_only", F.when(sentence, 0.9).when(span, -0.35).otherwise(0.0) + _if(body.rlike("(?i)\\b(?:transform domain|optimization problem)"), 0.95))
        .otherwise(0.0)
    )
    wants_figure, wants_panels, wants_boxes = F.col("want_figure") > 0, F.size("want_panels") > 0, F.size("want_boxes") > 0
    common = F.size(F.array_intersect("want_panels", "panels"))
    own_box = F.array_contains("want_boxes", F.col("box")) & (F.col("box") > 0)
    in_scope = (~wants_figure | (F.col("figure") == F.col("want_figure"))) & (~wants_panels | (common > 0)) & (~wants_boxes | own_box)
    any_target = wants_figure | wants_panels | wants_boxes
    terms = [
        1.15 * overlap(F.col("probe"), body), 0.25 * overlap(probe, F.concat_ws("\n", "heading", "text")), F.least(F.lit(0.9), 0.18 * F.size(shared)), F.least(F.lit(0.72), 0.22 * strong), F.least(F.lit(1.0), 0.34 * phrases),
        F.when(clause, 0.22).when(sentence, 0.1).when(span, 0.18).otherwise(0.0), by_claim, F.when(family == "citation_lookup", F.least(F.lit(1.4), 0.44 * refs)).otherwise(F.least(F.lit(0.45), 0.12 * refs)),
        _if(any_target, F.when(in_scope, 1.65).otherwise(-1.05)), _if(wants_figure, F.when(F.col("figure") == F.col("want_figure"), 1.15).otherwise(-0.6)),
        _if(wants_panels, F.when(common > 0, 1.8 + 0.24 * common + _if(common == F.size("want_panels"), 0.8)).when(F.size("panels") > 0, -0.85).when(claim == "figure_panel", -0.55).otherwise(0.0)),
        _if(wants_boxes, F.when(own_box, 1.55 + _if(family == "box_only", 0.7)).when(F.col("box") > 0, -0.95).otherwise(0.0)), F.when(F.length(body) <= 220, 0.26).when(F.length(body) >= 540, -0.18).otherwise(0.0),
    ]
    return atoms.where(body != "").withColumns({"atom_score": F.round(reduce(add, terms), 6), "in_scope": in_scope})


def support_atoms(atoms: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    """atoms as in atom_score() with pos.  The k best for each claim: by score, then those in scope, clauses, spans, and the longer ones."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("atom_score"), F.desc("in_scope"), F.desc(F.col("atom_kind") == "caption_clause"), F.desc(F.col("atom_kind") == "ref_span"), F.desc(F.length("text")), "pos"))
    return atom_score(atoms).withColumn("place", rank).where(F.col("place") <= k)


def panel_letters(x: Column | str) -> Column:
    """The panels that a caption or prompt names, sorted."""
    x = text._c(x)
    each = lambda p, k=1: F.regexp_extract_all(x, F.lit(p), F.lit(k))
    within = lambda found, p: F.flatten(F.transform(found, lambda g: F.regexp_extract_all(g, F.lit(p), F.lit(0))))
    slash = "(?i)\\b([a-z])\\s*/\\s*([a-z])\\b"
    found = [
        each(slash, 1), each(slash, 2), within(each("(?i)panels?\\s*\\(([^)]+)\\)"), "(?i)\\b[a-z]\\b"), within(each("(?i)\\bpanels?\\s+([a-g](?:\\s*(?:[/,&-]|\\band\\b)\\s*[a-g])*)(?![a-z])"), "(?i)\\b[a-g]\\b"),
        within(each("(?i)\\(([a-g](?:\\s*[/,&-]\\s*[a-g])*)\\)"), "(?i)[a-g]"), each("(?m)(?:^|[.;:]\\s*)([A-Ga-g])\\s+(?=[A-Z])"), each("(?im)(?:^|[.;:]\\s*)([a-z])\\s*,"),
    ]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found), lambda c: F.lower(c))))


def panel_clauses(x: Column | str) -> Column:
    """A caption's clauses as structs of letter and clause, apart at '(a)' marks."""
    parts = F.split(F.regexp_replace(text._c(x), "\\(([A-Ga-g])\\)\\s*", "\x01$1\x02"), "\x01")
    return F.filter(F.transform(F.slice(parts, 2, 26), lambda p: F.struct(F.lower(F.split(p, "\x02")[0]).alias("letter"), F.trim(F.regexp_replace(F.split(p, "\x02")[1], "[;,\\s]+$", "")).alias("clause"))), lambda s: s["clause"] != "")


def numbered_citations(x: Column | str, source: Column | str) -> Column:
    """[3-5] as a token for each number of the one source that an answer is about."""
    s = F.regexp_replace(text._c(x), "(^|[^\\[])(\\[\\d{1,4}(?:\\s*[-,]\\s*\\d{1,4})*\\])(?!\\])", "$1\x01$2\x01")
    tokens = lambda p: F.array_join(F.transform(text.inline_citations(p), lambda n: F.concat(F.lit("[[CITE:"), text._c(source), F.lit(":"), n.cast("string"), F.lit("]]"))), "")
    made = F.transform(F.split(s, "\x01"), lambda p, i: F.when((i % 2 == 1) & (F.size(text.inline_citations(p)) > 0), tokens(p)).otherwise(p))
    return F.array_join(made, "")


def context_block(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """hits: by, place, heading, text.  The text block of evidence that a prompt carries, in order of place."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.when(F.col("heading") != "", F.concat("heading", F.lit(": "))).otherwise(""), "text")
    return hits.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda r: r["line"]), "\n").alias("block"))


def messages(history: DataFrame, block: DataFrame, rules: str, by: str = "conv_id") -> DataFrame:
    """history: by, turn, role, text.  block: by, block.  The messages that are sent: the rules, the turns of user and assistant in order, and the last user turn with the block."""
    kept = history.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy(by))
    kept = kept.withColumn("last", last).where("turn <= last").join(block, by, "left")
    said = F.when((F.col("turn") == F.col("last")) & F.col("block").isNotNull(), F.concat("text", F.lit("\n\n"), "block")).otherwise(F.col("text"))
    head = kept.select(by).distinct().select(by, F.lit(0).alias("n"), F.lit("system").alias("role"), F.lit(rules).alias("content"))
    rest = kept.select(by, F.row_number().over(Window.partitionBy(by).orderBy("turn")).alias("n"), "role", said.alias("content"))
    return head.unionByName(rest)


#: Fixed values: (family, where, any of these words, weight) of a block of the bound document, and words that count where prompt and block share them.
BLOCK_RULES = [
    ("method", "heading", "method|implementation|algorithm|analysis", 7.0), ("method", "text", "phase correlation|image registration|algorithm|workflow|rvt", 3.5),
    ("reproduce", "heading", "materials and methods|methods|setup|data acquisition|protocol|implementation", 6.0), ("reproduce", "text", "camera|laser|dwell time|exposure|acquisition|hardware", 3.2),
    ("overview", "heading", "abstract|introduction|results|discussion|conclusion", 4.5), ("equation", "heading", "equation|formula|method|background", 5.0), ("equation", "raw", "\\\\tag\\{|\\$\\$|\\\\\\[|\\\\\\]|where |denotes|represents", 3.8),
    ("figure_walkthrough", "heading", "figure|caption|panel|results", 5.0), ("figure_walkthrough", "text", "figure|fig\\.|panel|caption", 2.5),
]
SHARED_WORDS = {"hadamard": 12.0, "richardson": 8.0, "lucy": 8.0}
#: Blocks behind the header of a box that belong to it.
BOX_BLOCKS = 18


def targeted_blocks(blocks: DataFrame, wanted: DataFrame, k: int = 4) -> DataFrame:
    """blocks: doc_id, block_id, order_index, heading_path, line.  wanted: doc_id, prompt.  The k best blocks of a document for a prompt: what it asks for by section, box or figure counts most
    (and alone, unless it looks for a citation), then common words and the rules of its family; each heading and text once."""
    own = Window.partitionBy("doc_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0)
    box = F.nullif(F.regexp_extract("line", "(?i)^\\W*box\\s*(\\d{1,2})\\b", 1), F.lit("")).cast("int")
    rows = blocks.select("doc_id", "block_id", "order_index", F.col("heading_path").alias("heading"), F.trim("line").alias("text"), box.alias("own_box")).withColumn("head", F.last(F.when(F.col("own_box").isNotNull(), F.struct("order_index", F.col("own_box").alias("n"))), ignorenulls=True).over(own))
    rows = rows.where("text <> ''").join(wanted, "doc_id").withColumn("_family", prompt_family("prompt"))
    prompt, body, path, family = F.col("prompt"), F.col("text"), F.col("heading"), F.col("_family")
    within = F.coalesce(F.array_contains(box_numbers("prompt"), F.col("head.n")) & (F.col("order_index") - F.col("head.order_index") <= BOX_BLOCKS), F.lit(False))
    combined = F.concat_ws("\n", F.when(path != "", path), F.substring("text", 1, 800))
    rows = rows.withColumns({"_box": within, "_fits": within | matches_targets(prompt, combined)})
    figure = F.coalesce(text.figure_number("prompt") > 0, F.lit(False))
    asks = (F.size(section_targets("prompt")) > 0) | (F.size(box_numbers("prompt")) > 0) | figure
    rows = rows.where(~asks | (family == "citation_lookup") | F.col("_fits"))
    surface = {"heading": F.lower(path), "text": F.lower(body), "raw": body}
    cue = F.when(family == "citation_lookup", F.filter(cue_tokens("prompt"), lambda t: ~t.isin(*CITE_STOP))).otherwise(cue_tokens("prompt"))
    terms = [
        _if(F.col("_fits"), 32.0), _if(F.col("_box"), 14.0), F.least(F.lit(14.0), 2.0 * F.size(F.array_intersect(cue_tokens(combined), cue))),
        *[_if((family == f) & surface[s].rlike(p), w) for f, s, p, w in BLOCK_RULES], *[_if(F.lower(prompt).contains(word) & F.lower(body).contains(word), w) for word, w in SHARED_WORDS.items()],
        _if(family == "citation_lookup", _if(F.size(text.inline_citations(body)) > 0, 8.0) + citation_signal(prompt, path, body)),
    ]
    scored = rows.withColumn("score", F.round(reduce(add, terms), 6)).where("score > 0")
    first = F.row_number().over(Window.partitionBy("doc_id", "prompt", F.sha1(F.concat_ws("\n", "heading", F.substring("text", 1, 1200)))).orderBy(F.desc("score"), "order_index"))
    scored = scored.withColumn("_n", first).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("doc_id", "prompt").orderBy(F.desc("score"), "order_index"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("doc_id", "prompt", "block_id", "heading", "text", "score", "place")


def rescued(hits: DataFrame, deep: DataFrame, by: str = "query_id", k: int = 4) -> DataFrame:
    """hits: by, block_id, score (of a targeted scan).  deep: by, block_id, score (of a deep read).  The k best of the scan for each query; where it found nothing, those of the deep read, whose
    scores below 0.01 fall by a tenth from 1 on with their place."""
    rank = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "block_id"))).where(F.col("place") <= k)
    found = rank(hits.select(by, "block_id", "score")).withColumn("fallback", F.lit(False))
    rest = rank(deep.select(by, "block_id", "score").join(hits.select(by).distinct(), by, "left_anti")).withColumn("fallback", F.lit(True))
    rest = rest.withColumn("score", F.when(F.col("score") > 0, F.col("score")).otherwise(F.greatest(F.lit(0.01), 1.0 - (F.col("place") - 1) * 0.1)))
    return found.unionByName(rest)


#: What a summarising segment claims, and what a block says of it.
NOVELTY = "(?i)\\b(?:first(?:\\s+to)?|novel|novelty|innovation|innovative|contributions?|we\\s+propose|introduc(?:e|es|ed|ing)|camera\\s+pose\\s+stamps?|transformation\\s+network)\\b|首次|首个|首创|创新点|创新|贡献|提出"
RESULT = "(?i)\\b(?:extensive\\s+experiments?|experiments?\\s+demonstrate|high[- ]quality|novel[- ]view|outperform(?:s|ed|ing)?|surpass(?:es|ed|ing)?|superior|static(?:\\s+and)?\\s+dynamic|dynamic\\s+scenes?|static\\s+scenes?|multi-view\\s+consisten(?:t|cy))\\b|实验表明|高质量|新视角|优于|静态|动态|多视角一致"
CONTRIBUTION_BLOCK = "(?i)\\b(?:first(?:\\s+to)?|novel|we\\s+propose|introduc(?:e|es|ed|ing)|main\\s+contributions?|camera\\s+pose\\s+stamps?|transformation\\s+network)\\b|首次|首个|创新|贡献|提出"
RESULT_BLOCK = "(?i)\\b(?:extensive\\s+experiments?|experiments?\\s+demonstrate|high[- ]quality|novel[- ]view|outperform(?:s|ed|ing)?|surpass(?:es|ed|ing)?|superior|static(?:\\s+and)?\\s+dynamic|dynamic\\s+scenes?|static\\s+scenes?)\\b|实验表明|高质量|新视角|优于|静态|动态"
DEFINITION_BLOCK = "(?i)\\bis\\s+defined\\s+as\\b|\\bdefined\\s+as\\b|\\bparameterized\\s+as\\b|\\bcan\\s+be\\s+calculated\\s+by\\b|\\balpha\\s+blending\\b|\\bjacobian\\b|\\bwhere\\b.{0,48}\\b(?:denotes?|represents?|stands?\\s+for)\\b|定义为|表示|记为|其中.{0,16}(?:表示|代表|对应)"
LEAD_IN = "(?i)\\b(?:our\\s+main\\s+contributions?\\s+can\\s+be\\s+summarized\\s+as\\s+follows|main\\s+contributions?\\s+are\\s+as\\s+follows|contributions?\\s+are\\s+summarized\\s+as\\s+follows)\\b"
EXPERIMENT_HEADING = "experiment|setup|results|ablation|evaluation|dataset|implementation|baseline|comparison"


def summary_adjustment(segment: Column, block: Column, heading: Column, kind: Column) -> Column:
    """What a block is worth for a segment that claims something new or a result; 0 for other segments."""
    low = text.match_text(heading)
    new, result = segment.rlike(NOVELTY), segment.rlike(RESULT)
    definition, lead_in, item = block.rlike(DEFINITION_BLOCK), block.rlike(LEAD_IN), kind == "list_item"
    for_new = _if(block.rlike(CONTRIBUTION_BLOCK), 0.72 + _if(item, 0.18) + F.when(low.contains("abstract"), 0.18).when(low.contains("introduction"), 0.10).otherwise(0.0)) + _if(definition, -0.88) + _if(lead_in, -0.14)
    for_result = _if(block.rlike(RESULT_BLOCK), 0.58 + _if(item, 0.12) + F.when(low.rlike(EXPERIMENT_HEADING), 0.16).when(low.contains("abstract"), 0.08).otherwise(0.0)) + _if(definition, -0.46) + _if(lead_in, -0.10)
    total = _if(kind == "heading", -0.22) + _if(kind == "equation", -0.36) + _if(new, for_new) + _if(result, for_result)
    return F.when((new | result) & (block != ""), total).otherwise(0.0)
