"""Clean-up of converted Markdown: noise lines, levels, citations, tables, ligatures, reflow, and an analyzer of what is left."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _c, citation_set

#: Lines that carry no text of a paper, and typographic replacements.
NOISE_LINES = (
    "^ACM Trans\\. Graph\\., Vol\\.", "^Publication date:\\s+", "^ACM Transactions on Graphics\\b", "^Latest updates:\\s*", "^Check for updates\\s*$", "^RESEARCH-ARTICLE\\b", "^PDF Download\\b", "^Total Citations:", "^Total Downloads:",
    "^Citation in BibTeX format\\b", "^Open Access Support provided by:\\s*$", "^Contents lists available at\\s+ScienceDirect\\s*$", "^journal homepage:\\s+", "^A\\s+R\\s+T\\s+I\\s+C\\s+L\\s+E\\s+I\\s+N\\s+F\\s+O\\s*$", "^Article history\\s*$", "^Keywords:\\s*$",
    "^Optics and Laser Technology\\s*$", "^Optics Express\\s*$", "^Vol\\.\\s*\\d+\\s*,\\s*No\\.\\s*\\d+\\s*\\|\\s*\\d+.*OPTICS EXPRESS.*$", "^[A-Z]\\.\\s*[A-Za-z\\-']+\\s+et al\\.\\s*$", "^[0-9():,;\\s]{8,}$", "^\\s*\\d+:\\d+\\s*$", "^\\s*-\\s*$",
    "^\\s*REVIEW\\s+ARTICLE\\s*$", "^\\s*(?:NATURAL|NATURE)\\s+PHOTONICS\\s*$",
)
UNREADABLE = "(?i)\\((?:incomplete\\s+visible|partially\\s+visible|not\\s+fully\\s+visible)\\)|\\b(?:unreadable|illegible)\\b"
RUNNING_PAGE = "(?i)\\bpage\\s+\\d+\\s+of\\s+\\d+\\b"
RUNNING_SOURCE = "(?i)\\b(?:light:\\s*science\\s*&\\s*applications|optics express|natural photonics|nature photonics|advanced science news)\\b"
RUNNING_VOLUME, RUNNING_AUTHORS = "\\(\\d{4}\\)\\s+\\d+[:\\s]\\d+", "\\b[A-Z][a-z]+\\s+and\\s+[A-Z][a-z]+\\b"
REPLACED = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "“": '"', "”": '"', "‘": "'", "’": "'", "­": "", "​": ""}


def is_noise_line(x: Column | str) -> Column:
    """Boilerplate of publishers, with or without heading marks."""
    plain = F.trim(F.regexp_replace(_c(x), "\\s+", " "))
    bare = F.trim(F.regexp_replace(plain, "^#+\\s*", ""))
    pattern = "|".join(NOISE_LINES)
    return (plain != "") & (plain.rlike(pattern) | bare.rlike(pattern))


def is_running_header(x: Column | str) -> Column:
    """A page of pages beside a journal, a volume or a pair of authors."""
    plain = F.trim(F.regexp_replace(_c(x), "\\s+", " "))
    return plain.rlike(RUNNING_PAGE) & (plain.rlike(RUNNING_SOURCE) | plain.rlike(RUNNING_VOLUME) | plain.rlike(RUNNING_AUTHORS))


def without_noise(md: DataFrame) -> DataFrame:
    """md: doc_id, pos, line.  Lines without boilerplate and running headers, without what could not be read (outside of fences and formulas), and with one blank line for several."""
    own = Window.partitionBy("doc_id").orderBy("pos")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence, mark = F.col("line").rlike("^\\s*```"), F.trim("line") == "$$"
    rows = md.withColumns({"_f": F.sum(fence.cast("int")).over(so_far), "_m": F.sum((mark & ~fence).cast("int")).over(so_far)})
    outside = (F.col("_f") % 2 == 0) & (F.col("_m") % 2 == 0) & ~fence & ~mark
    rows = rows.where(~(outside & F.col("line").rlike(UNREADABLE)) & ~is_noise_line("line") & ~is_running_header("line")).drop("_f", "_m")
    blank = F.trim("line") == ""
    return rows.withColumn("_before", F.lag(blank).over(own)).where(~(blank & F.coalesce("_before", F.lit(False)))).drop("_before")


def numbered_level(x: Column | str) -> Column:
    """The level of a numbered heading: 2.1.3 has 3, an appendix letter 1, none 0."""
    number = F.regexp_extract(_c(x), "^#*\\s*((?:\\d+\\.)*\\d+|[A-Z](?:\\.\\d+)*)\\.?\\s+\\S", 1)
    return F.when(number == "", 0).otherwise(F.size(F.split(number, "\\.")))


def normal_citations(x: Column | str) -> Column:
    """[ 1, 2 ], $^{1,2}$ and $^{[1]}$ as [1,2]."""
    out = F.regexp_replace(_c(x), "\\$\\^\\{\\[?\\s*(\\d+(?:\\s*[,-]\\s*\\d+)*)\\s*\\]?\\}\\$", "[$1]")
    out = F.regexp_replace(out, "\\[\\s+(\\d)", "[$1")
    out = F.regexp_replace(out, "(\\d)\\s+\\]", "$1]")
    return F.regexp_replace(out, "(\\d)\\s*,\\s+(\\d+[\\],])", "$1,$2")


def array_to_rows(x: Column | str) -> Column:
    """The body of a TeX array as rows of cells."""
    body = F.regexp_extract(_c(x), "(?s)\\\\begin\\{(?:array|tabular)\\}(?:\\{[^}]*\\})?(.*?)\\\\end\\{(?:array|tabular)\\}", 1)
    rows = F.filter(F.split(F.replace(body, F.lit("\\hline"), F.lit("")), "\\\\\\\\"), lambda r: F.trim(F.replace(r, F.lit("\n"), F.lit(""))) != "")
    return F.transform(rows, lambda r: F.transform(F.split(r, "&"), lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))))


def folded(x: Column | str) -> Column:
    """Ligatures and quotes replaced, by built-in functions."""
    out = _c(x)
    for a, b in REPLACED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@F.pandas_udf(T.StringType())
def compatible(x: pd.Series) -> pd.Series:
    """Unicode compatibility form (no built-in function has it)."""
    return x.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def _reflow(text: str) -> str:
    out: list[str] = []
    fenced = False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        plain = not fenced and line.strip() and not re.match(r"\s*([#>|]|[-*+]\s|\d+\.\s|\$\$|```|!\[)", line)
        if plain and out and out[-1].strip() and not re.search(r"[.!?:|]\s*$", out[-1]) and not re.match(r"\s*([#>|]|\$\$|```|!\[)", out[-1]):
            last = out.pop().rstrip()
            out.append(last[:-1] + line.lstrip() if last.endswith("-") and line.lstrip()[:1].islower() else f"{last} {line.lstrip()}")
        else:
            out.append(line)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def reflowed(x: pd.Series) -> pd.Series:
    """Hard-wrapped lines of paragraphs joined, outside of fences, tables, lists and formulas."""
    return x.map(lambda t: t if t is None else _reflow(t))


#: What the analyzer looks for: headings that are formulas or captions, metadata lines, and lines that look like references.
FORMULA_HEADING = "^\\s*[A-Z]?\\s*\\d+\\s*[a-z]|^\\s*\\d+\\s*[a-z]+\\s*[+\\-]"
SHORT_FORMULA = "\\d+.*[a-z]|[a-z].*\\d+"
CAPTION = "(?:Fig\\.|Figure|Table|Algorithm)\\s*(?:\\d+|[IVXLC]+)"
METADATA = "(?i)^(?:ACM Trans\\.|Publication date:|PDF Download|Total Citations:|RESEARCH-ARTICLE|Latest updates:)"
SOURCE_WORDS = "(?i)\\b(?:doi|http|arxiv|vol\\.|pp\\.|pages?)\\b"


#: What is marked: issue: (category, severity).
ISSUES = {
    "formula_heading": ("heading", "error"), "skipped_level": ("heading", "warning"), "long_heading": ("heading", "info"), "body_text_heading": ("heading", "warning"), "caption_heading": ("heading", "error"), "no_title": ("structure", "info"), "many_titles": ("structure", "warning"),
    "short_formula": ("formula", "warning"), "open_inline": ("formula", "error"), "formulas_as_headings": ("formula", "error"), "no_formulas": ("formula", "info"), "one_row_table": ("table", "warning"), "uneven_table": ("table", "error"), "few_references": ("reference", "warning"),
    "metadata": ("noise", "warning"), "plain_caption": ("caption", "info"), "image_without_caption": ("caption", "warning"), "no_captions": ("caption", "warning"), "long_paragraph": ("structure", "info"),
}


def _marked(md: DataFrame) -> DataFrame:
    """md: doc_id, pos, line.  Its rows with a column an issue, the line it is about or null; and n (from 1), end (the last line), bar and run (the n at which a run of bars began).

    The lines are shuffled and sorted once; what is about a run, a paragraph or a document is marked where that ends."""
    own = Window.partitionBy("doc_id").orderBy("pos")
    so_far, before = own.rowsBetween(Window.unboundedPreceding, Window.currentRow), own.rowsBetween(Window.unboundedPreceding, -1)
    x, t, no = F.col("line"), F.trim("line"), F.col("line_no")
    c = F.col
    md = md.select("doc_id", "pos", "line").repartition("doc_id").sortWithinPartitions("doc_id", "pos").withColumn("line_no", (c("pos") + 1).cast("int"))

    # What a line is by itself.
    md = md.withColumns({"level": F.length(F.regexp_extract(x, "^(#{1,6})\\s+.+$", 1)), "title": F.when(x.startswith("#"), F.trim(F.regexp_extract(x, "^#{1,6}\\s+(.+)$", 1))), "headed": F.when(x.startswith("#") & x.rlike("^#+\\s+"), F.trim(F.regexp_replace(x, "^#+\\s+", "")))})
    section = c("title").rlike("^\\d+(?:\\.\\d+)*\\.?\\s+[A-Z][A-Za-z]")
    formula = c("title").rlike(FORMULA_HEADING + "|^\\s*[a-z]\\s*\\d+") | ((F.length("title") <= 10) & c("title").rlike(SHORT_FORMULA) & ~c("title").rlike("[A-Z]{2,}"))
    misread = c("headed").isNotNull() & (c("headed").rlike(FORMULA_HEADING) | ((F.length("headed") <= 15) & c("headed").rlike(SHORT_FORMULA) & c("headed").contains("=")))
    listed, blank = x.startswith("#") & x.rlike("(?i)^#+\\s*REFERENCES?\\s*$"), t == ""
    cited = ~listed & x.rlike("\\b(?:19|20)\\d{2}\\b") & (x.rlike(SOURCE_WORDS) | ((F.length(t) > 30) & x.contains(",")))
    md = md.withColumns({
        "formula": (c("level") > 0) & ~section & formula, "mark": x.contains("$$") & x.rlike("^\\s*\\$\\$\\s*$"), "odd": x.contains("$") & x.rlike("\\$[^$]+\\$") & (F.regexp_count(x, F.lit("\\$")) % 2 == 1), "misread": misread, "bar": t.startswith("|") & (F.regexp_count(t, F.lit("\\|")) >= 2),
        "width": F.when(t.startswith("|"), F.regexp_count(x, F.lit("\\|"))), "listed": listed, "cited": cited, "italic": x.contains("*") & x.rlike("(?i)^\\s*\\*.*?" + CAPTION), "plain": x.rlike("(?i)^\\s*" + CAPTION), "image": x.contains("![") & x.rlike("!\\[.*?\\]\\(.*?\\)"), "blank": blank,
        "text_line": ~blank & ~t.startswith("#") & ~t.startswith("|") & ~t.startswith("```"),
    })
    good, caption = (c("level") > 0) & ~c("formula"), c("italic") | c("plain")

    # What stands around it: lines of $$ alone open and close formulas in turn; blank lines end paragraphs.
    n = lambda cond: F.count(F.when(cond, 1)).over(so_far)
    last = lambda cond, value, over=so_far: F.last(F.when(cond, value), ignorenulls=True).over(over)
    md = md.withColumns({
        "n": F.row_number().over(own), "end": F.lead("line_no").over(own).isNull(), "above": last(good, c("level"), before), "goods": n(good), "firsts": n(good & (c("level") == 1)), "marks": n(c("mark")), "opened": last(c("mark"), no, before), "first_misread": F.min(F.when(c("misread"), no)).over(so_far),
        "was_bar": F.coalesce(F.lag("bar").over(own), F.lit(False)), "was_width": F.lag("width").over(own), "bar_next": F.lead("bar").over(own), "lists": n(c("listed")), "last_list": F.max(F.when(c("listed"), no)).over(so_far), "first_image": F.min(F.when(c("image"), no)).over(so_far), "captions": n(caption),
        "near": F.max(caption.cast("int")).over(own.rowsBetween(0, 3)), "texts": n(c("text_line")),
    })
    md = md.withColumns({
        "run": last(c("bar") & ~c("was_bar"), c("n")), "run_line": last(c("bar") & ~c("was_bar"), no), "uneven": last(c("bar") & c("was_bar") & (c("width") != c("was_width")), c("n")), "listing": n(c("cited") & (c("lists") > 0)), "done": F.coalesce(last(c("blank"), c("texts"), before), F.lit(0)),
    })
    md = md.withColumn("para_line", last(c("text_line") & (c("texts") - c("done") == 1), no))

    ends = c("bar") & ~c("bar_next")  # a run that reaches the end of the text is not judged
    one = F.lit(1)
    about = {
        "formula_heading": (c("formula"), no), "skipped_level": (good & (c("level") > F.coalesce("above", F.lit(0)) + 1), no), "long_heading": (good & (F.length("title") > 100), no), "body_text_heading": (good & (F.size(F.split("title", "\\s+")) > 15), no), "caption_heading": (good & c("title").rlike("(?i)^\\s*" + CAPTION), no),
        "no_title": (c("end") & (c("goods") > 0) & (c("firsts") == 0), one), "many_titles": (c("end") & (c("firsts") > 5), one), "short_formula": (c("mark") & (c("marks") % 2 == 0) & (no - c("opened") < 2), c("opened")), "open_inline": (~c("mark") & (c("marks") % 2 == 0) & c("odd"), no),
        "formulas_as_headings": (c("end"), c("first_misread")), "no_formulas": (c("end") & (c("n") > 50) & (c("marks") < 2), one), "one_row_table": (ends & (c("n") == c("run")), c("run_line")), "uneven_table": (ends & (c("n") > c("run")) & (c("uneven") > c("run")), c("run_line")),
        "few_references": (c("end") & (c("listing") < 5), c("last_list")), "metadata": (x.rlike(METADATA), no), "plain_caption": (~c("italic") & c("plain"), no), "image_without_caption": (c("image") & (c("near") == 0), no), "no_captions": (c("end") & (c("captions") == 0), c("first_image")),
        "long_paragraph": (c("blank") & (c("texts") - c("done") > 20), c("para_line")),
    }
    return md.select("doc_id", "pos", "line", "n", "end", "bar", "run", *[F.when(cond, line).alias(k) for k, (cond, line) in about.items()])


def issues(md: DataFrame) -> DataFrame:
    """md: doc_id, pos, line.  What an editor would mark, with the line it is about (from 1): doc_id, category, severity, issue, line_no."""
    each = [F.when(F.col(k).isNotNull(), F.struct(F.lit(kind).alias("category"), F.lit(severity).alias("severity"), F.lit(k).alias("issue"), F.col(k).alias("line_no"))) for k, (kind, severity) in ISSUES.items()]
    return _marked(md).where(F.coalesce(*ISSUES).isNotNull()).select("doc_id", F.inline(F.array_compact(F.array(*each))))


COUNTED = (
    "chars", "lines", "headings", "images", "captions", "table_blocks", "display_math", "inline_math", "reference_lines", "max_reference", "citations", "cited_numbers", "issues", "errors", "warnings",
)


def quality_summary(md: DataFrame) -> DataFrame:
    """md: doc_id, pos, line.  A row of 23 counts a document: sizes, headings by level, images, captions, tables, formulas, references, citations of the body, and what the analyzer finds."""
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x, t = F.col("line"), F.trim("line")
    level = F.length(F.regexp_extract(x, "^(#{1,6})\\s+.+$", 1))
    listed = t.startswith("#") & t.rlike("(?i)^#{1,6}\\s+References?\\s*$")
    single, mark = t.startswith("$$") & t.rlike("^\\$\\$.+\\$\\$$"), t == "$$"
    found = {w: sum((F.col(k).isNotNull().cast("int") for k, (_, severity) in ISSUES.items() if severity == w), F.lit(0)) for w in ("error", "warning", "info")}
    rows = _marked(md).select("doc_id", "pos", "line", "end", (F.col("bar") & (F.col("n") == F.col("run") + 1)).alias("second"), t.alias("t"), level.alias("level"), listed.alias("listed"), single.alias("single"), mark.alias("mark"), *[v.alias(k) for k, v in found.items()])
    rows = rows.withColumns({"marks": F.sum(F.col("mark").cast("int")).over(so_far), "begun": F.sum(F.col("listed").cast("int")).over(so_far) > 0})
    plain = ~F.col("single") & ~F.col("mark") & (F.col("marks") % 2 == 0)
    number = F.when(x.startswith("["), F.nullif(F.regexp_extract("line", "^\\[(\\d{1,4})\\]\\s+", 1), F.lit("")).cast("int"))
    marker = "\\[(\\d{1,4}(?:\\s*-\\s*\\d{1,4})?(?:\\s*,\\s*\\d{1,4}(?:\\s*-\\s*\\d{1,4})?)*)\\]"
    none = F.array().cast("array<string>")
    tokens = F.when(~F.col("begun") & x.contains("["), F.regexp_extract_all("line", F.lit(marker), F.lit(1))).otherwise(none)
    rows = rows.withColumns({"number": F.when(F.col("begun"), number), "tokens": tokens, "inline": F.when(plain & x.contains("$"), F.regexp_count("line", F.lit("(?<!\\$)\\$[^$]+?\\$(?!\\$)"))).otherwise(0)})
    rows = rows.withColumn("cited", F.when(F.size("tokens") > 0, F.flatten(F.transform("tokens", lambda m: citation_set(m, 200, 1000)))))
    n = F.count_if
    out = rows.groupBy("doc_id").agg(
        (F.sum(F.length("line") + 1) - 1).alias("chars"), (F.count("*") - n(F.col("end") & (F.col("line") == ""))).alias("lines"), n(F.col("t") != "").alias("nonempty_lines"), n(F.col("level") > 0).alias("headings"), n(F.col("level") == 1).alias("h1"), n(F.col("level") == 2).alias("h2"), n(F.col("level") >= 3).alias("h3_plus"),
        F.bool_or(x.startswith("#") & x.rlike("(?i)^#{1,6}\\s+Abstract\\s*$")).alias("has_abstract"), F.sum(F.when(x.contains("!["), F.regexp_count("line", F.lit("!\\[[^\\]]*\\]\\([^)]+\\)"))).otherwise(0)).alias("images"), n(F.col("t").rlike("(?i)^(?:\\*\\*)?(?:Figure\\b|Fig\\.|Table\\b|Algorithm\\b)")).alias("captions"),
        (n("single") + F.floor(n("mark") / 2)).alias("display_math"), F.sum("inline").alias("inline_math"), n("listed").alias("reference_headings"), F.count("number").alias("reference_lines"), F.coalesce(F.max("number"), F.lit(0)).alias("max_reference"),
        F.sum(F.size("tokens")).alias("citations"), F.sum(F.size(F.filter("tokens", lambda m: m.contains("-")))).alias("citation_ranges"), F.size(F.array_distinct(F.flatten(F.collect_list("cited")))).alias("cited_numbers"),
        n("second").alias("table_blocks"), F.sum(F.col("error") + F.col("warning") + F.col("info")).alias("issues"), *[F.sum(w).alias(f"{w}s") for w in found],
    )
    # A line break at the end of a text begins no line.
    return out.fillna(0)


def compared(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Two quality summaries: what the candidate has more of each of COUNTED, and eight flags of what it lost."""
    c = candidate.select("doc_id", *[F.col(m).alias(f"_{m}") for m in (*COUNTED, "has_abstract")])
    b = lambda m: F.col(m)
    now = lambda m: F.col(f"_{m}")
    flags = {
        "missing_abstract": b("has_abstract") & ~now("has_abstract"), "references_dropped": now("reference_lines") + 2 < b("reference_lines"), "reference_index_regressed": now("max_reference") + 1 < b("max_reference"), "tables_dropped": now("table_blocks") < b("table_blocks"),
        "images_dropped": now("images") < b("images"), "display_math_dropped": now("display_math") < b("display_math"), "errors_increased": now("errors") > b("errors"), "warnings_increased": now("warnings") > b("warnings"),
    }
    return base.join(c, "doc_id").select("doc_id", *[(now(m) - b(m)).alias(m) for m in COUNTED], *[v.alias(k) for k, v in flags.items()])


def issue_report(found: DataFrame) -> DataFrame:
    """Issues by category: how many of each severity, and the first lines."""
    severities = [F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")]
    return found.groupBy("doc_id", "category").agg(F.count("*").alias("n"), *severities, F.min("line_no").alias("first_line"), F.array_join(F.sort_array(F.collect_set("issue")), ",").alias("issues"))


def toc_parts(line: Column | str) -> Column:
    """A run of contents entries in one line, apart at their section numbers; a line with fewer than two, or without a page number at its end, is whole."""
    s = F.trim(F.regexp_replace(_c(line), "\\s+", " "))
    parts = F.filter(F.transform(F.split(F.regexp_replace(s, "(^|[^0-9])(\\d+\\.\\d+(?:\\.\\d+)*)", "$1\x01$2"), "\x01"), lambda v: F.trim(v)), lambda p: p.rlike("^\\d+\\.\\d+"))
    return F.when(s == "", F.array().cast("array<string>")).when((F.size(parts) >= 2) & s.rlike("\\b\\d{1,4}\\s*$"), parts).otherwise(F.array(s))


def without_page_number(heading: Column | str) -> Column:
    """A numbered heading without the page number (up to 500) behind it."""
    t = F.trim(F.regexp_replace(_c(heading), "\\s+", " "))
    page = F.regexp_extract(t, "^\\d+(?:\\.\\d+)*\\s+.+?\\s+(\\d{1,3})\\s*$", 1)
    return F.when((page != "") & (page.try_cast("int") <= 500), F.rtrim(F.regexp_extract(t, "^(\\d+(?:\\.\\d+)*\\s+.+?)\\s+\\d{1,3}\\s*$", 1))).otherwise(t)


def _columns(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(line), "\\t+|\\s{2,}"), lambda v: F.trim(v)), lambda c: c != "")


def is_code(lines: Column) -> Column:
    """Three lines or more with at least three points for arrows, keywords and indented lines."""
    x = F.array_join(lines, "\n")
    points = F.when(x.rlike("->|<-|:="), 2).otherwise(0) + F.when(x.rlike("(?mi)^\\s*(?:while|for|if|function)\\b"), 2).otherwise(0) + F.when(x.rlike("(?mi)\\bend (?:if|for|while|function)\\b"), 1).otherwise(0) + F.when(x.rlike("(?mi)\\breturn\\b"), 1).otherwise(0)
    indented = F.size(F.filter(lines, lambda v: v.rlike("^ {2,}"))) >= F.greatest(F.lit(2), F.floor(F.size(lines) / 3))
    return (F.size(lines) >= 3) & (points + F.when(indented, 1).otherwise(0) >= 3)


def is_table(lines: Column) -> Column:
    """Three lines or more of which two have bars, three have three columns, or three of these hold two numbers."""
    bars = F.size(F.filter(lines, lambda v: v.contains("|"))) >= 2
    rich = F.size(F.filter(lines, lambda v: F.size(_columns(v)) >= 3)) >= 3
    return (F.size(lines) >= 3) & (bars | rich)


def is_contents(lines: Column) -> Column:
    """Two of the first twenty lines have a section number and end with a page number."""
    one = lambda v: F.trim(v).rlike("(?:^|[^0-9])\\d+\\.\\d+(?:[^0-9]|$)") & F.trim(v).rlike("\\b\\d{1,4}\\s*$")
    return (F.size(lines) >= 2) & (F.size(F.filter(F.slice(lines, 1, 20), one)) >= 2)


def table_quality(rows: DataFrame, *by: str) -> DataFrame:
    """rows: by, pos, cells (an array without the outer bars), the header first and a rule second.  Per table: width, body rows, shares of filled
    slots, of sparse rows, of cells of one character and of long phrases, a score, and whether it is a table in earnest."""
    own = Window.partitionBy(*by).orderBy("pos")
    number = F.row_number().over(own)
    width = F.first(F.size("cells")).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = rows.withColumns({"n": number, "width": width})
    filled = F.filter("cells", lambda c: c != "")
    count = lambda p: F.size(F.filter(filled, p))
    r = r.select(
        *by, "n", "width", F.size("cells").alias("size"), F.size(filled).alias("filled"), count(lambda c: c.rlike("(?i)^[+-]?(?:\\d+(?:\\.\\d+)?|\\.\\d+)(?:%|e[+-]?\\d+)?$")).alias("numbers"), count(lambda c: F.length(c) <= 1).alias("tiny"),
        count(lambda c: c.rlike("^[A-Za-z]{1,2}$")).alias("tiny_words"), count(lambda c: F.regexp_count(c, F.lit("[A-Za-z]{2,}")) >= 8).alias("phrases"), count(lambda c: c != "---").alias("shown"),
    )
    body = lambda v: F.sum(F.when(F.col("n") > 2, v).otherwise(0))
    out = r.groupBy(*by).agg(
        F.first("width").alias("width"), F.greatest(F.count("*") - 2, F.lit(0)).alias("body_rows"), body(F.col("filled")).alias("cells"), body(F.col("numbers")).alias("numbers"), body(F.col("tiny")).alias("tiny"), body(F.col("tiny_words")).alias("tiny_words"), body(F.col("phrases")).alias("phrases"),
        body(F.when(F.col("filled") <= F.greatest(F.lit(1), F.floor(F.col("width") / 3)), 1).otherwise(0)).alias("sparse"), body(F.when(F.col("size") != F.col("width"), 1).otherwise(0)).alias("uneven"), F.sum("shown").alias("shown"),
    )
    n, lines = F.greatest(F.col("cells"), F.lit(1)), F.col("body_rows") + 2
    share = {"fill": F.col("cells") / F.greatest(F.col("body_rows") * F.col("width"), F.lit(1)), "sparse_share": F.col("sparse") / F.greatest(F.col("body_rows"), F.lit(1)), "tiny_share": F.col("tiny") / n, "word_share": F.col("tiny_words") / n, "phrase_share": F.col("phrases") / n}
    out = out.withColumns(share).withColumn("score", F.when(F.col("body_rows") > 0, F.col("width") * F.col("body_rows") + 0.08 * F.col("shown")).otherwise(0.0))
    sane = F.col("width").between(2, 18) & (F.col("body_rows") > 0) & (F.col("uneven") == 0) & (F.col("cells") > 0) & (F.col("fill") >= 0.36) & (F.col("sparse_share") <= 0.34) & ((F.col("numbers") > 0) | (lines < 5)) & (F.col("tiny_share") <= 0.35)
    sane = sane & (F.col("word_share") <= 0.22) & ~((lines > 12) & (F.col("word_share") > 0.10)) & ~((F.col("width") >= 5) & (F.col("word_share") > 0.14))
    sane = sane & (F.col("phrase_share") <= 0.55) & ~((F.col("phrase_share") > 0.38) & (F.col("numbers") / n < 0.12))
    return out.withColumn("sane", sane).select(*by, "width", "body_rows", *[F.round(c, 6).alias(c) for c in share], F.round("score", 4).alias("score"), "sane")


def body_size(spans: DataFrame, *by: str) -> DataFrame:
    """spans: size.  The most frequent font size to a tenth, the first seen of equals (the smallest pos); 10 without spans."""
    n = spans.withColumn("size", F.round("size", 1)).groupBy(*by, "size").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return n.groupBy(*by).agg(F.max_by("size", F.struct("n", -F.col("pos"))).alias("body_size"))


#: Lines of a converter's log.
STEP = "^\\s*\\[Page\\s+(\\d+)\\]\\s+Step\\s+(\\d+)\\s+\\(([^)]+)\\):\\s+(\\d+(?:\\.\\d+)?)s(?:,\\s*(.*))?$"
TOTAL = "^\\s*\\[Page\\s+(\\d+)\\]\\s+TOTAL:\\s+(\\d+(?:\\.\\d+)?)s\\s*$"
CROP = "(?i)^\\[VISION_DIRECT\\]\\[(REFS|LAYOUT)\\]\\s+page\\s+(\\d+)(?::\\s+(?:column|structured crop) mode enabled|\\s+crop\\s+\\d+/\\d+.*?\\s+done\\s+\\((\\d+(?:\\.\\d+)?)s,)"


def log_metrics(log: DataFrame, by: str = "run") -> DataFrame:
    """log: by, line.  Per run: timed pages with mean, median and 90th percentile of their seconds and of the vision step, pages of references and crops, and retries."""
    get = lambda p, k: F.nullif(F.regexp_extract("line", p, k), F.lit(""))
    rows = log.select(
        by, "line", F.coalesce(get(STEP, 1), get(TOTAL, 1), get(CROP, 2)).cast("int").alias("page"), get(STEP, 2).cast("int").alias("step"), get(STEP, 3).alias("label"), F.round(get(STEP, 4).cast("double"), 4).alias("seconds"),
        get(STEP, 5).rlike("(?:^|,\\s*)references=1\\b").alias("refs"), F.round(get(TOTAL, 2).cast("double"), 4).alias("total"), F.upper(get(CROP, 1)).alias("crop"), get(CROP, 3).cast("double").alias("crop_s"),
    )
    vision = (F.col("step") == 6) & (F.lower("label") == "vision convert")
    pages = rows.where("page is not null").groupBy(by, "page").agg(
        F.last("total", ignorenulls=True).alias("total"), F.last(F.when(vision, F.col("seconds")), ignorenulls=True).alias("vision"), F.coalesce(F.bool_or(F.when(F.col("step") == 1, F.col("refs"))), F.lit(False)).alias("refs"),
        F.coalesce(F.bool_or(F.col("crop") == "REFS"), F.lit(False)).alias("refs_column"), F.coalesce(F.bool_or(F.col("crop") == "LAYOUT"), F.lit(False)).alias("layout"),
    )
    stats = lambda c: [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(f"{c}_avg"), F.round(F.coalesce(F.percentile(c, 0.5), F.lit(0.0)), 4).alias(f"{c}_p50"), F.round(F.coalesce(F.percentile(c, 0.9), F.lit(0.0)), 4).alias(f"{c}_p90")]
    page = pages.groupBy(by).agg(F.count("*").alias("pages"), F.count("total").alias("timed"), *stats("total"), F.count("vision").alias("vision_pages"), *stats("vision"), F.count_if("refs").alias("refs_pages"), F.count_if("refs_column").alias("refs_column_pages"), F.count_if("layout").alias("layout_pages"))
    count = lambda p: F.count_if(F.col("line").rlike(p))
    calls = rows.groupBy(by).agg(
        F.count(F.when(F.col("crop") == "REFS", F.col("crop_s"))).alias("refs_crops"), F.round(F.coalesce(F.avg(F.when(F.col("crop") == "REFS", F.col("crop_s"))), F.lit(0.0)), 4).alias("refs_crop_avg"),
        count("\\[VISION_DIRECT\\] VL empty on page.*, retry ").alias("empty_retries"), count("\\[VISION_DIRECT\\] fragmented math detected on page").alias("math_retries"), count("falling back to extraction pipeline|using extraction fallback").alias("fallbacks"),
    )
    return calls.join(page, by, "left")


def unused_assets(assets: DataFrame, md: DataFrame, doc: str = "doc_id") -> DataFrame:
    """assets: doc, name.  Those that no image link of their document names."""
    links = md.select(doc, F.explode(F.regexp_extract_all("line", F.lit("!\\[[^\\]]*\\]\\(([^)]*)\\)"), F.lit(1))).alias("target")).select(doc, F.element_at(F.split("target", "/"), -1).alias("name"))
    return assets.join(links.distinct(), [doc, "name"], "left_anti")
