"""Text functions on columns: tokens, normal forms, extraction.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\x{4e00}-\\x{9fff}"
#: The token class of the index and the year and identifier patterns.
TOKEN = f"[A-Za-z0-9_]+|[{CJK}]"
YEAR = "(19\\d{2}|20\\d{2})"
DOI = "10\\.\\d{4,9}/[^\\s\"<>]+"
ARXIV = "(?i)arxiv[:\\s]*(\\d{4}\\.\\d{4,5})"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _all(x: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(pattern), F.lit(group))


def tokens(x: Column | str) -> Column:
    """ASCII words in lower case and single CJK characters; everything else separates."""
    return F.transform(_all(x, TOKEN), F.lower)


def match_tokens(x: Column | str) -> Column:
    """ASCII words of two characters or more, and CJK runs as overlapping bigrams (whole if of at most two characters)."""
    low = F.lower(_c(x))
    runs = F.transform(
        _all(low, f"[{CJK}]+"),
        lambda r: F.when(F.length(r) <= 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))),
    )
    return F.concat(_all(low, "[a-z0-9]{2,}"), F.flatten(runs))


def strip_inline(x: Column | str) -> Column:
    """Markdown without images, link targets, citation tokens, code, emphasis and tags."""
    out = F.regexp_replace(_c(x), "\\[\\[CITE:[^\\]]*\\]\\]", " ")
    out = F.regexp_replace(out, "!\\[[^\\]]*\\]\\([^)]*\\)", " ")
    out = F.regexp_replace(out, "\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    out = F.regexp_replace(out, "[`*~]+", "")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def match_text(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[\\s_]+", " "))


def has_cjk(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit("")).rlike(f"[{CJK}]")


def has_latin(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit("")).rlike("[A-Za-z]")


def prompt_locale(x: Column | str) -> Column:
    """zh where CJK characters are at least a third of CJK and Latin ones together."""
    cjk = F.length(F.regexp_replace(_c(x), f"[^{CJK}]", ""))
    latin = F.length(F.regexp_replace(_c(x), "[^A-Za-z]", ""))
    return F.when((cjk > 0) & (cjk * 3 >= cjk + latin), "zh").otherwise("en")


def heading_parts(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), " / "), lambda v: F.trim(v)), lambda p: p != "")


def top_heading(x: Column | str) -> Column:
    return F.element_at(F.split(_c(x), " / ", 2), 1)


def title_key(x: Column | str) -> Column:
    """A title without file ending, case and punctuation."""
    out = F.regexp_replace(F.trim(_c(x)), "(?i)\\.(pdf|md)$", "")
    out = F.regexp_replace(out, "[_-]+", " ")
    out = F.regexp_replace(out, "[^\\p{L}\\p{N}_ ]", " ")
    return F.trim(F.regexp_replace(F.lower(out), " +", " "))


def last_year(x: Column | str) -> Column:
    found = _all(x, YEAR, 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("int"))


def first_year(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(x), YEAR, 1), F.lit("")).cast("int")


def doi(x: Column | str) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(_c(x), DOI, 0)), "[.,;:)\\]}]+$", ""), F.lit(""))


def arxiv_id(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(x), ARXIV, 1), F.lit(""))


def doi_like(x: Column | str) -> Column:
    """A DOI, or that of an arXiv number."""
    return F.coalesce(doi(x), F.concat(F.lit("10.48550/arxiv."), arxiv_id(x)))


def citation_set(x: Column | str, widest: int = 12, most: int = 48) -> Column:
    """'1,3-5' as [1, 3, 4, 5]: distinct, in order of first sight; ranges wider than `widest` are dropped."""

    def numbers(part: Column) -> Column:
        low = F.regexp_extract(part, "^\\s*(\\d{1,4})", 1).cast("int")
        high = F.coalesce(F.nullif(F.regexp_extract(part, "-\\s*(\\d{1,4})\\s*$", 1), F.lit("")).cast("int"), low)
        return F.when((high >= low) & (high - low <= widest), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    parts = F.filter(F.split(F.translate(F.coalesce(_c(x), F.lit("")), "–—−;", "---,"), ","), lambda p: p.rlike("^\\s*\\d{1,4}(\\s*-\\s*\\d{1,4})?\\s*$"))
    return F.slice(F.array_distinct(F.flatten(F.transform(parts, numbers))), 1, most)


def inline_citations(x: Column | str) -> Column:
    """Distinct numbers of all [n], [a-b] and [a, b] marks in order of first sight."""
    marks = _all(x, "\\[(\\d{1,4}(?:\\s*[-,]\\s*\\d{1,4})*)\\]", 1)
    return F.array_distinct(F.flatten(F.transform(marks, lambda m: citation_set(m))))


def digit_mask(x: Column | str) -> Column:
    """Lower case with years and numbers as #."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "\\d+", "#"), "\\s+", " "))


def suggestion_text(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", " "))


def contains_phrase(text: Column | str, phrase: Column | str) -> Column:
    """Whether a whole phrase stands in a text; both normalised."""
    return F.concat(F.lit(" "), _c(text), F.lit(" ")).contains(F.concat(F.lit(" "), _c(phrase), F.lit(" ")))


def shouty(x: Column | str) -> Column:
    """At least 75 % of the ASCII letters in upper case and at most 20 % in lower case."""
    upper = F.length(F.regexp_replace(_c(x), "[^A-Z]", ""))
    lower = F.length(F.regexp_replace(_c(x), "[^a-z]", ""))
    return (upper + lower > 0) & (upper >= 0.75 * (upper + lower)) & (lower <= 0.20 * (upper + lower))


def issn(x: Column | str) -> Column:
    plain = F.regexp_replace(F.upper(F.coalesce(_c(x), F.lit(""))), "[^0-9X]", "")
    return F.when(F.length(plain) == 8, F.concat(F.substring(plain, 1, 4), F.lit("-"), F.substring(plain, 5, 4)))


def initials(x: Column | str) -> Column:
    return F.array_join(F.transform(_all(x, "[A-Za-z]+"), lambda w: F.upper(F.substring(w, 1, 1))), "")


def first_author(x: Column | str) -> Column:
    """The longest alphabetic token before the first comma, the first of equals."""
    words = F.regexp_extract_all(F.split(F.coalesce(_c(x), F.lit("")), ",", 2)[0], F.lit("[A-Za-z]+"), F.lit(0))
    return F.lower(F.aggregate(words, F.lit(None).cast("string"), lambda best, w: F.when(F.length(w) <= F.length(best), best).otherwise(w)))


def clean_reference(x: Column | str, most: int = 360) -> Column:
    """A reference without its lead mark and addresses, for a search."""
    out = F.regexp_replace(_c(x), "^\\s*(\\[\\d+\\]|\\d+\\.)\\s*", "")
    out = F.regexp_replace(out, "https?://\\S+", "")
    return F.substring(F.trim(F.regexp_replace(out, "\\s+", " ")), 1, most)


def equation_number(x: Column | str) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(_c(x), "\\\\tag\\{(\\d{1,3})\\}", 1), F.lit("")), F.nullif(F.regexp_extract(_c(x), "(?i)eq(?:uation)?s?\\.?\\s*\\(?(\\d{1,3})\\)?", 1), F.lit("")))
    return found.cast("int")


def figure_number(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(x), "(?i)fig(?:ure)?s?\\.?\\s*(\\d{1,3})", 1), F.lit("")).cast("int")


def join_hyphenated(lines: Column) -> Column:
    """Lines as one text; a word broken by a hyphen before a lower-case letter is joined."""
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "-\n([a-z])", "$1"), "\n", " ")


def sentences(x: Column | str) -> Column:
    """Sentences of at least 12 characters."""
    marked = F.regexp_replace(F.coalesce(_c(x), F.lit("")), "([.!?])\\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda v: F.trim(v)), lambda s: F.length(s) >= 12)


def norm_path(x: Column | str) -> Column:
    return F.lower(F.replace(_c(x), F.lit("\\"), F.lit("/")))


def stem(x: Column | str) -> Column:
    """The file name of a path without its ending and a trailing .en."""
    name = F.element_at(F.split(_c(x), "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, "\\.[^.]*$", ""), "\\.en$", "")
