"""What a reader sees: citations and markers in texts replaced by what they stand for, documents with their anchors, figures against files, and hits of a bound source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.naming import duplicate_norm

#: An inline citation, and a marker that an answer carries for its evidence.
CITATION = "\\[\\d{1,4}(?:\\s*[-,]\\s*\\d{1,4})*\\]"
MARKER = "\\[\\[SUPPORT:DOC-\\d{1,3}(?:-S\\d{1,3})?\\]\\]"
#: Words of a prompt that are no focus, and the least score of a category.
FOCUS_STOP = ("The", "This", "That", "Which", "What", "Where", "When", "Who", "How", "Why", "Does", "Do", "Is", "Are", "Please", "And", "Fig", "Figure", "Table", "Box")
CATEGORY_FLOOR = 3.2


def _replaced(x: Column, pattern: str, made) -> Column:
    """x with each match of the pattern replaced by made(match)."""
    parts = F.split(F.regexp_replace(x, f"({pattern})", "\x01$1\x01"), "\x01")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, made(p)).otherwise(p)), "")


def annotated(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """lines: doc_id, pos, line.  refs: doc_id, num, label (at most some hundred a document).  Lines in which the numbers of a citation that the document lists are links with their
    labels, and the others stay; known and unknown count them."""
    lists = refs.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("num", "label")))).alias("_refs"))
    out = lines.join(lists, "doc_id", "left").withColumn("_refs", F.coalesce("_refs", F.create_map().cast("map<int,string>")))
    one = lambda n: F.when(F.map_contains_key("_refs", n), F.concat(F.lit("["), n.cast("string"), F.lit("](#ref-"), n.cast("string"), F.lit(' "'), F.col("_refs")[n], F.lit('")'))).otherwise(n.cast("string"))
    link = lambda m: F.when(F.size(text.inline_citations(m)) > 0, F.concat(F.lit("["), F.array_join(F.transform(text.inline_citations(m), one), ", "), F.lit("]"))).otherwise(m)
    numbers = text.inline_citations("line")
    known = F.size(F.filter(numbers, lambda n: F.map_contains_key("_refs", n)))
    return out.select("doc_id", "pos", _replaced(F.col("line"), CITATION, link).alias("line"), known.alias("known"), (F.size(numbers) - known).alias("unknown"))


def resolved_markers(answers: DataFrame, slots: DataFrame, by: str = "answer_id") -> DataFrame:
    """answers: by, text.  slots: by, marker (DOC-1-S2), source, refs (numbers).  Answers in which each marker is the citation tokens of its slot, and markers without one are gone;
    resolved and dropped count them."""
    token = F.array_join(F.transform("refs", lambda n: F.concat(F.lit("[[CITE:"), F.col("source"), F.lit(":"), n.cast("string"), F.lit("]]"))), "")
    lists = slots.select(by, F.upper("marker").alias("marker"), token.alias("token")).groupBy(by, "marker").agg(F.min("token").alias("token")).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("marker", "token"))).alias("_slots"))
    out = answers.join(lists, by, "left").withColumn("_slots", F.coalesce("_slots", F.create_map().cast("map<string,string>")))
    key = lambda m: F.regexp_extract(m, "SUPPORT:(DOC-[0-9]+(?:-S[0-9]+)?)", 1)
    marks = F.transform(F.regexp_extract_all("text", F.lit(MARKER), F.lit(0)), key)
    resolved = F.size(F.filter(marks, lambda m: F.coalesce(F.col("_slots")[m], F.lit("")) != ""))
    body = _replaced(F.col("text"), MARKER, lambda m: F.coalesce(F.col("_slots")[key(m)], F.lit("")))
    return out.select(by, body.alias("text"), resolved.alias("resolved"), (F.size(marks) - resolved).alias("dropped"))


def is_bound(hit_path: Column, path: str, name: str = "") -> Column:
    """Whether a hit is of the bound source: by its path, else by the stem of its path or name."""
    wanted = F.lower(text.stem(F.lit(name or path)))
    return (text.norm_path(hit_path) == text.norm_path(F.lit(path))) | (F.lower(text.stem(hit_path)) == wanted)


def bound_hits(hits: DataFrame, path: str, name: str = "") -> DataFrame:
    return hits.where(is_bound(F.col("path"), path, name))


def unbound_hits(hits: DataFrame, path: str, name: str = "") -> DataFrame:
    return hits.where(~F.coalesce(is_bound(F.col("path"), path, name), F.lit(False)))


def reconciled_figures(md: DataFrame, figures: DataFrame) -> DataFrame:
    """md: doc_id, pos, line.  figures: doc_id, asset, page.  Images of the text against the rows of pages by asset: both, or only one of them; the first line of an image counts."""
    links = md.select("doc_id", "pos", F.explode(F.regexp_extract_all("line", F.lit("!\\[[^\\]]*\\]\\(([^)]*)\\)"), F.lit(1))).alias("target"))
    links = links.groupBy("doc_id", F.element_at(F.split("target", "/"), -1).alias("asset")).agg(F.min("pos").alias("pos"), F.count("*").alias("links"))
    both = links.join(figures, ["doc_id", "asset"], "full_outer")
    state = F.when(F.col("pos").isNull(), "not shown").when(F.col("page").isNull(), "not known").otherwise("matched")
    return both.withColumn("state", state)


def reader_documents(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """blocks: doc_id, order_index, line.  A row a document: its text, and its anchors in order."""
    body = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "line"))), lambda r: r["line"]), "\n").alias("text"))
    marks = anchors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "anchor_id", "block_id", "kind", "heading_path"))).alias("anchors"))
    return body.join(marks, "doc_id", "left")


def asset_links(x: Column | str, root: str, prefix: str = "/api/references/asset?path=") -> Column:
    """Relative image links of a text as addresses below an asset root; those with a scheme, an anchor or an address of their own stay, and so do those that leave the root."""
    parts = F.split(F.regexp_replace(text._c(x), "(!\\[[^\\]]*\\]\\([^)]*\\))", "\x01$1\x01"), "\x01")

    def rewritten(p: Column) -> Column:
        url = F.trim(F.regexp_extract(p, "\\(\\s*<?([^)\\s>]*)", 1))
        stays = (url == "") | F.lower(url).rlike("^(?:https?://|data:|#|/)") | url.rlike("(?:^|/)\\.\\.(?:/|$)")
        return F.when(stays, p).otherwise(F.concat(F.regexp_extract(p, "^(!\\[[^\\]]*\\])", 1), F.lit("(" + prefix), F.replace(F.url_encode(F.concat(F.lit(root.rstrip("/") + "/"), url)), F.lit("+"), F.lit("%20")), F.lit(")")))

    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, rewritten(p)).otherwise(p)), "")


def focus_terms(x: Column | str, most: int = 8) -> Column:
    """What a prompt is about: quoted phrases, and words with capitals inside, digits or hyphens; without those that stand within a longer one."""
    x = text._c(x)
    quoted = F.regexp_extract_all(x, F.lit("[\"']([^\"']{2,80})[\"']"), F.lit(1))
    words = F.filter(F.regexp_extract_all(x, F.lit("[A-Za-z][A-Za-z0-9_-]{1,40}"), F.lit(0)), lambda w: (F.substring(w, 2, 100).rlike("[A-Z]") | w.rlike("[0-9-]")) & ~w.isin(*FOCUS_STOP))
    terms = F.array_distinct(F.filter(F.transform(F.concat(quoted, words), lambda t: duplicate_norm(t)), lambda t: F.length(t) >= 3))
    return F.slice(F.filter(terms, lambda t: ~F.exists(terms, lambda o: (o != t) & (F.length(o) > F.length(t)) & o.contains(t) & ~o.rlike("\\b(?:and|vs|versus)\\b"))), 1, most)


def focus_matches(terms: Column, surface: Column) -> Column:
    """How many of the terms stand on a surface."""
    low = F.concat(F.lit(" "), duplicate_norm(surface), F.lit(" "))
    return F.size(F.filter(terms, lambda t: low.contains(F.concat(F.lit(" "), t, F.lit(" ")))))


def suggested_category(scores: DataFrame, meta: DataFrame) -> DataFrame:
    """scores: doc_id, category, score.  meta: doc_id, category (the current one) and dismissed.  The category that is suggested to a document without one: its best but for the dismissed
    one, if it has CATEGORY_FLOOR."""
    own = scores.join(meta.select("doc_id", F.col("category").alias("_now"), "dismissed"), "doc_id", "left").where("coalesce(_now, '') = '' and not (category <=> dismissed)")
    best = own.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.lower("category").alias("l"), "category", "score")).alias("b"))
    return best.select("doc_id", "b.category", "b.score").where(F.col("score") >= CATEGORY_FLOOR)
