"""References of documents: entries from lines, catalogs, audits, and matching with metadata rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..sources.shared import cut, kept
from .prompts import is_promising_reference


def entries(md: DataFrame) -> DataFrame:
    """md: doc_id, pos, line.  Numbered entries behind the last References heading; lines without a mark continue the entry before."""
    own = Window.partitionBy("doc_id")
    head = F.when(F.col("line").rlike("(?i)^#+\\s*(references|bibliography)\\s*$"), F.col("pos"))
    tail = md.withColumn("start", F.max(head).over(own)).where("pos > start")
    later = F.min(F.when(F.col("line").rlike("^#+\\s"), F.col("pos"))).over(own)
    tail = tail.withColumn("stop", later).where("stop is null or pos < stop")
    mark = F.nullif(F.regexp_extract("line", "^\\s*(?:\\[(\\d{1,4})\\]|(\\d{1,4})\\.)\\s", 1), F.lit(""))
    mark = F.coalesce(mark, F.nullif(F.regexp_extract("line", "^\\s*(\\d{1,4})\\.\\s", 1), F.lit(""))).cast("int")
    run = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tail = tail.withColumn("mark", mark).withColumn("num", F.last("mark", ignorenulls=True).over(run)).where("num is not null")
    return tail.groupBy("doc_id", "num").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.trim("line").alias("line")))), lambda r: r["line"]), " ").alias("raw"))


def without_outliers(entry: DataFrame) -> DataFrame:
    """Drops numbers that are years, and those beyond 1.6 times the entries of a document and 20 more (between 80 and 500)."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    cap = F.least(F.greatest(1.6 * n + 20, F.lit(80)), F.lit(500))
    return entry.where(~F.col("num").between(1900, 2099)).withColumn("cap", cap).where("num <= cap").drop("cap")


def catalog(entry: DataFrame) -> DataFrame:
    """Per document: ref_count, first and last number, missing numbers, and whether the numbers go on without a gap."""
    out = entry.groupBy("doc_id").agg(F.countDistinct("num").alias("ref_count"), F.min("num").alias("first_num"), F.max("num").alias("last_num"), F.sort_array(F.collect_set("num")).alias("nums"))
    out = out.withColumn("missing", F.slice(F.array_except(F.sequence("first_num", "last_num"), "nums"), 1, 128))
    status = F.when(F.size("missing") > 0, "gapped").when(F.col("first_num") > 1, "offset").otherwise("continuous")
    return out.select("doc_id", "ref_count", "first_num", "last_num", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"), status.alias("status"))


def parsed(entry: DataFrame) -> DataFrame:
    """entry with doi, year, first author, a cleaned text and a parse confidence."""
    return entry.select("*", text.doi_like("raw").alias("doi"), text.last_year("raw").alias("year"), text.first_author(text.clean_reference("raw")).alias("author"), text.clean_reference("raw").alias("clean"), F.round(scoring.parse_confidence(F.col("raw")), 4).alias("confidence"))


def audit(refs: DataFrame) -> DataFrame:
    """refs: doc_id, doi, title, match_method.  Counts of what is missing and a repair score."""
    n = lambda c: F.count_if(c)
    out = refs.groupBy("doc_id").agg(
        F.count("*").alias("refs"),
        n(F.coalesce("doi", F.lit("")) == "").alias("missing_doi"),
        n(F.coalesce("title", F.lit("")) == "").alias("empty_title"),
        n(F.coalesce("match_method", F.lit("")) == "").alias("blank_match"),
        n(F.col("match_method") == "unresolved").alias("unresolved"),
    )
    return out.withColumn("repair_score", 3 * F.col("missing_doi") + 2 * F.col("empty_title") + F.col("blank_match") + 2 * F.col("unresolved"))


#: Bonuses of equal and near years and of equal authors, maluses of others, and the floors of a match by content and by number.
STRICT = {"year": 0.14, "near": 0.05, "other_year": 0.08, "author": 0.10, "other_author": 0.04, "doi": 0.03}
LENIENT = {"year": 0.10, "near": 0.04, "other_year": 0.0, "author": 0.08, "other_author": 0.0, "doi": 0.02}
CONTENT_FLOOR, NUMBER_FLOOR = 0.63, 0.56


def row_score(raw: Column, row_text: Column, row_doi: Column, row_year: Column, row_author: Column, weights: dict[str, float], known: dict[str, Column] | None = None) -> Column:
    """How well a row of a source's reference list fits a raw entry: 1 for the same DOI, else similarity of texts with year, author and DOI; null for a row without text.  known: what raw_fields() and the title key of
    the row's text say, where it is at hand."""
    own = known or {**raw_fields(raw), "row_key": text.title_key(row_text)}
    a, b = own["key"], own["row_key"]
    words = lambda x: F.array_remove(F.split(x, " "), "")
    similar = F.when((a != "") & (b != ""), 0.68 * scoring.sequence_ratio(a, b) + 0.32 * scoring.jaccard(F.array_distinct(words(a)), F.array_distinct(words(b)))).otherwise(0.0)
    gap = F.abs(row_year.try_cast("int") - own["own_year"])
    by_year = F.when(own["own_year"].isNull(), 0.0).when(gap == 0, weights["year"]).when(gap <= 1, weights["near"]).otherwise(-weights["other_year"])
    author = own["own_author"]
    by_author = F.when(F.coalesce(author, F.lit("")) == "", 0.0).when(F.lower(row_author).contains(author), weights["author"]).otherwise(-weights["other_author"])
    score = similar + by_year + by_author + F.when(F.coalesce(row_doi, F.lit("")) != "", weights["doi"]).otherwise(0.0)
    return F.when(F.lower(row_doi) == own["own_doi"], 1.0).when(F.coalesce(row_text, F.lit("")) != "", scoring.clamp(score, 0, 1))


def raw_fields(raw: Column) -> dict[str, Column]:
    return {"key": text.title_key(raw), "own_year": text.last_year(raw), "own_author": text.first_author(text.clean_reference(raw)), "own_doi": text.doi_like(raw)}


def _scored(pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """pairs with score.  Equal pairs of texts go to one task, which compares them once; what is found in a text is taken from the pair, where it is there."""
    tasks = 8 * pairs.sparkSession.sparkContext.defaultParallelism  # a set number, as a pair takes longer than its bytes let the optimizer think
    found = {**raw_fields(F.col("raw")), "row_key": text.title_key("row_text")}
    new = [c for c in found if c not in pairs.columns]
    keyed = pairs.withColumns({c: found[c] for c in new}).repartition(tasks, "key", "row_key")
    fields = [F.col(c) for c in ("raw", "row_text", "doi", "year", "author")]
    return keyed.withColumn("score", row_score(*fields, weights, {c: F.col(c) for c in found})).drop(*new)


class _Lists:
    """Entries and rows with ids of their contents in place of these, and each content once with what is found in it: entries and rows of many documents that say the same are read and compared once."""

    def __init__(self, refs: DataFrame, rows: DataFrame):
        content = lambda *c: F.unhex(F.md5(F.to_json(F.struct(*c))))
        fields = ["row_text", "doi", "year", "author"]
        refs = kept(refs.select("doc_id", "num", "raw", content("raw").alias("raw_id")), "entries")
        rows = kept(rows.withColumnRenamed("text", "row_text").select("doc_id", "pos", *fields, content(*fields).alias("row_id")), "rows")
        self.refs, self.rows = refs.select("doc_id", "num", "raw_id"), rows.select("doc_id", "pos", "row_id")
        entry = refs.groupBy("raw_id").agg(F.any_value("raw").alias("raw"))
        row = rows.groupBy("row_id").agg(*[F.any_value(c).alias(c) for c in fields])
        telling = F.regexp_count(F.regexp_replace("row_text", text.DOI, " "), F.lit("[A-Za-z\\x{4e00}-\\x{9fff}]{2,}")) >= 4
        self.entries = cut(entry.withColumns({**raw_fields(F.col("raw")), "blank": F.trim("raw") == ""}))
        self.sources = cut(row.withColumns({"row_key": text.title_key("row_text"), "telling": telling}))

    def scored(self, pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
        """pairs (with raw_id and row_id) with score and whether the pair tells anything; contents are compared once a pair of them."""
        once = pairs.select("raw_id", "row_id").where("row_id is not null").distinct().join(self.entries, "raw_id").join(self.sources, "row_id")
        tells = F.col("telling") | ((F.coalesce("doi", F.lit("")) != "") & F.col("own_doi").isNotNull())
        return pairs.join(cut(_scored(once, weights).select("raw_id", "row_id", "score", tells.alias("tells"))), ["raw_id", "row_id"], "left")


def order_rules(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """refs: doc_id, num, raw.  rows: doc_id, pos (from 1), text, doi, year, author.  Per document: exact, prefix and loose, whether its entries may be
    mapped to the rows by their numbers.  The numbers count only if a sample of up to eight of them fits; with fewer than four, or fewer than three that
    say anything, they do."""
    return _rules(_Lists(refs, rows))


def _rules(lists: _Lists) -> DataFrame:
    refs, rows = lists.refs, lists.rows
    lengths = rows.groupBy("doc_id").agg(F.max("pos").alias("rows"))
    own = refs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("num")).alias("nums")).join(lengths, "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("num")) - 1
    said = refs.join(lists.entries.where("not blank").select("raw_id"), "raw_id")
    there = said.join(lengths, "doc_id").where(F.col("num") <= F.col("rows")).withColumns({"i": place, "n": F.count("*").over(Window.partitionBy("doc_id"))})
    half = F.floor(F.col("n") / 2)
    sampled = there.where((F.col("n") >= 4) & (F.col("i").isin(0, 1, 2) | F.col("i").isin(half, half - 1, F.col("n") - 1, F.col("n") - 2, F.col("n") - 3)))
    listed = rows.select(F.col("doc_id").alias("_doc"), "pos", "row_id")
    scored = sampled.join(listed, (F.col("doc_id") == F.col("_doc")) & (F.col("num") == F.col("pos"))).select("doc_id", "raw_id", "row_id")
    scored = lists.scored(scored, STRICT).where("tells and score is not null")
    fits = scored.groupBy("doc_id").agg(F.count("*").alias("k"), F.count_if(F.col("score") >= 0.66).alias("strong"), F.count_if(F.col("score") >= 0.56).alias("ok"), F.avg("score").alias("mean"))
    enough = (F.col("ok") >= F.greatest(F.lit(3), F.ceil(F.col("k") * 0.60 - 0.001))) & (F.col("strong") >= F.greatest(F.lit(2), F.ceil(F.col("k") * 0.30 - 0.001))) & (F.col("mean") >= 0.58)
    aligned = fits.select("doc_id", ((F.col("k") < 3) | enough).alias("aligned"))
    out = own.join(aligned, "doc_id", "left").withColumn("aligned", F.coalesce("aligned", F.lit(True)))
    first = F.least("rows", "n")
    run = lambda m: F.slice(F.col("nums"), 1, m) == F.sequence(F.lit(1), m)
    inside = F.size(F.filter("nums", lambda x: x.between(1, F.col("rows")))) / F.col("n")
    return out.select("doc_id", "rows", (F.col("aligned") & (F.col("n") == F.col("rows")) & run(F.col("n").cast("int"))).alias("exact"), (F.col("aligned") & run(first.cast("int"))).alias("prefix"), (F.col("aligned") & (F.col("n") >= 8) & (inside >= 0.75)).alias("loose"))


def match_rows(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """refs and rows as in order_rules().  doc_id, num, pos, method and score of the row that each entry is mapped to: by order, by number (from
    NUMBER_FLOOR on), by number loosely, or by content, an equal DOI or the best score from CONTENT_FLOOR on, the first of equals.

    What is left for content is compared with all rows of its own document.  Their number is bounded: without_outliers() leaves at most 500 entries, and a list of
    references is as long; documents are never compared with one another."""
    lists = _Lists(refs, rows)
    listed = lists.rows.select(F.col("doc_id").alias("_doc"), "pos", "row_id")
    at = lists.refs.join(_rules(lists), "doc_id").join(listed, (F.col("doc_id") == F.col("_doc")) & (F.col("num") == F.col("pos")), "left").drop("_doc")
    at = lists.scored(at, LENIENT).withColumn("score", F.round("score", 6))
    ordered = F.col("exact") | (F.col("prefix") & (F.col("num") <= F.col("rows")))
    method = F.when(F.col("pos").isNull(), None).when(ordered, "order").when(F.col("score") >= NUMBER_FLOOR, "number").when(F.col("loose"), "loose")
    at = cut(at.select("doc_id", "num", "pos", method.alias("method"), "score", F.when(method.isNull(), F.col("raw_id")).alias("raw_id")))
    rest = at.where("method is null").select("doc_id", "num", "raw_id").join(listed, F.col("doc_id") == F.col("_doc")).drop("_doc")
    rest = lists.scored(rest, STRICT).withColumn("score", F.round("score", 6)).where(F.col("score") >= CONTENT_FLOOR)
    best = rest.groupBy("doc_id", "num").agg(F.max(F.struct("score", (-F.col("pos")).alias("less"))).alias("b"))
    found = best.select("doc_id", "num", (-F.col("b.less")).alias("pos"), F.lit("content").alias("method"), F.col("b.score").alias("score"))
    columns = ["doc_id", "num", "pos", "method", "score"]
    return at.where("method is not null").select(columns).unionByName(found.select(columns))


def enrichment(refs: DataFrame) -> DataFrame:
    """refs: doc_id, raw, doi, title, authors, resolved.  Per document, of the entries that look like references: those without DOI or record, and of the
    others those without title or authors."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    missing = empty("doi") & ~F.col("resolved")
    fit = is_promising_reference("raw")
    return refs.groupBy("doc_id").agg(F.count_if(fit & missing).alias("unresolved"), F.count_if(fit & ~missing & (empty("title") | empty("authors"))).alias("sparse"))


def index_statistics(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """docs: doc_id, reused.  refs: doc_id, doi, resolved, method.  One row of counters of an index build."""
    return docs.agg(F.count("*").alias("docs_total"), F.count_if(~F.col("reused")).alias("docs_updated"), F.count_if("reused").alias("docs_reused")).crossJoin(
        F.broadcast(refs.agg(  # one row
            F.count("*").alias("refs_total"), F.count_if(F.coalesce("doi", F.lit("")) != "").alias("refs_with_doi"), F.count_if("resolved").alias("refs_resolved"),
            F.count_if(F.col("method").isNotNull()).alias("refs_mapped"),
        ))
    )


def merged(base: DataFrame, extra: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base with empty fields filled from extra."""
    other = extra.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = base.join(other, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in base.columns])


def validated_citations(cited: DataFrame, entry: DataFrame) -> DataFrame:
    """cited: doc_id, num.  Per document: citations kept (their entry exists) and dropped."""
    joined = cited.join(entry.select("doc_id", "num", F.lit(True).alias("known")).distinct(), ["doc_id", "num"], "left")
    return joined.groupBy("doc_id").agg(F.count("*").alias("cited"), F.count_if("known").alias("kept"), F.count_if(F.col("known").isNull()).alias("dropped"))


def resolve(wanted: DataFrame, library: DataFrame) -> DataFrame:
    """wanted: want_id, path, sha1.  library: path, sha1.  The library path of each: by normalised path, else content hash, else stem."""
    lib = library.select(text.norm_path("path").alias("lib_norm"), F.col("sha1").alias("lib_sha1"), F.lower(text.stem("path")).alias("lib_stem"), F.col("path").alias("found"))

    def lookup(key: str, name: str) -> DataFrame:
        return lib.groupBy(key).agg(F.min("found").alias(name))

    out = wanted.withColumn("norm", text.norm_path("path")).withColumn("stem", F.lower(text.stem("path")))
    out = out.join(lookup("lib_norm", "by_path"), F.col("norm") == F.col("lib_norm"), "left").join(lookup("lib_sha1", "by_sha1"), F.col("sha1") == F.col("lib_sha1"), "left").join(lookup("lib_stem", "by_stem"), F.col("stem") == F.col("lib_stem"), "left")
    how = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_sha1").isNotNull(), "sha1").when(F.col("by_stem").isNotNull(), "stem").otherwise("none")
    return out.select("want_id", F.coalesce("by_path", "by_sha1", "by_stem").alias("found"), how.alias("how"))


def path_suffix_score(a, b, most: int = 8):
    """Number of equal trailing parts of two paths."""
    left, right = F.reverse(F.split(text.norm_path(a), "/")), F.reverse(F.split(text.norm_path(b), "/"))
    same = F.zip_with(left, right, lambda x, y: F.coalesce(x == y, F.lit(False)))
    state = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))
    return F.least(state["n"], F.lit(most))


#: The gates of a match by title and by the whole text.
TITLE_FLOOR, TITLE_ALONE, TITLE_ALONE_SCORE, VENUE_FLOOR = 0.88, 0.94, 0.96, 0.90
BIBLIOGRAPHIC_FLOOR, YEAR_FLOOR, AUTHOR_FLOOR = 0.62, 0.72, 0.74


def similarity(a: Column, b: Column, weight: float) -> Column:
    """weight * sequence ratio + (1 - weight) * Jaccard of two titles in normal form."""
    return key_similarity(text.title_key(a), text.title_key(b), weight)


def key_similarity(x: Column, y: Column, weight: float) -> Column:
    """similarity() of normal forms."""
    words = lambda v: F.array_distinct(F.array_remove(F.split(v, " "), ""))
    return F.when((x != "") & (y != ""), weight * scoring.sequence_ratio(x, y) + (1 - weight) * scoring.jaccard(words(x), words(y))).otherwise(0.0)


def venue_similarity(expected: Column, got: Column) -> Column:
    """1 for equal venues, .92 where one holds the other, .96 for equal (or contained) beginnings of their words, .94 for equal initials, else their similarity."""
    a, b = text.title_key(expected), text.title_key(got)
    words = lambda v: F.split(text.title_key(F.replace(F.regexp_replace(v, "([a-z])([A-Z])", "$1 $2"), F.lit("&"), F.lit(" and "))), " ")
    part = lambda v, n: F.array_join(F.transform(words(v), lambda w: F.substring(w, 1, n)), "")
    shape_a, shape_b, first_a, first_b = part(expected, 4), part(got, 4), part(expected, 1), part(got, 1)
    shaped = (shape_a != "") & (shape_b != "") & (shape_a.contains(shape_b) | shape_b.contains(shape_a))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.92).when(shaped, 0.96).when((first_a != "") & (first_a == first_b), 0.94).otherwise(similarity(expected, got, 0.72))


def best_by_title(wanted: DataFrame, candidates: DataFrame, least: float = 0.90, title_only: bool = False) -> DataFrame:
    """wanted: want_id, title, year, venue, doi (empty where unknown).  candidates: want_id, rank, title, year, venue, doi (what a search gave for it).  The record of each: that of its DOI where the titles agree,
    else the best by title with year and venue, ties by venue, then year, then rank, if it passes the gates: a known year must match, else a known venue must fit, else the
    title alone must (if that is allowed)."""
    pairs = candidates.select("want_id", "rank", *[F.col(c).alias(f"c_{c}") for c in ("title", "year", "venue", "doi")], text.title_key("title").alias("c_key")).join(wanted.withColumn("key", text.title_key("title")), "want_id")
    known_year, known_venue = F.col("year") != "", F.col("venue") != ""
    pairs = pairs.withColumns({"similar": key_similarity(F.col("key"), F.col("c_key"), 0.72), "same_year": known_year & (F.col("year") == F.col("c_year")), "fit": F.when(known_venue, venue_similarity(F.col("venue"), F.col("c_venue"))).otherwise(0.0)})
    score = F.col("similar") + F.when(~known_year, 0.0).when(F.col("same_year"), 0.06).otherwise(-0.10) + F.when(known_venue, 0.05 * (2 * F.col("fit") - 1)).otherwise(0.0)
    pairs = pairs.withColumn("score", F.round(score, 9))
    doi = (F.col("doi") != "") & (F.lower("doi") == F.lower("c_doi")) & ((F.col("title") == "") | (F.col("similar") >= 0.80))
    pairs = pairs.withColumn("by_doi", doi)
    own = Window.partitionBy("want_id").orderBy(F.desc("by_doi"), F.desc("score"), F.desc("fit"), F.desc("same_year"), "rank")
    best = pairs.withColumn("_n", F.row_number().over(own)).where("_n = 1")
    gates = F.when(known_year, F.col("same_year")).when(known_venue, F.col("fit") >= VENUE_FLOOR).otherwise(F.lit(title_only) & (F.col("similar") >= TITLE_ALONE) & (F.col("score") >= max(least, TITLE_ALONE_SCORE)))
    kept = F.col("by_doi") | (gates & (F.col("score") >= least) & (F.col("similar") >= TITLE_FLOOR) & (F.col("title") != ""))
    shown = F.when(F.col("by_doi"), F.greatest(F.lit(0.97), F.col("similar"))).otherwise(scoring.clamp(F.col("score"), 0, 1))
    return best.where(kept).select("want_id", "rank", F.when(F.col("by_doi"), "doi").otherwise("title").alias("method"), F.round("similar", 4).alias("similar"), F.round(shown, 4).alias("score"))


def best_by_text(wanted: DataFrame, candidates: DataFrame, least: float = BIBLIOGRAPHIC_FLOOR) -> DataFrame:
    """wanted: want_id, raw.  candidates: want_id, rank, text, year, authors (family names), doi.  The best record of each raw reference by its whole text with year, first author
    and a DOI, the first of equals; another year or author needs a higher score."""
    raw = wanted.where(is_promising_reference("raw")).select("want_id", text.title_key("raw").alias("key"), text.last_year("raw").alias("year"), F.coalesce(text.first_author(text.clean_reference("raw")), F.lit("")).alias("author"))
    pairs = candidates.select("want_id", "rank", text.title_key("text").alias("c_key"), F.col("year").try_cast("int").alias("c_year"), F.transform("authors", lambda v: F.lower(v)).alias("authors"), F.col("doi").alias("c_doi")).join(raw, "want_id")
    gap = F.abs(F.col("year") - F.col("c_year"))
    same_year, same_author = F.coalesce(gap == 0, F.lit(False)), F.array_contains("authors", F.col("author"))
    by_year = F.when(F.col("year").isNull(), 0.0).when(gap == 0, 0.18).when(gap <= 1, 0.06).otherwise(-0.12)
    by_author = F.when(F.col("author") == "", 0.0).when(same_author, 0.14).otherwise(-0.08)
    similar = key_similarity(F.col("key"), F.col("c_key"), 0.64)
    scored = pairs.withColumn("similar", similar).withColumn("score", F.round(scoring.clamp(F.col("similar") + by_year + by_author + F.when(F.coalesce("c_doi", F.lit("")) != "", 0.03).otherwise(0.0), 0, 1), 9))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("want_id").orderBy(F.desc("score"), "rank"))).where("_n = 1")
    kept = (F.col("score") >= least) & (F.col("year").isNull() | same_year | (F.col("score") >= YEAR_FLOOR)) & ((F.col("author") == "") | same_author | (F.col("score") >= AUTHOR_FLOOR))
    return best.where(kept).select("want_id", "rank", F.round("similar", 4).alias("similar"), F.round("score", 4).alias("score"))
