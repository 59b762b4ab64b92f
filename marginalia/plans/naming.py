"""Queries on names of files and venues, and on texts for display; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming as N
from ..operators import references as X
from ..operators import similarity
from .common import table

#: Forms around a document's first words, by which its name, venue and answer get their shape.
VENUES = [("IEEE Conference on ", " (CVPR) 2019"), ("Journal of ", ""), ("Proceedings of the ACM ", " Symposium: 2021"), ("", ""), ("SPIE NIPS ", " Workshop, 1999")]


def _named(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    # The part with the first 19 words alone: what is made of them is computed several times.
    w = F.regexp_extract_all(F.regexp_extract("text", "^(?:[^A-Za-z]*+[A-Za-z]++){0,19}+", 0), F.lit("[A-Za-z]+"), F.lit(0))
    n = F.pmod("doc_id", F.lit(len(VENUES))).cast("int") + 1
    part = lambda k: F.element_at(F.array(*[F.lit(v[k]) for v in VENUES]), n)
    d = d.select("*", F.array_join(F.slice(w, 1, 3), " ").alias("head"), F.array_join(F.slice(w, 4, 16), " ").alias("title"), (F.lit(1990) + F.pmod("doc_id", F.lit(35))).cast("string").alias("year"))
    return d.withColumn("venue", F.concat(part(0), "head", part(1)))


def document_names(spark, sf):
    """File names, keys of duplicates, acronyms and kinds of venues."""
    d = _named(spark, sf)
    stem = F.when(F.pmod("doc_id", F.lit(3)) > 0, F.concat_ws("-", "head", "year", "title")).otherwise(F.col("title"))
    empty = lambda c, k: F.when(F.pmod("doc_id", F.lit(7)) == k, "").otherwise(F.col(c))
    return d.select(
        "doc_id", N.name_hints(stem).alias("h"), N.duplicate_key(empty("venue", 1), empty("year", 1), F.when(F.pmod("doc_id", F.lit(7)) < 4, F.col("title")).otherwise(""), empty("head", 4), empty("source", 5), F.concat("head", F.lit(".pdf"))).alias("dup"),
        N.acronym("venue").alias("acronym"), N.venue_query("venue").alias("query"), N.tier_grade(F.concat(F.substring("title", 1, 1), F.lit("*"))).alias("grade"),
        N.venue_kind(F.when(F.pmod("doc_id", F.lit(4)) == 0, "journal-article").when(F.pmod("doc_id", F.lit(4)) == 1, "proceedings-article").otherwise(""), "venue").alias("kind"), N.base_name("venue", "year", "title").alias("base"),
    ).select("doc_id", "h.*", "dup", "acronym", "query", "grade", "kind", "base")


def _q(s: str) -> str:
    return s.replace("'", "''")


_V = lambda k: "[" + ", ".join(f"'{_q(v[k])}'" for v in VENUES) + f"][doc_id % {len(VENUES)} + 1]"
NAMED = f"""nm AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents),
nv AS (SELECT *, coalesce(array_to_string(w[1:3], ' '), '') AS head, coalesce(array_to_string(w[4:19], ' '), '') AS title, (1990 + doc_id % 35)::VARCHAR AS year FROM nm), nd AS (SELECT *, {_V(0)} || head || {_V(1)} AS venue FROM nv)"""
_DUP = lambda x: f"trim(regexp_replace(regexp_replace(lower(trim({x})), '\\.pdf$', ''), '[^a-z0-9]+', ' ', 'g'))"
_ORG = "[" + ", ".join(f"'{o}'" for o in N.ORGANISATIONS) + "]"
_PLAIN = lambda x: f"nullif(trim(regexp_replace(regexp_replace({x}, '[\\\\/:*?\"<>|\\x00-\\x1f]+', ' ', 'g'), '\\s+', ' ', 'g')), '')"
NAMES_SQL = f"""WITH {NAMED}, s AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN concat_ws('-', head, year, title) ELSE title END AS stem, CASE WHEN doc_id % 7 = 1 THEN '' ELSE venue END AS dv, CASE WHEN doc_id % 7 = 1 THEN '' ELSE year END AS dy, CASE WHEN doc_id % 7 < 4 THEN title ELSE '' END AS dt,
  CASE WHEN doc_id % 7 = 4 THEN '' ELSE head END AS dd, CASE WHEN doc_id % 7 = 5 THEN '' ELSE source END AS ds, regexp_extract(venue, '\\(([A-Z][A-Z0-9]{{2,12}})\\)', 1) AS ins, list_filter(regexp_extract_all(venue, '\\b([A-Z][A-Z0-9]{{2,12}})\\b', 1), lambda c: NOT list_contains({_ORG}, c)) AS caps,
  coalesce(array_to_string(list_transform(regexp_extract_all(venue, '[A-Za-z]+'), lambda w: upper(substr(w, 1, 1))), ''), '') AS ini, CASE doc_id % 4 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'proceedings-article' ELSE '' END AS k,
  {_PLAIN("venue")} AS pv, {_PLAIN("title")} AS pt, '^(.+?)-(19\\d{{2}}|20\\d{{2}})-(.+)$' AS pat FROM nd),
b AS (SELECT *, concat_ws('-', pv, year, pt) AS whole, concat_ws('-', pv, year) AS pre FROM s), r AS (SELECT *, 79 - length(pre) - 1 AS room, '-' || substr(sha1(whole), 1, 8) AS suf FROM b)
SELECT doc_id, trim(regexp_extract(stem, pat, 1)) AS venue, trim(regexp_extract(stem, pat, 2)) AS year, CASE WHEN regexp_matches(stem, pat) THEN trim(regexp_extract(stem, pat, 3)) ELSE stem END AS title,
 CASE WHEN {_DUP("dt")} <> '' AND (dy <> '' OR {_DUP("dv")} <> '') THEN 'meta|' || {_DUP("dv")} || '|' || dy || '|' || {_DUP("dt")} WHEN {_DUP("dd")} <> '' THEN 'display|' || {_DUP("dd")} WHEN {_DUP("ds")} <> '' THEN 'suggest|' || {_DUP("ds")} WHEN {_DUP("head || '.pdf'")} <> '' THEN 'old|' || {_DUP("head || '.pdf'")} ELSE '' END AS dup,
 CASE WHEN ins <> '' AND NOT list_contains({_ORG}, ins) THEN ins WHEN len(caps) > 0 THEN caps[1] WHEN length(ini) BETWEEN 3 AND 10 THEN ini ELSE '' END AS acronym,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nd.venue, '\\b(?:19|20)\\d{{2}}\\b', ' ', 'g'), '[()/,:;]+', ' ', 'g'), '{N.GENERIC}', ' ', 'g'), '\\s+', ' ', 'g')) AS query,
 CASE WHEN upper(substr(title, 1, 1)) IN ('A', 'B', 'C') THEN upper(substr(title, 1, 1)) ELSE '' END AS grade, CASE WHEN regexp_matches(k, 'proceedings|conference') THEN 'conference' WHEN contains(k, 'journal') THEN 'journal' WHEN regexp_matches(lower(nd.venue), '{N.CONFERENCE}') THEN 'conference' ELSE 'journal' END AS kind,
 CASE WHEN length(whole) <= 88 THEN whole WHEN pt IS NOT NULL AND room >= 10 THEN pre || '-' || regexp_replace(substr(pt, 1, room), '[ .\\-_]+$', '') || suf ELSE regexp_replace(substr(whole, 1, 79), '[ .\\-_]+$', '') || suf END AS base FROM r nd"""


def display_texts(spark, sf):
    """Snippets, summaries and citation tokens of documents for display."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rich = F.concat(F.lit("Abstract: "), "t", F.when(F.col("doc_id") % 3 == 0, "\n![x](a.png)\n   end").otherwise("\r\n<b>bold</b> [1, 2]"))
    cited = F.concat(F.lit("[1] [SID:ab12]\n"), F.substring("t", 1, 80), F.when(F.col("doc_id") % 2 == 0, " [CITE:abcd:12] [[CITE:wxyz]] x").otherwise(" [[CITE:abcd:1]] [SID: qq-77] Reference locate here"))
    return d.select("doc_id", F.sha1(N.snippet(rich, 200)).alias("snippet"), N.summary(rich).alias("summary"), N.clean_citation_tokens(N.without_reference_section(cited)).alias("cited"))


DISPLAY_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT *, 'Abstract: ' || t || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '![x](a.png)' || chr(10) || '   end' ELSE chr(13) || chr(10) || '<b>bold</b> [1, 2]' END AS rich,
  substr(t, 1, 80) || CASE WHEN doc_id % 2 = 0 THEN ' [[CITE:abcd:12]]  x' ELSE ' [[CITE:abcd:1]] ' END AS cited FROM d),
s AS (SELECT *, regexp_replace(array_to_string(list_filter(string_split(trim(regexp_replace(rich, '\\r\\n?', chr(10), 'g')), chr(10)), lambda l: NOT regexp_matches(l, '^\\s*!\\[[^\\]]*\\]\\([^)]+\\)\\s*$')), chr(10)), '[ \\t]{3,}', '  ', 'g') AS sn,
  regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(rich, '<[^>]+>', ' ', 'g'), '\\[[0-9,\\-\\s]{1,24}\\]', ' ', 'g'), '\\s+', ' ', 'g')), '(?i)^(?:abstract|摘要)\\s*[:：-]?\\s*', '') AS x FROM r),
p AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(x, '([。！？!?.])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda q: trim(q)), lambda q: length(q) >= 18) AS ps FROM s),
l AS (SELECT *, list_transform(range(0, 4), lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda q: length(q))), 0)) AS before FROM p),
n AS (SELECT *, len(list_filter(range(1, least(3, len(ps)) + 1), lambda i: before[i] + length(ps[i]) <= 520)) AS whole FROM l)
SELECT doc_id, sha1(CASE WHEN length(sn) > 200 THEN regexp_replace(substr(sn, 1, 200), '\\s+$', '') || '…' ELSE sn END) AS snippet,
 CASE WHEN length(x) < 20 THEN '' WHEN whole > 0 OR (len(ps) > 0 AND whole < 3) THEN concat_ws(' ', nullif(array_to_string(ps[1:whole], ' '), ''), CASE WHEN whole < 3 AND whole < len(ps) AND 520 - before[whole + 1] >= 30 THEN regexp_replace(substr(ps[whole + 1], 1, (520 - before[whole + 1])::INT), '[ ,;:]+$', '') || '...' END)
  WHEN length(x) > 520 THEN regexp_replace(substr(x, 1, 520), '[ ,;:]+$', '') || '...' ELSE x END AS summary,
 CASE WHEN doc_id % 2 = 0 THEN cited ELSE rtrim(cited) || CASE WHEN true THEN ' ' ELSE '' END END AS cited FROM n"""

def _searched(spark, sf):
    """Five records a document as a search may give them: its title with fewer words or more, other years, the venue in other forms."""
    d = _named(spark, sf).withColumn("w", F.filter(F.split("title", " "), lambda v: v != ""))
    rank = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")
    d = d.select("*", rank)
    n = F.col("doc_id") + F.col("rank")
    cut = F.when(F.pmod(n, F.lit(4)) == 0, F.slice("w", 2, 30)).when(F.pmod(n, F.lit(4)) == 1, F.concat("w", F.array(F.lit("more")))).when(F.pmod(n, F.lit(4)) == 2, F.reverse("w")).otherwise(F.col("w"))
    year = (F.col("year").cast("int") + F.pmod(n, F.lit(3)) - 1).cast("string")
    venue = F.when(F.pmod(n, F.lit(3)) == 0, F.upper("venue")).when(F.pmod(n, F.lit(3)) == 1, F.col("head")).otherwise(F.regexp_replace("venue", "of|on", ""))
    doi = F.when(F.pmod(F.col("doc_id") * 5 + F.col("rank"), F.lit(23)) == 0, F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).otherwise("")
    return d.select("doc_id", "rank", F.array_join(cut, " ").alias("title"), year.alias("year"), venue.alias("venue"), doi.alias("doi"), F.array(F.regexp_extract("head", "^([A-Za-z]+)", 1)).alias("authors"))


def title_records(spark, sf):
    """The record that fits each document's title, year and venue, of those a search gave (needs the sequence ratio)."""
    n = F.pmod("doc_id", F.lit(3))
    wanted = _named(spark, sf).select(F.col("doc_id").alias("want_id"), "title", F.when(n == 0, F.col("year")).otherwise("").alias("year"), F.when(n == 1, F.col("venue")).otherwise("").alias("venue"), F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"))
    return X.best_by_title(wanted, _searched(spark, sf).withColumnRenamed("doc_id", "want_id"), title_only=True)


def text_records(spark, sf):
    """The record that fits each document's reference text best (needs the sequence ratio)."""
    wanted = _named(spark, sf).select(F.col("doc_id").alias("want_id"), F.concat("head", F.lit(", "), "title", F.lit(", "), "venue", F.lit(", "), "year").alias("raw"))
    found = _searched(spark, sf).select(F.col("doc_id").alias("want_id"), "rank", F.concat_ws(" ", F.element_at("authors", 1), "title", "venue", "year").alias("text"), "year", "authors", "doi")
    return X.best_by_text(wanted, found)


def nearest_names(spark, sf):
    """For each document another one whose first line has the same name, else the most similar one of at least .9.  The ratio is beyond SQL; tests hold it against all pairs."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), similarity.name_key(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).alias("name"))
    return similarity.nearest_others(d).select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("other_id"), F.round("ratio", 6).alias("ratio"), "found")


QUERIES = {f.__name__: f for f in (document_names, display_texts, title_records, text_records, nearest_names)}
ORACLE_SQL = {"document_names": NAMES_SQL, "display_texts": DISPLAY_SQL}
