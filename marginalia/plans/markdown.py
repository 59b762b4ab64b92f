"""Queries on Markdown made from documents, and on references; each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import indices as I
from ..operators import markdown as M
from ..operators import references as X
from .common import table


def _md(spark, sf):
    return M.synthetic_lines(table(spark, sf, "documents"))


LINES = """raw AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
md AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 0 THEN '# ' || line WHEN pos % 3 = 0 THEN '## ' || line
  ELSE line || CASE WHEN pos % 12 = 1 THEN ' [' || (pos % 9 + 1) || '-' || (pos % 9 + 3) || ']' WHEN pos % 4 = 1 THEN ' [' || (pos % 9 + 1) || ']' ELSE '' END END AS line FROM raw)"""
PATHS = f"""{LINES},
lv AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level, trim(regexp_replace(line, '^#{{1,6}}\\s+', '')) AS title FROM md),
st AS (SELECT *, last_value(CASE WHEN level = 1 THEN pos END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN level = 2 THEN pos END IGNORE NULLS) OVER w AS p2,
  last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS t2
  FROM lv WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
hp AS (SELECT doc_id, pos, line, level, concat_ws(' / ', t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END) AS heading_path FROM st)"""


def heading_paths(spark, sf):
    return M.with_heading_path(_md(spark, sf)).select("doc_id", "pos", "level", "heading_path")


HEADING_SQL = f"WITH {PATHS} SELECT doc_id, pos::INT AS pos, level::INT AS level, heading_path FROM hp"


def block_ids(spark, sf):
    return M.blocks(M.with_heading_path(_md(spark, sf))).select("doc_id", "pos", "kind", "order_index", "block_id")


KIND_SQL = """bl AS (SELECT *, CASE WHEN level > 0 THEN 'heading' WHEN regexp_matches(line, '^\\s*\\|') THEN 'table' WHEN regexp_matches(line, '^\\s*>') THEN 'blockquote' WHEN regexp_matches(line, '^\\s*([-*+]|\\d+\\.)\\s') THEN 'list_item'
  WHEN regexp_matches(line, '^\\s*!\\[') THEN 'figure' WHEN regexp_matches(line, '\\$\\$|\\\\begin\\{equation') THEN 'equation' ELSE 'paragraph' END AS kind FROM hp WHERE trim(line) <> ''),
bk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS order_index,
  CASE kind WHEN 'heading' THEN 'h' WHEN 'table' THEN 'tb' WHEN 'blockquote' THEN 'q' WHEN 'list_item' THEN 'li' WHEN 'figure' THEN 'fg' WHEN 'equation' THEN 'eq' ELSE 'p' END
  || '_' || lpad((row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos))::VARCHAR, 5, '0') AS block_id FROM bl)"""
BLOCK_SQL = f"WITH {PATHS}, {KIND_SQL} SELECT doc_id, pos::INT AS pos, kind, order_index::INT AS order_index, block_id FROM bk"


def heading_context(spark, sf):
    """The nearest paragraphs around each heading."""
    return M.nearest_prose(M.blocks(M.with_heading_path(_md(spark, sf))), "heading")


CONTEXT_SQL = f"""WITH {PATHS}, {KIND_SQL},
x AS (SELECT doc_id, block_id, kind, last_value(CASE WHEN kind = 'paragraph' THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN kind = 'paragraph' THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY order_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM bk)
SELECT doc_id, block_id, before, after FROM x WHERE kind = 'heading'"""


def chunked(spark, sf):
    """Chunks with overlap: a fold that SQL can't express."""
    made = M.chunks(M.with_heading_path(_md(spark, sf)))
    return made.select("doc_id", "chunk_idx", "heading_path", F.length("text").alias("chars"), F.sha1("text").alias("sha1"))


def repeated_lines(spark, sf):
    """Lines that stand on many pages of a document, ten lines to a page."""
    raw = M.lines(table(spark, sf, "documents").select("doc_id", F.col("text").alias("md")))
    pages = raw.select("doc_id", F.floor(F.col("pos") / 3).alias("page"), text.digit_mask("line").alias("line"))
    return M.repeated_noise(pages, least=2, share=0.3)


REPEATED_SQL = """
WITH raw AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
p AS (SELECT doc_id, pos // 3 AS page, trim(regexp_replace(regexp_replace(lower(line), '\\d+', '#', 'g'), '\\s+', ' ', 'g')) AS line FROM raw),
n AS (SELECT doc_id, line, count(DISTINCT page) AS n FROM p WHERE trim(line) <> '' GROUP BY ALL), t AS (SELECT doc_id, count(DISTINCT page) AS pages FROM p GROUP BY 1)
SELECT doc_id, line, n, pages FROM n JOIN t USING (doc_id) WHERE n >= greatest(2, ceil(pages * 0.3))"""


def cited_numbers(spark, sf):
    """Distinct citation numbers of each document."""
    md = _md(spark, sf)
    return md.select("doc_id", F.explode(text.inline_citations("line")).alias("num")).groupBy("doc_id", "num").agg(F.count("*").alias("lines"))


CITED_SQL = f"""WITH {LINES},
m AS (SELECT doc_id, pos, unnest(regexp_extract_all(line, '\\[(\\d{{1,4}}(?:\\s*[-,]\\s*\\d{{1,4}})*)\\]', 1)) AS s FROM md),
p AS (SELECT doc_id, pos, unnest(string_split(s, ',')) AS s FROM m),
r AS (SELECT doc_id, pos, regexp_extract(s, '^\\s*(\\d{{1,4}})', 1)::INT AS lo, coalesce(nullif(regexp_extract(s, '-\\s*(\\d{{1,4}})\\s*$', 1), '')::INT, regexp_extract(s, '^\\s*(\\d{{1,4}})', 1)::INT) AS hi FROM p WHERE regexp_matches(s, '^\\s*\\d{{1,4}}(\\s*-\\s*\\d{{1,4}})?\\s*$')),
n AS (SELECT DISTINCT doc_id, pos, unnest(range(lo, hi + 1)) AS num FROM r WHERE hi >= lo AND hi - lo <= 12)
SELECT doc_id, num::INT AS num, count(*) AS lines FROM n GROUP BY ALL"""


def _items(spark, sf):
    """doc_id, num and text: five to eight references a document, dealt from all benchmark items; number 3 is left out in every fifth document."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    total = F.broadcast(items.agg(F.count("*").alias("total")))  # one row
    own = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(5) + F.pmod("doc_id", F.lit(4)).cast("int"))).alias("num")).crossJoin(total)
    own = own.where("not (num = 3 and doc_id % 5 = 0)").withColumn("item_id", F.pmod(F.col("doc_id") * 7 + F.col("num") * 13, F.col("total")))
    return own.join(items, "item_id").select("doc_id", "num", "text")


def _with_tail(spark, sf):
    """The references of each document behind their heading; line breaks within an item are continuation lines."""
    tail = _items(spark, sf).select("doc_id", F.posexplode(F.split(F.concat(F.lit("["), "num", F.lit("] "), "text"), "\n")).alias("o", "line"), "num")
    tail = tail.select("doc_id", (10_001 + F.col("num") * 1000 + F.col("o")).cast("int").alias("pos"), "line")
    return tail.union(table(spark, sf, "documents").select("doc_id", F.lit(10_000), F.lit("## References")))


TAIL = """it AS (SELECT doc_id, num, text FROM (SELECT doc_id, unnest(range(1, (6 + doc_id % 4)::BIGINT)) AS num FROM documents) d JOIN benchmark b ON b.item_id = (d.doc_id * 7 + d.num * 13) % (SELECT count(*) FROM benchmark) WHERE NOT (num = 3 AND doc_id % 5 = 0))"""


def reference_entries(spark, sf):
    return X.entries(_with_tail(spark, sf)).select("doc_id", "num", F.sha1("raw").alias("sha1"))


ENTRIES_SQL = f"WITH {TAIL} SELECT doc_id, num::INT AS num, sha1('[' || num || '] ' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), ' ')) AS sha1 FROM it"


def reference_catalog(spark, sf):
    return X.catalog(X.without_outliers(X.entries(_with_tail(spark, sf))))


CATALOG_SQL = f"""WITH {TAIL}, c AS (SELECT doc_id, count(DISTINCT num) AS ref_count, min(num) AS first_num, max(num) AS last_num, list(DISTINCT num) AS nums FROM it GROUP BY 1),
m AS (SELECT *, list_filter(range(first_num, last_num + 1), lambda x: NOT list_contains(nums, x)) AS missing FROM c)
SELECT doc_id, ref_count, first_num::INT AS first_num, last_num::INT AS last_num, array_to_string(list_sort(missing), ',') AS missing, CASE WHEN len(missing) > 0 THEN 'gapped' WHEN first_num > 1 THEN 'offset' ELSE 'continuous' END AS status FROM m"""


def reference_parse(spark, sf):
    """Parsed fields of the entries, and the titles of their year-first forms."""
    e = X.entries(_with_tail(spark, sf))
    dated = F.concat(F.lit("Doe J. (2019) "), F.array_join(F.slice(F.split(text.clean_reference("raw"), "[ .]+"), 1, 6), " "), F.lit(". Venue. doi 10.1000/"), F.col("num").cast("string"))
    p = X.parsed(e.withColumn("raw", F.when(F.col("num") % 2 == 0, dated).otherwise(F.col("raw"))))
    return p.select("doc_id", "num", "year", "author", "doi", I.fallback_title("raw").alias("title"), "confidence")


_REF = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '^\\s*(\\[\\d+\\]|\\d+\\.)\\s*', ''), 'https?://\\S+', '', 'g'), '\\s+', ' ', 'g'))[1:360]"
PARSE_SQL = f"""WITH {TAIL}, e AS (SELECT doc_id, num, '[' || num || '] ' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), ' ') AS raw FROM it),
d AS (SELECT doc_id, num, CASE WHEN num % 2 = 0 THEN 'Doe J. (2019) ' || array_to_string(regexp_split_to_array({_REF.format("raw")}, '[ .]+')[1:6], ' ') || '. Venue. doi 10.1000/' || num ELSE raw END AS raw FROM e),
p AS (SELECT *, regexp_extract_all(string_split({_REF.format("raw")}, ',')[1], '[A-Za-z]+') AS ws, len(regexp_extract_all(raw, '[A-Za-z]+')) AS words, nullif(regexp_replace(lower(regexp_extract(raw, '10\\.\\d{{4,9}}/[^\\s"<>]+')), '[.,;:)\\]}}]+$', ''), '') AS doi,
  list_extract(regexp_extract_all(raw, '(19\\d{{2}}|20\\d{{2}})', 1), -1)::INT AS year, trim(regexp_extract(raw, '\\((?:19|20)\\d{{2}}\\)\\s*([^.]{{6,260}})\\.', 1), ' .;:,') AS ti FROM d),
t AS (SELECT *, length(ti) BETWEEN 8 AND 260 AND len(list_filter(regexp_split_to_array(ti, '\\s+'), lambda w: w <> '')) BETWEEN 2 AND 32 AND NOT regexp_matches(lower(ti), '^(?:in:|in |proceedings|abstracts of|workshop|conference)') AND NOT regexp_matches(lower(ti), '\\b(?:pp?|vol|no)\\.?\\s*\\d')
  AND NOT regexp_matches(lower(ti), '\\b\\d+\\(\\d+\\)\\s*:\\s*\\d') AND NOT (len(regexp_split_to_array(ti, '\\s+')) <= 8 AND regexp_matches(lower(ti), 'ieee|acm|springer|wiley|press|university|journal|transactions|proceedings|conference|workshop')) AND len(regexp_extract_all(ti, '[A-Za-z\\x{{4e00}}-\\x{{9fff}}]{{2,}}')) >= 2 AS ok FROM p)
SELECT doc_id, num::INT AS num, year, lower(list_filter(ws, lambda w: length(w) = list_max(list_transform(ws, lambda v: length(v))))[1]) AS author, doi, CASE WHEN ti <> '' AND ok THEN ti ELSE '' END AS title,
 round(least(greatest(0.50 + CASE WHEN length(raw) >= 40 THEN 0.16 ELSE 0 END + CASE WHEN words >= 8 THEN 0.12 ELSE 0 END + CASE WHEN regexp_matches(raw, '(19|20)\\d{{2}}') THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(raw, '10\\.\\d{{4,9}}/') THEN 0.09 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(raw, '\\.')) >= 2 OR len(regexp_extract_all(raw, ',')) >= 3 THEN 0.06 ELSE 0 END - CASE WHEN regexp_matches(raw, '(\\.\\.\\.|-|,)\\s*$') THEN 0.28 ELSE 0 END - CASE WHEN length(raw) < 18 THEN 0.18 ELSE 0 END, 0.05), 0.99)::DOUBLE, 4) AS confidence FROM t"""


def citation_validation(spark, sf):
    cited = M.with_heading_path(_md(spark, sf)).select("doc_id", F.explode(text.inline_citations("line")).alias("num"))
    return X.validated_citations(cited, X.entries(_with_tail(spark, sf)))


VALID_SQL = f"""WITH {LINES}, {TAIL},
m AS (SELECT doc_id, pos, unnest(regexp_extract_all(line, '\\[(\\d{{1,4}}(?:\\s*[-,]\\s*\\d{{1,4}})*)\\]', 1)) AS s FROM md),
p AS (SELECT doc_id, pos, unnest(string_split(s, ',')) AS s FROM m),
r AS (SELECT doc_id, pos, regexp_extract(s, '^\\s*(\\d{{1,4}})', 1)::INT AS lo, coalesce(nullif(regexp_extract(s, '-\\s*(\\d{{1,4}})\\s*$', 1), '')::INT, regexp_extract(s, '^\\s*(\\d{{1,4}})', 1)::INT) AS hi FROM p WHERE regexp_matches(s, '^\\s*\\d{{1,4}}(\\s*-\\s*\\d{{1,4}})?\\s*$')),
n AS (SELECT DISTINCT doc_id, pos, unnest(range(lo, hi + 1)) AS num FROM r WHERE hi >= lo AND hi - lo <= 12)
SELECT n.doc_id, count(*) AS cited, count(it.num) AS kept, count(*) - count(it.num) AS dropped FROM n LEFT JOIN it ON it.doc_id = n.doc_id AND it.num = n.num GROUP BY 1"""


def _source_rows(spark, sf):
    """The reference list of each document's own source: in order, one place on, or backwards, some with fewer words and another year."""
    it = _items(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("num"))
    kind = F.pmod("doc_id", F.lit(3))
    it = it.withColumn("place", place).withColumn("pos", F.when(kind == 0, F.col("place")).when(kind == 1, F.pmod("place", "n") + 1).otherwise(F.col("n") - F.col("place") + 1).cast("int"))
    words = F.split(F.regexp_replace("text", "\\s+", " "), " ")
    cut = F.when(F.pmod(F.col("doc_id") + F.col("num"), F.lit(4)) == 0, F.slice(words, 4, 100)).otherwise(words)
    return it.select("doc_id", "pos", F.array_join(cut, " ").alias("text"), F.when(F.pmod("num", F.lit(4)) == 1, F.concat(F.lit("10.1000/"), F.col("num").cast("string"))).otherwise("").alias("doi"), F.when(F.pmod("num", F.lit(3)) == 0, "2019").otherwise("").alias("year"), F.array_join(F.slice(words, 1, 2), " ").alias("author"))


def reference_match(spark, sf):
    """Entries of all documents mapped to the rows of their source's list (needs the sequence ratio)."""
    entry = X.without_outliers(X.entries(_with_tail(spark, sf)))
    return X.match_rows(entry.select("doc_id", "num", F.when(F.col("num") % 4 == 1, F.concat("raw", F.lit(" 10.1000/"), F.col("num").cast("string"))).otherwise(F.col("raw")).alias("raw")), _source_rows(spark, sf))


def reference_enrichment(spark, sf):
    """What the entries of each document still lack."""
    e = X.parsed(X.entries(_with_tail(spark, sf)).withColumn("raw", F.concat(F.substring("raw", 1, 300), F.lit(" 2015"))))
    refs = e.select("doc_id", "raw", F.when(F.col("num") % 3 == 0, "10.1/x").otherwise("").alias("doi"), F.when(F.col("num") % 2 == 0, F.col("clean")).otherwise("").alias("title"), F.when(F.col("num") < 4, F.col("author")).otherwise(" ").alias("authors"), (F.col("num") % 5 == 0).alias("resolved"))
    return X.enrichment(refs)


ENRICH_SQL = f"""WITH {TAIL}, e AS (SELECT doc_id, num, substr('[' || num || '] ' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), ' '), 1, 300) || ' 2015' AS raw FROM it),
p AS (SELECT *, length(raw) BETWEEN 24 AND 420 AND regexp_matches(raw, '(19|20)\\d{{2}}') AND len(regexp_extract_all(raw, '[A-Za-z]{{3,}}')) >= 4 AS fit, num % 3 <> 0 AND num % 5 <> 0 AS missing, regexp_matches(string_split(regexp_replace(raw, '^\\[\\d+\\]\\s*', ''), ',')[1], '[A-Za-z]') AS named FROM e)
SELECT doc_id, count(*) FILTER (WHERE fit AND missing) AS unresolved, count(*) FILTER (WHERE fit AND NOT missing AND (num % 2 = 1 OR num >= 4 OR NOT named)) AS sparse FROM p GROUP BY 1"""


def index_statistics(spark, sf):
    """Counters of an index build in which every third document is taken over."""
    e = X.parsed(X.entries(_with_tail(spark, sf)))
    docs = table(spark, sf, "documents").select("doc_id", (F.pmod("doc_id", F.lit(3)) == 0).alias("reused"))
    return X.index_statistics(docs, e.select("doc_id", F.when(F.col("num") % 4 == 0, "10.1/x").otherwise(F.col("doi")).alias("doi"), (F.col("num") % 2 == 0).alias("resolved"), F.when(F.col("num") < 5, "order").alias("method")))


STATISTICS_SQL = f"""WITH {TAIL}, r AS (SELECT num, num % 4 = 0 OR regexp_matches(text, '10\\.\\d{{4,9}}/') AS d FROM it)
SELECT (SELECT count(*) FROM documents) AS docs_total, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS docs_updated, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS docs_reused,
 count(*) AS refs_total, count(*) FILTER (WHERE d) AS refs_with_doi, count(*) FILTER (WHERE num % 2 = 0) AS refs_resolved, count(*) FILTER (WHERE num < 5) AS refs_mapped FROM r"""


def reference_audit(spark, sf):
    refs = X.parsed(X.entries(_with_tail(spark, sf))).select("doc_id", "doi", F.when(F.col("num") % 2 == 0, F.col("clean")).alias("title"), F.when(F.col("num") % 3 == 0, "unresolved").when(F.col("num") % 4 == 0, "").otherwise("title").alias("match_method"))
    return X.audit(refs)


AUDIT_SQL = f"""WITH {TAIL}, r AS (SELECT doc_id, num % 2 = 0 AND text IS NOT NULL AS has_title, CASE WHEN num % 3 = 0 THEN 'unresolved' WHEN num % 4 = 0 THEN '' ELSE 'title' END AS m FROM it),
c AS (SELECT doc_id, count(*) AS refs, count(*) AS missing_doi, count(*) FILTER (WHERE NOT has_title) AS empty_title, count(*) FILTER (WHERE m = '') AS blank_match, count(*) FILTER (WHERE m = 'unresolved') AS unresolved FROM r GROUP BY 1)
SELECT *, 3 * missing_doi + 2 * empty_title + blank_match + 2 * unresolved AS repair_score FROM c"""

QUERIES = {"heading_paths": heading_paths, "block_ids": block_ids, "heading_context": heading_context, "chunks_with_overlap": chunked, "repeated_lines": repeated_lines, "cited_numbers": cited_numbers, "reference_entries": reference_entries, "reference_catalog": reference_catalog, "reference_parse": reference_parse, "citation_validation": citation_validation, "reference_match": reference_match, "reference_enrichment": reference_enrichment, "index_statistics": index_statistics, "reference_audit": reference_audit}
ORACLE_SQL = {"heading_paths": HEADING_SQL, "block_ids": BLOCK_SQL, "heading_context": CONTEXT_SQL, "repeated_lines": REPEATED_SQL, "cited_numbers": CITED_SQL, "reference_entries": ENTRIES_SQL, "reference_catalog": CATALOG_SQL, "citation_validation": VALID_SQL, "reference_audit": AUDIT_SQL, "reference_parse": PARSE_SQL, "reference_enrichment": ENRICH_SQL, "index_statistics": STATISTICS_SQL}
