"""Queries on the clean-up of Markdown; each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleanup as C
from ..operators import markdown as M
from ..sources.shared import bounded
from .common import table
from .indices import RICH
from .markdown import LINES, PATHS


def _lines(spark, sf):
    return M.with_heading_path(M.synthetic_lines(table(spark, sf, "documents")))


NOISE = {1: "Publication date: May 2020", 2: "## RESEARCH-ARTICLE", 3: "139:2", 4: "Optics Express (2019) 12:3 Page 3 of 12", 6: "  ", 7: "", 8: "```", 9: "unreadable here", 10: "```", 12: "$$", 13: "illegible", 14: "$$", 16: "x (partially visible) y", 17: "-"}


def noise_lines(spark, sf):
    """Documents with noise at fixed places and without it: their lines and a hash."""
    raw = M.lines(table(spark, sf, "documents").select("doc_id", F.col("text").alias("md")))
    line = None
    for n, form in NOISE.items():
        line = F.when(F.pmod("pos", F.lit(19)) == n, form) if line is None else line.when(F.pmod("pos", F.lit(19)) == n, form)
    made = raw.select("doc_id", "pos", line.otherwise(F.col("line")).alias("line"))
    return C.without_noise(made).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n")).alias("sha1"))


_NOISE = "CASE pos % 19 " + " ".join(f"WHEN {n} THEN '{form}'" for n, form in NOISE.items()) + " ELSE line END"
_PATTERN = "|".join(C.NOISE_LINES).replace("'", "''")
NOISE_SQL = f"""WITH raw AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)), l AS (SELECT doc_id, pos, {_NOISE} AS line FROM raw),
f AS (SELECT *, regexp_matches(line, '^\\s*```') AS fe, trim(line) = '$$' AS mk, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS p FROM l), g AS (SELECT *, sum(fe::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS nf, sum((mk AND NOT fe)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS nm, trim(regexp_replace(p, '^#+\\s*', '')) AS b FROM f),
k AS (SELECT * FROM g WHERE NOT (nf % 2 = 0 AND nm % 2 = 0 AND NOT fe AND NOT mk AND regexp_matches(line, '{C.UNREADABLE}')) AND NOT (p <> '' AND (regexp_matches(p, '{_PATTERN}') OR regexp_matches(b, '{_PATTERN}')))
  AND NOT (regexp_matches(p, '{C.RUNNING_PAGE}') AND (regexp_matches(p, '{C.RUNNING_SOURCE}') OR regexp_matches(p, '{C.RUNNING_VOLUME}') OR regexp_matches(p, '{C.RUNNING_AUTHORS}')))),
o AS (SELECT *, lag(trim(line) = '') OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k)
SELECT doc_id, count(*) AS lines, sha1(string_agg(line, chr(10) ORDER BY pos)) AS sha1 FROM o WHERE NOT (trim(line) = '' AND coalesce(before, false)) GROUP BY 1"""


def outline_levels(spark, sf):
    """Levels of numbered headings made from the lines of documents."""
    md = _lines(spark, sf).where("level > 0")
    numbered = F.concat(F.lit("## "), F.when(F.col("pos") % 2 == 0, F.concat((F.col("pos") + 1).cast("string"), F.lit(".2.1 "))).when(F.col("pos") % 3 == 0, F.lit("B.1 ")).otherwise(""), F.regexp_replace("line", "^#+ ", ""))
    return md.select("doc_id", "pos", C.numbered_level(numbered).alias("depth"))


LEVEL_SQL = f"""WITH {PATHS}, n AS (SELECT doc_id, pos, regexp_extract('## ' || CASE WHEN pos % 2 = 0 THEN (pos + 1) || '.2.1 ' WHEN pos % 3 = 0 THEN 'B.1 ' ELSE '' END || regexp_replace(line, '^#+ ', ''), '^#*\\s*((?:\\d+\\.)*\\d+|[A-Z](?:\\.\\d+)*)\\.?\\s+\\S', 1) AS n FROM hp WHERE level > 0)
SELECT doc_id, pos::INT AS pos, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, '.')) END::INT AS depth FROM n"""


def citation_forms(spark, sf):
    """Citations in other forms, made normal."""
    md = M.synthetic_lines(table(spark, sf, "documents")).where(F.col("line").rlike("\\[\\d+\\]$"))
    k = F.regexp_extract("line", "\\[(\\d+)\\]$", 1)
    odd = F.when(F.col("pos") % 8 == 1, F.concat(F.lit("x $^{"), k, F.lit(", 12}$"))).otherwise(F.concat(F.lit("y [ "), k, F.lit(" ]")))
    return md.select("doc_id", "pos", C.normal_citations(odd).alias("line"))


FORMS_SQL = f"""WITH {LINES}, k AS (SELECT doc_id, pos, regexp_extract(line, '\\[(\\d+)\\]$', 1) AS k FROM md WHERE regexp_matches(line, '\\[\\d+\\]$'))
SELECT doc_id, pos::INT AS pos, CASE WHEN pos % 8 = 1 THEN 'x [' || k || ',12]' ELSE 'y [' || k || ']' END AS line FROM k"""


def _dirty(spark, sf):
    """Rich Markdown with the faults an editor would mark at fixed places."""
    md = M.rich_lines(table(spark, sf, "documents"))
    k = F.pmod("pos", F.lit(29))
    forms = {1: "# 3 a + b = c", 6: "#### Figure 2", 8: "$$", 16: "x $a$ costs $5", 12: "cited [3-5] and [2, 7]", 15: "$$", 17: "| one |", 18: "| two | 2 |", 19: "Publication date: 2019", 20: "*Table 4 in italics*", 22: "Figure IV plain", 23: "", 24: "## Abstract", 25: "## References", 27: "[12] A note", 26: "Doe, J., A long title of a paper, 2011, vol. 3"}
    line = None
    for n, form in forms.items():
        line = F.when(k == n, form) if line is None else line.when(k == n, form)
    return md.select("doc_id", "pos", line.otherwise(F.col("line")).alias("line"))


_FORMS = " ".join(f"WHEN pos % 29 = {n} THEN '{form}'" for n, form in {1: "# 3 a + b = c", 6: "#### Figure 2", 8: "$$", 16: "x $a$ costs $5", 12: "cited [3-5] and [2, 7]", 15: "$$", 17: "| one |", 18: "| two | 2 |", 19: "Publication date: 2019", 20: "*Table 4 in italics*", 22: "Figure IV plain", 23: "", 24: "## Abstract", 25: "## References", 27: "[12] A note", 26: "Doe, J., A long title of a paper, 2011, vol. 3"}.items())


def analyzer_issues(spark, sf):
    return C.issue_report(C.issues(_dirty(spark, sf)))


_RICH = RICH[: RICH.index(",\nlv AS")]
_ONE = "SELECT doc_id, '{}' AS category, '{}' AS severity, '{}' AS issue, {} AS line_no FROM {}"
ISSUE_SQL = f"""WITH {_RICH}, m AS (SELECT doc_id, pos + 1 AS line_no, CASE {_FORMS} ELSE line END AS line FROM md),
h0 AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s+.+$', 1)) AS level, trim(regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1)) AS title FROM m),
h AS (SELECT *, NOT regexp_matches(title, '^\\d+(?:\\.\\d+)*\\.?\\s+[A-Z][A-Za-z]') AND (regexp_matches(title, '{C.FORMULA_HEADING}|^\\s*[a-z]\\s*\\d+') OR (length(title) <= 10 AND regexp_matches(title, '{C.SHORT_FORMULA}') AND NOT regexp_matches(title, '[A-Z]{{2,}}'))) AS f FROM h0 WHERE level > 0),
g AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS above FROM h WHERE NOT f), o AS (SELECT doc_id, count(*) FILTER (WHERE level = 1) AS n FROM g GROUP BY 1),
fn AS (SELECT *, regexp_matches(line, '^\\s*\\$\\$\\s*$') AS mark, sum(regexp_matches(line, '^\\s*\\$\\$\\s*$')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS marks FROM m),
fb AS (SELECT * FROM (SELECT *, lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS opened FROM fn WHERE mark) WHERE marks % 2 = 0),
fi AS (SELECT * FROM fn WHERE NOT mark AND marks % 2 = 0 AND regexp_matches(line, '\\$[^$]+\\$') AND len(regexp_extract_all(line, '\\$')) % 2 = 1),
fm AS (SELECT doc_id, min(line_no) AS line_no FROM (SELECT *, trim(regexp_replace(line, '^#+\\s+', '')) AS t FROM m WHERE regexp_matches(line, '^#+\\s+')) WHERE regexp_matches(t, '{C.FORMULA_HEADING}') OR (length(t) <= 15 AND regexp_matches(t, '{C.SHORT_FORMULA}') AND contains(t, '=')) GROUP BY 1),
f0 AS (SELECT doc_id FROM m WHERE doc_id NOT IN (SELECT doc_id FROM fb) GROUP BY 1 HAVING count(*) > 50),
b0 AS (SELECT *, starts_with(trim(line), '|') AND len(regexp_extract_all(line, '\\|')) >= 2 AS bar, max(line_no) OVER (PARTITION BY doc_id) AS last FROM m), b1 AS (SELECT *, sum((NOT bar)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM b0),
tb AS (SELECT doc_id, run, count(*) AS n, min(line_no) AS line_no, count(DISTINCT len(string_split(line, '|'))) AS widths FROM b1 WHERE bar GROUP BY doc_id, run HAVING max(line_no) < any_value(last)),
r0 AS (SELECT *, regexp_matches(line, '(?i)^#+\\s*REFERENCES?\\s*$') AS hd FROM m), r1 AS (SELECT *, min(line_no) FILTER (WHERE hd) OVER (PARTITION BY doc_id) AS begun FROM r0),
rf AS (SELECT doc_id, max(line_no) FILTER (WHERE hd) AS line_no FROM r1 WHERE line_no >= begun GROUP BY 1 HAVING count(*) FILTER (WHERE NOT hd AND regexp_matches(line, '\\b(?:19|20)\\d{{2}}\\b') AND (regexp_matches(line, '{C.SOURCE_WORDS}') OR (length(trim(line)) > 30 AND contains(line, ',')))) < 5),
c0 AS (SELECT *, regexp_matches(line, '(?i)^\\s*\\*.*?{C.CAPTION}') AS it, regexp_matches(line, '(?i)^\\s*{C.CAPTION}') AS pl, regexp_matches(line, '!\\[.*?\\]\\(.*?\\)') AS im FROM m),
c1 AS (SELECT *, max((it OR pl)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS near FROM c0), c2 AS (SELECT doc_id, min(line_no) FILTER (WHERE im) AS line_no FROM c0 GROUP BY 1 HAVING count(*) FILTER (WHERE it OR pl) = 0 AND count(*) FILTER (WHERE im) > 0),
p0 AS (SELECT *, trim(line) = '' AS bl FROM m), p1 AS (SELECT *, sum(bl::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS para, sum(bl::INT) OVER (PARTITION BY doc_id) AS blanks FROM p0),
p2 AS (SELECT doc_id, para, min(line_no) AS line_no FROM p1 WHERE NOT bl AND NOT regexp_matches(trim(line), '^(#|\\||```)') AND para < blanks GROUP BY doc_id, para HAVING count(*) > 20),
i AS ({" UNION ALL ".join([
    _ONE.format("heading", "error", "formula_heading", "line_no", "h WHERE f"), _ONE.format("heading", "warning", "skipped_level", "line_no", "g WHERE level > coalesce(above, 0) + 1"), _ONE.format("heading", "info", "long_heading", "line_no", "g WHERE length(title) > 100"),
    _ONE.format("heading", "warning", "body_text_heading", "line_no", "g WHERE len(regexp_split_to_array(title, '\\s+')) > 15"), _ONE.format("heading", "error", "caption_heading", "line_no", "g WHERE regexp_matches(title, '(?i)^\\s*" + C.CAPTION + "')"), _ONE.format("structure", "info", "no_title", "1", "o WHERE n = 0"),
    _ONE.format("structure", "warning", "many_titles", "1", "o WHERE n > 5"), _ONE.format("formula", "warning", "short_formula", "opened", "fb WHERE line_no - opened < 2"), _ONE.format("formula", "error", "open_inline", "line_no", "fi"), _ONE.format("formula", "error", "formulas_as_headings", "line_no", "fm"),
    _ONE.format("formula", "info", "no_formulas", "1", "f0"), _ONE.format("table", "warning", "one_row_table", "line_no", "tb WHERE n < 2"), _ONE.format("table", "error", "uneven_table", "line_no", "tb WHERE n > 1 AND widths > 1"), _ONE.format("reference", "warning", "few_references", "line_no", "rf"),
    _ONE.format("noise", "warning", "metadata", "line_no", "m WHERE regexp_matches(line, '" + C.METADATA + "')"), _ONE.format("caption", "info", "plain_caption", "line_no", "c0 WHERE pl AND NOT it"), _ONE.format("caption", "warning", "image_without_caption", "line_no", "c1 WHERE im AND near = 0"),
    _ONE.format("caption", "warning", "no_captions", "line_no", "c2"), _ONE.format("structure", "info", "long_paragraph", "line_no", "p2"),
])})
SELECT doc_id, category, count(*) AS n, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info, min(line_no)::INT AS first_line, string_agg(DISTINCT issue, ',' ORDER BY issue) AS issues FROM i GROUP BY ALL"""


def markdown_quality(spark, sf):
    return C.quality_summary(_dirty(spark, sf))


_CITE = "\\[(\\d{1,4}(?:\\s*-\\s*\\d{1,4})?(?:\\s*,\\s*\\d{1,4}(?:\\s*-\\s*\\d{1,4})?)*)\\]"
_ISSUES = ISSUE_SQL[: ISSUE_SQL.rindex("SELECT doc_id, category, count(*)")].rstrip()


def _summary_sql(issues: str) -> str:
    """A WITH list that ends with the table s: the summary of the lines m that the given list makes."""
    return f"""{issues}, x0 AS (SELECT *, trim(line) AS t, length(regexp_extract(line, '^(#{{1,6}})\\s+.+$', 1)) AS level, regexp_matches(trim(line), '(?i)^#{{1,6}}\\s+References?\\s*$') AS listed, regexp_matches(trim(line), '^\\$\\$.+\\$\\$$') AS single, trim(line) = '$$' AS mark, starts_with(trim(line), '|') AND len(regexp_extract_all(line, '\\|')) >= 2 AS bar FROM m),
x1 AS (SELECT *, sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS marks, sum((NOT bar)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS gaps, min(line_no) FILTER (WHERE listed) OVER (PARTITION BY doc_id) AS begun FROM x0),
x2 AS (SELECT *, CASE WHEN line_no > begun THEN nullif(regexp_extract(line, '^\\[(\\d{{1,4}})\\]\\s+', 1), '')::INT END AS num, CASE WHEN begun IS NULL OR line_no < begun THEN regexp_extract_all(line, '{_CITE}', 1) ELSE [] END AS tk FROM x1),
x3 AS (SELECT *, flatten(list_transform(tk, lambda m: flatten(list_transform(string_split(m, ','), lambda v: range(trim(string_split(v, '-')[1])::INT, trim(string_split(v, '-')[-1])::INT + 1))))) AS cited FROM x2),
sm AS (SELECT doc_id, (sum(length(line) + 1) - 1)::BIGINT AS chars, count(*) - CASE WHEN arg_max(line, line_no) = '' THEN 1 ELSE 0 END AS lines, count(*) FILTER (WHERE t <> '') AS nonempty_lines, count(*) FILTER (WHERE level > 0) AS headings, count(*) FILTER (WHERE level = 1) AS h1, count(*) FILTER (WHERE level = 2) AS h2, count(*) FILTER (WHERE level >= 3) AS h3_plus,
  bool_or(regexp_matches(line, '(?i)^#{{1,6}}\\s+Abstract\\s*$')) AS has_abstract, sum(len(regexp_extract_all(line, '!\\[[^\\]]*\\]\\([^)]+\\)')))::BIGINT AS images, count(*) FILTER (WHERE regexp_matches(t, '(?i)^(?:\\*\\*)?(?:Figure\\b|Fig\\.|Table\\b|Algorithm\\b)')) AS captions,
  (count(*) FILTER (WHERE single) + count(*) FILTER (WHERE mark) // 2)::BIGINT AS display_math, coalesce(sum(len(regexp_extract_all(regexp_replace(line, '\\$\\$+', chr(2), 'g'), '\\$[^$\x02]+\\$'))) FILTER (WHERE NOT single AND NOT mark AND marks % 2 = 0), 0)::BIGINT AS inline_math, count(*) FILTER (WHERE listed) AS reference_headings, count(num) AS reference_lines, coalesce(max(num), 0) AS max_reference,
  sum(len(tk))::BIGINT AS citations, sum(len(list_filter(tk, lambda v: contains(v, '-'))))::BIGINT AS citation_ranges, len(list_distinct(flatten(list(cited))))::INT AS cited_numbers FROM x3 GROUP BY 1),
rn AS (SELECT doc_id, count(*) FILTER (WHERE n >= 2) AS table_blocks FROM (SELECT doc_id, gaps, count(*) AS n FROM x1 WHERE bar GROUP BY ALL) GROUP BY 1), ic AS (SELECT doc_id, count(*) AS issues, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos FROM i GROUP BY 1),
s AS (SELECT sm.*, coalesce(table_blocks, 0) AS table_blocks, coalesce(issues, 0) AS issues, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos FROM sm LEFT JOIN rn USING (doc_id) LEFT JOIN ic USING (doc_id))"""


MARKDOWN_SQL = _summary_sql(_ISSUES) + " SELECT * FROM s"


def regression_report(spark, sf):
    """What conversions lose when every seventh line is left out."""
    md = _dirty(spark, sf)
    return C.compared(C.quality_summary(md), C.quality_summary(md.where("(doc_id + pos) % 7 <> 3")))


_FEWER = _ISSUES.replace("ELSE line END AS line FROM md),", "ELSE line END AS line FROM md WHERE (doc_id + pos) % 7 <> 3),", 1)
REGRESSION_SQL = f"""SELECT b.doc_id, {", ".join(f"c.{m} - b.{m} AS {m}" for m in C.COUNTED)}, b.has_abstract AND NOT c.has_abstract AS missing_abstract, c.reference_lines + 2 < b.reference_lines AS references_dropped, c.max_reference + 1 < b.max_reference AS reference_index_regressed, c.table_blocks < b.table_blocks AS tables_dropped,
 c.images < b.images AS images_dropped, c.display_math < b.display_math AS display_math_dropped, c.errors > b.errors AS errors_increased, c.warnings > b.warnings AS warnings_increased FROM ({MARKDOWN_SQL}) b JOIN ({_summary_sql(_FEWER)} SELECT * FROM s) c USING (doc_id)"""


def block_classes(spark, sf):
    """Pages of ten lines, some with marks of code, tables and contents, by class; and headings and contents lines without page numbers."""
    raw = M.lines(table(spark, sf, "documents").select("doc_id", F.col("text").alias("md")))
    k = F.pmod(F.col("doc_id") + F.floor(F.col("pos") / 10), F.lit(5))
    first = F.substring("line", 1, 20)
    line = F.when((k == 1) & (F.col("pos") % 3 == 0), F.concat(F.lit("  if x -> "), first)).when((k == 2) & (F.col("pos") % 2 == 0), F.concat(F.lit("| "), first, F.lit(" |"))).when(k == 3, F.concat(F.lit("1.2 "), first, F.lit(" 1.3.1 "), first, F.lit(" 17"))).when(k == 4, F.concat(first, F.lit("\t12.5%  3"))).otherwise(F.col("line"))
    pages = raw.select("doc_id", F.floor(F.col("pos") / 10).alias("page"), "pos", line.alias("line"))
    grouped = pages.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]).alias("ls"))
    one = F.get("ls", F.lit(0))
    return grouped.select("doc_id", "page", C.is_code(F.col("ls")).alias("code"), C.is_table(F.col("ls")).alias("table_like"), C.is_contents(F.col("ls")).alias("contents"), F.array_join(C.toc_parts(one), "|").alias("toc"), C.without_page_number(F.concat(F.lit("2.1 "), one, F.lit(" 44"))).alias("heading"))


CLASS_SQL = """WITH raw AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, (doc_id + pos // 10) % 5 AS k, substr(line, 1, 20) AS f FROM raw),
l AS (SELECT doc_id, pos // 10 AS page, pos, CASE WHEN k = 1 AND pos % 3 = 0 THEN '  if x -> ' || f WHEN k = 2 AND pos % 2 = 0 THEN '| ' || f || ' |' WHEN k = 3 THEN '1.2 ' || f || ' 1.3.1 ' || f || ' 17' WHEN k = 4 THEN f || chr(9) || '12.5%  3' ELSE line END AS line FROM k),
g AS (SELECT doc_id, page, list(line ORDER BY pos) AS ls FROM l GROUP BY ALL), j AS (SELECT *, array_to_string(ls, chr(10)) AS x, ls[1] AS one FROM g),
c AS (SELECT *, list_transform(ls, lambda v: len(list_filter(regexp_split_to_array(trim(v), '\\t+|\\s{2,}'), lambda p: trim(p) <> ''))) AS cols, trim(regexp_replace(one, '\\s+', ' ', 'g')) AS s FROM j),
t AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(s, '(^|[^0-9])(\\d+\\.\\d+(?:\\.\\d+)*)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda p: trim(p)), lambda p: regexp_matches(p, '^\\d+\\.\\d+')) AS ps, trim(regexp_replace('2.1 ' || one || ' 44', '\\s+', ' ', 'g')) AS h FROM c)
SELECT doc_id, page, len(ls) >= 3 AND CASE WHEN regexp_matches(x, '->|<-|:=') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(x, '(?mi)^\\s*(?:while|for|if|function)\\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(x, '(?mi)\\bend (?:if|for|while|function)\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '(?mi)\\breturn\\b') THEN 1 ELSE 0 END
   + CASE WHEN len(list_filter(ls, lambda v: regexp_matches(v, '^ {2,}'))) >= greatest(2, len(ls) // 3) THEN 1 ELSE 0 END >= 3 AS code,
 len(ls) >= 3 AND (len(list_filter(ls, lambda v: contains(v, '|'))) >= 2 OR len(list_filter(cols, lambda n: n >= 3)) >= 3) AS table_like,
 len(ls) >= 2 AND len(list_filter(ls[1:20], lambda v: regexp_matches(trim(v), '(?:^|[^0-9])\\d+\\.\\d+(?:[^0-9]|$)') AND regexp_matches(trim(v), '\\b\\d{1,4}\\s*$'))) >= 2 AS contents,
 CASE WHEN s = '' THEN '' WHEN len(ps) >= 2 AND regexp_matches(s, '\\b\\d{1,4}\\s*$') THEN array_to_string(ps, '|') ELSE s END AS toc,
 CASE WHEN regexp_extract(h, '^\\d+(?:\\.\\d+)*\\s+.+?\\s+(\\d{1,3})\\s*$', 1) <> '' AND try_cast(regexp_extract(h, '^\\d+(?:\\.\\d+)*\\s+.+?\\s+(\\d{1,3})\\s*$', 1) AS INT) <= 500 THEN rtrim(regexp_extract(h, '^(\\d+(?:\\.\\d+)*\\s+.+?)\\s+\\d{1,3}\\s*$', 1)) ELSE h END AS heading FROM t"""


def table_grids(spark, sf):
    """Tables made from the lines of documents, a word a cell, and how good they are."""
    raw = M.lines(table(spark, sf, "documents").select("doc_id", F.col("text").alias("md")))
    words = F.split(F.trim(F.regexp_replace("line", "[^A-Za-z0-9.%]+", " ")), " ")
    cells = F.transform(F.slice(F.concat(words, F.array_repeat(F.lit(""), 6)), 1, 5), lambda w, i: F.when((i == 2) & (F.col("pos") % 2 == 0), F.concat(F.length(w).cast("string"), F.lit(".5%"))).otherwise(w))
    return C.table_quality(raw.where("pos < 15").select("doc_id", "pos", cells.alias("cells")), "doc_id")


GRID_SQL = """WITH raw AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
c AS (SELECT doc_id, pos, list_transform(range(1, 6), lambda i: CASE WHEN i = 3 AND pos % 2 = 0 THEN length(coalesce(w[i], '')) || '.5%' ELSE coalesce(w[i], '') END) AS cells FROM (SELECT doc_id, pos, string_split(trim(regexp_replace(line, '[^A-Za-z0-9.%]+', ' ', 'g')), ' ') AS w FROM raw WHERE pos < 15)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, list_filter(cells, lambda x: x <> '') AS f FROM c),
t AS (SELECT doc_id, 5 AS width, greatest(count(*) - 2, 0) AS body_rows, coalesce(sum(len(f)) FILTER (WHERE n > 2), 0) AS cells, coalesce(sum(len(list_filter(f, lambda x: regexp_full_match(x, '(?i)[+-]?(?:\\d+(?:\\.\\d+)?|\\.\\d+)(?:%|e[+-]?\\d+)?')))) FILTER (WHERE n > 2), 0) AS numbers,
  coalesce(sum(len(list_filter(f, lambda x: length(x) <= 1))) FILTER (WHERE n > 2), 0) AS tiny, coalesce(sum(len(list_filter(f, lambda x: regexp_full_match(x, '[A-Za-z]{1,2}')))) FILTER (WHERE n > 2), 0) AS words, coalesce(sum(len(list_filter(f, lambda x: len(regexp_extract_all(x, '[A-Za-z]{2,}')) >= 8))) FILTER (WHERE n > 2), 0) AS phrases, count(*) FILTER (WHERE n > 2 AND len(f) <= 1) AS sparse, sum(len(f)) AS shown FROM n GROUP BY 1),
s AS (SELECT *, cells / greatest(body_rows * width, 1) AS fill, sparse / greatest(body_rows, 1) AS sparse_share, tiny / greatest(cells, 1) AS tiny_share, words / greatest(cells, 1) AS word_share, phrases / greatest(cells, 1) AS phrase_share FROM t)
SELECT doc_id, width, body_rows, round(fill::DOUBLE, 6) AS fill, round(sparse_share::DOUBLE, 6) AS sparse_share, round(tiny_share::DOUBLE, 6) AS tiny_share, round(word_share::DOUBLE, 6) AS word_share, round(phrase_share::DOUBLE, 6) AS phrase_share, round(CASE WHEN body_rows > 0 THEN width * body_rows + 0.08 * shown ELSE 0 END::DOUBLE, 4) AS score,
 body_rows > 0 AND cells > 0 AND fill >= 0.36 AND sparse_share <= 0.34 AND (numbers > 0 OR body_rows + 2 < 5) AND tiny_share <= 0.35 AND word_share <= 0.22 AND NOT (body_rows + 2 > 12 AND word_share > 0.10) AND word_share <= 0.14
 AND phrase_share <= 0.55 AND NOT (phrase_share > 0.38 AND numbers / greatest(cells, 1) < 0.12) AS sane FROM s"""


def body_sizes(spark, sf):
    """Lines as spans of a font size by their length: the size of each document's body."""
    raw = M.lines(table(spark, sf, "documents").select("doc_id", F.col("text").alias("md")))
    return C.body_size(raw.select("doc_id", "pos", (8 + F.pmod(F.length("line"), F.lit(7)) / 2).alias("size")), "doc_id")


SIZE_SQL = """WITH n AS (SELECT doc_id, round(8 + (length(line) % 7) / 2, 1) AS size, count(*) AS n, min(pos) AS pos FROM (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)) GROUP BY ALL)
SELECT doc_id, size AS body_size FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) = 1"""


def converter_metrics(spark, sf):
    """Metrics of converter logs; the lines are events in the log's forms, a run a user."""
    e = table(spark, sf, "events")
    n = lambda k: F.pmod("event_id", F.lit(k)).cast("string")
    s = F.round(F.abs("value"), 2).cast("string")
    page = F.concat(F.lit("[Page "), n(13), F.lit("] "))
    forms = [
        F.concat(page, F.lit("TOTAL: "), s, F.lit("s")), F.concat(page, F.lit("Step 6 (vision convert): "), s, F.lit("s")), F.concat(page, F.lit("Step 1 (scan): "), s, F.lit("s, x=1, references="), n(2)), F.concat(F.lit("[VISION_DIRECT][REFS] page "), n(13), F.lit(": column mode enabled")),
        F.concat(F.lit("[VISION_DIRECT][REFS] page "), n(13), F.lit(" crop 1/2 done ("), s, F.lit("s, x")), F.concat(F.lit("[vision_direct][LAYOUT] page "), n(13), F.lit(": structured crop mode enabled")), F.concat(F.lit("[VISION_DIRECT] VL empty on page "), n(13), F.lit(", retry 1")), F.lit("now falling back to extraction pipeline"),
    ]
    line = F.element_at(F.array(*forms), F.pmod(F.floor(F.col("event_id") / 13) + F.col("event_id"), F.lit(len(forms))).cast("int") + 1)
    # A page has one line of each form in a run.
    rows = e.select(F.concat(F.lit("u"), F.pmod("user_id", F.lit(90))).alias("run"), line.alias("line"), F.pmod("event_id", F.lit(13)).alias("p"), F.pmod(F.floor(F.col("event_id") / 13) + F.col("event_id"), F.lit(len(forms))).alias("f"))
    return C.log_metrics(rows.groupBy("run", "p", "f").agg(F.max("line").alias("line")))


METRIC_SQL = """WITH e AS (SELECT 'u' || (user_id % 90) AS run, event_id % 13 AS p, (event_id // 13 + event_id) % 8 AS f, event_id % 2 AS r, round(abs(value), 2) AS s, round(abs(value), 2)::VARCHAR AS t FROM events),
x AS (SELECT run, p, f, max({'t': t, 's': s, 'r': r}) AS m, max({'t': t, 'r': r}) AS mr FROM e GROUP BY ALL),
g AS (SELECT run, p, max(m.s) FILTER (WHERE f = 0) AS total, max(m.s) FILTER (WHERE f = 1) AS vision, coalesce(bool_or(mr.r = 1) FILTER (WHERE f = 2), false) AS refs, coalesce(bool_or(f IN (3, 4)), false) AS rc, coalesce(bool_or(f = 5), false) AS la FROM x WHERE f < 6 GROUP BY ALL),
k AS (SELECT run, count(*) FILTER (WHERE f = 4) AS refs_crops, round(coalesce(avg(m.s) FILTER (WHERE f = 4), 0), 4) AS refs_crop_avg, count(*) FILTER (WHERE f = 6) AS empty_retries, 0::BIGINT AS math_retries, count(*) FILTER (WHERE f = 7) AS fallbacks FROM x GROUP BY 1),
q AS (SELECT run, count(*) AS pages, count(total) AS timed, round(coalesce(avg(total), 0), 4) AS total_avg, round(coalesce(quantile_cont(total, 0.5), 0), 4) AS total_p50, round(coalesce(quantile_cont(total, 0.9), 0), 4) AS total_p90, count(vision) AS vision_pages, round(coalesce(avg(vision), 0), 4) AS vision_avg,
  round(coalesce(quantile_cont(vision, 0.5), 0), 4) AS vision_p50, round(coalesce(quantile_cont(vision, 0.9), 0), 4) AS vision_p90, count(*) FILTER (WHERE refs) AS refs_pages, count(*) FILTER (WHERE rc) AS refs_column_pages, count(*) FILTER (WHERE la) AS layout_pages FROM g GROUP BY 1)
SELECT * FROM k LEFT JOIN q USING (run)"""


def unused_assets(spark, sf):
    """Links of pages as assets of their host, that the pages of other hosts don't name: each page's first three links against the links of the next page."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("(?i)(?:href|src)=\"([^\"]*)\""), F.lit(1)).alias("links"))
    name = lambda x: F.element_at(F.split(x, "/"), -1)
    assets = p.select(F.col("page_id").alias("doc_id"), F.explode(F.array_distinct(F.transform("links", name))).alias("name"))
    md = p.select((F.col("page_id") - 1).alias("doc_id"), F.array_join(F.transform("links", lambda x: F.concat(F.lit("![x]("), F.regexp_replace(x, "[()]", ""), F.lit(")"))), " ").alias("line"))
    return C.unused_assets(assets, md)


ASSET_SQL = """WITH p AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)="([^"]*)"', 1) AS links FROM pages), a AS (SELECT DISTINCT page_id AS doc_id, string_split(unnest(links), '/')[-1] AS name FROM p),
m AS (SELECT page_id - 1 AS doc_id, string_split(regexp_replace(unnest(links), '[()]', '', 'g'), '/')[-1] AS name FROM p) SELECT * FROM a WHERE (doc_id, name) NOT IN (SELECT (doc_id, name) FROM m)"""


def reflowed_documents(spark, sf):
    """Documents with their hard-wrapped lines joined (a fold that SQL can't express)."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", F.size(F.split("t", "\n")).alias("before"), F.size(F.split(C.reflowed("t"), "\n")).alias("after"))


def folded_text(spark, sf):
    bounded(spark)
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("ﬁrst “quoted” "), F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", F.sha1(C.folded("t")).alias("sha1"), F.length(C.compatible("t")).alias("compatible"))


QUERIES = {f.__name__: f for f in (noise_lines, outline_levels, citation_forms, analyzer_issues, markdown_quality, regression_report, block_classes, table_grids, body_sizes, converter_metrics, unused_assets, reflowed_documents, folded_text)}
ORACLE_SQL = {
    "noise_lines": NOISE_SQL, "outline_levels": LEVEL_SQL, "citation_forms": FORMS_SQL, "analyzer_issues": ISSUE_SQL, "markdown_quality": MARKDOWN_SQL, "regression_report": REGRESSION_SQL, "unused_assets": ASSET_SQL, "block_classes": CLASS_SQL, "table_grids": GRID_SQL, "body_sizes": SIZE_SQL, "converter_metrics": METRIC_SQL,
    "folded_text": "SELECT doc_id, sha1('first \"quoted\" ' || coalesce(text, '')) AS sha1, length('first “quoted” ' || nfc_normalize(coalesce(text, '')))::INT AS compatible FROM documents",
}
