"""Claims of documents against the earlier document that they share a line with: bindings, contract and coverage; DuckDB SQL for what has no sequence ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import coverage as C
from ..operators import indices as I
from ..operators import markdown as M
from ..sources.shared import kept
from .common import table
from .indices import _MATCH, _SIGNAL, FIGURES, RICH, blocks

BY = ["answer_id"]
#: Characters of a line that makes an earlier document a source.
SHARED = 40


def sources(spark, sf) -> DataFrame:
    """answer_id and doc_id: the smallest document that has a line of SHARED characters or more in common with a later one."""
    line = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    line = line.where(F.length("line") >= SHARED).select("doc_id", F.unhex(F.md5("line")).alias("line")).distinct()
    first = line.groupBy("line").agg(F.min("doc_id").alias("first"))
    return line.join(first, "line").where("first < doc_id").groupBy(F.col("doc_id").alias("answer_id")).agg(F.min("first").alias("doc_id"))


def _blocks(spark, sf, src: DataFrame, key: str) -> DataFrame:
    """Numbered blocks of the documents that src names in a column; no others are read into a shuffle."""
    docs = table(spark, sf, "documents").join(src.select(F.col(key).alias("doc_id")).distinct(), "doc_id", "left_semi")
    return I.numbered(M.blocks(M.with_heading_path(M.rich_lines(docs))))


def claims(spark, sf, src: DataFrame | None = None, theirs: DataFrame | None = None) -> DataFrame:
    """The lines of a document that has a source, as claims, with the first block of the source that has the same text."""
    src = sources(spark, sf) if src is None else src
    theirs = _blocks(spark, sf, src, "doc_id") if theirs is None else theirs
    ours = _blocks(spark, sf, src, "answer_id").join(src.withColumnRenamed("doc_id", "source_id"), F.col("doc_id") == F.col("answer_id"))
    ours = ours.select("answer_id", F.col("order_index").alias("seg_no"), F.col("line").alias("segment"), "kind", F.col("heading_path").alias("heading"), F.col("source_id").alias("doc_id"), F.sha1(text.match_text("line")).alias("said"))
    theirs = theirs.groupBy("doc_id", F.sha1(text.match_text("line")).alias("said")).agg(F.min_by("block_id", "order_index").alias("block_id"), F.min("order_index").alias("order_index"))
    out = ours.join(theirs, ["doc_id", "said"], "left").drop("said")
    typed = C.claim_types(out.withColumn("mode", F.when(F.col("block_id").isNotNull(), "direct").otherwise("synthesis")))
    return typed.withColumn("mode", F.when(F.col("claim_type").isin(*C.MARKED), "direct").otherwise(F.col("mode")))


def claim_kinds(spark, sf):
    return C.scoped(claims(spark, sf), BY).select(*BY, "seg_no", "doc_id", "block_id", "claim_type", "number", "mode", "outside", F.sha1("anchor_text").alias("anchor"))


def figure_bindings(spark, sf):
    b = blocks(spark, sf)
    return C.figure_bindings(claims(spark, sf), I.numbered(b), I.figures(b), BY)


def equation_bindings(spark, sf):
    return C.equation_bindings(claims(spark, sf), I.equations(blocks(spark, sf)), BY)


def quote_bindings(spark, sf):
    return C.quote_bindings(claims(spark, sf), I.numbered(blocks(spark, sf)), BY)


def contract(spark, sf) -> DataFrame:
    """The contract of all claims.  Claims, blocks of sources and bindings are used several times and kept as tables."""
    src = kept(sources(spark, sf), "sources")
    n = kept(_blocks(spark, sf, src, "doc_id"), "blocks")
    c = kept(claims(spark, sf, src, n), "claims")
    b = n.drop("anchor_id", "is_caption", "number")
    bound = kept(C.bound_claims(c, n, BY, C.equation_bindings(c, I.equations(b), BY), C.figure_bindings(c, n, I.figures(b), BY), C.quote_bindings(c, n, BY)), "bound")
    agree = (F.col("number") > 0) & (F.col("number") == F.col("block_number"))
    align = F.round(C.alignment("segment", F.coalesce("block_text", F.lit("")), F.coalesce(agree, F.lit(False))), 6)
    return C.contract(kept(C.scoped(bound, BY).withColumns({"must_locate": F.lit(False), "align": align}), "ready"), BY)


def claim_contract(spark, sf):
    return contract(spark, sf).select(*BY, "seg_no", "claim_type", "block_id", "policy", "surface", "origin", "grp")


def claim_coverage(spark, sf):
    return C.coverage(contract(spark, sf), BY)


_INLINE = "\\$([^$]{1,280})\\$"
_SPANS = "list_concat(list_concat(" + ", ".join(f"regexp_extract_all(line, '{p}', 1)".replace("‘’'", "‘’''") for p in C.QUOTES[:2]) + f"), regexp_extract_all(line, '{C.QUOTES[2]}', 1))"
_FIGURE_NO = "coalesce(nullif(regexp_extract(line, '(?i)fig(?:ure)?s?\\.?\\s*(\\d{1,3})', 1), '')::INT, 0)"
_EQUATION_NO = "coalesce(nullif(regexp_extract(line, '\\\\tag\\{(\\d{1,3})\\}', 1), '')::INT, nullif(regexp_extract(line, '(?i)eq(?:uation)?s?\\.?\\s*\\(?(\\d{1,3})\\)?', 1), '')::INT, 0)"
_DISPLAY = f"(regexp_matches(trim(line), '(?s)\\$\\$.+\\$\\$') OR ({_SIGNAL('trim(line)')} AND regexp_matches(line, '=|\\\\tag\\{{|\\\\(?:sum|int|frac|mathcal|mathbf)') AND len(regexp_extract_all(line, '[A-Za-z]{{3,}}')) <= 12))"
_SAYS = f"(regexp_matches(line, '{C.NOT_SAID}') OR " + " OR ".join(f"contains(lower(line), '{h}')" for h in C.NOT_FROM_SOURCE) + " OR (contains(line, '补充说明') AND (contains(line, '检索片段') OR contains(lower(line), 'retrieved context'))))"
CLAIMS = f"""{RICH},
ln AS (SELECT DISTINCT doc_id, line FROM raw WHERE length(line) >= {SHARED}), fl AS (SELECT line, min(doc_id) AS first FROM ln GROUP BY 1),
src AS (SELECT ln.doc_id AS answer_id, min(first) AS source_id FROM ln JOIN fl USING (line) WHERE first < ln.doc_id GROUP BY 1),
th AS (SELECT doc_id, {_MATCH("line")} AS said, arg_min(block_id, order_index) AS block_id, min(order_index) AS spot FROM bn GROUP BY 1, 2),
c0 AS (SELECT answer_id, b.order_index AS seg_no, b.line, b.kind, source_id AS doc_id, th.block_id, th.spot FROM bn b JOIN src ON b.doc_id = answer_id LEFT JOIN th ON th.doc_id = source_id AND th.said = {_MATCH("b.line")}),
c1 AS (SELECT *, {_SAYS} AS says, {_DISPLAY} AS display, {_SIGNAL("line")} AS signal, regexp_extract(line, '{_INLINE}', 1) AS formula, {_FIGURE_NO} AS fig, {_EQUATION_NO} AS eq, list_transform(list_filter({_SPANS}, lambda s: length(s) >= 12), lambda s: substr(s, 1, 360)) AS sp FROM c0),
c2 AS (SELECT *, list_filter(sp, lambda s, i: list_position(sp, s) = i)[1:6] AS spans FROM c1),
c3 AS (SELECT *, CASE WHEN says THEN CASE WHEN block_id IS NOT NULL THEN 'evidence_note_claim' ELSE 'shell_sentence' END
  WHEN formula <> '' AND NOT contains(line, '$$') AND (length(formula) >= greatest(16, 0.38 * length(line)) OR length(trim(regexp_replace(line, '{_INLINE}', ' ', 'g'))) <= 40) THEN 'inline_formula_claim'
  WHEN display THEN 'formula_claim' WHEN fig > 0 THEN 'figure_claim' WHEN kind = 'blockquote' THEN 'blockquote_claim' WHEN len(spans) > 0 THEN 'quote_claim' WHEN regexp_matches(line, '[:：]$') AND length(line) <= 33 THEN 'shell_sentence' ELSE 'critical_fact_claim' END AS claim_type FROM c2),
cl AS (SELECT *, CASE claim_type WHEN 'inline_formula_claim' THEN formula WHEN 'quote_claim' THEN list_max(list_transform(spans, lambda s: {{'n': length(s), 's': s}})).s WHEN 'shell_sentence' THEN '' ELSE substr(trim(line), 1, 900) END AS anchor_text,
  CASE WHEN claim_type = 'figure_claim' THEN fig WHEN signal THEN eq ELSE 0 END AS number, CASE WHEN block_id IS NOT NULL OR claim_type IN {C.MARKED} THEN 'direct' ELSE 'synthesis' END AS mode,
  CASE WHEN says AND (regexp_matches(trim(line), '[:：]$') OR contains(lower(substr(trim(line), 1, 48)), 'supplement') OR contains(substr(trim(line), 1, 16), '说明')) THEN true WHEN NOT says AND regexp_matches(trim(line), '{C.BOUNDARY}') THEN false END AS event FROM c3)"""
KIND_SQL = f"WITH {CLAIMS} SELECT answer_id, seg_no::INT AS seg_no, doc_id, block_id, claim_type, number, mode, says OR coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY answer_id ORDER BY seg_no), false) AS outside, sha1(anchor_text) AS anchor FROM cl"
FIGURE_SQL = f"""WITH {CLAIMS}, {FIGURES}, kf AS (SELECT fi.*, order_index AS f_at FROM fi JOIN bn USING (doc_id, block_id)),
a0 AS (SELECT answer_id, seg_no, cl.doc_id, cl.number, cl.block_id AS own, spot, kf.block_id AS figure_id, kf.f_at, kf.caption_block_id FROM cl LEFT JOIN kf ON kf.doc_id = cl.doc_id AND kf.number = cl.number WHERE claim_type = 'figure_claim' AND cl.number > 0),
a1 AS (SELECT *, coalesce(f_at, spot) AS pos FROM a0 QUALIFY row_number() OVER (PARTITION BY answer_id, seg_no ORDER BY CASE WHEN figure_id = own THEN 0 ELSE 1 END, f_at NULLS FIRST) = 1),
nm AS (SELECT doc_id, {_FIGURE_NO} AS number, block_id AS caption_id, order_index AS c_at, is_caption, line FROM bn WHERE kind IN {I.PROSE}),
s AS (SELECT a1.*, caption_id, c_at, round((CASE WHEN caption_id = caption_block_id THEN 2.9 ELSE 0 END + CASE WHEN is_caption THEN 0.72 ELSE 0 END + CASE WHEN regexp_matches(lower(line), '^\\s*(?:fig(?:ure)?\\.?\\s*' || a1.number || '\\b|图\\s*' || a1.number || '\\b)') THEN 1.3 ELSE 0 END
  + coalesce(CASE abs(c_at - pos) WHEN 1 THEN 0.42 WHEN 0 THEN 0.28 ELSE greatest(0, 0.18 - 0.04 * abs(c_at - pos)) END, 0))::DOUBLE, 6) AS score FROM a1 LEFT JOIN nm ON nm.doc_id = a1.doc_id AND nm.number = a1.number),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY answer_id, seg_no ORDER BY CASE WHEN caption_id IS NULL THEN NULL ELSE score END DESC NULLS LAST, c_at) = 1)
SELECT answer_id, seg_no::INT AS seg_no, figure_id, CASE WHEN score >= {C.CAPTION_FLOOR} THEN caption_id END AS caption_id FROM b WHERE figure_id IS NOT NULL OR CASE WHEN score >= {C.CAPTION_FLOOR} THEN caption_id END IS NOT NULL"""

QUERIES = {f.__name__: f for f in (claim_kinds, figure_bindings, equation_bindings, quote_bindings, claim_contract, claim_coverage)}
#: The others take sequence ratios; tests hold them against plain Python.
ORACLE_SQL = {"claim_kinds": KIND_SQL, "figure_bindings": FIGURE_SQL}
