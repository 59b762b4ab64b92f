"""Evidence: answer segments against blocks, hit levels, and the display of the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def segments(answers: DataFrame, key: str = "answer_id", body: str = "text") -> DataFrame:
    """key, seg_no, kind and segment: paragraphs, list items, tables and quotes of at least ten characters."""
    parts = answers.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n")).alias("pos", "segment"))
    kind = F.when(F.col("segment").rlike("^\\s*\\|"), "table").when(F.col("segment").rlike("^\\s*>"), "blockquote").when(F.col("segment").rlike("^\\s*([-*+]|\\d+\\.)\\s"), "list_item").otherwise("paragraph")
    kept = parts.withColumn("segment", F.trim("segment")).withColumn("kind", kind).where(F.length("segment") >= 10)
    return kept.withColumn("seg_no", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).drop("pos")


def hit_level(block_id: Column, anchor_id: Column, heading: Column, score: Column) -> Column:
    return F.when(anchor_id.isNotNull() & (score >= 0.9), "exact").when(block_id.isNotNull(), "block").when(F.coalesce(heading, F.lit("")) != "", "heading").otherwise("none")


def level_summary(hits: DataFrame, *by: str) -> DataFrame:
    """Counts of each hit level and the share located."""
    levels = {n: F.count_if(F.col("level") == n).alias(n) for n in ("exact", "block", "heading", "none")}
    return hits.groupBy(*by).agg(*levels.values(), F.round(F.avg((F.col("level") != "none").cast("double")), 4).alias("located"))


def claim_groups(segment: DataFrame, key: str = "answer_id") -> DataFrame:
    """Consecutive segments of one kind as groups with their first segment."""
    own = Window.partitionBy(key).orderBy("seg_no")
    new = F.coalesce(F.col("kind") != F.lag("kind").over(own), F.lit(True)).cast("int")
    runs = segment.withColumn("grp", F.sum(new).over(own))
    return runs.groupBy(key, "grp", "kind").agg(F.count("*").alias("segments"), F.min("seg_no").alias("lead"))


def overview(blocks: DataFrame, doc: str = "doc_id", n: int = 3) -> DataFrame:
    """Up to n blocks a document, at most one for each heading and text, the earliest and longest first."""
    score = F.greatest(1.1 - 0.09 * F.col("order_index"), F.lit(0.0)) + F.least(F.lit(0.6), F.length("text") / 1500)
    scored = blocks.where(F.length("text") >= 90).withColumn("score", F.round(score, 6))
    for keys in (["heading_path"], ["text"]):
        scored = scored.withColumn("_p", F.row_number().over(Window.partitionBy(doc, *keys).orderBy(F.desc("score"), "order_index"))).where("_p = 1").drop("_p")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), "order_index"))).where(F.col("place") <= n)


#: Blocks behind the header of a box to which its number is carried, under the same heading.
BOX_BLOCKS = 20


def atoms(blocks: DataFrame, doc: str = "doc_id", most: int = 10) -> DataFrame:
    """Sentences of blocks as atoms with an id, their citation numbers, the figure they are about and the number of their box, which is carried on from its header; at most `most` a block."""
    own = Window.partitionBy(doc).orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0)
    number = F.nullif(F.regexp_extract("text", "(?i)^\\W*box\\s*(\\d{1,2})\\b", 1), F.lit("")).cast("int")
    rows = blocks.withColumn("_box", F.last(F.when(number.isNotNull(), F.struct(number.alias("n"), "order_index", "heading_path")), ignorenulls=True).over(own))
    carried = (F.col("order_index") - F.col("_box.order_index") <= BOX_BLOCKS) & (text.match_text("heading_path") == text.match_text("_box.heading_path"))
    figure = text.figure_number(F.concat_ws("\n", "heading_path", F.substring("text", 1, 2400)))
    out = rows.select(doc, "block_id", "order_index", F.when(carried, F.col("_box.n")).otherwise(0).alias("box"), F.coalesce(figure, F.lit(0)).alias("figure"), F.posexplode(F.slice(text.sentences("text"), 1, most)).alias("n", "sentence"))
    return out.select(doc, "block_id", "order_index", F.concat_ws("#", "block_id", "n").alias("atom_id"), "sentence", text.inline_citations("sentence").alias("refs"), "figure", F.coalesce("box", F.lit(0)).alias("box"))


def section_map(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The first sentence under each heading path of a document, in order."""
    found = blocks.select(doc, "heading_path", "order_index", F.get(text.sentences("text"), F.lit(0)).alias("sentence")).where("sentence is not null")
    first = found.groupBy(doc, "heading_path").agg(F.min_by("sentence", "order_index").alias("sentence"), F.min("order_index").alias("order_index"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("order_index")))


def richer(a: Column, b: Column, by: int = 12) -> Column:
    """Of two values the first, unless it is empty or the second is longer by `by` characters."""
    return F.when(F.coalesce(a, F.lit("")) == "", b).when(F.length(b) >= F.length(a) + by, b).otherwise(a)


def with_task(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """files: path, name.  tasks: path, name, state, at.  The last task of each file: by path, else by name."""
    by_path = tasks.where("path is not null").groupBy(F.col("path").alias("_p")).agg(F.max_by("state", "at").alias("by_path"))
    by_name = tasks.groupBy(F.col("name").alias("_n")).agg(F.max_by("state", "at").alias("by_name"))
    out = files.join(by_path, F.col("path") == F.col("_p"), "left").join(by_name, F.col("name") == F.col("_n"), "left")
    return out.withColumn("state", F.coalesce("by_path", "by_name", F.lit("idle"))).drop("_p", "_n", "by_path", "by_name")


def strict_identity(hits: DataFrame, *by: str) -> DataFrame:
    """hits: block_id, anchor_id, heading.  Candidates, those with all identities, and what the others lack."""
    missing = F.concat_ws("+", *[F.when(F.coalesce(F.col(c), F.lit("")) == "", c) for c in ("block_id", "anchor_id", "heading")])
    out = hits.withColumn("missing", missing)
    return out.groupBy(*by).agg(F.count("*").alias("candidates"), F.count_if(F.col("missing") == "").alias("strict"), F.array_join(F.sort_array(F.collect_set(F.nullif("missing", F.lit("")))), ",").alias("reasons"))
