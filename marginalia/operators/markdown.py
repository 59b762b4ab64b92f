"""Markdown as tables: lines, headings filled forward, blocks, chunks, captions and equation contexts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import bounded


def lines(docs: DataFrame, key: str = "doc_id", text: str = "md") -> DataFrame:
    """key, pos (from 0) and line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def synthetic_lines(docs: DataFrame) -> DataFrame:
    """Markdown made from prose: every 7th line is a heading of level 1, every 3rd of level 2, and some others carry citations."""
    raw = lines(docs.select("doc_id", F.col("text").alias("md")))
    k = F.pmod("pos", F.lit(9)) + 1
    cite = F.when(F.pmod("pos", F.lit(12)) == 1, F.concat(F.lit(" ["), k, F.lit("-"), k + 2, F.lit("]"))).when(F.pmod("pos", F.lit(4)) == 1, F.concat(F.lit(" ["), k, F.lit("]"))).otherwise("")
    body = F.concat("line", cite)
    return raw.select("doc_id", "pos", F.when(F.pmod("pos", F.lit(7)) == 0, F.concat(F.lit("# "), "line")).when(F.pmod("pos", F.lit(3)) == 0, F.concat(F.lit("## "), "line")).otherwise(body).alias("line"))


def rich_lines(docs: DataFrame) -> DataFrame:
    """Markdown made from prose like synthetic_lines(), with equations, figures and captions, tables, quotes, lists and mentions at fixed places."""
    raw = lines(docs.select("doc_id", F.col("text").alias("md")))
    k, at = F.pmod("pos", F.lit(9)) + 1, F.pmod("pos", F.lit(20))
    forms = {
        2: F.concat(F.lit("$$ E_{"), k, F.lit("} = \\sum "), F.substring("line", 1, 12), F.lit(" \\tag{"), k, F.lit("} $$")),
        4: F.concat(F.lit("![fig](assets/f"), k, F.lit(".png)")),
        5: F.concat(F.lit("**Figure "), k, F.lit(".** "), "line"),
        8: F.concat(F.lit("| "), "line", F.lit(" | "), k, F.lit(" |")),
        10: F.concat(F.lit("> "), "line"),
        11: F.concat(F.lit("- "), "line"),
        13: F.concat(F.lit("eq. ("), k, F.lit(") says "), "line"),
        16: F.concat(F.lit("see Fig. "), k, F.lit(" "), "line"),
    }
    body = F.when(F.pmod("pos", F.lit(7)) == 0, F.concat(F.lit("# "), "line")).when(F.pmod("pos", F.lit(3)) == 0, F.concat(F.lit("## "), "line"))
    for n, form in forms.items():
        body = body.when(at == n, form)
    return raw.select("doc_id", "pos", body.otherwise(F.col("line")).alias("line"))


def with_heading_path(md: DataFrame, levels: int = 3) -> DataFrame:
    """md: doc_id, pos, line.  Adds level (0: body) and heading_path, the titles of the headings above a line."""
    level = F.length(F.regexp_extract("line", "^(#{1,6})\\s", 1))
    out = md.withColumn("level", level).withColumn("title", F.trim(F.regexp_replace("line", "^#{1,6}\\s+", "")))
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for n in range(1, levels + 1):
        # A heading of level n holds until one of its own or of a higher level comes.
        mark = F.when(F.col("level") == n, F.struct(F.col("title").alias("t"))).when((F.col("level") > 0) & (F.col("level") < n), F.struct(F.lit(None).cast("string").alias("t")))
        out = out.withColumn(f"_h{n}", F.last(mark, ignorenulls=True).over(order)["t"])
    return out.withColumn("heading_path", F.concat_ws(" / ", *[f"_h{n}" for n in range(1, levels + 1)])).drop("title", *[f"_h{n}" for n in range(1, levels + 1)])


def blocks(md: DataFrame) -> DataFrame:
    """Non-blank lines as blocks with a kind, an order and an id that counts by kind (p_00001, h_00001, ...)."""
    kind = (
        F.when(F.col("level") > 0, "heading").when(F.col("line").rlike("^\\s*\\|"), "table").when(F.col("line").rlike("^\\s*>"), "blockquote").when(F.col("line").rlike("^\\s*([-*+]|\\d+\\.)\\s"), "list_item")
        .when(F.col("line").rlike("^\\s*!\\["), "figure").when(F.col("line").rlike("\\$\\$|\\\\begin\\{equation"), "equation").otherwise("paragraph")
    )
    out = md.where(F.trim("line") != "").withColumn("kind", kind)
    order = Window.partitionBy("doc_id").orderBy("pos")
    prefix = F.create_map(*[F.lit(x) for kv in {"heading": "h", "table": "tb", "blockquote": "q", "list_item": "li", "figure": "fg", "equation": "eq", "paragraph": "p"}.items() for x in kv])
    n = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("pos"))
    return out.withColumn("order_index", F.row_number().over(order)).withColumn("block_id", F.concat(prefix[F.col("kind")], F.lit("_"), F.lpad(n.cast("string"), 5, "0")))


_CHUNK = T.StructType([T.StructField("chunk_idx", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("heading_path", T.StringType())])


def _fold(rows: list[tuple[int, str, str]], size: int, overlap: int) -> list[tuple[int, str, str]]:
    out: list[tuple[int, str, str]] = []
    parts: list[str] = []
    path, length = "", 0

    def flush(keep: bool) -> None:
        nonlocal parts, length
        text = "\n".join(parts).strip()
        if text:
            out.append((len(out), text, path))
        tail = text[-overlap:] if keep and overlap and text else ""
        parts, length = ([tail], len(tail)) if tail else ([], 0)

    for level, line, heading in rows:
        if level:
            flush(False)
            path = heading
        if parts and length + len(line) + 1 > size and length > 200:
            flush(True)
        parts.append(line)
        length += len(line) + 1
    flush(False)
    return out


def chunks(md: DataFrame, size: int = 1400, overlap: int = 200) -> DataFrame:
    """md: doc_id, pos, line, level, heading_path.  Greedy chunks of about `size` characters: a heading starts a new
    one, and where a chunk is full the next begins with its last `overlap` characters.  The fold runs inside
    one row a document, in Arrow batches that are bounded in bytes; a path goes there with its heading alone."""
    bounded(md.sparkSession)
    path = F.when(F.col("level") > 0, F.col("heading_path")).alias("heading_path")
    folded = md.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "level", "line", path))).alias("rows"))

    @F.pandas_udf(T.ArrayType(_CHUNK))
    def fold(rows: pd.Series) -> pd.Series:
        return pd.Series([_fold([(r["level"], r["line"], r["heading_path"]) for r in own], size, overlap) for own in rows])

    return folded.select("doc_id", F.inline(fold("rows")))


def caption_of_figure(block: DataFrame) -> DataFrame:
    """Figure blocks with the next paragraph as caption if it starts with 'Figure' or 'Fig.'."""
    nxt = Window.partitionBy("doc_id").orderBy("order_index")
    out = block.withColumn("next_line", F.lead("line").over(nxt)).where("kind = 'figure'")
    return out.select("doc_id", "block_id", F.when(F.col("next_line").rlike("(?i)^\\W*fig(ure|\\.)"), F.col("next_line")).alias("caption"))


def nearest_prose(block: DataFrame, kind: str) -> DataFrame:
    """Blocks of a kind with the closest paragraph before and after each."""
    prose = F.when(F.col("kind") == "paragraph", F.col("block_id"))
    own = Window.partitionBy("doc_id").orderBy("order_index")
    out = block.withColumn("before", F.last(prose, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(prose, ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing)))
    return out.where(F.col("kind") == kind).select("doc_id", "block_id", "before", "after")


def repeated_noise(page_lines: DataFrame, least: int = 3, share: float = 0.4) -> DataFrame:
    """page_lines: doc_id, page, line.  Lines that stand on at least `share` of a document's pages, and on `least`."""
    pages = page_lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    seen = page_lines.where(F.trim("line") != "").groupBy("doc_id", "line").agg(F.countDistinct("page").alias("n"))
    return seen.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))).select("doc_id", "line", "n", "pages")
