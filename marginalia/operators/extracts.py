"""Answers that are taken from a document as it stands, what hits are about, and whether an index is behind its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .indices import _clean
from .selection import citation_signal, panel_clauses, panel_letters

#: What a prompt wants of hits, and (label, words of the hits) in the order in which aspects are named.
WANTS = {
    "detector": "单光子|探测器|spad|snspd|nanowire|dark count|jitter|quantum efficiency|detector", "encoding": "编码|掩膜|pattern|mask|sampling|hadamard|fourier|dmd|metamaterial|multiplex|coded|coding", "compare": "对比|比较|baseline|compare|ablation|消融",
    "metrics": "指标|性能|效率|灵敏度|暗计数|jitter|psnr|ssim|efficiency|dcr", "definition": "是什么|定义|含义|概念|what is|definition",
}
DETECTOR_ASPECTS = [
    ("探测原理/工作机制", "spad|avalanche|geiger|nanowire|snspd|superconduct|transition edge|tes"), ("器件结构/材料体系", "semiconductor|bulk|low-dimensional|perovskite|superconduct|nanowire|material"),
    ("关键指标与权衡", "dark count|dcr|time jitter|jitter|efficiency|quantum efficiency|snr|time resolution"), ("应用场景", "application|lidar|imaging|communication|quantum|bio"),
]
DETECTOR_COMPARED = ("对比/优缺点总结", "compare|comparison|advantage|disadvantage|trade-off|baseline")
DETECTOR_NAMES = [("spad", "SPAD"), ("snspd", "SNSPD"), ("nanowire", "纳米线"), ("transition edge", "TES"), ("perovskite", "钙钛矿")]
ENCODING = ("编码/采样策略", "hadamard|fourier|pattern|mask|dmd|coded|coding|sampling|multiplex|frequency-division|metamaterial|metasurface|speckle")
ENCODING_NAMES = [("hadamard", "Hadamard"), ("fourier", "Fourier"), ("dmd", "DMD"), ("frequency-division", "频分复用"), ("multiplex", "复用"), ("metamaterial", "超材料"), ("metasurface", "超表面"), ("speckle", "散斑")]
ASPECTS = [
    ("测量/前向模型", "forward model|measurement model|measurement|sensing|compressive|snapshot|ghost imaging|single-pixel|single pixel|spi"), ("光学/硬件架构", "hardware|optical|disperser|camera|mask|sensor|system|metamaterial|metasurface"),
    ("重建/反演算法", "reconstruction|inverse|recover|optimization|solver|iter|algorithm|unrolling|tv|l1"), ("训练设置/实现细节", "implementation|training|hyperparameter|batch|lr|learning rate"), ("损失/正则项", "loss|objective|regular|prior|constraint"),
    ("实验设置/数据集", "dataset|benchmark|setup|scene|real data|simulated"), ("评价指标/对比结果", "psnr|ssim|metric|performance|compare|baseline|ablation|result"), ("局限/失败案例", "limitation|failure|future work|discussion"), ("可追溯参考文献", "references|bibliography"),
]
RESULTS, DEFINITION = "评价指标/对比结果", "概念定义/问题设定"


def _named(x: Column, names: list[tuple[str, str]]) -> Column:
    """The first two names whose words stand in a text, in brackets; '' without any."""
    found = F.slice(F.filter(F.array(*[F.when(x.contains(k), v) for k, v in names]), lambda n: n.isNotNull()), 1, 2)
    return F.when(F.size(found) > 0, F.concat(F.lit("（"), F.array_join(found, "、"), F.lit("）"))).otherwise("")


def aspects(prompt: Column, snippets: Column, most: int = 4) -> Column:
    """What hits are about, as up to four labels: by the words of their text, in an order that follows what the prompt wants."""
    low = F.lower(snippets)
    want = {k: F.lower(prompt).rlike(p) for k, p in WANTS.items()}
    there = lambda label, p: F.when(low.rlike(p), label)
    some = lambda *cs: F.filter(F.array(*cs), lambda a: a.isNotNull())
    detector = some(*[there(*a) for a in DETECTOR_ASPECTS], F.when(want["compare"], there(*DETECTOR_COMPARED)))
    detector = F.when(F.size(detector) > 0, F.concat(F.array(F.concat(detector[0], _named(low, DETECTOR_NAMES))), F.slice(detector, 2, 10))).otherwise(detector)
    general = some(F.when(want["encoding"], there(*ENCODING)), *[there(*a) for a in ASPECTS])
    first = (want["metrics"] | want["compare"]) & F.array_contains(general, RESULTS)
    general = F.when(first, F.concat(F.array(F.lit(RESULTS)), F.array_remove(general, RESULTS))).otherwise(general)
    general = F.transform(general, lambda a: F.when(a == ENCODING[0], F.concat(a, _named(low, ENCODING_NAMES))).otherwise(a))
    general = F.when(want["definition"], F.concat(F.array(F.lit(DEFINITION)), general)).otherwise(general)
    return F.slice(F.when(want["detector"], detector).otherwise(general), 1, most)


def exact_equations(wanted: DataFrame, equation: DataFrame) -> DataFrame:
    """wanted: doc_id, prompt.  The equation of the number that a prompt names, the first of equals, as it stands: doc_id, answer, block_id."""
    own = wanted.select("doc_id", text.equation_number("prompt").alias("number")).where("number > 0")
    rows = equation.join(own, ["doc_id", "number"]).groupBy("doc_id", "number").agg(F.min(F.struct("block_id", "tex", "heading_path")).alias("e"))
    where = F.when(F.col("e.heading_path") != "", F.concat(F.lit(" in "), "e.heading_path")).otherwise("")
    return rows.select("doc_id", F.concat(F.lit("Equation ("), F.col("number").cast("string"), F.lit(") is stated"), where, F.lit(":\n"), "e.tex").alias("answer"), F.col("e.block_id").alias("block_id"))


def exact_panels(wanted: DataFrame, figure: DataFrame) -> DataFrame:
    """The caption of the figure that a prompt names, or its clause for the panel; with the references of what is quoted."""
    own = wanted.select("doc_id", text.figure_number("prompt").alias("number"), panel_letters("prompt").alias("panels")).where("number > 0")
    rows = figure.where("caption <> ''").join(own, ["doc_id", "number"]).groupBy("doc_id", "number", "panels").agg(F.min(F.struct("block_id", "caption", "heading_path")).alias("f"))
    clause = F.get(F.filter(panel_clauses("f.caption"), lambda c: F.array_contains("panels", c["letter"])), F.lit(0))
    rows = rows.withColumn("clause", clause)
    quoted = F.coalesce("clause.clause", "f.caption")
    refs = text.inline_citations(quoted)
    panel = F.when(F.col("clause").isNotNull(), F.concat(F.lit(" for panel ("), F.col("clause.letter"), F.lit(")"))).otherwise("")
    section = F.when(F.col("f.heading_path") != "", F.concat(F.lit("\nSection: "), "f.heading_path")).otherwise("")
    label = F.when(F.size(refs) > 0, F.concat(F.lit("\nReferences in this clause: "), F.array_join(F.transform(F.slice(refs, 1, 4), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", "))).otherwise("")
    return rows.select("doc_id", F.concat(F.lit("Figure "), F.col("number").cast("string"), F.lit(" caption"), panel, F.lit(" states:"), section, F.lit("\n> "), quoted, label).alias("answer"), F.col("f.block_id").alias("block_id"))


def exact_citations(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block that best answers what is cited for a prompt's topic, with its numbers; none where no block with citations scores above 0."""
    rows = blocks.select("doc_id", "block_id", "order_index", F.col("heading_path").alias("heading"), _clean("line", 1200).alias("body")).where(F.col("body").contains("[")).join(wanted, "doc_id").withColumn("refs", text.inline_citations("body")).where(F.size("refs") > 0)
    rows = rows.withColumn("score", citation_signal(F.col("prompt"), F.col("heading"), F.col("body")))
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "order_index"))).where("_n = 1 and score > 0")
    label = F.array_join(F.transform(F.slice("refs", 1, 4), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", ")
    where = F.when(F.col("heading") != "", F.concat(F.lit("This is stated in "), "heading", F.lit(":"))).otherwise("This is stated explicitly in the paper:")
    return best.select("doc_id", F.concat(F.lit("The paper cites "), label, F.lit(" for this point.\n"), where, F.lit("\n> "), "body").alias("answer"), "block_id")


def exact_methods(wanted: DataFrame, targeted: DataFrame) -> DataFrame:
    """targeted: doc_id, block_id, heading, text, place (a targeted scan).  The best block as it stands."""
    where = F.when(F.col("heading") != "", F.concat(F.lit("The paper states this explicitly in "), "heading", F.lit(":\n> "))).otherwise("The paper states this explicitly:\n> ")
    return targeted.where("place = 1").join(wanted.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.concat(where, "text").alias("answer"), "block_id")


def reindex_hint(files: DataFrame, indexed: DataFrame, sources: DataFrame) -> DataFrame:
    """files: path, stem, modified (of Markdown).  indexed: stem, modified (of its index).  sources: stem.  One row: files that are new or newer than their index (by more than a
    microsecond), files without a source, and whether the index is behind."""
    at = indexed.select("stem", F.col("modified").alias("_indexed"))
    rows = files.join(at, "stem", "left").join(sources.select("stem", F.lit(True).alias("_source")).distinct(), "stem", "left")
    newer = F.col("_indexed").isNull() | (F.col("modified").cast("double") > F.col("_indexed").cast("double") + 1e-6)
    out = rows.agg(F.count("*").alias("files"), F.count_if(newer).alias("newer"), F.count_if(F.col("_source").isNull()).alias("orphans"))
    return out.withColumn("behind", (F.col("newer") > 0) | (F.col("orphans") > 0))




#: The line that begins an abstract, its least and most characters, and what leads an extract.
ABSTRACT_LINE = "(?i)^\\s*#{1,6}\\s*abstract\\b|^\\s*(?:abstract|摘要)\\s*$"
ABSTRACT_CHARS = (120, 4000)
LEADS = {"strength_limits": "the paper describes this trade-off", "discussion_only": "the paper states"}


def abstracts(md: DataFrame) -> DataFrame:
    """md: doc_id, pos, line.  The abstract of each document: what stands behind its heading (or a line of that word) up to the next heading, if that is long enough; without such a
    line the first long enough text line ahead of the second heading."""
    own = Window.partitionBy("doc_id")
    rows = md.withColumns({"begun": F.min(F.when(F.col("line").rlike(ABSTRACT_LINE), F.col("pos"))).over(own), "head": F.col("line").rlike("^\\s*#{1,6}\\s+")})
    rows = rows.withColumns({"stop": F.min(F.when(F.col("head") & (F.col("pos") > F.col("begun") + 1), F.col("pos"))).over(own), "heads": F.sum(F.col("head").cast("int")).over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))})
    inside = (F.col("pos") > F.col("begun")) & (F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
    named = rows.where(inside).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias("text"))
    named = named.select("doc_id", F.substring(F.regexp_replace("text", "^\\s+|\\s+$", ""), 1, ABSTRACT_CHARS[1]).alias("abstract"), F.lit(True).alias("named"))
    long = rows.where(F.col("begun").isNull() & ~F.col("head") & (F.col("heads") < 2) & (F.length(F.trim("line")) >= ABSTRACT_CHARS[0]))
    first = long.groupBy("doc_id").agg(F.min(F.struct("pos", F.substring(F.trim("line"), 1, ABSTRACT_CHARS[1]).alias("abstract")))["abstract"].alias("abstract")).withColumn("named", F.lit(False))
    return named.unionByName(first).where(F.length("abstract") >= ABSTRACT_CHARS[0])


def broad_extracts(targeted: DataFrame, family: Column, boxes: Column) -> DataFrame:
    """targeted: doc_id, prompt, block_id, heading, text, place.  The best block for prompts about strengths and limits, a discussion or a box, with a line that says where it stands."""
    leaf = F.coalesce(F.nullif(F.try_element_at(F.split("heading", " / "), F.lit(-1)), F.lit("")), F.lit("target section"))
    lead = F.when((family == "box_only") & (F.size(boxes) > 0), F.concat(F.lit("From Box "), boxes[0].cast("string"), F.lit(", the paper states:\n> "), F.col("text")))
    for name, words in LEADS.items():
        lead = lead.when(family == name, F.concat(F.lit("From the "), leaf, F.lit(f" section, {words}:\n> "), F.col("text")))
    return targeted.where("place = 1").select("doc_id", "block_id", lead.alias("answer")).where("answer is not null")
