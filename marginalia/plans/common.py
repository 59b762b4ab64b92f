"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Question forms around the first words of a turn, so that every branch of a classifier meets text of the table.
FORMS = [
    ("Where is ", " discussed? See Fig. 3"),
    ("Which other papers discuss ", "?"),
    ("compare ", " versus single-pixel imaging, equation (12)"),
    ("What is ", " defined as? 定理 十二"),
    ("写一段代码 python random number ", ""),
    ("describe this figure ", ""),
    ("describe this figure in the paper ", " table IV"),
    ("单像素成像是什么 ", " snapshot 推论 二十"),
    ("please debug the script for ", " optics imaging"),
    ("limitations of ", " and the ablation results; theorem xiv"),
    ("Besides this paper, which papers compare ", " and snapshot compressive imaging?"),
    ("", ""),
    ("panels f and g of \"", "\" Figure 2 (a, b) spectral"),
    ("第3张图 说明了 ", " 怎么实现"),
    ("Box 2 and the abstract of ", ", then the materials and methods and the discussion section"),
    ("Which paper mentions ", " and spad arrays? lemma mcmxc"),
    ("提到了 ", "？ single exposure, 公式 三十一"),
]


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn and text: the first four words of each turn in one of the FORMS."""
    from pyspark.sql import functions as F

    n = F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(len(FORMS))).cast("int") + 1
    part = lambda k: F.element_at(F.array(*[F.lit(f[k]) for f in FORMS]), n)
    words = F.array_join(F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \\t\\n]+"), F.lit(0)), 1, 4), " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(part(0), words, part(1)).alias("text"))


def _list(k: int) -> str:
    return "[" + ", ".join("'" + f[k] + "'" for f in FORMS) + "]"


PROMPTS = f"pr AS (SELECT conv_id, turn, {_list(0)}[(conv_id * 5 + turn) % {len(FORMS)} + 1] || array_to_string(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n]+')[1:4], ' ') || {_list(1)}[(conv_id * 5 + turn) % {len(FORMS)} + 1] AS text FROM conversations)"
