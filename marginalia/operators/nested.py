"""Texts of nested values: JSON of any shape as VARIANT, opened level by level with lateral joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys of an object that are taken first, in this order.
FIRST_KEYS = ("label", "display_name", "name", "title", "keyword", "keywords", "subject", "subjects", "topic", "topics", "summary", "summary_line", "description", "text")
_EDGE = "^\\s+|\\s+$"


def nested_texts(values: DataFrame, by: list[str], json: str = "json", most: int = 12, depth: int = 2, longest: int = 600) -> DataFrame:
    """The strings in each value, at most `most` down to `depth` levels below it: key, place and text.

    Lists go in order; of an object the FIRST_KEYS it has come first, then all its keys in alphabetical order, so that the former are read twice.  Blank strings, numbers and booleans give nothing, nor do nulls
    and text that isn't JSON.  Rows with equal keys are taken as one value after another."""
    level = values.select(*by, F.try_parse_json(json).alias("v"), F.array().cast("array<int>").alias("path")).where("v is not null")
    levels = []
    for n in range(depth + 1):
        levels.append(level.where(F.schema_of_variant("v") == "STRING").select(*by, "path", F.try_variant_get("v", "$", "string").alias("text")))
        if n < depth:
            parts = level.lateralJoin(values.sparkSession.tvf.variant_explode(F.col("v").outer()))
            rank = F.array_position(F.array(*[F.lit(k) for k in FIRST_KEYS]), F.col("key")).cast("int")
            turns = F.when(rank > 0, F.array(rank, F.col("pos") + len(FIRST_KEYS) + 1)).otherwise(F.array(F.col("pos") + len(FIRST_KEYS) + 1))
            level = parts.select(*by, F.col("value").alias("v"), "path", F.explode(turns).alias("at")).select(*by, "v", F.concat("path", F.array("at")).alias("path"))
    found = reduce(DataFrame.unionByName, levels).withColumn("text", F.regexp_replace("text", _EDGE, "")).where("text <> ''")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("path"))
    return found.withColumn("place", place).where(F.col("place") <= most).select(*by, "place", F.substring("text", 1, longest).alias("text"))
