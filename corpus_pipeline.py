"""A corpus pipeline over documents: toxic ones go, one of each near-duplicate group stays, documents with benchmark
passages go, personal data get pseudonyms, and what is left is packed into token sequences.

Each stage works on all that the one before it kept, and all but the last return the columns of documents.  Null and repeated doc_ids,
null, empty and very long texts, repeated rows and further columns of any name pass through each stage as its operator's module states; no stage drops a
row for having them, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.decontamination import without_contaminated
from marginalia.llm.packing import pack_documents
from marginalia.llm.pii import EXAMPLE_KEY, with_pseudonyms
from marginalia.llm.simhash import one_of_each_group
from marginalia.llm.storage import delete, fresh_dir
from marginalia.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_pseudonyms(docs, EXAMPLE_KEY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: SQL can't express the classifier, the fingerprints or the tokens; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet to the shared folder and read again, and goes when the next one is there."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if last:
            delete(spark, last)
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)
