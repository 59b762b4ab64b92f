"""Shared folders and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).  Where that is unset, a temporary one on a single machine, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (where or "file://" + tempfile.gettempdir()).rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/marginalia-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: computed once, later reads do not depend on any executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Spark's own setting: the shuffle files of a query go when it ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder (in `folder`, where one is given), and its shuffle files dropped: a step whose disk is free before the next begins."""
    spark = df.sparkSession
    folder = folder or fresh_dir(spark, what)
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(folder)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
