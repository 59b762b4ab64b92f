"""The folder that a cluster shares, and tables kept there so that they are computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers in bytes; by itself only their rows are, and a row may hold a whole text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset, a temporary folder on a single machine, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (where or "file://" + tempfile.gettempdir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: later reads neither compute it anew nor depend on any executor."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and later reads take only the columns they need."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/marginalia-{what}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
