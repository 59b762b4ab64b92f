"""Structured Streaming: windows, duplicates, latest rows and task states over the events table as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A user's task after some events.
STATE = "user_id long, task long, status string, done long, rejected long"


def shared_dir(spark: SparkSession) -> str:
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, name: str = "events", files: int = 1000) -> DataFrame:
    """The table's files as a stream, at most so many a batch."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{sf_dir}/{name}*.parquet")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over all files that are there and returns its table: the last batch of complete mode, or all of append mode."""
    spark = stream.sparkSession
    folder = shared_dir(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/table").start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/table/batch={n:08d}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{folder}/table")
    rows = spark.read.parquet(f"{folder}/table")
    if mode == "complete":
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
    return rows


def window_counts(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and their values by tumbling window and type.  With `late`, a window is final, and its state dropped, once the stream is so far beyond it."""
    if late:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def distinct_events(events: DataFrame, late: str = "365 days") -> DataFrame:
    """Each event once; a duplicate may come as late as `late`."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest(events: DataFrame) -> DataFrame:
    """The last event of each user (a partial result that newer ones overwrite).  The state is a row a user."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_id", "e.event_type")


def step(state: tuple, event_id: int, event_type: str) -> tuple:
    """A task of one user: a click starts one if none is running, a purchase ends it and an error cancels it, all others advance it; what comes for no task is rejected."""
    task, status, done, rejected = state
    running = status == "running"
    if event_type == "click":
        return (task, status, done, rejected + 1) if running else (event_id, "running", 0, rejected)
    if not running:
        return task, status, done, rejected + 1
    if event_type == "purchase":
        return task, "done", done, rejected
    if event_type == "error":
        return task, "cancelled", done, rejected
    return task, status, done + 1, rejected


def slices(events: DataFrame, minutes: int = 60) -> DataFrame:
    """What the events of a user in a slice of time do to a task that is running and to one that isn't.

    Whether a task is running is decided by the last click, purchase or error alone, so within a slice it is known behind the first of these.
    before: other events ahead of it; first: that event; the rest counts what is known: rejected, the last task started and what advances or ends it, or
    (head_*) what does so to the task ahead of any start.  A user with any number of events is a row a slice."""
    at = F.struct("ts", "event_id")
    slot = F.floor(F.col("ts").cast("timestamp").cast("long") / (60 * minutes))
    kind, ends = F.col("event_type"), F.col("event_type").isin("purchase", "error")
    own = Window.partitionBy("user_id", "slot").orderBy("ts", "event_id")
    rows = events.select("user_id", "event_id", "event_type", "ts", slot.alias("slot"), F.when(kind == "click", 1).when(ends, 0).alias("decides"))
    rows = rows.withColumn("running", F.last("decides", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    known, free = F.col("running"), F.col("running").isNull()
    rows = rows.withColumn("starts", F.coalesce((kind == "click") & (known == 0), F.lit(False)))
    rows = rows.withColumn("part", F.sum(F.col("starts").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("parts", F.max("part").over(Window.partitionBy("user_id", "slot")))
    other = ~ends & (kind != "click")
    word = F.when(kind == "purchase", "done").otherwise("cancelled")
    in_last, in_head = (F.col("part") == F.col("parts")) & (F.col("parts") > 0), F.col("part") == 0
    return rows.groupBy("user_id", "slot").agg(
        F.count_if(other & free).alias("before"), F.max(F.when(free & F.col("decides").isNotNull(), F.struct("event_type", "event_id"))).alias("first"),
        F.count_if(((kind == "click") & (known == 1)) | ((kind != "click") & (known == 0))).alias("rejected"), F.max(F.when(F.col("starts"), F.struct(at, "event_id")))["event_id"].alias("task"),
        F.count_if(other & (known == 1) & in_last).alias("done"), F.max(F.when(ends & (known == 1) & in_last, word)).alias("ended"),
        F.count_if(other & (known == 1) & in_head).alias("head_done"), F.max(F.when(ends & (known == 1) & in_head, word)).alias("head_ended"),
    )


def _after(s: Column, e: Column) -> Column:
    """A state after a slice."""
    running = s["status"] == "running"
    click, closed = e["first"]["event_type"] == "click", F.when(e["first"]["event_type"] == "purchase", "done").when(e["first"]["event_type"] == "error", "cancelled")
    began = e["task"].isNotNull()
    fresh = ~running & F.coalesce(click, F.lit(False))
    task = F.when(began, e["task"]).when(fresh, e["first"]["event_id"]).otherwise(s["task"])
    going = F.coalesce(e["head_ended"], F.lit("running"))
    status = F.when(began, F.coalesce(e["ended"], F.lit("running"))).when(running, F.when(closed.isNotNull(), closed).when(click, going).otherwise(s["status"])).otherwise(F.when(fresh, going).otherwise(s["status"]))
    done = F.when(began, e["done"]).when(running, s["done"] + e["before"] + F.when(click, e["head_done"]).otherwise(0)).when(fresh, e["head_done"]).otherwise(s["done"])
    here = F.when(running, F.when(click, 1).otherwise(0)).otherwise(e["before"] + F.when(closed.isNotNull(), 1).otherwise(0))
    return F.struct(task.alias("task"), status.alias("status"), done.alias("done"), (s["rejected"] + e["rejected"] + here).alias("rejected"))


def advanced(states: DataFrame, events: DataFrame) -> DataFrame:
    """states after the events of a batch; users without events stay.  Only the slices of a user meet, in the order of time."""
    effect = slices(events)
    fields = [c for c in effect.columns if c != "user_id"]
    lists = effect.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("slices"))
    start = F.struct(F.coalesce("task", F.lit(-1).cast("long")).alias("task"), F.coalesce("status", F.lit("idle")).alias("status"), F.coalesce("done", F.lit(0).cast("long")).alias("done"), F.coalesce("rejected", F.lit(0).cast("long")).alias("rejected"))
    none = F.array().cast(lists.schema["slices"].dataType)
    out = states.join(lists, "user_id", "full_outer")
    return out.select("user_id", F.aggregate(F.coalesce("slices", none), start, _after).alias("s")).select("user_id", "s.*")


def task_states(events: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over all files that are there and returns each user's task.  The states after batch n are the table batch=n of the folder: a batch that is run again after
    a failure starts from those of the one before and writes the same."""
    spark = events.sparkSession

    def run(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        before = own.read.schema(STATE).parquet(f"{folder}/states/batch={n - 1:08d}") if n else own.createDataFrame([], STATE)
        advanced(before, batch).write.mode("overwrite").parquet(f"{folder}/states/batch={n:08d}")

    query = events.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(run).start()
    query.awaitTermination()
    rows = spark.read.schema(STATE + ", batch long").parquet(f"{folder}/states")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
