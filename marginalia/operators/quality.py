"""Metrics of answers, runs and evaluations: grouping sets, nearest-rank and interpolated percentiles, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quality_events(events: DataFrame) -> DataFrame:
    """Answer-quality events in the shape of the log, derived from the events table."""
    value = F.coalesce("value", F.lit(0.0))
    return events.select(
        "event_id", "ts", F.col("event_type").alias("intent"), F.concat(F.lit("L"), F.pmod("user_id", F.lit(3)) + 1).alias("depth"),
        (value > 20).alias("minimum_ok"), (value > 35).alias("evidence_ok"), (F.pmod("event_id", F.lit(4)) > 0).alias("evidence_required"), (value > 50).alias("has_limits"),
        F.least(value / 100, F.lit(1.0)).alias("coverage"), (value * 10).cast("int").alias("char_count"),
    )


def answer_summary(events: DataFrame) -> DataFrame:
    """Totals and rates over all events, by intent and by depth, in one pass of grouping sets."""
    grouped = events.groupingSets([[], ["intent"], ["depth"]], "intent", "depth")
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 3)
    out = grouped.agg(F.grouping_id("intent", "depth").alias("level"), F.count("*").alias("n"), rate("minimum_ok").alias("minimum_ok"), rate("evidence_ok").alias("evidence_ok"), F.round(F.avg("coverage"), 3).alias("coverage"), F.round(F.avg(F.when(F.col("evidence_required"), F.col("evidence_ok").cast("double"))), 3).alias("required_ok"))
    return out.select(F.coalesce("intent", F.lit("*")).alias("intent"), F.coalesce("depth", F.lit("*")).alias("depth"), "n", "minimum_ok", "evidence_ok", "coverage", "required_ok")


def failure_reasons(events: DataFrame) -> DataFrame:
    """How often each gate fails."""
    reasons = F.filter(F.array(F.when(~F.col("minimum_ok"), "short"), F.when(F.col("evidence_required") & ~F.col("evidence_ok"), "no_evidence"), F.when(~F.col("has_limits"), "no_limits"), F.when(F.col("coverage") < 0.25, "low_coverage")), lambda r: r.isNotNull())
    return events.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def kpis(runs: DataFrame, *by: str) -> DataFrame:
    """runs: status, latency_ms.  Counts by status, mean and nearest-rank 95th percentile of positive latencies."""
    positive = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    return runs.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("errors"),
        F.round(F.avg(positive), 3).alias("mean_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY case when latency_ms > 0 then latency_ms end)").alias("p95_ms"),
    )


def percentiles(df: DataFrame, value: str, *by: str, ps: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Linearly interpolated percentiles of non-negative values."""
    kept = df.where(F.col(value) >= 0)
    return kept.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.percentile(value, F.lit(p)), 6).alias(f"p{round(100 * p)}") for p in ps])


def last_n(events: DataFrame, n: int, order: list) -> DataFrame:
    """The newest n events (a ring buffer's content)."""
    return events.orderBy(*order).limit(min(max(n, 100), 5000))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics: scope, metric, value.  thresholds: metric, low, high.  Per scope whether all gates hold, and the failed ones."""
    joined = metrics.join(F.broadcast(thresholds), "metric")  # a fixed table
    ok = (F.col("value") >= F.coalesce("low", F.lit(float("-inf")))) & (F.col("value") <= F.coalesce("high", F.lit(float("inf"))))
    return joined.groupBy("scope").agg(F.bool_and(ok).alias("passed"), F.array_join(F.sort_array(F.collect_list(F.when(~ok, F.col("metric")))), ",").alias("failed"))


def queue_progress(events: DataFrame) -> DataFrame:
    """events: ts, event_id, user_id, value.  Position, running maximum and share of each event in its queue."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", "user_id", F.row_number().over(own).alias("position"), F.max("value").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("high"), F.count("*").over(Window.partitionBy("user_id")).alias("total"))
