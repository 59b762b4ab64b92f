"""Streaming queries, run over all files that are there; each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..streaming import events as S
from ..streaming import keyed as K


def stream_window_counts(spark, sf):
    return S.drained(S.window_counts(S.source(spark, sf)), "complete")


def stream_distinct(spark, sf):
    return S.drained(S.distinct_events(S.source(spark, sf)), "append").select("event_id", "user_id", "event_type")


def stream_latest(spark, sf):
    return S.drained(S.latest(S.source(spark, sf)), "complete")


def stream_task_states(spark, sf):
    return S.task_states(S.source(spark, sf), S.shared_dir(spark))


#: Types of events as operations of the machines, and how many runs, signatures and documents there are.
RUNS = {"click": "start", "view": "progress", "purchase": "finish", "error": "fail", "signup": "cancel"}
CACHE = {"purchase": "store", "click": "lookup", "view": "lookup", "error": "lookup"}
RENDERS = {"click": "request", "view": "request", "purchase": "ready", "error": "failed"}
QUEUE = {"click": "add", "signup": "add", "view": "begin", "purchase": "finish", "error": "remove"}
MARKS = 3
TTL_HOURS = 12


def stream_runs(spark, sf):
    return K.applied(K.keyed_events(S.source(spark, sf), RUNS, MARKS), K.Runs())


def stream_cache(spark, sf):
    return K.applied(K.keyed_events(S.source(spark, sf), CACHE, MARKS), K.Cache(TTL_HOURS * 3600 * 1000))


def stream_renders(spark, sf):
    return K.applied(K.keyed_events(S.source(spark, sf), RENDERS, MARKS), K.Renders())


def stream_queue(spark, sf):
    return K.applied(K.keyed_events(S.source(spark, sf), QUEUE, MARKS), K.Queue())


#: Slices are final that end no later than an hour before the last event of the operations.
CACHE_SQL = f"""WITH e AS (SELECT user_id AS key, ts, event_id, event_type = 'purchase' AS stores, coalesce((props ->> 'k')::BIGINT, 0) % {MARKS} AS mark, date_trunc('day', ts) + INTERVAL 1 DAY AS slice_end FROM events WHERE event_type IN ('purchase', 'click', 'view', 'error') AND user_id IS NOT NULL),
s AS (SELECT *, last_value(CASE WHEN stores THEN {{'at': ts, 'mark': mark}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entry FROM e),
o AS (SELECT *, CASE WHEN stores THEN 'store' WHEN entry IS NULL THEN 'empty' WHEN epoch_ms(ts) - epoch_ms(entry.at) > {TTL_HOURS} * 3600000 THEN 'stale' WHEN entry.mark = mark THEN 'hit' ELSE 'other' END AS found FROM s)
SELECT key, slice_end, count(*) FILTER (WHERE found = 'hit') AS hits, count(*) FILTER (WHERE found = 'stale') AS stale, count(*) FILTER (WHERE found = 'other') AS other, count(*) FILTER (WHERE found = 'empty') AS empty
FROM o WHERE slice_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e) GROUP BY ALL"""

#: Whether a task is running is decided by the last click, purchase or error before an event.
TASK_SQL = """WITH d AS (SELECT *, CASE WHEN event_type = 'click' THEN 1 WHEN event_type IN ('purchase', 'error') THEN 0 END AS decides FROM events),
r AS (SELECT *, coalesce(last_value(decides IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running FROM d),
p AS (SELECT *, sum((event_type = 'click' AND running = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM r), q AS (SELECT *, max(part) OVER (PARTITION BY user_id) AS parts FROM p),
s AS (SELECT user_id, max({'t': ts, 'i': event_id}) FILTER (WHERE event_type = 'click' AND running = 0) AS task, count(*) FILTER (WHERE event_type NOT IN ('click', 'purchase', 'error') AND running = 1 AND part = parts) AS done,
  max(event_type) FILTER (WHERE event_type IN ('purchase', 'error') AND running = 1 AND part = parts) AS ended, count(*) FILTER (WHERE (event_type = 'click') = (running = 1)) AS rejected FROM q GROUP BY 1)
SELECT user_id, coalesce(task.i, -1) AS task, CASE WHEN task IS NULL THEN 'idle' WHEN ended = 'purchase' THEN 'done' WHEN ended = 'error' THEN 'cancelled' ELSE 'running' END AS status, done, rejected FROM s"""

QUERIES = {f.__name__: f for f in (stream_window_counts, stream_distinct, stream_latest, stream_task_states, stream_runs, stream_cache, stream_renders, stream_queue)}
ORACLE_SQL = {
    "stream_cache": CACHE_SQL,
    "stream_window_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_task_states": TASK_SQL,
    "stream_distinct": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "stream_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
