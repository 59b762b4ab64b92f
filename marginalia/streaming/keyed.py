"""State by key in Spark's state store: runs that only their owner may write, caches whose entries expire, renderings that are awaited, and queues.

Events of a key wait in the store until the watermark has passed their slice of time; then a timer applies them in the order of time, so that the outcome depends neither on how
the stream is cut into batches nor on the order within one.  What comes after the watermark is dropped by Spark.  A key has a timer for the first slice that waits, and a call takes all
slices that are over by then, so that calls grow with the keys of a batch, not with their slices.  A task holds what waits of one key at a time.  A restart goes on from the checkpoint.  Each slice with events gives a row of the state behind it.
Events are: key, ts, at (ts in microseconds), id, op, mark (what the event claims to belong to) and value.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .events import shared_dir

SLICE = 24 * 3600 * 1000
LATE = "1 hour"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _slice_end(at: int) -> int:
    return (at // 1000 // SLICE + 1) * SLICE


class InOrder(StatefulProcessor):
    """Applies the events of a key slice by slice.  Subclasses state STATE (the schema of a key's value), START (its first values), OUT (the columns of a row behind key and
    slice_end) and the step."""

    STATE, START, OUT = "", (), ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, op string, mark long, value double")
        self.value = handle.getValueState("value", self.STATE)
        self.open()

    def open(self) -> None:
        """Further state of a subclass."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            first = min([int(frame["at"].min()), *([] if first is None else [first])])
            self.waiting.appendList(list(zip(*[frame[c].tolist() for c in ("at", "id", "op", "mark", "value")], strict=True)))
        if first is not None:
            self.handle.registerTimer(_slice_end(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All slices that the watermark has passed, one after another: a key's state is read and written once, however many they are."""
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due, rest = [], []
        for row in self.waiting.get():
            (due if _slice_end(row[0]) <= passed else rest).append(tuple(row))
        if not due:
            return  # a timer before this one has taken them
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(_slice_end(row[0]) for row in rest))
        else:
            self.waiting.clear()
        names = [c.split()[0] for c in self.STATE.split(", ")]
        stored = self.value.get()
        state = dict(zip(names, self.START if stored is None else stored, strict=True))
        self.load(state)
        out = []
        for end, events in groupby(sorted(due), lambda row: _slice_end(row[0])):
            for at, i, op, mark, value in events:
                self.step(state, at // 1000, i, op, mark, value)
            out.append({"key": key[0], "slice_end": end, **self.row(state, end)})
            forgotten = self.forgets(state, end)
            if forgotten:
                state = dict(zip(names, self.START, strict=True))
        self.save(state)
        if forgotten:
            self.value.clear()
        else:
            self.value.update(tuple(state[c] for c in names))
        yield pd.DataFrame(out)

    def load(self, state: dict) -> None:
        """What a subclass reads from its further state before the first step."""

    def save(self, state: dict) -> None:
        """What a subclass writes to its further state after the last step."""

    def step(self, state: dict, at: int, i: int, op: str, mark: int, value: float) -> None:
        raise NotImplementedError

    def row(self, state: dict, end: int) -> dict:
        return {c.split()[0]: state[c.split()[0]] for c in self.OUT.split(", ")}

    def forgets(self, state: dict, end: int) -> bool:
        """Whether nothing of the key needs to be kept after a slice."""
        return False

    def close(self) -> None:
        pass


class Runs(InOrder):
    """start: begins the run that it names, unless one is running.  progress, finish and fail: only of the current run; others are rejected.  cancel: only of the current run while it is running."""

    STATE = "run long, status string, progress double, cancelled boolean, accepted long, rejected long"
    START = (-1, "idle", 0.0, False, 0, 0)
    OUT = STATE

    def step(self, state, at, i, op, mark, value):
        running, own = state["status"] == "running", state["run"] == mark
        if op == "start":
            taken = not running
            if taken:
                state.update(run=mark, status="running", progress=0.0, cancelled=False)
        elif op == "cancel":
            taken = own and running and not state["cancelled"]
            if taken:
                state["cancelled"] = True
        else:
            taken = own
            if taken:
                state["progress"] = max(state["progress"], value)
                if op != "progress":
                    state["status"] = "cancelled" if state["cancelled"] else "done" if op == "finish" else "error"
        state["accepted" if taken else "rejected"] += 1


class Cache(InOrder):
    """store: an entry with its signature (mark).  lookup: a hit if the signature is equal and the entry no older than ttl.  An entry is forgotten once it is too old."""

    STATE = "signature long, stored_at long, hits long, stale long, other long, empty long"
    START = (-1, -1, 0, 0, 0, 0)
    OUT = "hits long, stale long, other long, empty long"

    def __init__(self, ttl_ms: int = 12 * 3600 * 1000):
        self.ttl = ttl_ms

    def step(self, state, at, i, op, mark, value):
        if op == "store":
            state.update(signature=mark, stored_at=at)
        elif state["stored_at"] < 0:
            state["empty"] += 1
        elif at - state["stored_at"] > self.ttl:
            state["stale"] += 1
        else:
            state["hits" if state["signature"] == mark else "other"] += 1

    def row(self, state, end):
        out = super().row(state, end)
        state.update(hits=0, stale=0, other=0, empty=0)  # counts of the slice
        return out


class Renders(InOrder):
    """request: served if what is ready has the signature (mark), else pending, with one attempt more if the signature is the same.  ready and failed: of the pending one, others are rejected.
    overdue: pending for longer than `patience`, so that it should be asked for anew."""

    STATE = "signature long, status string, attempts long, since long, built_at long, served long, rejected long"
    START = (-1, "none", 0, -1, -1, 0, 0)
    OUT = "signature long, status string, attempts long, built_at long, served long, rejected long, overdue boolean"

    def __init__(self, patience_ms: int = 6 * 3600 * 1000):
        self.patience = patience_ms

    def step(self, state, at, i, op, mark, value):
        if op == "request":
            same = state["signature"] == mark
            if same and state["status"] == "ready":
                state["served"] += 1
            elif not (same and state["status"] == "pending"):
                state.update(status="pending", since=at, attempts=state["attempts"] + 1 if same else 1, signature=mark)
        elif state["status"] != "pending" or state["signature"] != mark:
            state["rejected"] += 1
        else:
            state["status"] = op
            if op == "ready":
                state["built_at"] = at

    def row(self, state, end):
        return {c: state[c] for c in ("signature", "status", "attempts", "built_at", "served", "rejected")} | {"overdue": state["status"] == "pending" and end - state["since"] > self.patience}


class Queue(InOrder):
    """First in, first out.  add: a task (its id) for a document (mark).  begin: the first task becomes active; after a cancel the queue is emptied before.  finish: the first active task is done.
    remove: what waits for the document goes.  cancel: marks the queue.  done and total begin anew when something is added to an idle queue."""

    STATE = "head long, tail long, active array<long>, done long, total long, cancel boolean, last long"
    START = (0, 0, [], 0, 0, False, -1)
    OUT = "waiting long, active long, current long, done long, total long, cancel boolean, last long"

    def open(self):
        self.queue = self.handle.getMapState("queue", "place long", "task long, document long")

    def load(self, state):
        self.waits, self.places = OrderedDict(sorted((k[0], tuple(v)) for k, v in self.queue.iterator())) if state["head"] < state["tail"] else OrderedDict(), {}
        for place, (_, document) in self.waits.items():
            self.places.setdefault(document, set()).add(place)
        self.stored = set(self.waits)
        state["active"] = deque(state["active"])

    def save(self, state):
        state["head"] = next(iter(self.waits), state["tail"])
        for place in self.stored - self.waits.keys():
            self.queue.removeKey((place,))
        for place in self.waits.keys() - self.stored:
            self.queue.updateValue((place,), self.waits[place])
        state["active"] = list(state["active"])

    def step(self, state, at, i, op, mark, value):
        active = state["active"]
        if op == "add":
            if not active and not self.waits:
                state.update(done=0, total=0, last=-1)
            self.waits[state["tail"]] = (i, mark)
            self.places.setdefault(mark, set()).add(state["tail"])
            state.update(tail=state["tail"] + 1, total=state["total"] + 1)
        elif op == "begin":
            if state["cancel"]:
                self.waits.clear()
                self.places.clear()
                state.update(total=state["done"] + len(active), cancel=False)
            if self.waits:
                place, (task, document) = self.waits.popitem(last=False)
                self.places[document].discard(place)
                active.append(task)
        elif op == "finish":
            if active:
                active.popleft()
            state["done"] += 1
            state.update(total=max(state["total"], state["done"]), last=i)
        elif op == "remove":
            gone = self.places.pop(mark, ())
            for place in gone:
                del self.waits[place]
            state["total"] = max(state["done"] + len(active), state["total"] - len(gone))
        elif op == "cancel":
            state["cancel"] = True

    def row(self, state, end):
        active = state["active"]
        return {"waiting": len(self.waits), "active": len(active), "current": active[0] if active else -1} | {c: state[c] for c in ("done", "total", "cancel", "last")}


def keyed_events(events: DataFrame, ops: dict[str, str], marks: int) -> DataFrame:
    """key, ts, at, id, op, mark and value of the events table: users as keys, types of events as `ops`, and what props names (k), by its remainder, as what an event belongs to."""
    table = F.create_map(*[F.lit(x) for kv in ops.items() for x in kv])
    mark: Column = F.pmod(F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)), F.lit(marks))
    out = events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), table[F.col("event_type")].alias("op"), mark.alias("mark"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return out.where("op is not null and key is not null and ts is not null")


def applied(stream: DataFrame, machine: InOrder, folder: str | None = None, late: str = LATE) -> DataFrame:
    """Runs the stream over all that is there and returns the rows of all slices that the watermark has passed so far.  With the folder of an earlier run it goes on where that ended."""
    spark = stream.sparkSession
    folder = folder or shared_dir(spark)
    schema = f"key {dict(stream.dtypes)['key']}, slice_end long, {machine.OUT}"
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        rows = stream.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(machine, schema, "Append", "EventTime")
        query = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    return rows.withColumn("slice_end", F.timestamp_millis("slice_end"))
