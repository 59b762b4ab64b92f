"""Machines in the state store against plain Python, cut into batches, with late events, and after a restart."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.streaming import keyed as K

DAY = timedelta(days=1)
START = datetime(2024, 3, 1, tzinfo=timezone.utc)
OPS = {K.Runs: ("start", "progress", "finish", "fail", "cancel"), K.Cache: ("store", "lookup", "lookup"), K.Renders: ("request", "request", "ready", "failed"), K.Queue: ("add", "add", "begin", "finish", "remove", "cancel")}


def events(machine, n=400, keys=3, days=6, seed=1):
    """A third of all events and more have one key."""
    r = random.Random(seed)
    out = [(r.choice([0, 0, *range(keys)]), START + timedelta(seconds=r.randint(0, days * 86400 - 1)), i, r.choice(OPS[machine]), r.randint(0, 2), r.random()) for i in range(n)]
    return out + [(9, START + days * DAY + timedelta(hours=2), n, OPS[machine][0], 0, 0.0)]  # carries the watermark beyond all others


def plain(machine, rows):
    """The same rules, event by event over all of a key's events."""
    out = []
    for key in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        s, queue, active, per = {}, [], [], defaultdict(list)
        for e in own:
            per[(e[1] - START) // DAY].append(e)
        if machine is K.Runs:
            s = dict(run=-1, status="idle", progress=0.0, cancelled=False, accepted=0, rejected=0)
        elif machine is K.Renders:
            s = dict(signature=-1, status="none", attempts=0, since=None, built_at=-1, served=0, rejected=0)
        elif machine is K.Queue:
            s = dict(done=0, total=0, cancel=False, last=-1)
        entry = None
        for day in sorted(per):
            end = START + (day + 1) * DAY
            if machine is K.Cache:
                s = dict(hits=0, stale=0, other=0, empty=0)
            for _, ts, i, op, mark, value in per[day]:
                if machine is K.Runs:
                    if op == "start" and s["status"] != "running":
                        s.update(run=mark, status="running", progress=0.0, cancelled=False, accepted=s["accepted"] + 1)
                    elif op == "cancel" and mark == s["run"] and s["status"] == "running" and not s["cancelled"]:
                        s.update(cancelled=True, accepted=s["accepted"] + 1)
                    elif op in ("progress", "finish", "fail") and mark == s["run"]:
                        s.update(progress=max(s["progress"], value), accepted=s["accepted"] + 1)
                        if op != "progress":
                            s["status"] = "cancelled" if s["cancelled"] else {"finish": "done", "fail": "error"}[op]
                    else:
                        s["rejected"] += 1
                elif machine is K.Cache:
                    if op == "store":
                        entry = (mark, ts)
                    elif entry is None:
                        s["empty"] += 1
                    elif ts - entry[1] > timedelta(hours=12):
                        s["stale"] += 1
                    else:
                        s["hits" if entry[0] == mark else "other"] += 1
                elif machine is K.Renders:
                    if op == "request":
                        if (s["signature"], s["status"]) == (mark, "ready"):
                            s["served"] += 1
                        elif (s["signature"], s["status"]) != (mark, "pending"):
                            s.update(attempts=s["attempts"] + 1 if s["signature"] == mark else 1, status="pending", since=ts, signature=mark)
                    elif (s["signature"], s["status"]) == (mark, "pending"):
                        s["status"] = op
                        if op == "ready":
                            s["built_at"] = int(ts.timestamp() * 1000)
                    else:
                        s["rejected"] += 1
                else:
                    if op == "add":
                        if not queue and not active:
                            s.update(done=0, total=0, last=-1)
                        queue.append((i, mark))
                        s["total"] += 1
                    elif op == "begin":
                        if s["cancel"]:
                            queue.clear()
                            s["total"] = s["done"] + len(active)
                        s["cancel"] = False
                        if queue:
                            active.append(queue.pop(0)[0])
                    elif op == "finish":
                        active = active[1:]
                        s["done"] += 1
                        s.update(total=max(s["total"], s["done"]), last=i)
                    elif op == "remove":
                        left = [q for q in queue if q[1] != mark]
                        s["total"] = max(s["done"] + len(active), s["total"] - len(queue) + len(left))
                        queue = left
                    else:
                        s["cancel"] = True
            row = dict(s)
            if machine is K.Renders:
                row["overdue"] = row["status"] == "pending" and end - row.pop("since") > timedelta(hours=6)
                row.pop("since", None)
            if machine is K.Queue:
                row |= {"waiting": len(queue), "active": len(active), "current": active[0] if active else -1}
            if key != 9:
                out.append(row | {"key": key, "slice_end": end.replace(tzinfo=None)})
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, ts timestamp, id long, op string, mark long, value double").withColumn("at", F.unix_micros("ts"))


def stream(spark, folder, files=1000):
    return spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", files).parquet(folder)


def ordered(rows):
    return sorted((tuple(sorted((k, v if not isinstance(v, float) else round(v, 9)) for k, v in r.items())) for r in rows), key=repr)


@pytest.mark.parametrize("machine", list(OPS))
def test_machines_against_plain_python(spark, tmp_path, machine):
    rows = events(machine)
    shuffled = random.Random(5).sample(rows, len(rows))
    frame(spark, shuffled).repartition(3).write.parquet(f"{tmp_path}/in")
    got = [r.asDict() for r in K.applied(stream(spark, f"{tmp_path}/in"), machine(), f"file://{tmp_path}/out").collect()]
    assert ordered(got) == ordered(plain(machine, rows))


@pytest.mark.parametrize("machine", [K.Queue, K.Runs])
def test_batches_and_restarts_change_nothing(spark, tmp_path, machine):
    """Day by day with a restart after each, in reverse order within a day."""
    rows = events(machine, seed=3)
    for day in range(7):
        own = [r for r in rows if (r[1] - START) // DAY == day]
        frame(spark, own[::-1]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = K.applied(stream(spark, f"{tmp_path}/in", 1), machine(), f"file://{tmp_path}/out")
    assert ordered(r.asDict() for r in got.collect()) == ordered(plain(machine, rows))


def test_late_events_are_left_out(spark, tmp_path):
    rows = events(K.Runs, n=120, seed=4)
    frame(spark, rows).write.parquet(f"{tmp_path}/in")
    K.applied(stream(spark, f"{tmp_path}/in"), K.Runs(), f"file://{tmp_path}/out")
    late = [(0, START + timedelta(hours=3), 10_000 + i, "start", 1, 1.0) for i in range(5)]
    frame(spark, late + [(9, START + 9 * DAY, 99_999, "start", 0, 0.0)]).write.mode("append").parquet(f"{tmp_path}/in")
    got = K.applied(stream(spark, f"{tmp_path}/in"), K.Runs(), f"file://{tmp_path}/out")
    assert ordered(r.asDict() for r in got.where("key <> 9").collect()) == ordered(plain(K.Runs, rows))


class CountedStore:
    """A store in memory that counts what is asked of it."""

    def __init__(self):
        self.calls, self.rows, self.stored, self.timers = 0, [], None, set()

    def getListState(self, *a):
        return self

    def getValueState(self, *a):
        outer = self

        class Value:
            def get(self):
                outer.calls += 1
                return outer.stored

            def exists(self):
                outer.calls += 1
                return outer.stored is not None

            def update(self, value):
                outer.calls += 1
                outer.stored = value

        return Value()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        self.calls += 1
        return list(self.rows)

    def clear(self):
        self.rows = []


@pytest.mark.parametrize("passed", [12, 30])
def test_calls_to_the_store_do_not_grow_with_the_slices_of_a_key(passed):
    """30 days of a key in one batch: what the watermark has passed is applied in one call, what it has not stays."""
    rows = [r for r in events(K.Runs, days=30) if r[0] == 0]
    frame = pd.DataFrame([(int(r[1].timestamp() * 1e6), *r[2:]) for r in rows], columns=["at", "id", "op", "mark", "value"])
    store, machine, got = CountedStore(), K.Runs(), []
    machine.init(store)
    machine.handleInputRows((0,), iter([frame[:50], frame[50:]]), None)
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: int((START + passed * DAY).timestamp() * 1000))
    while due := [t for t in store.timers if t <= watermark.getCurrentWatermarkInMs()]:
        store.timers.remove(min(due))
        for out in machine.handleExpiredTimer((0,), watermark, SimpleNamespace(getExpiryTimeInMs=lambda: min(due))):
            got += out.to_dict("records")
    want = [r for r in plain(K.Runs, rows) if r["slice_end"] <= (START + passed * DAY).replace(tzinfo=None)]
    assert ordered(r | {"slice_end": datetime.fromtimestamp(r["slice_end"] / 1000, timezone.utc).replace(tzinfo=None)} for r in got) == ordered(want)
    assert len(got) > 10 and store.calls <= 8 and len(store.timers) == (passed < 30)
