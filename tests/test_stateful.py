"""Streams whose state expires, over several triggers, with late rows and failing work."""

from __future__ import annotations

import datetime
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import frames, stateful

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def _at(seconds: float) -> datetime.datetime:
    return START + datetime.timedelta(seconds=seconds)


class Feed:
    """A stream of files, one a trigger."""

    def __init__(self, spark, folder, schema: str):
        self.spark, self.folder, self.schema, self.n = spark, f"file://{folder}", schema, 0
        (folder / "in").mkdir()
        self.stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{self.folder}/in")

    def put(self, rows) -> None:
        df = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        df.write.json(f"{self.folder}/new{self.n}")
        source = next(p for p in __import__("pathlib").Path(self.folder[7:], f"new{self.n}").iterdir() if p.suffix == ".json")
        source.rename(source.parent.parent / "in" / f"{self.n:04d}.json")
        self.n += 1
        time.sleep(0.02)

    def run(self, build, mode: str = "append"):
        """All that is there, and the state rows after each trigger."""
        with stateful.rocksdb(self.spark):
            out = []
            query = (
                build(self.stream).writeStream.outputMode(mode).foreachBatch(lambda df, k: out.extend((k, tuple(r)) for r in df.collect()))
                .option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
            )
            query.awaitTermination()
        return out, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_late_rows_are_counted_and_closed_windows_leave(spark, tmp_path):
    rng = random.Random(5)
    feed = Feed(spark, tmp_path, "owner string, at timestamp")
    batches = []
    for k in range(5):
        batch = [(rng.choice("ab"), _at(k * 1200 + rng.random() * 1200 - (rng.choice([0, 0, 0, 3000])))) for _ in range(60)]
        batches.append([*batch, ("c", None)])
        feed.put(batches[-1])
    got, held = feed.run(lambda s: stateful.windows_and_late(s, "at", "owner", 300, "10 minutes"))
    want, late, passed = Counter(), Counter(), None
    for batch in batches:
        for owner, at in batch:
            if at is not None:
                start = _at((at - START).total_seconds() // 300 * 300)
                (late if passed is not None and start + datetime.timedelta(seconds=300) <= passed else want)[owner, start] += 1
        passed = max([*(at for _, at in batch if at is not None), *([passed + datetime.timedelta(minutes=10)] if passed else [])]) - datetime.timedelta(minutes=10)
    closed = {k: n for k, n in want.items() if k[1] + datetime.timedelta(seconds=300) <= passed}
    aware = lambda t: t.replace(tzinfo=datetime.UTC) if t.tzinfo is None else t
    assert {(o, aware(s)): n for _, (o, s, n, l) in got if not l} == closed and late and len(closed) < len(want)
    counted = Counter()
    for _, (o, s, n, l) in got:
        if l:
            counted[o, aware(s)] += n
    assert counted == late
    # what is open stays small: an hour of windows for two owners, with a timer each, and not the whole history
    assert max(held) <= 2 * 2 * 14 and held[-1] <= 2 * 2 * (len(want) - len(closed))


def test_calls_to_the_store_do_not_grow_with_the_windows():
    import pandas as pd

    class Handle:
        def __init__(self):
            self.calls, self.value, self.timers = 0, None, []

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.update(None)

        def registerTimer(self, at):
            self.calls += 1
            self.timers.append(at)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    handle, windows = Handle(), stateful._Windows(10)
    windows.init(handle)
    assert not list(windows.handleInputRows(("a",), iter([pd.DataFrame({"at_ms": range(2000)})]), At(-1)))
    (late,) = windows.handleInputRows(("a",), iter([pd.DataFrame({"at_ms": [3, 4, 25, 1999]})]), At(20))
    assert late["n"].tolist() == [2] and late["late"].all()
    (out,) = windows.handleExpiredTimer(("a",), At(1000), At(10))
    assert out["start_ms"].tolist() == [*range(0, 1000, 10)] and out["n"].tolist() == [10, 10, 11] + [10] * 97 and not out["late"].any()
    assert handle.timers == [10, 1010] and handle.calls <= 10
    (out,) = windows.handleExpiredTimer(("a",), At(2000), At(1010))
    assert len(out) == 100 and out["n"].sum() == 1001 and handle.value is None
    assert not list(windows.handleExpiredTimer(("a",), At(2000), At(2000)))


def _until():
    """Work that fails until an attempt; made here, as workers know no test module."""

    def work(payload, attempt):
        if attempt < int(payload):
            raise ValueError(f"not yet {attempt}")
        return f"ok {attempt}"

    return work


def test_failed_jobs_come_again_by_a_timer(spark, tmp_path):
    feed = Feed(spark, tmp_path, "job string, at timestamp, need string")
    feed.put([("one", _at(0), "1"), ("two", _at(0), "2"), ("three", _at(1), "3"), ("never", _at(2), "9")])
    feed.put([("two", _at(4), "2"), ("tick", _at(9), "1")])  # the first wait is of ten seconds
    feed.put([("tock", _at(15), "1")])
    feed.put([("end", _at(100), "2")])
    got, held = feed.run(lambda s: stateful.retry_stream(s, "job", "at", "need", _until(), tries=3, base_s=10))
    by_job = {r[0]: r[1:] for _, r in got}
    assert by_job == {"one": ("done", 1, "ok 1"), "two": ("done", 2, "ok 2"), "three": ("done", 3, "ok 3"), "never": ("failed", 3, "not yet 3"), "tick": ("done", 1, "ok 1"), "tock": ("done", 1, "ok 1")}
    trigger = {r[0]: k for k, r in got}
    assert trigger["one"] == 0 and trigger["two"] > trigger["tock"] - 1 and trigger["never"] > trigger["two"]
    assert len(got) == len(by_job) and held[0] > 0 and held[-1] <= 2  # the last job waits, with its timer


def test_retry_by_the_clock(spark, tmp_path):
    feed = Feed(spark, tmp_path, "job string, at timestamp, need string")
    feed.put([("a", _at(0), "2"), ("b", _at(0), "9"), ("c", _at(0), "1")])
    out = []
    with stateful.rocksdb(spark):
        query = (
            stateful.retry_stream(feed.stream, "job", "at", "need", _until(), tries=2, base_s=0.5, late=None).writeStream.outputMode("append")
            .foreachBatch(lambda df, k: out.extend((k, tuple(r)) for r in df.collect())).option("checkpointLocation", f"{feed.folder}/state").trigger(processingTime="500 milliseconds").start()
        )
        end = time.time() + 90
        while len(out) < 3 and query.isActive and time.time() < end:
            time.sleep(0.5)
        query.stop()
    assert sorted(r for _, r in out) == [("a", "done", 2, "ok 2"), ("b", "failed", 2, "not yet 2"), ("c", "done", 1, "ok 1")]
    assert min(k for k, r in out if r[0] != "c") > min(k for k, r in out if r[0] == "c")


def test_kept_frames_with_expiring_state(spark, tmp_path):
    rng = random.Random(9)
    feed = Feed(spark, tmp_path, "source string, at timestamp, id long, difference double")
    rows, n = [], 0
    for k in range(6):
        batch = []
        for _ in range(40):
            batch.append((f"s{k // 2}", _at(k * 60 + rng.randrange(60)), n, rng.choice([0.5, 0.001, 0.001, 0.001, None])))
            n += 1
        rows += batch
        feed.put(batch)
    got, held = feed.run(lambda s: stateful.keep_stream(s, "source", "at", "id", "difference", force_s=10, late="1 minute"))
    want = frames.keep(spark.createDataFrame(rows, feed.schema), "source", "at", "id", "difference", force_s=10)
    assert {r[1]: r[3] for _, r in got} == {r["id"]: r["kept"] for r in want.collect()}
    # sources that are over are forgotten
    assert held[-1] <= 4


def test_waiting_items_leave_as_batches_and_idle_owners_are_forgotten(spark, tmp_path):
    feed = Feed(spark, tmp_path, "owner string, id long, at timestamp")
    feed.put([("a", 1, _at(0)), ("a", 2, _at(1)), ("b", 3, _at(1))])
    feed.put([("a", 4, _at(2)), ("a", 5, _at(3))])
    feed.put([("a", 6, _at(50)), ("c", 7, _at(60))])
    feed.put([("c", 8, _at(300))])
    feed.put([("a", 9, _at(301)), ("a", 10, _at(301)), ("a", 11, _at(302))])
    got, held = feed.run(lambda s: stateful.absorb_stream(s, "owner", "id", "id", "at", least=3, idle_s=100))
    assert sorted((r for _, r in got), key=str) == sorted([("a", 1, x) for x in "1 2 4 5".split()] + [("b", None, "3"), ("a", None, "6")] + [("a", 1, x) for x in "9 10 11".split()], key=str)
    assert held[-1] <= 8  # what waits of one owner, and its timers


def test_ended_frames_stay_ended_until_they_are_forgotten(spark, tmp_path):
    """By the clock there is always a next trigger, so the query is stopped when all files are read."""
    for folder, forget_s in (("long", 3600.0), ("short", 0.001)):
        (tmp_path / folder).mkdir()
        feed = Feed(spark, tmp_path / folder, "frame long, place int, what string")
        feed.put([(1, 1, "claim"), (1, 2, "fail"), (2, 1, "claim"), (2, 2, "text")])
        feed.put([(3, 1, "claim")])
        feed.put([(1, 3, "claim"), (2, 3, "claim")])
        out = []
        with stateful.rocksdb(spark):
            built = stateful.machine_stream(feed.stream, "frame", "what", "place", forget_s=forget_s)
            query = built.writeStream.outputMode("update").foreachBatch(lambda df, k, out=out: out.extend((k, tuple(r)) for r in df.collect()))
            query = query.option("checkpointLocation", f"{feed.folder}/state").trigger(processingTime="200 milliseconds").start()
            end = time.time() + 60
            while len([r for _, r in out if r[0] in (1, 2)]) < 4 and query.isActive and time.time() < end:
                time.sleep(0.3)
            query.stop()
        last = max(k for k, r in out if r[0] == 1)
        assert sorted(r for k, r in out if k == 0) == [(1, -1), (2, 2)]
        assert sorted(r for k, r in out if k == last) == ([(1, -1), (2, 3)] if folder == "long" else [(1, 1), (2, 1)])
