"""Streaming operators whose state expires (section 2.9 #1, #2, #6, #13, #14).

Each keeps value, list or map state by key and drops it by a timer or a time to
live, so that the state is as large as what is open, not as the history.
Timers that decide a result go by event time: a rerun gives the same.  The
queries need the RocksDB state store; ``rocksdb`` sets it while they start.
Columns go in under plain names, as rows come to Python as named tuples.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .absorb import BATCH
from .frames import DIFFERENCE, FORCE_S, keep_flags
from .status import Codes, transitions

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start here keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _millis(time: str):
    return F.unix_millis(F.col(time).cast("timestamp"))


# Late rows ------------------------------------------------------------------------


class _Windows(StatefulProcessor):
    """Counts of a key's open windows, by start; a window leaves when the watermark passes its end.

    They are one value, and the earliest of them has the timer: each call to
    the store is a round trip, so that there are some for a key and trigger,
    not for each window.
    """

    def __init__(self, size_ms: int):
        self.size = size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, counts array<long>")

    def _known(self) -> dict[int, int]:
        known = self.open.get()
        return dict(zip(*known, strict=True)) if known else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        new: dict[int, int] = {}
        for part in rows:
            starts, counts = np.unique(part["at_ms"].to_numpy() // self.size * self.size, return_counts=True)
            for start, n in zip(starts.tolist(), counts.tolist(), strict=True):
                new[start] = new.get(start, 0) + n
        late = {s: n for s, n in new.items() if s + self.size <= passed}
        if len(late) < len(new):
            known = self._known()
            first = min(known, default=None)
            for start in new.keys() - late.keys():
                known[start] = known.get(start, 0) + new[start]
            if first is None or min(known) < first:
                self.handle.registerTimer(min(known) + self.size)
            self.open.update((list(known), list(known.values())))
        if late:
            yield pd.DataFrame({"owner": key[0], "start_ms": list(late), "n": list(late.values()), "late": True})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        done = sorted(s for s in known if s + self.size <= passed)
        left = {s: n for s, n in known.items() if s + self.size > passed}
        if not done:  # the timer of a window that left with an earlier one
            return
        if left:
            self.open.update((list(left), list(left.values())))
            self.handle.registerTimer(min(left) + self.size)
        else:
            self.open.clear()
        yield pd.DataFrame({"owner": key[0], "start_ms": done, "n": [known[s] for s in done], "late": False})

    def close(self) -> None:
        pass


def windows_and_late(events: DataFrame, time: str, owner: str, size_s: int = 900, late: str = "10 minutes") -> DataFrame:
    """(owner, start, n, late): each tumbling window once the watermark has passed its end, and beside them the rows that came too late for theirs.

    Spark's own window aggregation drops such rows unseen.  Here they are
    counted: ``late`` rows, by window and trigger.  The watermark column itself
    ends before the stateful step, or late rows would be filtered there.  Rows
    without a time are left out.  State: the open windows.
    """
    kind = dict(events.dtypes)[owner]
    given = events.where(F.col(time).isNotNull()).withWatermark(time, late).select(F.col(owner).alias("owner"), _millis(time).alias("at_ms"))
    schema = f"owner {kind}, start_ms long, n long, late boolean"
    out = given.groupBy("owner").transformWithStateInPandas(_Windows(size_s * 1000), schema, "Append", "EventTime")
    return out.select(F.col("owner").alias(owner), F.timestamp_millis("start_ms").alias("start"), "n", "late")


# Retry ----------------------------------------------------------------------------


class _Retry(StatefulProcessor):
    """A job that failed waits with its payload, its attempts and when it came; the timer of its next attempt is all that it holds."""

    def __init__(self, work: Callable, tries: int, base_ms: int, by_event: bool):
        self.work, self.tries, self.base, self.by_event = work, tries, base_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "payload string, attempts int, due long")

    def _now(self, timer_values) -> int:
        return timer_values.getCurrentWatermarkInMs() if self.by_event else timer_values.getCurrentProcessingTimeInMs()

    def _attempt(self, key, payload, attempts: int, due: int, now: int) -> Iterator[pd.DataFrame]:
        """Attempts that are due; the first always is."""
        while True:
            attempts += 1
            try:
                result, status = self.work(payload, attempts), "done"
            except Exception as e:  # whatever the work raises is a failed attempt
                result, status = str(e), "failed"
            if status == "done" or attempts >= self.tries:
                self.waiting.clear()
                yield pd.DataFrame({"job": [key[0]], "status": [status], "attempts": [attempts], "result": [result]})
                return
            due += self.base * 2 ** (attempts - 1)
            if due > now:
                self.waiting.update((payload, attempts, due))
                self.handle.registerTimer(due)
                return

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = min(((int(t), p) for part in rows for t, p in zip(part["at_ms"], part["payload"], strict=True)), key=lambda x: (x[0], x[1] is None, x[1] or ""))
        if not self.waiting.exists():
            now = self._now(timerValues)
            yield from self._attempt(key, first[1], 0, first[0] if self.by_event else now, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        payload, attempts, due = self.waiting.get()
        yield from self._attempt(key, payload, attempts, due, self._now(timerValues))

    def close(self) -> None:
        pass


def retry_stream(jobs: DataFrame, key: str, time: str, payload: str, work: Callable[[str, int], str], tries: int = 3, base_s: float = 1.0, late: str | None = "0 seconds") -> DataFrame:
    """(key, status, attempts, result) of each job once it is done or has failed ``tries`` times (2.9 #14).

    ``work(payload, attempt)`` gives the result or raises; the next attempt
    follows after base_s * 2**n by a timer, and no task sleeps meanwhile.  By
    event time, with ``late`` as the watermark's delay, or by the clock if it is
    None.  A job that comes again while it waits is the same job.  Attempts are
    made again if a trigger is.  State: the jobs that wait.
    """
    kind = dict(jobs.dtypes)[key]
    by_event = late is not None
    given = jobs.withWatermark(time, late) if by_event else jobs
    given = given.select(F.col(key).alias("job"), F.coalesce(_millis(time), F.lit(0)).alias("at_ms"), F.col(payload).cast("string").alias("payload"))
    processor = _Retry(work, tries, int(base_s * 1000), by_event)
    out = given.groupBy("job").transformWithStateInPandas(processor, f"job {kind}, status string, attempts int, result string", "Append", "EventTime" if by_event else "ProcessingTime")
    return out.withColumnRenamed("job", key)


# Frames ---------------------------------------------------------------------------


class _LastKept(StatefulProcessor):
    """When a source's frame was last kept; after ``force`` the next one is kept in any case, so the state can go."""

    def __init__(self, least: float, force_us: float):
        self.least, self.force = least, force_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["at", "key"])
        known = self.last.get()[0] if self.last.exists() else None
        micros = part["at"].astype("datetime64[us]").astype("int64").to_numpy()
        flags, last = keep_flags(micros, part["difference"].astype(float).fillna(1.0).to_numpy(), known, self.least, self.force)
        if last != known:
            self.last.update((int(last),))
            self.handle.registerTimer(self._end(last))
        yield part[["source", "key", "at"]].assign(kept=flags)

    def _end(self, last: int) -> int:
        return -int(-(last + self.force) // 1000)  # a millisecond begun is not over

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self._end(self.last.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def keep_stream(frames: DataFrame, source: str, time: str, key: str, difference: str, least: float = DIFFERENCE, force_s: float = FORCE_S, late: str = "0 seconds") -> DataFrame:
    """``frames.keep`` for a stream, with state for the sources alone that kept a frame less than ``force_s`` before the watermark.

    Frames older than the watermark are dropped, so what the state would still
    decide is decided alike without it.  Frames of a trigger go in order.
    """
    kinds = dict(frames.dtypes)
    given = frames.withWatermark(time, late).select(F.col(source).alias("source"), F.col(time).alias("at"), F.col(key).alias("key"), F.col(difference).alias("difference"))
    schema = f"source {kinds[source]}, key {kinds[key]}, at {kinds[time]}, kept boolean"
    out = given.groupBy("source").transformWithStateInPandas(_LastKept(least, force_s * 1e6), schema, "Append", "EventTime")
    return out.select(F.col("source").alias(source), F.col("key").alias(key), F.col("at").alias(time), "kept")


# Batches --------------------------------------------------------------------------


class _Waiting(StatefulProcessor):
    """Items that wait, as a list, and how many; the list leaves whole."""

    def __init__(self, least: int, idle_ms: int):
        self.least, self.idle = least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "item string")
        self.seen = handle.getValueState("seen", "batch long, n long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("place", kind="stable")
        new = part["item"].tolist()
        if self.seen.exists() and self.seen.get()[2] <= timerValues.getCurrentWatermarkInMs():
            yield from self._forget(key)  # input comes before the timers of a trigger
        batch, n, until = self.seen.get() if self.seen.exists() else (0, 0, 0)
        until = max(until, int(part["at_ms"].max()) + self.idle)
        self.handle.registerTimer(until)
        if n + len(new) < self.least:
            self.items.appendList([(x,) for x in new])
            self.seen.update((batch, n + len(new), until))
            return
        held = [x[0] for x in self.items.get()] if n else []
        self.items.clear()
        self.seen.update((batch + 1, 0, until))
        yield pd.DataFrame({"owner": key[0], "batch": batch + 1, "item": held + new})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and self.seen.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            yield from self._forget(key)

    def _forget(self, key) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.items.get()] if self.seen.get()[1] else []
        self.items.clear()
        self.seen.clear()
        if held:
            yield pd.DataFrame({"owner": key[0], "batch": pd.array([None] * len(held), dtype="Int64"), "item": held})

    def close(self) -> None:
        pass


def absorb_stream(items: DataFrame, owner: str, key: str, position: str, time: str, least: int = BATCH, idle_s: float = 3600.0, late: str = "0 seconds") -> DataFrame:
    """(owner, batch, item): at ``least`` or more, all that waits leaves as a batch (2.9 #6); items are keys as text.

    An owner whose last item is ``idle_s`` older than the watermark is
    forgotten: what it still had leaves without a batch number, and numbers
    begin anew.  State: the waiting items of owners that are not idle.
    """
    kind = dict(items.dtypes)[owner]
    given = items.withWatermark(time, late).select(F.col(owner).alias("owner"), F.col(key).cast("string").alias("item"), F.col(position).alias("place"), _millis(time).alias("at_ms"))
    out = given.groupBy("owner").transformWithStateInPandas(_Waiting(least, int(idle_s * 1000)), f"owner {kind}, batch long, item string", "Append", "EventTime")
    return out.withColumnRenamed("owner", owner)


# Status ---------------------------------------------------------------------------


class _Machine(StatefulProcessor):
    """A frame's state; every change renews its time to live."""

    def __init__(self, codes: Codes, forget_ms: int):
        self.codes, self.forget = codes, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "status int", self.forget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps = transitions(self.codes)
        before = self.now.get()[0] if self.now.exists() else None
        now = self.codes.pending if before is None else before
        for what in pd.concat(list(rows)).sort_values("place", kind="stable")["event"]:
            now = steps.get((now, what), now)
        if now != before:
            self.now.update((now,))
        yield pd.DataFrame({"frame": [key[0]], "status": [now]})

    def close(self) -> None:
        pass


def machine_stream(stream: DataFrame, key: str, event: str, place: str, codes: Codes = Codes(), forget_s: float = 86_400.0) -> DataFrame:
    """``status.machine_stream`` with state that is dropped ``forget_s`` of the clock after its last change.

    An ended frame stays ended for that time; what comes later would begin anew,
    so it is to be longer than events can be repeated.
    """
    kind = dict(stream.dtypes)[key]
    given = stream.select(F.col(key).alias("frame"), F.col(event).alias("event"), F.col(place).alias("place"))
    out = given.groupBy("frame").transformWithStateInPandas(_Machine(codes, int(forget_s * 1000)), f"frame {kind}, status int", "Update", "ProcessingTime")
    return out.withColumnRenamed("frame", key)
