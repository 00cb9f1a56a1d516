"""Ordered work in stretches: the same as owner by owner, and no task with an owner's whole history."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import context, segments, timeline
from tidemark.streaming import frames

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def many_stretches(spark):
    """Small stretches stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def _rows(rng, n, owners, step=40.0, differing=0.1):
    rows, at = [], dict.fromkeys(owners, 0.0)
    for k in range(n):
        owner = rng.choice(owners)
        at[owner] += rng.choice([0.0, 0.5, rng.random() * step])
        rows.append((owner, START + datetime.timedelta(microseconds=int(at[owner] * 1e6)), k, rng.choice([None, 1, 2]), 0.5 if rng.random() < differing else rng.choice([0.001, 0.0])))
    return rows


SCHEMA = "owner string, at timestamp_ntz, id long, size int, difference double"


@pytest.mark.parametrize("owners", [["a"], ["a", "a", "a", "b", None, "c"]])
def test_stretches_equal_windows_by_owner(spark, owners):
    df = spark.createDataFrame([*_rows(random.Random(1), 4000, owners, 600.0), (owners[0], None, -1, 3, 0.0), (owners[0], None, -2, 3, 0.0)], SCHEMA)
    order = Window.partitionBy("owner").orderBy("at", "id")
    gap = timeline.micros("at") - F.lag(timeline.micros("at")).over(order)
    want = df.withColumn("previous", F.lag("size").over(order)).withColumn("running", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    want = want.withColumn("session", F.sum(F.when(gap.isNull() | (gap > 300_000_000), 1).otherwise(0)).over(order))
    want = {r["id"]: (r["previous"], r["running"], r["session"]) for r in want.collect()}
    previous = {r["id"]: r["previous"] for r in timeline.with_previous(df, ["owner"], "at", "id", "size").collect()}
    session = {r["id"]: r["session"] for r in timeline.session_numbers(df, ["owner"], "at", "id").collect()}
    running = {r["id"]: r["running"] for r in segments.running(df, ["owner"], ["at", "id"], F.col("size"), "running").collect()}
    assert {k: (previous[k], running[k], session[k]) for k in want} == want and len(previous) == len(session) == len(running) == len(want)


def test_running_total_keeps_the_columns(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 1, None), (None, 1, 2)], "owner string, place int, size int")
    out = context.running_total(df, ["owner"], "place", F.col("size"))
    assert out.columns == ["owner", "place", "size", "running"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == [("a", 1, 5, 5), ("a", 2, None, 5), ("b", 1, None, None), (None, 1, 2, 2)]


def test_a_hot_owner_is_in_many_stretches(spark):
    df = spark.createDataFrame(_rows(random.Random(3), 6000, ["a"]), SCHEMA)
    held = [r["count"] for r in segments.segmented(df, ["owner"], ["at", "id"]).groupBy(segments.SEGMENT).count().collect()]
    assert len(held) > 1 and max(held) < 6000 * 0.7


def by_hand(rows, force_s):
    kept, last = {}, {}
    for owner, at, key, _, difference in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        kept[key] = owner not in last or not ((1.0 if difference is None else difference) < 0.01 and at - last[owner] < datetime.timedelta(seconds=force_s))
        if kept[key]:
            last[owner] = at
    return kept


@pytest.mark.parametrize("differing", [0.0, 0.0005, 0.1])
@pytest.mark.parametrize("force_s", [1.0, 10.0, 500.0, 1e7])
@pytest.mark.parametrize("owners", [["a"], ["a", "a", "a", "b", None, "c"]])
def test_frames_kept_in_stretches_equal_frames_in_order(spark, monkeypatch, owners, force_s, differing):
    rows = _rows(random.Random(int(force_s)), 600, owners, 4.0, differing)
    df = spark.createDataFrame(rows, SCHEMA)
    # small stretches, whatever adaptive execution would join
    dealt = df.repartitionByRange(7, "owner", "at", "id").withColumn(segments.SEGMENT, F.spark_partition_id()).withColumn(segments.OWNER, F.struct("owner"))
    monkeypatch.setattr(segments, "segmented", lambda *_: frames.stored(dealt, "test"))
    got = {r["id"]: r["kept"] for r in frames.keep(df, "owner", "at", "id", "difference", force_s=force_s).collect()}
    assert got == by_hand(rows, force_s)


def test_steps_tell_what_is_kept_last():
    rng = np.random.default_rng(2)
    for force in (3, 20, 500):
        for _ in range(200):
            times = np.cumsum(rng.choice([0, 1, 7], 30)) + 100
            until, last = frames.last_kept(times, force)
            for before in times[0] - rng.integers(0, 2 * force, 5):
                want = frames.keep_flags(times, np.zeros(30), before, force=force)[1]
                assert next((v for u, v in zip(until, last, strict=True) if u - before >= force), before) == want
