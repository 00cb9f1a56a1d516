"""Batches of messages: absorbed when enough are ready (section 2.9 #6-10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Ready items that trigger a batch; seconds after which a pending upload fails.
BATCH, TIMEOUT_S = 20, 10


def batches(items: DataFrame, owner: str, arrival: str, position: str, least: int = BATCH) -> DataFrame:
    """``items`` with batch: arrivals (polls) in order; when ``least`` or more items wait, all of them form a batch.

    Items that no batch took have a null batch.  Null owners and arrivals are
    values like others, the first in order; ``position`` orders nothing here,
    as a poll's items stay together.  Only the sizes of polls are gone through
    in order; items get their poll's batch by a join.
    """
    poll = F.struct(F.col(owner).alias("owner"), F.col(arrival).alias("arrival"))
    sizes = items.groupBy(poll.alias("poll")).agg(F.count(F.lit(1)).alias("size"))
    named = sizes.select("poll", F.to_json(F.struct("poll.owner")).alias("owner"), "size")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting, batch, open_polls = None, 0, 0, []
        for part in parts:
            done: list[tuple[int, int | None]] = []
            for name, size, place in zip(part["owner"], part["size"], part["place"], strict=True):
                if name != now:
                    done += [(p, None) for p in open_polls]
                    now, waiting, batch, open_polls = name, 0, 0, []
                waiting += size
                open_polls.append(place)
                if waiting >= least:
                    batch += 1
                    done += [(p, batch) for p in open_polls]
                    waiting, open_polls = 0, []
            yield pd.DataFrame({"place": [p for p, _ in done], "batch": pd.array([b for _, b in done], dtype="Int64")})
        yield pd.DataFrame({"place": open_polls, "batch": pd.array([None] * len(open_polls), dtype="Int64")})

    placed = stored(named.withColumn("place", F.monotonically_increasing_id()), "polls")
    ordered = placed.repartition("owner").sortWithinPartitions("owner", "poll").select("owner", "size", "place")
    taken = ordered.mapInPandas(run, "place long, batch long")
    of_poll = placed.select("place", "poll").join(taken, "place").select(F.col("poll").alias("_poll"), "batch")
    return items.withColumn("_of", poll).join(of_poll, F.col("_of") == F.col("_poll")).drop("_of", "_poll")


def absorb_stream(items: DataFrame, owner: str, key: str, position: str, least: int = BATCH) -> DataFrame:
    """(owner, batch, key): each trigger adds items to the owner's state; at ``least`` or more, all of them leave as a batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = dict(items.dtypes)
    schema = f"{owner} {kinds[owner]}, batch long, {key} {kinds[key]}"

    def run(name, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        for part in parts:
            held += part.sort_values(position)[key].tolist()
        if len(held) >= least:
            batch += 1
            yield pd.DataFrame({owner: [name[0]] * len(held), "batch": batch, key: held})
            held = []
        state.update((batch, held))

    return items.groupBy(owner).applyInPandasWithState(run, schema, f"batch long, held array<{kinds[key]}>", "append", GroupStateTimeout.NoTimeout)


def upload_state(status: Column, started: Column, now: Column, timeout_s: int = TIMEOUT_S) -> Column:
    """A pending upload fails after ``timeout_s`` (2.9 #9)."""
    return F.when((status == "pending") & (now - started >= F.expr(f"interval {timeout_s} seconds")), F.lit("failed")).otherwise(status)


def upload_stream(uploads: DataFrame, key: str, time: str, status: str = "status", timeout_s: int = TIMEOUT_S) -> DataFrame:
    """(key, status) of a stream of uploads: what is still pending ``timeout_s`` after it was seen first fails by a timer (2.9 #9).

    The timer goes by event time, so a rerun gives the same; state is dropped
    as soon as an upload has ended.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(uploads.dtypes)[key]

    def run(name, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [name[0]], status: ["failed"]})
            return
        rows = pd.concat(parts).sort_values(time)
        ended = rows[rows[status] != "pending"]
        if len(ended):
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [name[0]], status: [ended[status].iloc[0]]})
        elif not state.exists:
            began = int(rows[time].iloc[0].timestamp() * 1000)
            state.update((began,))
            state.setTimeoutTimestamp(max(began + timeout_s * 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutTimestamp(max(state.get[0] + timeout_s * 1000, state.getCurrentWatermarkMs() + 1))

    held = uploads.withWatermark(time, "0 seconds").groupBy(key)
    return held.applyInPandasWithState(run, f"{key} {kind}, {status} string", "began long", "update", GroupStateTimeout.EventTimeTimeout)


def usable_images(images: Column, done: str = "completed") -> Column:
    """Images that failed or are unknown dropped from an item (2.9 #7)."""
    return F.filter(images, lambda x: F.coalesce(x["status"] == done, F.lit(False)))


def turn_order(requests: DataFrame, kind: str, position: str) -> DataFrame:
    """``requests`` with turn: requests of a type wait for the earlier ones of it (2.9 #10)."""
    from pyspark.sql import Window

    return requests.withColumn("turn", F.row_number().over(Window.partitionBy(kind).orderBy(position)))


def window_counts(events: DataFrame, time: str, owner: str, size: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(owner, start, n) of tumbling windows of a stream, rows later than ``late`` left out (2.9 #12, #13)."""
    out = events.withWatermark(time, late).groupBy(owner, F.window(time, size).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(owner, F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, time: str, owner: str, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """(owner, start, end, n) of sessions of a stream."""
    out = events.withWatermark(time, late).groupBy(owner, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(owner, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
