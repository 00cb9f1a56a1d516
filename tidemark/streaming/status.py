"""Status-driven processing: pending, claimed, done, failed (section 2.9 #2-4, #14)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codes:
    """Six states of the two stages: pending, reading, read, describing, described, failed."""

    pending: int = 0
    reading: int = 1
    read: int = 2
    describing: int = 3
    described: int = 4
    failed: int = -1


#: The three codes of the processor with one stage.
SIMPLE = Codes(pending=0, reading=0, read=1, describing=1, described=1, failed=2)


def pending(frames: DataFrame, status: str, code: int, time_col: str, key: str, limit: int = 10) -> DataFrame:
    """The oldest rows in a state (2.7 #7)."""
    return frames.where(F.col(status) == code).orderBy(F.col(time_col).asc_nulls_last(), F.col(key).asc_nulls_last()).limit(limit)


def claim(frames: DataFrame, status: str, time_col: str, key: str, limit: int = 10, codes: Codes = Codes(), done: int | None = None) -> DataFrame:
    """The table with its oldest ``limit`` pending rows claimed (2.9 #2): from pending to reading, of the second stage from read to describing."""
    taken = pending(frames, status, codes.pending, time_col, key, limit).select(key, F.lit(True).alias("_taken"))
    # at most ``limit`` rows
    marked = frames.join(F.broadcast(taken), key, "left")
    return marked.withColumn(status, F.when(F.col("_taken"), F.lit(codes.reading if done is None else done)).otherwise(F.col(status))).select(*frames.columns)


def released(frames: DataFrame, status: str, claimed_at: str, now: Column, seconds: int, codes: Codes = Codes()) -> DataFrame:
    """Claims older than ``seconds`` given back, as those of a worker that was lost."""
    late = (F.col(status) == codes.reading) & (now - F.col(claimed_at) >= F.expr(f"interval {seconds} seconds"))
    return frames.withColumn(status, F.when(late, F.lit(codes.pending)).otherwise(F.col(status)))


def process(frames: DataFrame, status: str, result: Column, codes: Codes = SIMPLE) -> DataFrame:
    """The processor with one stage: pending rows become done, or failed where the result is null (2.9 #4)."""
    open_rows = F.col(status) == codes.pending
    return frames.withColumn("result", F.when(open_rows, result)).withColumn(
        status, F.when(open_rows, F.when(result.isNull(), F.lit(codes.failed)).otherwise(F.lit(codes.read))).otherwise(F.col(status))
    )


def transitions(codes: Codes) -> dict[tuple[int, str], int]:
    """The state after an event, where a state allows it."""
    return {
        (codes.pending, "claim"): codes.reading, (codes.reading, "text"): codes.read, (codes.reading, "no_text"): codes.read, (codes.reading, "fail"): codes.failed,
        (codes.read, "claim"): codes.describing, (codes.describing, "summary"): codes.described, (codes.describing, "fail"): codes.failed,
    }


def machine_stream(stream: DataFrame, key: str, event: str, place: str, codes: Codes = Codes()) -> DataFrame:
    """(key, status) after each trigger, from a stream of a frame's events: claim, text, no_text, summary, fail (2.9 #2, #3).

    ``place`` orders the events of a trigger.  An event that a state doesn't
    allow changes nothing, so a described or failed frame stays so: the state,
    one number a frame, is kept for it.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    steps = transitions(codes)
    kind = dict(stream.dtypes)[key]

    def run(name, parts, state):
        now = state.get[0] if state.exists else codes.pending
        rows = pd.concat([p[[place, event]] for p in parts]).sort_values(place, kind="stable")
        for what in rows[event]:
            now = steps.get((now, what), now)
        state.update((now,))
        yield pd.DataFrame({key: [name[0]], "status": [now]})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, status int", "status int", "update", GroupStateTimeout.NoTimeout)


def read_result(frames: DataFrame, text: Column, codes: Codes = Codes(), least: int = 1) -> DataFrame:
    """Apply recognised text to claimed frames: has_text if enough is left after trimming, else no text; null fails (2.9 #3)."""
    found = F.length(F.trim(text)) >= least
    return (
        frames.withColumn("_text", text)
        .withColumn("has_text", F.coalesce(found, F.lit(False)))
        .withColumn("ocr_text", F.when(found, F.col("_text")))
        .withColumn("ocr_status", F.when(F.col("_text").isNull(), F.lit(codes.failed)).otherwise(F.lit(codes.read)))
        .drop("_text")
    )


def describe_result(frames: DataFrame, summary: Column, codes: Codes = Codes()) -> DataFrame:
    """Apply summaries to read frames; null fails."""
    return frames.withColumn("vision_summary", summary).withColumn("vision_status", F.when(summary.isNull(), F.lit(codes.failed)).otherwise(F.lit(codes.described)))


def text_rows(frames: DataFrame) -> DataFrame:
    """Child rows of frames that have text."""
    return frames.where("has_text").select(F.col("id").alias("frame_id"), F.col("ocr_text").alias("text"))


def with_retry(work: Callable, tries: int = 3, base_s: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """Call ``work`` up to ``tries`` times, waiting base * 2**n between (2.9 #14)."""
    for k in range(tries):
        try:
            return work()
        except Exception:
            if k == tries - 1:
                raise
            sleep(base_s * 2**k)


def idempotent_append(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends rows whose key isn't there: a batch that is delivered again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        new.select(*batch.columns).write.mode("append").parquet(path)

    return write


def run_available(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Process what is there now through the idempotent sink, and stop."""
    query = stream.writeStream.foreachBatch(idempotent_append(path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def fan_out(sinks: dict[str, Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives one batch to several sinks, read once (2.9 #11)."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for sink in sinks.values():
                sink(batch)
        finally:
            batch.unpersist()

    return write
