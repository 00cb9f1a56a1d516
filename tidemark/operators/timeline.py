"""Sessions, buckets and rollups of activity (sections 2.4 #11-12, 2.6 #7-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import segments

SESSION_GAP_S, BUCKET = 300, "15 minutes"


def primary(value: Column) -> Column:
    """Aggregate: the most frequent value, the smallest of equally frequent ones."""
    return F.mode(value, True)


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def session_numbers(df: DataFrame, owner: Sequence[str], time: str, key: str, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """``df`` with session, from 1 for each owner; a gap of more than ``gap_s`` begins a new one.  A hot owner is in many tasks."""
    return segments.numbered(df, owner, [time, key], micros(time), gap_s * 1_000_000, "session")


def sessions(df: DataFrame, owner: Sequence[str], time: str, key: str, app: str, words: Column | None = None, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """A row for each session: start, end, primary_app, frame_count, total_words."""
    numbered = session_numbers(df, owner, time, key, gap_s).withColumn("_words", words if words is not None else F.lit(0))
    return numbered.groupBy(*owner, "session").agg(
        F.min(time).alias("start_time"), F.max(time).alias("end_time"), primary(F.col(app)).alias("primary_app"),
        F.count(F.lit(1)).alias("frame_count"), F.sum("_words").alias("total_words"),
    )


def session_windows(df: DataFrame, owner: Sequence[str], time: str, gap: str = f"{SESSION_GAP_S} seconds") -> DataFrame:
    """Sessions by ``session_window``, for streams too; a gap of exactly the limit stays inside."""
    return df.groupBy(*owner, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("frame_count"), F.min(time).alias("start_time"), F.max(time).alias("end_time"))


def buckets(df: DataFrame, owner: Sequence[str], time: str, size: str = BUCKET, **aggregates: Column) -> DataFrame:
    """Counts, and further aggregates, of tumbling windows."""
    out = df.groupBy(*owner, F.window(time, size).alias("w")).agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in aggregates.items()))
    return out.select(*owner, F.col("w.start").alias("bucket"), "n", *aggregates)


def days(df: DataFrame, owner: Sequence[str], time: str, app: str) -> DataFrame:
    """A row for each owner and day: frames, distinct apps, primary app, first and last time."""
    return df.groupBy(*owner, F.to_date(time).alias("day")).agg(
        F.count(F.lit(1)).alias("frames"), F.count_distinct(app).alias("apps"), primary(F.col(app)).alias("primary_app"),
        F.min(time).alias("first_at"), F.max(time).alias("last_at"),
    )


def with_previous(df: DataFrame, owner: Sequence[str], time: str, key: str, value: str) -> DataFrame:
    """``df`` with the value of the row before (2.6 #7)."""
    return segments.previous(df, owner, [time, key], value, "previous")
