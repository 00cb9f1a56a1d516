"""Ordered work within an owner, without one task for an owner: stretches of the order, and what they carry over.

Rows are dealt by ranges of (owner, order), so that a hot owner's rows are in
many tasks, each a stretch of its time.  A step is done stretch by stretch; what
a stretch needs of those before it follows from a small table with a row for
each owner and stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: The stretch of a row, and its owner as one value (nulls are owners too).
SEGMENT, OWNER = "_segment", "_owner"


def segmented(df: DataFrame, owner: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with SEGMENT and OWNER, stored: later steps must see the same stretches.  Stretches are numbered in order."""
    dealt = df.repartitionByRange(*owner, *order).withColumn(SEGMENT, F.spark_partition_id())
    return stored(dealt.withColumn(OWNER, F.struct(*owner)), "segments")


def within(order: Sequence[str]) -> Window:
    """Rows of one owner and stretch, in order."""
    return Window.partitionBy(SEGMENT, OWNER).orderBy(*order)


def earlier() -> Window:
    """Stretches of one owner: as many as hold rows of it."""
    return Window.partitionBy(OWNER).orderBy(SEGMENT)


def attached(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``edges``, which has a row for each owner and stretch."""
    return rows.join(edges, [SEGMENT, OWNER]).drop(SEGMENT, OWNER)


def running(df: DataFrame, owner: Sequence[str], order: Sequence[str], size: Column, name: str) -> DataFrame:
    """``df`` with the running sum of ``size`` of each owner, null while all are null."""
    rows = segmented(df.withColumn("_size", size), owner, order)
    so_far = F.sum("_size").over(within(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = rows.groupBy(SEGMENT, OWNER).agg(F.sum("_size").alias("_total"))
    edges = edges.withColumn("_before", F.sum("_total").over(earlier().rowsBetween(Window.unboundedPreceding, -1))).drop("_total")
    out = attached(rows.withColumn("_so_far", so_far).drop("_size"), edges)
    both = F.coalesce(F.col("_so_far") + F.col("_before"), "_so_far", "_before")
    return out.withColumn(name, both).drop("_so_far", "_before")


def previous(df: DataFrame, owner: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the value of its owner's row before."""
    rows = segmented(df, owner, order)
    edges = rows.groupBy(SEGMENT, OWNER).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    edges = edges.withColumn("_before", F.lag("_last").over(earlier())).drop("_last")
    inner = within(order)
    out = attached(rows.withColumn("_at", F.row_number().over(inner)).withColumn("_here", F.lag(value).over(inner)), edges)
    return out.withColumn(name, F.when(F.col("_at") == 1, F.col("_before").getField(value)).otherwise(F.col("_here"))).drop("_at", "_here", "_before")


def numbered(df: DataFrame, owner: Sequence[str], order: Sequence[str], at: Column, most: int, name: str) -> DataFrame:
    """``df`` with the number, from 1 for each owner, of the run that a row is in; a step of ``at`` by more than ``most``, or an unknown one, begins a new run.

    The first of ``order`` is what ``at`` grows with, nulls first.
    """
    rows = segmented(df.withColumn("_at", at), owner, order)
    inner = within(order)
    step = F.col("_at") - F.lag("_at").over(inner)
    opens = F.when((F.row_number().over(inner) > 1) & (step.isNull() | (step > most)), 1).otherwise(0)
    rows = rows.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(inner))
    # nulls come first: the first row has one if any has, the last only if all have
    edges = rows.groupBy(SEGMENT, OWNER).agg(
        F.when(F.count("_at") == F.count(F.lit(1)), F.min("_at")).alias("_first"), F.max("_at").alias("_last"), F.max("_run").alias("_runs"))
    step = F.col("_first") - F.lag("_last").over(earlier())
    edges = edges.withColumn("_starts", F.when(step.isNull() | (step > most), 1).otherwise(0))
    edges = edges.withColumn("_before", F.sum(F.col("_runs") + F.col("_starts")).over(earlier()) - F.col("_runs")).select(SEGMENT, OWNER, "_before")
    out = attached(rows.drop("_at", "_opens"), edges)
    return out.withColumn(name, F.col("_before") + F.col("_run")).drop("_before", "_run")
