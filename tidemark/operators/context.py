"""Running totals, cutoffs, prefixes and trims of ordered messages (sections 2.6, 2.11 #14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments

#: Share of the tokens to fold into a summary, and messages kept at the end.
FOLD_SHARE, KEEP_LAST = 0.9, 5


def running_total(df: DataFrame, owner: Sequence[str], position: str, size: Column, name: str = "running") -> DataFrame:
    """``df`` with the running sum of ``size`` in order (2.6 #1); a hot owner is in many tasks."""
    return segments.running(df, owner, [position], size, name)


def summarizer_cutoff(messages: DataFrame, owner: str, position: str, role: str, tokens: Column, desired: float = FOLD_SHARE, keep_last: int = KEEP_LAST) -> DataFrame:
    """(owner, cutoff): how many messages of each conversation to fold into a summary (2.6 #2).

    Messages after the first (the system one) add up their tokens; the fold
    ends at the first one that is not from user, tool or function and either
    reaches the share of all tokens or leaves ``keep_last`` or fewer; tool
    messages that follow belong to it.  0 if none qualifies.
    """
    order = Window.partitionBy(owner).orderBy(position)
    numbered = messages.select(owner, F.col(role).alias("role"), tokens.alias("tokens"), (F.row_number().over(order) - 1).alias("i"))
    every = Window.partitionBy(owner)
    rest = numbered.where("i > 0").withColumn("total", F.sum("tokens").over(every)).withColumn("many", F.count(F.lit(1)).over(every))
    rest = rest.withColumn("cum", F.sum("tokens").over(Window.partitionBy(owner).orderBy("i")))
    ends = ~F.col("role").isin("user", "tool", "function")
    enough = (F.col("cum") >= F.floor(F.col("total") * desired)) | (F.col("many") - F.col("i") <= keep_last)
    rest = rest.withColumn("stop", F.min(F.when(ends & enough, F.col("i"))).over(every))
    # the first row after the stop that is no tool message ends the fold; at the end of the list there is none
    beyond = F.min(F.when((F.col("i") > F.col("stop")) & (F.col("role") != "tool"), F.col("i"))).over(every)
    cut = F.coalesce(F.when(F.col("stop").isNotNull(), F.coalesce(beyond, F.col("many") + 1)), F.lit(0))
    return rest.withColumn("cutoff", cut).groupBy(owner).agg(F.first("cutoff").cast("long").alias("cutoff"))


def fold_count(messages: DataFrame, owner: str, tokens: Column, window: int, trigger: float = 0.75, share: float = 0.8) -> DataFrame:
    """(owner, folded): messages to cut from a summary's input: ratio * share of them if all are over ``trigger`` of the window (2.10)."""
    per = messages.groupBy(owner).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("n"))
    ratio = trigger * window / F.col("tokens")
    return per.select(owner, F.when(F.col("tokens") > trigger * window, F.floor(F.col("n") * ratio * share)).otherwise(0).cast("long").alias("folded"))


def ready_prefix(items: DataFrame, owner: Sequence[str], position: str, pending: Column) -> DataFrame:
    """Items before the first pending one (2.6 #4, 2.9 #7)."""
    first = F.min(F.when(pending, F.col(position))).over(Window.partitionBy(*owner))
    return items.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(position) < F.col("_first"))).drop("_first")


def ready_any(items: DataFrame, pending: Column) -> tuple[DataFrame, DataFrame]:
    """Ready items, wherever they stand, and the pending ones that stay (2.9 #8)."""
    waits = F.coalesce(pending, F.lit(False))
    return items.where(~waits), items.where(waits)


def last_then_recent(df: DataFrame, owner: Sequence[str], time: str, key: str, n: int, seconds: int) -> DataFrame:
    """The last ``n`` by arrival, of these the ones within ``seconds`` of the latest; in this order (2.6 #5)."""
    late = Window.partitionBy(*owner).orderBy(F.col(time).desc_nulls_last(), F.col(key).desc_nulls_last())
    last = df.withColumn("_place", F.row_number().over(late)).where(F.col("_place") <= n)
    newest = F.max(time).over(Window.partitionBy(*owner))
    return last.withColumn("_newest", newest).where(F.col(time) >= F.col("_newest") - F.expr(f"interval {seconds} seconds")).drop("_place", "_newest")


def beyond_newest(df: DataFrame, time: str, key: str, keep: int = 600) -> DataFrame:
    """Rows to delete so that the newest ``keep`` stay (2.6 #6): the first kept one is found by a top-k, no window over all rows."""
    turn = [F.col(time).desc_nulls_last(), F.col(key).desc_nulls_last()]
    return df.join(F.broadcast(df.orderBy(*turn).limit(keep).select(key)), key, "left_anti")


def numbered(df: DataFrame, owner: Sequence[str], *order: Column) -> DataFrame:
    """``df`` with idx from 0 (2.6 #3)."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(*owner).orderBy(*order)) - 1)


def trim(agents: DataFrame, messages: DataFrame, user: str, keep: int) -> DataFrame:
    """(agent_id, message_ids): the system message, other users' messages, and ``user``'s own from position keep - 1 on (2.11 #14)."""
    listed = agents.select("agent_id", F.posexplode("message_ids").alias("pos", "message_id")).join(messages.select("message_id", "role", "user_id"), "message_id")
    own = F.coalesce(F.col("user_id") == user, F.lit(False)) & (F.col("role") != "system")
    place = F.row_number().over(Window.partitionBy("agent_id", own).orderBy("pos")) - 1
    kept = listed.withColumn("own", own).withColumn("place", place).where(~F.col("own") | (F.col("place") >= keep - 1))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "message_id"))), lambda x: x["message_id"])
    return kept.groupBy("agent_id").agg(ids.alias("message_ids"))


def only_system(agents: DataFrame) -> DataFrame:
    """All but the first message dropped."""
    return agents.withColumn("message_ids", F.slice("message_ids", 1, 1))


def attach(agents: DataFrame, ids: Sequence[str], front: bool = False) -> DataFrame:
    """Message ids appended, or put right after the system message."""
    new = F.array(*map(F.lit, ids))
    held = F.col("message_ids")
    both = F.concat(F.slice(held, 1, 1), new, F.slice(held, 2, 1_000_000)) if front else F.concat(held, new)
    return agents.withColumn("message_ids", both)
