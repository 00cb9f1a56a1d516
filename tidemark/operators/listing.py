"""Scoped, filtered, tagged and keyset-paged listing (sections 2.2, 2.3, 2.7)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT = 50


class NotFound(LookupError):
    """A record that was asked for by its id isn't there."""


def scope(df: DataFrame, column: str, value: Any, deleted: str | None = None) -> DataFrame:
    """Rows of one owner, without the softly deleted ones where ``deleted`` names that flag (2.2 #5, #6)."""
    if value is None:
        raise ValueError(f"a value for {column} is required")
    out = df.where(F.col(column) == value)
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def match(df: DataFrame, **filters: Any) -> DataFrame:
    """Equality by keyword; a list, tuple or set means IN (2.2 #1)."""
    for name, value in filters.items():
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, list | tuple | set | frozenset) else F.col(name) == value)
    return df


def match_truthy(df: DataFrame, **filters: Any) -> DataFrame:
    """``match`` with the filters that have a truthy value only, as counting does (2.2 #2)."""
    return match(df, **{k: v for k, v in filters.items() if v})


def within(df: DataFrame, column: str, start: Any = None, end: Any = None) -> DataFrame:
    """Strictly between start and end, either open (2.2 #3)."""
    if start is not None and end is not None and start > end:
        raise ValueError("the range starts after its end")
    if start is not None:
        df = df.where(F.col(column) > F.lit(start))
    return df.where(F.col(column) < F.lit(end)) if end is not None else df


def during(df: DataFrame, column: str, start: Any, end: Any) -> DataFrame:
    """From start to end, both included (2.2 #4)."""
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def after_cursor(time: str, key: str, at: Any, key_at: Any, ascending: bool = True) -> Column:
    """Rows that follow a cursor row in (time, key) order; both conjuncts reach the scan (2.7 #2)."""
    t, k = F.col(time), F.col(key)
    if ascending:
        return (t >= F.lit(at)) & ((t > F.lit(at)) | (k > F.lit(key_at)))
    return (t <= F.lit(at)) & ((t < F.lit(at)) | (k < F.lit(key_at)))


def ordered(df: DataFrame, time: str, key: str, ascending: bool = True) -> DataFrame:
    """By (time, key), nulls last either way (2.7 #1)."""
    turn = (lambda c: F.col(c).asc_nulls_last()) if ascending else (lambda c: F.col(c).desc_nulls_last())
    return df.orderBy(turn(time), turn(key))


def page(df: DataFrame, time: str, key: str, cursor: Any = None, limit: int | None = DEFAULT_LIMIT, ascending: bool = True) -> DataFrame:
    """The page that follows the row whose key is ``cursor``; an unknown cursor is an error (2.7 #1-3)."""
    if cursor is not None:
        row = df.where(F.col(key) == cursor).select(time).first()
        if row is None:
            raise NotFound(f"no row with {key} {cursor}")
        df = df.where(after_cursor(time, key, row[0], cursor, ascending))
    out = ordered(df, time, key, ascending)
    return out if limit is None else out.limit(limit)


def one(df: DataFrame, **key: Any) -> DataFrame:
    """The row with a key; an error if there is none (2.2 #11)."""
    out = match(df, **key).limit(1)
    if out.isEmpty():
        raise NotFound(str(key))
    return out


def exists(df: DataFrame, **key: Any) -> bool:
    """Whether a row with a key is there (2.2 #13)."""
    return not match(df, **key).limit(1).isEmpty()


def in_asked_order(df: DataFrame, key: str, ids: Sequence[Any], partial: bool = False) -> DataFrame:
    """Rows by id in the order asked, each as often as asked; a missing one is an error unless ``partial`` (2.2 #12)."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    asked = spark.createDataFrame([(list(ids),)], f"ids array<{kind}>").select(F.posexplode("ids").alias("position", key))
    if not partial:
        lost = asked.join(df, key, "left_anti").select(key).distinct().limit(5).collect()
        if lost:
            raise NotFound(f"{key}: {[r[0] for r in lost]}")
    return df.join(asked, key).orderBy("position")


def missing(asked: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Ids that were asked for and aren't there, once each (2.8 #8)."""
    return asked.select(key).distinct().join(df.select(key), key, "left_anti")


def with_any_tag(df: DataFrame, bridge: DataFrame, key: str, tags: Sequence[str], tag: str = "tag") -> DataFrame:
    """Rows with at least one of the tags, once each (2.3 #2)."""
    return df.join(bridge.where(F.col(tag).isin(list(tags))), key, "left_semi")


def with_all_tags(df: DataFrame, bridge: DataFrame, key: str, tags: Sequence[str], tag: str = "tag") -> DataFrame:
    """Rows with all the tags.  As many bridge rows as tags asked are needed: a repeated tag asks the impossible (2.3 #3)."""
    found = bridge.where(F.col(tag).isin(list(tags))).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(tags))
    return df.join(found, key, "left_semi")


def tag_page(owners: DataFrame, bridge: DataFrame, key: str, tag: str = "tag", cursor: str | None = None, like: str | None = None, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Distinct tags of the owners in order, after a cursor, matching a case-insensitive pattern (2.3 #5, 2.2 #14, 2.7 #6)."""
    out = bridge.join(owners, key, "left_semi").select(tag).distinct()
    if like:
        out = out.where(F.col(tag).ilike(f"%{like}%"))
    if cursor is not None:
        out = out.where(F.col(tag) > cursor)
    out = out.orderBy(F.col(tag).asc_nulls_last())
    return out if limit is None else out.limit(limit)


def detached(messages: DataFrame, agents: DataFrame, agent: str, message: str, held: str) -> DataFrame:
    """Messages that their agent's list ``held`` doesn't name (2.3 #6)."""
    listed = agents.select(agent, F.explode(held).alias(message))
    return messages.join(listed, [agent, message], "left_anti")


def detached_counts(messages: DataFrame, agents: DataFrame, agent: str, message: str, held: str) -> DataFrame:
    """Detached messages of every agent, those with none too, and the total under a null agent."""
    per = detached(messages, agents, agent, message, held).groupBy(agent).agg(F.count(F.lit(1)).alias("n"))
    every = agents.select(agent).distinct().join(per, agent, "left").select(agent, F.coalesce("n", F.lit(0)).alias("n"))
    kind = agents.schema[agent].dataType
    return every.unionByName(every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(None).cast(kind).alias(agent), "n"))


def related(owner_ids: DataFrame, records: DataFrame, key: str, partial: bool = True) -> DataFrame:
    """Records of a set of ids; unless ``partial`` a missing one is an error (2.3 #7)."""
    wanted = owner_ids.select(key).distinct()
    if not partial and not wanted.join(records, key, "left_anti").isEmpty():
        raise NotFound(f"some {key} have no record")
    return records.join(wanted, key, "left_semi")


def children(parents: DataFrame, rows: DataFrame, key: str, foreign: str, keep_childless: bool = False) -> DataFrame:
    """Parents with their child rows (2.3 #8)."""
    return parents.join(rows, parents[key] == rows[foreign], "left" if keep_childless else "inner")


def drill_down(days: DataFrame, activities: DataFrame, frames: DataFrame, projects: DataFrame) -> DataFrame:
    """Day, project, activity and frame in one row each frame (2.3 #9)."""
    day = days.select("deployment_id", "date", F.col("summary").alias("day_summary"))
    activity = activities.select(F.col("id").alias("activity_id"), "deployment_id", "project_id", F.col("summary").alias("activity_summary"), F.to_date("start_at").alias("date"))
    project = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    return frames.drop("deployment_id").join(activity, "activity_id").join(project, "project_id", "left").join(day, ["deployment_id", "date"], "left")


def newest(df: DataFrame, partition: Sequence[str], time: str, key: str, n: int = 1) -> DataFrame:
    """The ``n`` latest rows of each group, ties by key (2.1 #17, 2.5 #8, 2.6 #6)."""
    order = Window.partitionBy(*partition).orderBy(F.col(time).desc_nulls_last(), F.col(key).desc_nulls_last())
    return df.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")


def active_or_first(users: DataFrame, status: str = "status", created: str = "created_at", key: str = "id") -> DataFrame:
    """The active user, else the first one (2.2 #23)."""
    return users.orderBy(F.coalesce(F.col(status) != "active", F.lit(True)), F.col(created).asc_nulls_last(), F.col(key).asc_nulls_last()).limit(1)


def between_rows(df: DataFrame, time: str, key: str, after: Any = None, before: Any = None, limit: int | None = None, newest_first: bool = False) -> DataFrame:
    """Rows strictly after one row's time and before another's (2.7 #5)."""

    def moment(k: Any) -> Any:
        row = df.where(F.col(key) == k).select(time).first()
        if row is None:
            raise NotFound(f"no row with {key} {k}")
        return row[0]

    out = within(df, time, moment(after) if after is not None else None, moment(before) if before is not None else None)
    out = ordered(out, time, key, ascending=not newest_first)
    return out if limit is None else out.limit(limit)
