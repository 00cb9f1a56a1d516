"""Keyed writes as rewrites: upsert, patch, merge, sync, delete (sections 2.8, 2.11, 2.14).

Parquet has no update: each function gives the table's next version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Conflict(ValueError):
    """A unique key is there already."""


def insert_new(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't in ``old``: append these (2.1 #15).

    Of rows with a repeated key one is taken.  A key with a null is equal to
    none, as in a unique index, so such rows are all new.
    """
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    known = new.where(whole).dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti")
    return known.select(*new.columns).unionByName(new.where(~whole))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``new`` rows in place of ``old`` ones of the same key, and the rest of both (2.11 #12); a repeated or null key is an error."""
    unique(required(new, *key), *key)
    return old.join(new, list(key), "left_anti").unionByName(new.select(*old.columns))


def replace(old: DataFrame, dropped: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete ids and insert rows in one version; an id that isn't there is an error (2.11 #8, #9)."""
    missing = dropped.select(key).join(old, key, "left_anti")
    if not missing.isEmpty():
        raise LookupError(f"no row with {key} {[r[0] for r in missing.limit(5).collect()]}")
    return old.join(dropped.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Only set fields change: ``changes`` has a flag ``set_<field>`` for each field, so that null can be set too (2.11 #10); a repeated key is an error."""
    unique(changes, key)
    fields = [c for c in changes.columns if c != key and f"set_{c}" in changes.columns]
    renamed = changes.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in fields), *(F.col(f"set_{c}").alias(f"_set_{c}") for c in fields))
    both = old.join(renamed, key, "left")
    return both.select(*(F.when(F.col(f"_set_{c}"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns))


def delete(old: DataFrame, ids: DataFrame, key: str, soft: str | None = None) -> DataFrame:
    """Without the ids, or with the flag ``soft`` set (2.11 #11)."""
    if soft is None:
        return old.join(ids.select(key), key, "left_anti")
    marked = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return old.join(marked, key, "left").withColumn(soft, F.coalesce(F.col("_gone"), F.col(soft))).drop("_gone")


def merge_event(summary: Column, details: Column, operations: Column, new_summary: Column, new_details: Column) -> list[Column]:
    """summary replaced, details appended with a newline, operations joined by a comma (2.11 #7)."""
    return [
        F.coalesce(new_summary, summary).alias("summary"),
        F.concat_ws("\n", details, new_details).alias("details"),
        F.concat_ws(", ", operations, F.when(new_summary.isNotNull(), "updated_summary"), F.when(new_details.isNotNull(), "updated_details")).alias("operation"),
    ]


def sync_difference(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(key, state): new, obsolete or current (2.8 #3)."""
    a, b = ours.select(key).distinct().withColumn("_a", F.lit(1)), theirs.select(key).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "obsolete").otherwise("current")
    return a.join(b, key, "full").select(key, state.alias("state"))


def key_sync(current: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, action): update, insert, drop or keep (2.8 #4)."""
    a, b = current.select(key, F.col(value).alias("_old")), wanted.select(key, F.col(value).alias("_new"))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full")
    action = (
        F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "drop").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    )
    return both.select(key, F.when(F.col("_b").isNotNull(), F.col("_new")).otherwise(F.col("_old")).alias(value), action.alias("action"))


def right_wins(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Two key-value tables as one, the right one's values first (2.8 #5)."""
    a, b = left.select(key, F.col(value).alias("_l")), right.select(key, F.col(value).alias("_r"), F.lit(True).alias("_there"))
    return a.join(b, key, "full").select(key, F.when(F.col("_there"), F.col("_r")).otherwise(F.col("_l")).alias(value))


def last_value_map(df: DataFrame, owner: str, key: str, value: str, order: str) -> DataFrame:
    """(owner, settings): a map of each key's last value (2.10)."""
    last = df.groupBy(owner, key).agg(F.max_by(value, order).alias(value))
    return last.groupBy(owner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("settings"))


def mapping_conflicts(old: DataFrame, new: DataFrame, left: str, right: str) -> DataFrame:
    """New pairs of which either side is mapped to something else already (2.11 #13)."""
    taken = [old.select(c, F.col(o).alias(f"_{o}")).withColumnRenamed(f"_{o}", f"old_{o}") for c, o in ((left, right), (right, left))]
    by_left = new.join(taken[0], left).where(F.col(f"old_{right}") != F.col(right)).select(left, right)
    by_right = new.join(taken[1], right).where(F.col(f"old_{left}") != F.col(left)).select(left, right)
    return by_left.union(by_right).distinct()


def add_mapping(old: DataFrame, new: DataFrame, left: str, right: str, force: bool = False) -> DataFrame:
    """Pairs added; a side that is there is an error, or replaced when forced (2.11 #13, 2.3 #11)."""
    if not force and not mapping_conflicts(old, new, left, right).isEmpty():
        raise Conflict("a side of the mapping is there already")
    kept = old.join(new.select(left), left, "left_anti").join(new.select(right), right, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def unique(df: DataFrame, *key: str) -> DataFrame:
    """``df``, or an error if a key is there twice (1.3)."""
    twice = df.groupBy(*key).count().where("count > 1").limit(1)
    if not twice.isEmpty():
        raise Conflict(f"{key} is there twice: {twice.first()}")
    return df


def required(df: DataFrame, *fields: str) -> DataFrame:
    """``df``, or an error if a required field is null (2.14 #1)."""
    missing = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in fields)).first()
    empty = [c for c in fields if missing[c]]
    if empty:
        raise ValueError(f"required: {', '.join(empty)}")
    return df


def references(df: DataFrame, foreign: str, parents: DataFrame, key: str) -> DataFrame:
    """``df``, or an error if a foreign key has no parent (2.14 #18)."""
    lost = df.where(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")
    if not lost.isEmpty():
        raise LookupError(f"{foreign} without a parent")
    return df


def rename_cascade(bridge: DataFrame, renamed: DataFrame, key: str, label: str) -> DataFrame:
    """A changed label of a block carried to its bridge rows (2.11 #15)."""
    new = renamed.select(key, F.col(label).alias("_new"))
    return bridge.join(new, key, "left").withColumn(label, F.coalesce("_new", label)).drop("_new").select(*bridge.columns)


def first_positions(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values in order of first appearance (2.8 #7)."""
    return df.groupBy(value).agg(F.min(position).alias(position)).orderBy(position)
