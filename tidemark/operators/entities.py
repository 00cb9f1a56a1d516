"""Create, read, list, change and delete records of any kind (section 2.14).

A kind says what its records need: required and unique fields, parents, the
columns that hold their owner, and whether deleting keeps them.  Every
function takes a kind and its table and gives rows or the table's next
version; nothing is written here.  Whole sets of records are handled at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import stored
from . import listing, maintenance
from .maintenance import Conflict


class Invalid(ValueError):
    """A record lacks a required field or has one that its kind doesn't know."""


@dataclass(frozen=True)
class Kind:
    name: str
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    parents: Mapping[str, str] = field(default_factory=dict)  # foreign key to kind
    owner: tuple[str, ...] = ("organization_id", "user_id")
    soft: bool = False
    key: str = "id"


def _kinds(*kinds: Kind) -> dict[str, Kind]:
    return {k.name: k for k in kinds}


#: What the store keeps; tables may have further columns.
KINDS = _kinds(
    Kind("episodic", ("event_type", "summary")),
    Kind("semantic", ("name", "summary")),
    Kind("procedural", ("entry_type", "summary")),
    Kind("resource", ("title", "summary", "resource_type")),
    Kind("vault", ("entry_type", "sensitivity", "secret_value", "caption")),
    Kind("message", ("agent_id", "role"), parents={"agent_id": "agent"}),
    Kind("block", ("label", "value")),
    Kind("agent", ("name",)),
    Kind("tool", ("name",), unique=(("organization_id", "name"),), owner=("organization_id",)),
    Kind("file", ("file_name",), owner=("organization_id",)),
    Kind("cloud_file", ("cloud_file_id", "local_file_id"), unique=(("cloud_file_id",), ("local_file_id",))),
    Kind("step", ("agent_id",), owner=("organization_id",)),
    Kind("user", ("name",), owner=("organization_id",), soft=True),
    Kind("organization", ("name",), owner=(), soft=True),
    Kind("provider", ("name",), unique=(("organization_id", "name"),), owner=("organization_id",), soft=True),
    Kind("sandbox", ("type",), unique=(("organization_id", "type"),), owner=("organization_id",)),
    Kind("variable", ("sandbox_id", "key", "value"), unique=(("sandbox_id", "key"),), parents={"sandbox_id": "sandbox"}, owner=("organization_id",)),
)


def _of(kind: str) -> Kind:
    if kind not in KINDS:
        raise Invalid(f"unknown kind {kind}")
    return KINDS[kind]


def short_ids(rows: DataFrame, taken: DataFrame, key: str, seed: Sequence[str], sizes: Sequence[int] = (4, 8, 32)) -> DataFrame:
    """``rows`` with an id that no row of ``taken`` and no other row has (2.10, short id).

    An id derives from the ``seed`` columns; where it is there already, a
    longer one of the same digest is taken, at last the whole digest.  Rows
    with equal seeds are told apart by their place among these.
    """
    order = Window.partitionBy(*seed).orderBy(*seed)
    open_rows = rows.drop(key).withColumn("_again", F.row_number().over(order)).withColumn("_last", F.lit(False))
    out, held = None, taken.select(key)
    for k, size in enumerate(sizes):
        made = X.short_id(*(F.col(c).cast("string") for c in seed), F.when(F.col("_again") > 1, F.col("_again").cast("string")), size=size)
        first = F.row_number().over(Window.partitionBy(key).orderBy("_again", *seed)) == 1
        asked = open_rows.withColumn(key, made).withColumn("_first", first)
        there = held.select(key).distinct().withColumn("_there", F.lit(True))
        asked = asked.join(there, key, "left").withColumn("_free", F.col("_first") & F.col("_there").isNull())
        if k == len(sizes) - 1:
            # a whole digest clashes with nothing but itself
            clash = F.raise_error(F.concat(F.lit("no free id for "), F.col(key))).cast("string")
            done = asked.withColumn(key, F.when(F.col("_free"), F.col(key)).otherwise(clash))
        else:
            done = asked.where("_free")
            open_rows = asked.where("not _free").drop(key, "_first", "_there", "_free")
        done = done.select(key, *(c for c in rows.columns if c != key))
        held = held.unionByName(done.select(key))
        out = done if out is None else out.unionByName(done)
    return out


def create(
    kind: str,
    table: DataFrame,
    rows: DataFrame,
    actor: Mapping[str, Any],
    now: Column | None = None,
    parents: Mapping[str, DataFrame] | None = None,
    seed: Sequence[str] | None = None,
    id_sizes: Sequence[int] = (4, 8, 32),
) -> DataFrame:
    """The rows to append: checked, with ids, owner, times and last change (2.14 #1, #2).

    One append for all rows.  Missing required fields, keys that are there and
    parents that are not raise the categories of 2.14 #18.  Columns of the
    table that the rows lack are null.
    """
    what = _of(kind)
    lost = [c for c in what.required if c not in rows.columns and c not in actor]
    unknown = [c for c in rows.columns if c not in table.columns]
    if lost or unknown:
        raise Invalid(f"{kind}: required {lost}, unknown {unknown}")
    maintenance.required(rows, *(c for c in what.required if c in rows.columns))
    now = F.current_timestamp() if now is None else now
    out = rows
    for c in what.owner:
        if c in table.columns:
            if actor.get(c) is None:
                raise Invalid(f"{kind}: an actor with {c} is required")
            out = out.withColumn(c, F.lit(actor[c]))
    stamps = {"created_at": now, "updated_at": now, "is_deleted": F.lit(False), "last_modify": F.struct(now.cast("string").alias("timestamp"), F.lit("created").alias("operation"))}
    out = out.withColumns({c: v for c, v in stamps.items() if c in table.columns and c not in rows.columns})
    for foreign, parent in what.parents.items():
        if parents and parent in parents and foreign in out.columns:
            maintenance.references(out, foreign, parents[parent], KINDS[parent].key)
    if what.key in rows.columns:
        _free(table, out, (what.key,))
    else:
        out = short_ids(out.withColumn(what.key, F.lit(None).cast("string")), table, what.key, seed or [c for c in what.required if c in rows.columns], id_sizes)
        out = stored(out, "created")  # the checks that follow and the result read it
    for fields in what.unique:
        if set(fields) <= set(table.columns) and set(fields) <= set(out.columns):
            _free(live(kind, table), out, fields)
    kinds = {f.name: f.dataType for f in table.schema.fields}
    return out.select(*((F.col(c) if c in out.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in table.columns))


def _free(table: DataFrame, rows: DataFrame, fields: Sequence[str]) -> None:
    maintenance.unique(rows, *fields)
    if not rows.join(table.select(*fields), list(fields), "left_semi").isEmpty():
        raise Conflict(f"{tuple(fields)} is there already")


def live(kind: str, table: DataFrame) -> DataFrame:
    """Rows that are not softly deleted."""
    return table.where(~F.coalesce(F.col("is_deleted"), F.lit(False))) if "is_deleted" in table.columns else table


def visible(kind: str, table: DataFrame, actor: Mapping[str, Any], user: bool = False) -> DataFrame:
    """Rows of the actor's organization, of the actor alone with ``user``, that are not deleted."""
    out = live(kind, table)
    for c in _of(kind).owner:
        if c in table.columns and (user or c != "user_id"):
            out = listing.scope(out, c, actor.get(c))
    return out


def read(kind: str, table: DataFrame, key: Any, actor: Mapping[str, Any]) -> DataFrame:
    """The record with an id; an error if it isn't there, deleted or another organization's (2.14 #3)."""
    return listing.one(visible(kind, table, actor), **{_of(kind).key: key})


def find(kind: str, table: DataFrame, actor: Mapping[str, Any], **fields: Any) -> DataFrame:
    """The first record with these fields, by time and id, or none: missing names are no error (2.14 #10, 2.2 #24)."""
    out = listing.match(visible(kind, table, actor), **fields)
    order = [F.col("created_at").asc_nulls_last()] if "created_at" in table.columns else []
    return out.orderBy(*order, F.col(_of(kind).key).asc_nulls_last()).limit(1)


def by_ids(kind: str, table: DataFrame, ids: Sequence[Any]) -> DataFrame:
    """A row for each id in the order asked, all null but for the id where it isn't there (2.14 #8)."""
    key = _of(kind).key
    shape = f"ids array<{table.schema[key].dataType.simpleString()}>"
    asked = table.sparkSession.createDataFrame([(list(ids),)], shape).select(F.posexplode("ids").alias("position", key))
    return asked.join(live(kind, table), key, "left").orderBy("position")


def listed(kind: str, table: DataFrame, actor: Mapping[str, Any], cursor: Any = None, limit: int | None = listing.DEFAULT_LIMIT, ascending: bool = True, **fields: Any) -> DataFrame:
    """A page of the organization's records by time and id (2.14 #10, #11, #14, #15)."""
    return listing.page(listing.match(visible(kind, table, actor), **fields), "created_at", _of(kind).key, cursor, limit, ascending)


def patch(kind: str, table: DataFrame, changes: DataFrame, now: Column | None = None, only_different: bool = False) -> DataFrame:
    """The table with set fields changed and their time (2.11 #10, 2.14 #7-11); ids that aren't there or come twice are errors.

    ``only_different`` leaves records alone whose fields have these values (2.14 #16).
    """
    key = _of(kind).key
    if not changes.select(key).join(live(kind, table), key, "left_anti").isEmpty():
        raise listing.NotFound(f"{kind}: a record to change isn't there")
    fields = [c for c in changes.columns if f"set_{c}" in changes.columns]
    unknown = [c for c in fields if c not in table.columns]
    if unknown:
        raise Invalid(f"{kind}: unknown {unknown}")
    out = maintenance.patch(table, changes, key)
    if "updated_at" not in table.columns:
        return out
    marks = changes.select(key, F.lit(True).alias("_touched"))
    if only_different:
        old = table.select(key, *(F.col(c).alias(f"_was_{c}") for c in fields))
        differs = F.lit(False)
        for c in fields:
            differs = differs | (F.col(f"set_{c}") & ~F.col(c).eqNullSafe(F.col(f"_was_{c}")))
        marks = changes.join(old, key).where(differs).select(key, F.lit(True).alias("_touched"))
    stamp = F.when(F.col("_touched"), F.current_timestamp() if now is None else now).otherwise(F.col("updated_at"))
    return out.join(marks, key, "left").withColumn("updated_at", stamp).select(*table.columns)


def delete(kind: str, table: DataFrame, ids: DataFrame, soft: bool | None = None) -> DataFrame:
    """The table without the records, or with them marked, as their kind has it (2.11 #11, 2.14 #4, #15); a missing one is an error."""
    what = _of(kind)
    if not ids.select(what.key).join(live(kind, table), what.key, "left_anti").isEmpty():
        raise listing.NotFound(f"{kind}: a record to delete isn't there")
    return maintenance.delete(table, ids, what.key, "is_deleted" if (what.soft if soft is None else soft) else None)


def get_or_create(kind: str, table: DataFrame, row: DataFrame, actor: Mapping[str, Any], by: Sequence[str], **options: Any) -> DataFrame:
    """The rows to append so that each of ``row`` is there by its fields ``by``: none if they all are (2.14 #14, #16)."""
    missing = row.join(visible(kind, table, actor).select(*by), list(by), "left_anti")
    return create(kind, table, missing, actor, **options)


def upsert(kind: str, table: DataFrame, rows: DataFrame, actor: Mapping[str, Any], by: Sequence[str], now: Column | None = None, **options: Any) -> DataFrame:
    """The table with records changed where one with the same ``by`` is there, else added (2.11 #12, 2.14 #10)."""
    key = _of(kind).key
    maintenance.unique(rows, *by)
    there = visible(kind, table, actor).select(*by, F.col(key).alias("_id"))
    fields = [c for c in rows.columns if c not in by and c != key]
    known = rows.join(there, list(by)).select(F.col("_id").alias(key), *fields, *(F.lit(True).alias(f"set_{c}") for c in fields))
    added = create(kind, table, rows.join(there, list(by), "left_anti"), actor, now, **options)
    return patch(kind, table, known, now).unionByName(added)


def insert_lists(kind: str, table: DataFrame, calls: DataFrame, items: str, actor: Mapping[str, Any], **options: Any) -> DataFrame:
    """The rows to append for calls that hold arrays of records (2.14 #5); null and empty arrays add nothing."""
    rows = calls.select(F.explode(items).alias("_item")).select("_item.*")
    return create(kind, table, rows, actor, **options)


def checked(kind: str, table: DataFrame, ids: Sequence[Any], *fields: str) -> DataFrame:
    """Fields of records by id in the order asked; a missing one is an error (2.14 #6)."""
    key = _of(kind).key
    return listing.in_asked_order(live(kind, table), key, ids).select("position", key, *fields)


# Lists that agents hold --------------------------------------------------------------


def held_with(held: Column, members: Column) -> Column:
    """A list with members added at its end that it doesn't have (2.14 #9)."""
    held = F.coalesce(held, F.array().cast("array<string>"))
    return F.concat(held, F.array_except(members, held))


def held_without(held: Column, members: Column) -> Column:
    """A list without members; order and repeats of the others stay (2.14 #9)."""
    return F.filter(held, lambda x: ~F.coalesce(F.array_contains(members, x), F.lit(False)))


def change_lists(agents: DataFrame, changes: DataFrame, key: str, held: str, attach: bool = True) -> DataFrame:
    """Agents with what ``changes`` (key, member) names attached to or detached from their list (2.14 #9)."""
    named = changes.groupBy(key).agg(F.array_sort(F.collect_set("member")).alias("_members"))
    members = F.coalesce("_members", F.array().cast("array<string>"))
    new = held_with(F.col(held), members) if attach else held_without(F.col(held), members)
    return agents.join(named, key, "left").withColumn(held, F.when(F.col("_members").isNotNull(), new).otherwise(F.col(held))).select(*agents.columns)


# Single families ---------------------------------------------------------------------


def set_processed(cloud: DataFrame, ids: DataFrame, status: str = "processed") -> DataFrame:
    """Cloud files marked as processed; an unknown one is an error (2.14 #12)."""
    if not ids.select("cloud_file_id").join(cloud, "cloud_file_id", "left_anti").isEmpty():
        raise listing.NotFound("a cloud file isn't mapped")
    marked = ids.select("cloud_file_id").distinct().withColumn("_done", F.lit(status))
    return cloud.join(marked, "cloud_file_id", "left").withColumn("status", F.coalesce("_done", "status")).select(*cloud.columns)


def by_status(cloud: DataFrame, status: str, time: str = "timestamp", key: str = "cloud_file_id") -> DataFrame:
    """Mapped files in a state, oldest first (2.2 #15)."""
    return cloud.where(F.col("status") == status).orderBy(F.col(time).asc_nulls_last(), F.col(key).asc_nulls_last())


def lookup(cloud: DataFrame, wanted: DataFrame, given: str, other: str) -> DataFrame:
    """(given, other): the other side of each id, null where it isn't mapped (2.3 #11)."""
    return wanted.select(given).distinct().join(cloud.select(given, other), given, "left")


def categories(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order, null and blank ones left out (2.2 #17)."""
    return df.where(F.trim(column) != "").select(column).distinct().orderBy(column)


def told_blocks(blocks: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """Blocks with a value, the persona left out (2.2 #20)."""
    return blocks.where((F.trim(F.coalesce(value, F.lit(""))) != "") & ~F.col(label).eqNullSafe(F.lit("persona")))


def registry_sync(registered: DataFrame, offered: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Tools to register and tools to unregister, by the two-way difference (2.14 #17, 2.8 #3)."""
    state = maintenance.sync_difference(registered, offered, key)
    return offered.join(state.where("state = 'new'"), key, "left_semi"), registered.join(state.where("state = 'obsolete'"), key, "left_semi")
