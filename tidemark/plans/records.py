"""Registered queries of records, agents, queues and searches over several stores, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context, counting, entities, listing, maintenance, search, similarity
from ..session import table, with_instants, workspace
from ..sources import files
from ..streaming import absorb, frames, status
from .catalog import _SQL_BRIDGE, _SQL_RECORDS, _bridge, _frames, _messages, _records, _register, _sql

ACTOR = {"organization_id": "org-1", "user_id": "user-1"}
_NOW = "2024-06-01 12:00:00"
_NTZ = "timestamp_ntz"


def _now():
    return F.lit(_NOW).cast(_NTZ)


# Records -------------------------------------------------------------------------------


def _semantic(spark, d) -> DataFrame:
    """Parts below 60 % of the largest key as semantic records of two organizations; every seventh is deleted."""
    ours, _ = _records(spark, d)
    key = F.col("id")
    return ours.select(
        F.concat(F.lit("s"), key.cast("string")).alias("id"), "name", F.concat(F.lit("about "), "name").alias("summary"), F.lit(None).cast("string").alias("details"),
        F.when(key % 5 == 0, "org-2").otherwise("org-1").alias("organization_id"), F.when(key % 2 == 0, "user-2").otherwise("user-1").alias("user_id"),
        (F.lit("2024-01-01 00:00:00").cast(_NTZ) + F.make_dt_interval(F.lit(0), F.lit(0), (key % 50).cast("int"))).alias("created_at"),
        F.lit("2024-01-01 00:00:00").cast(_NTZ).alias("updated_at"), (key % 7 == 0).alias("is_deleted"),
    )


_SQL_SEMANTIC = _SQL_RECORDS + """, sem as (select 's' || id as id, name, 'about ' || name as summary, null::varchar as details,
  case when id % 5 = 0 then 'org-2' else 'org-1' end organization_id, case when id % 2 = 0 then 'user-2' else 'user-1' end user_id,
  timestamp '2024-01-01 00:00:00' + to_minutes((id % 50)::int) created_at, timestamp '2024-01-01 00:00:00' updated_at, id % 7 = 0 is_deleted from ours)"""


@_register(_SQL_SEMANTIC + """, m as (select name || ' ' || id as name, name || ' anew' as summary from theirs), h as (select *, md5(name || chr(1) || summary) x from m)
select substr(translate(x, '0123456789', 'ghijklmnop'), 1, 1) || substr(x, 2, 31) as id, name, summary, 'org-1' as organization_id, 'user-1' as user_id, timestamp '2024-06-01 12:00:00' as created_at, false as is_deleted from h""")
def memory_create(spark, d):
    """New records, their ids, owner and times (2.14 #1, #2)."""
    _, theirs = _records(spark, d)
    new = theirs.select(F.concat_ws(" ", "name", "id").alias("name"), F.concat("name", F.lit(" anew")).alias("summary"))
    made = entities.create("semantic", _semantic(spark, d), new, ACTOR, _now(), id_sizes=(32,))
    return made.select("id", "name", "summary", "organization_id", "user_id", "created_at", "is_deleted")


@_register(_SQL_SEMANTIC + " select id, name from sem where id = 's3' and organization_id = 'org-1' and not is_deleted")
def memory_read(spark, d):
    return entities.read("semantic", _semantic(spark, d), "s3", ACTOR).select("id", "name")


@_register(_SQL_SEMANTIC + " select id, name from sem where id not in ('s1', 's2', 's3')")
def memory_delete(spark, d):
    gone = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "id string")
    return entities.delete("semantic", _semantic(spark, d), gone).select("id", "name")


@_register("""
select c.conv_id::varchar as name, u.text as summary from conversations c, (select conv_id, text from conversations) u where c.turn = 0 and u.conv_id = c.conv_id""")
def insert_item_lists(spark, d):
    """Each conversation's turns as a list of records in one call (2.14 #5)."""
    item = F.struct(F.col("conv_id").cast("string").alias("name"), F.col("text").alias("summary"))
    calls = _messages(spark, d).groupBy("conv_id").agg(F.collect_list(item).alias("items"))
    return entities.insert_lists("semantic", _semantic(spark, d), calls, "items", ACTOR, now=_now()).select("name", "summary")


@_register(_SQL_SEMANTIC + " select p as position, v.i as id, s.name from (values (0, 's9'), (1, 's2'), (2, 's9')) v(p, i) join sem s on s.id = v.i")
def memory_check(spark, d):
    return entities.checked("semantic", _semantic(spark, d), ["s9", "s2", "s9"], "name").select("position", "id", "name")


@_register(_SQL_SEMANTIC + " select p as position, v.i as id, s.name from (values (0, 's9'), (1, 'none'), (2, 's7'), (3, 's1')) v(p, i) left join sem s on s.id = v.i and not s.is_deleted")
def blocks_by_ids(spark, d):
    """Ids that aren't there, or are deleted, stay with nulls (2.14 #8)."""
    return entities.by_ids("block", _semantic(spark, d), ["s9", "none", "s7", "s1"]).select("position", "id", "name")


@_register(_SQL_SEMANTIC + " select id, created_at from sem where organization_id = 'org-1' and not is_deleted order by created_at, id limit 50")
def tools_listed(spark, d):
    return entities.listed("tool", _semantic(spark, d), ACTOR).select("id", "created_at")


@_register(_SQL_SEMANTIC + " select id, name from sem where organization_id = 'org-1' and not is_deleted and summary = (select summary from sem where id = 's4') order by created_at, id limit 1")
def tool_by_name(spark, d):
    """The first of that name; none is no error (2.14 #10, 2.2 #24)."""
    records = _semantic(spark, d)
    wanted = records.where("id = 's4'").first()["summary"]
    return entities.find("tool", records, ACTOR, summary=wanted).select("id", "name")


def _messages_kept(spark, d) -> DataFrame:
    key = F.concat_ws("-", "conv_id", "turn")
    return _messages(spark, d).select(key.alias("id"), F.col("conv_id").cast("string").alias("agent_id"), "role", "text", F.lit("2024-01-01 00:00:00").cast(_NTZ).alias("updated_at"))


@_register("""
with k as (select conv_id || '-' || turn as id, conv_id, turn, role, text from conversations)
select id, case when turn = 1 then 'assistant-2' else role end as role, case when turn = 1 and conv_id % 2 = 0 then null else text end as text,
  case when turn = 1 then timestamp '2024-06-01 12:00:00' else timestamp '2024-01-01 00:00:00' end as updated_at from k""")
def message_patch(spark, d):
    """Second turns get another role; of even conversations the text is cleared (2.14 #7)."""
    kept = _messages_kept(spark, d)
    changes = _messages(spark, d).where("turn = 1").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("assistant-2").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("set_role"), (F.col("conv_id") % 2 == 0).alias("set_text")
    )
    return entities.patch("message", kept, changes, _now()).select("id", "role", "text", "updated_at")


@_register("select conv_id || '-' || turn as id, text from conversations where role = 'user'")
def user_messages(spark, d):
    return listing.match(_messages_kept(spark, d), role="user").select("id", "text")


@_register(_SQL_RECORDS + """, old as (select id, name || ' ' || id as name from ours where id % 4 <> 0), new as (select id, name || ' ' || id as name from theirs)
select coalesce(t.name, o.name) as name, t.id is not null as offered from old o full join new t on o.name = t.name""")
def tool_upsert(spark, d):
    """Tools by name: known ones change, others are added (2.14 #10, 2.11 #12)."""
    ours, theirs = _records(spark, d)
    shape = ("id", "name", "offered", "organization_id")
    named = F.concat_ws(" ", "name", "id").alias("name")
    old = ours.where("id % 4 <> 0").select(F.col("id").cast("string").alias("id"), named, F.lit(False).alias("offered"), F.lit("org-1").alias("organization_id"))
    new = theirs.select(named, F.lit(True).alias("offered"))
    return entities.upsert("tool", old.select(*shape), new, ACTOR, ["name"], _now()).select("name", "offered")


@_register(_SQL_RECORDS + " select name from theirs where name not in (select name from ours)")
def user_get_or_create(spark, d):
    """Users that aren't there yet (2.14 #14)."""
    ours, theirs = _records(spark, d)
    users = ours.select(F.col("id").cast("string").alias("id"), "name", F.lit("org-1").alias("organization_id"))
    return entities.get_or_create("user", users, theirs.select("name"), ACTOR, ["name"]).select("name")


@_register(_SQL_SEMANTIC + " select id, is_deleted or id in ('s1', 's4') as is_deleted from sem")
def provider_soft_delete(spark, d):
    gone = spark.createDataFrame([("s1",), ("s4",)], "id string")
    return entities.delete("provider", _semantic(spark, d), gone).select("id", "is_deleted")


@_register(_SQL_SEMANTIC + """, c as (select id, case when user_id = 'user-1' then summary else 'new' end summary from sem where organization_id = 'org-1' and not is_deleted)
select s.id, coalesce(c.summary, s.summary) as summary, case when c.summary <> s.summary then timestamp '2024-06-01 12:00:00' else s.updated_at end as updated_at from sem s left join c using (id)""")
def sandbox_patch_if_different(spark, d):
    """Only records whose values differ are touched (2.14 #16)."""
    records = _semantic(spark, d)
    live = records.where("organization_id = 'org-1' and not is_deleted")
    changes = live.select("id", F.when(F.col("user_id") == "user-1", F.col("summary")).otherwise("new").alias("summary"), F.lit(True).alias("set_summary"))
    return entities.patch("sandbox", records, changes, _now(), only_different=True).select("id", "summary", "updated_at")


@_register(_SQL_RECORDS + " select id, 'register' as action from theirs where id not in (select id from ours) union all select id, 'unregister' from ours where id not in (select id from theirs)")
def registry_sync(spark, d):
    new, old = entities.registry_sync(*_records(spark, d), "id")
    return new.select("id", F.lit("register").alias("action")).unionByName(old.select("id", F.lit("unregister").alias("action")))


@_register("""
with m as (select o_custkey k, string_agg(distinct o_orderpriority, '|' order by o_orderpriority) held from orders group by 1)
select c_custkey::varchar as id, concat_ws('|', 'base', held) as held from customer left join m on k = c_custkey""")
def agent_attach_tools(spark, d):
    """Order priorities attached to the lists of customers (2.14 #9)."""
    agents = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array(F.lit("base")).alias("held"))
    changes = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderpriority").alias("member"))
    return entities.change_lists(agents, changes, "id", "held").select("id", F.array_join("held", "|").alias("held"))


@_register("""
with m as (select o_custkey k, list(distinct o_orderpriority) held from orders group by 1)
select c_custkey::varchar as id, concat_ws('|', case when list_contains(held, '1-URGENT') then null else '1-URGENT' end, 'base', case when list_contains(held, '5-LOW') then null else '5-LOW' end) as held
from customer left join m on k = c_custkey""")
def agent_detach_tools(spark, d):
    held = F.array(F.lit("1-URGENT"), F.lit("base"), F.lit("5-LOW"))
    agents = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), held.alias("held"))
    changes = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderpriority").alias("member"))
    return entities.change_lists(agents, changes, "id", "held", attach=False).select("id", F.array_join("held", "|").alias("held"))


def _cloud(spark, d) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("c"), key.cast("string")).alias("cloud_file_id"), F.concat(F.lit("l"), key.cast("string")).alias("local_file_id"),
        F.when(key % 3 == 0, "processed").otherwise("uploaded").alias("status"), F.lpad(((key * 7) % 100).cast("string"), 3, "0").alias("timestamp"),
    )


_SQL_CLOUD = "with cloud as (select 'c' || s_suppkey cloud_file_id, 'l' || s_suppkey local_file_id, case when s_suppkey % 3 = 0 then 'processed' else 'uploaded' end status, lpad(((s_suppkey * 7) % 100)::varchar, 3, '0') as timestamp from supplier) "


@_register(_SQL_CLOUD + "select cloud_file_id, case when cloud_file_id in ('c1', 'c2') then 'processed' else status end as status from cloud")
def cloud_set_processed(spark, d):
    return entities.set_processed(_cloud(spark, d), spark.createDataFrame([("c1",), ("c2",)], "cloud_file_id string")).select("cloud_file_id", "status")


@_register(_SQL_CLOUD + "select cloud_file_id, timestamp from cloud where status = 'uploaded' order by timestamp, cloud_file_id")
def cloud_by_status(spark, d):
    return entities.by_status(_cloud(spark, d), "uploaded").select("cloud_file_id", "timestamp")


@_register(_SQL_CLOUD + "select v.c as cloud_file_id, local_file_id from (values ('c1'), ('c3'), ('nowhere')) v(c) left join cloud on cloud_file_id = v.c")
def cloud_lookup(spark, d):
    wanted = spark.createDataFrame([("c1",), ("c3",), ("nowhere",), ("c3",)], "cloud_file_id string")
    return entities.lookup(_cloud(spark, d), wanted, "cloud_file_id", "local_file_id")


@_register(_SQL_CLOUD + """, new as (select 'c' || s_suppkey c, 'l' || (s_suppkey + 1) l from supplier where s_suppkey % 2 = 0)
select cloud_file_id, local_file_id from cloud where cloud_file_id not in (select c from new) and local_file_id not in (select l from new) union all select c, l from new""")
def mapping_forced(spark, d):
    """Pairs that replace what either side had (2.11 #13)."""
    key = F.col("s_suppkey")
    new = table(spark, d, "supplier").where(key % 2 == 0).select(F.concat(F.lit("c"), key.cast("string")).alias("cloud_file_id"), F.concat(F.lit("l"), (key + 1).cast("string")).alias("local_file_id"))
    return maintenance.add_mapping(_cloud(spark, d).select("cloud_file_id", "local_file_id"), new, "cloud_file_id", "local_file_id", force=True)


@_register("select conv_id::varchar as agent_id, 'org-1' as organization_id, (length(text) // 4)::bigint as tokens from conversations where text is not null")
def step_append(spark, d):
    """Token usage rows (2.14 #13)."""
    steps = spark.createDataFrame([], "id string, agent_id string, organization_id string, tokens long, turn long")
    rows = _messages(spark, d).where("text is not null").select(F.col("conv_id").cast("string").alias("agent_id"), F.floor(F.length("text") / 4).alias("tokens"), F.col("turn").cast("long").alias("turn"))
    return entities.create("step", steps, rows, ACTOR, seed=["agent_id", "turn"]).select("agent_id", "organization_id", "tokens")


@_register("select distinct source from documents where trim(source) <> '' order by source")
def distinct_categories(spark, d):
    return entities.categories(table(spark, d, "documents"), "source")


@_register("select conv_id, turn from conversations where trim(coalesce(text, ''), ' ') <> '' and role is distinct from 'system'")
def told_blocks(spark, d):
    blocks = _messages(spark, d).withColumn("label", F.when(F.col("role") == "system", "persona").otherwise(F.col("role")))
    return entities.told_blocks(blocks, "label", "text").select("conv_id", "turn")


# Filters, lookups, joins ---------------------------------------------------------------------


@_register("select doc_id, n_chars from documents left join labels using (doc_id) where lang = 'en' and coalesce(toxic, 0) = 0")
def scoped_live(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("is_deleted", F.col("toxic") == 1)
    return listing.scope(docs, "lang", "en", "is_deleted").select("doc_id", "n_chars")


@_register("select event_id, event_type, user_id from events where event_id = 42")
def point_lookup(spark, d):
    return listing.one(table(spark, d, "events"), event_id=42).select("event_id", "event_type", "user_id")


@_register("select 42::bigint as event_id, exists (select 1 from events where event_id = 42) as there union all select -1, exists (select 1 from events where event_id = -1)")
def exists_by_key(spark, d):
    events = table(spark, d, "events")
    return spark.createDataFrame([(k, listing.exists(events, event_id=k)) for k in (42, -1)], "event_id long, there boolean")


@_register("select p_partkey, p_name from part where contains(lower(regexp_replace(to_json(string_split(p_name, ' '))::varchar, '[\"\\[\\],]', ' ', 'g')), 'part')")
def steps_contain(spark, d):
    """A list searched by its text (2.2 #9)."""
    steps = X.steps_text(F.split("p_name", " "))
    return table(spark, d, "part").where(F.contains(steps, F.lit("part"))).select("p_partkey", "p_name")


@_register("select user_id, event_id, event_type, ts from events order by event_type is distinct from 'purchase', ts, event_id limit 1")
def active_or_first(spark, d):
    """The first purchase, else the first event."""
    users = table(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "purchase", "active").otherwise("idle"))
    return listing.active_or_first(users, created="ts", key="event_id").select("user_id", "event_id", "event_type", "ts")


@_register(_SQL_BRIDGE + "select c_custkey, c_name from customer where c_nationkey = 7 and c_custkey in (select c_custkey from bridge where tag = '1-URGENT')")
def tags_keep_scope(spark, d):
    owners = listing.scope(table(spark, d, "customer"), "c_nationkey", 7)
    return listing.with_any_tag(owners, _bridge(spark, d), "c_custkey", ["1-URGENT"]).select("c_custkey", "c_name")


@_register("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def related_records(spark, d):
    wanted = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return listing.related(wanted, table(spark, d, "customer"), "c_custkey").select("c_custkey", "c_name")


@_register("select v.i as doc_id from (values (3::bigint), (-5), (17), (-6)) v(i) where v.i not in (select doc_id from documents)")
def missing_ids(spark, d):
    asked = spark.createDataFrame([(3,), (-5,), (17,), (-6,), (-5,)], "doc_id long")
    return listing.missing(asked, table(spark, d, "documents"), "doc_id")


@_register("""
with act as (select distinct user_id, event_type, ts::date dt from events)
select e.event_id, 'p-' || e.event_type as project, 'did ' || e.event_type as activity_summary, case when e.user_id % 2 = 0 then 'day of ' || e.user_id end as day_summary from events e""")
def drill_down(spark, d):
    """Days and activities of users, projects by type, events as frames (2.3 #9)."""
    events = table(spark, d, "events")
    activity = F.concat_ws("/", "user_id", "event_type", F.to_date("ts").cast("string"))
    frames = events.select("event_id", activity.alias("activity_id"), F.col("user_id").alias("deployment_id"))
    activities = events.groupBy("user_id", "event_type", F.to_date("ts").alias("at")).agg(F.min("ts").alias("start_at")).select(
        F.concat_ws("/", "user_id", "event_type", F.col("at").cast("string")).alias("id"), F.col("user_id").alias("deployment_id"), F.col("event_type").alias("project_id"),
        F.concat(F.lit("did "), "event_type").alias("summary"), "start_at",
    )
    projects = events.select(F.col("event_type").alias("id"), F.concat(F.lit("p-"), "event_type").alias("name")).distinct()
    days = events.where("user_id % 2 = 0").select(F.col("user_id").alias("deployment_id"), F.to_date("ts").alias("date")).distinct()
    days = days.withColumn("summary", F.concat(F.lit("day of "), F.col("deployment_id").cast("string")))
    return listing.drill_down(days, activities, frames, projects).select("event_id", "project", "activity_summary", "day_summary")


# Aggregates ------------------------------------------------------------------------------


@_register("select user_id, sum(length(props) + coalesce(k, 0) + 3)::bigint as tokens from (select *, cast(json_extract_string(props, '$.k') as bigint) k from events) group by user_id")
def token_totals(spark, d):
    parts = table(spark, d, "events").select("user_id", F.length("props").cast("long").alias("system"), F.get_json_object("props", "$.k").cast("long").alias("summary"), F.lit(3).cast("long").alias("tools"))
    return counting.token_totals(parts, "user_id", "system", "summary", "tools")


@_register("select sum(case when held is null then 0 else len(held) end)::bigint as members from (select conv_id, case when conv_id % 3 <> 0 then list(turn) end held from conversations group by conv_id)")
def array_totals(spark, d):
    agents = _messages(spark, d).groupBy("conv_id").agg(F.collect_list("turn").alias("turns")).select(F.when(F.col("conv_id") % 3 != 0, F.col("turns")).alias("held"))
    return agents.agg(counting.array_total(F.col("held")).alias("members"))


@_register("""
select user_id, array_to_string(list(event_type order by event_id) filter (where event_type <> 'view'), ' ') as text, round(avg(value) filter (where value > 20), 6) as confidence from events group by user_id""")
def ocr_summary(spark, d):
    """Blank tokens dropped, the mean of confidences above zero (2.4 #5)."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value")))
    held = table(spark, d, "events").groupBy("user_id").agg(rows.alias("r"))
    tokens = F.transform("r", lambda x: F.when(x["event_type"] == "view", F.lit("  ")).otherwise(x["event_type"]))
    confidences = F.transform("r", lambda x: F.when(x["value"] > 20, x["value"]).otherwise(F.lit(-1.0)))
    out = held.select("user_id", counting.ocr_summary(tokens, confidences).alias("s"))
    return out.select("user_id", "s.text", F.round("s.confidence", 6).alias("confidence"))


@_register("""
select user_id, case when user_id % 2 = 0 then event_type else 'Screenshots' end as source, string_agg(event_id, ',' order by event_id) as images from events group by all""")
def images_by_source(spark, d):
    """Images of a user's events by source; where the lists differ in length there is one group (2.4 #9)."""
    events = table(spark, d, "events")
    source = F.when(F.col("user_id") % 2 == 0, F.array("event_type")).otherwise(F.array())
    items = events.select("user_id", "event_id", F.array(F.col("event_id").cast("string")).alias("images"), source.alias("sources"))
    out = counting.images_by_source(items, "user_id", "event_id", "images", "sources")
    return out.select("user_id", "source", F.array_join("images", ",").alias("images"))


@_register("select p_partkey, case when p_partkey % 3 = 0 then p_brand else p_name || e'\\n' || p_brand end as value from part")
def block_append(spark, d):
    old = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name"))
    blocks = table(spark, d, "part").select("p_partkey", counting.appended(old, F.col("p_brand")).alias("value"), F.lit(2000).alias("limit"))
    return counting.within_limit(blocks, "value", "limit").select("p_partkey", "value")


@_register("select conv_id, turn, row_number() over (partition by conv_id order by turn desc) - 1 as idx from conversations")
def numbered_rows(spark, d):
    return context.numbered(_messages(spark, d), ["conv_id"], F.desc("turn")).select("conv_id", "turn", F.col("idx").cast("long").alias("idx"))


# Queues ----------------------------------------------------------------------------------


@_register("select event_id from events where event_type = 'view' order by ts, event_id limit 10")
def oldest_pending(spark, d):
    frames = table(spark, d, "events").withColumn("ocr_status", F.when(F.col("event_type") == "view", 0).otherwise(2))
    return status.pending(frames, "ocr_status", 0, "ts", "event_id").select("event_id")


@_register("""
with p as (select event_id from events where event_type = 'view' order by ts, event_id limit 25)
select event_id, case when event_id in (select event_id from p) then 1 when event_type = 'view' then 0 else 2 end as ocr_status from events""")
def claim_oldest(spark, d):
    """Pending to claimed, the oldest first; the others stay (2.9 #2)."""
    frames = table(spark, d, "events").withColumn("ocr_status", F.when(F.col("event_type") == "view", 0).otherwise(2))
    return status.claim(frames, "ocr_status", "ts", "event_id", 25).select("event_id", "ocr_status")


@_register("select event_id, case when event_type = 'error' then 1 when event_type = 'view' then 2 else 1 end as status, case when event_type not in ('view', 'error') then upper(event_type) end as result from events")
def single_stage(spark, d):
    """The processor of one stage: views fail, errors are done already (2.9 #4)."""
    frames = table(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "error", 1).otherwise(0))
    work = F.when(F.col("event_type") != "view", F.upper("event_type"))
    return status.process(frames, "status", work).select("event_id", "status", "result")


@_register("select event_id, event_type <> 'view' as ready from events")
def ready_any(spark, d):
    ready, waiting = context.ready_any(table(spark, d, "events"), F.col("event_type") == "view")
    return ready.select("event_id", F.lit(True).alias("ready")).unionByName(waiting.select("event_id", F.lit(False).alias("ready")))


@_register("select event_id, case when event_type = 'view' and ts <= timestamp '2024-01-05 00:00:00' - interval 10 seconds then 'failed' when event_type = 'view' then 'pending' else 'completed' end as status from events")
def upload_timeout(spark, d):
    state = F.when(F.col("event_type") == "view", "pending").otherwise("completed")
    out = absorb.upload_state(state, F.col("ts"), F.lit("2024-01-05 00:00:00").cast(_NTZ))
    return table(spark, d, "events").select("event_id", out.alias("status"))


@_register("select event_id, case when event_id % 4 = 1 then 'a' when event_id % 4 = 2 then '' when event_id % 4 = 3 then 'a,b' else 'b' end as kept from events")
def usable_images(spark, d):
    """Images that failed or are unknown are dropped from an item (2.9 #7)."""
    k = F.col("event_id") % 4
    one = F.struct(F.lit("a").alias("name"), F.when(k % 2 == 1, "completed").otherwise("failed").alias("status"))
    two = F.struct(F.lit("b").alias("name"), F.when((k == 3) | (k == 0), "completed").alias("status"))
    kept = F.transform(absorb.usable_images(F.array(one, two)), lambda x: x["name"])
    return table(spark, d, "events").select("event_id", F.array_join(kept, ",").alias("kept"))


@_register("select event_id, row_number() over (partition by event_type order by event_id) as turn from events")
def turn_order(spark, d):
    return absorb.turn_order(table(spark, d, "events"), "event_type", "event_id").select("event_id", F.col("turn").cast("long").alias("turn"))


@_register("""
with g as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) gap from events),
n as (select *, sum(case when gap is null or gap >= 300000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) s from g)
select user_id, min(ts) as start, count(*) as n from n group by user_id, s""")
def session_stream(spark, d):
    """Sessions of a stream, all of them once the stream has ended (2.9 #12)."""
    out = _streamed(spark, d, lambda events: absorb.session_counts(events, "ts", "user_id", late="10000 days"), "session", "complete")
    return out.select("user_id", F.col("start").cast(_NTZ).alias("start"), "n")


@_register("select user_id, time_bucket(interval 15 minutes, ts) as start, count(*) as n from events group by all")
def window_stream(spark, d):
    """Tumbling windows of a stream (2.9 #12, #13)."""
    out = _streamed(spark, d, lambda events: absorb.window_counts(events, "ts", "user_id", late="10000 days"), "window", "complete")
    return out.select("user_id", F.col("start").cast(_NTZ).alias("start"), "n")


@_register("select user_id as frame_id, least(count(*), 4)::int as status from events group by user_id")
def status_machine_stream(spark, d):
    """Users as frames: their first four events claim, read, claim and describe them; what comes later changes nothing (2.9 #2)."""

    def machine(events):
        return status.machine_stream(events.select(F.col("user_id").alias("frame_id"), "event_id", "what"), "frame_id", "what", "event_id")

    place = F.row_number().over(_by_user())
    what = F.when(place == 1, "claim").when(place == 2, "text").when(place == 3, "claim").when(place == 4, "summary").otherwise("fail")
    given = table(spark, d, "events").withColumn("what", what)
    return _streamed(spark, d, machine, "machine", "update", given)


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("event_id")


def _new_folder(spark, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def _streamed(spark, d, build, name: str, mode: str, given: DataFrame | None = None) -> DataFrame:
    """What a stream over the events, read from files, has put out when it has read them all."""
    folder = _new_folder(spark, name)
    (with_instants(table(spark, d, "events")) if given is None else given).write.parquet(f"{folder}/in")
    batch = spark.read.parquet(f"{folder}/in")
    stream = build(spark.readStream.schema(batch.schema).parquet(f"{folder}/in"))

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


# Maintenance -----------------------------------------------------------------------------


@_register(_SQL_RECORDS + " select coalesce(o.id, t.id) as id, case when t.id is not null then t.name else o.name end as name from ours o full join theirs t on o.id = t.id")
def right_wins(spark, d):
    return maintenance.right_wins(*_records(spark, d), "id", "name")


@_register("""
select doc_id, case when doc_id % 2 = 0 then 'new summary' else source end as summary, case when doc_id % 3 = 0 then lang || e'\\nmore' else lang end as details,
  'create' || case when doc_id % 2 = 0 then ', updated_summary' else '' end || case when doc_id % 3 = 0 then ', updated_details' else '' end as operation from documents where lang is not null""")
def merge_event(spark, d):
    columns = maintenance.merge_event(
        F.col("source"), F.col("lang"), F.lit("create"), F.when(F.col("doc_id") % 2 == 0, "new summary"), F.when(F.col("doc_id") % 3 == 0, "more")
    )
    return table(spark, d, "documents").where("lang is not null").select("doc_id", *columns)


@_register(_SQL_RECORDS + " select id, name from ours where id % 10 <> 0 union all select id, name from theirs where id not in (select id from ours)")
def replace_items(spark, d):
    ours, theirs = _records(spark, d)
    return maintenance.replace(ours, ours.where("id % 10 = 0"), maintenance.insert_new(ours, theirs, ["id"]), "id")


@_register("""
with l as (select conv_id, turn, role, row_number() over (partition by conv_id, role = 'user' and turn > 0 order by turn) - 1 p, role = 'user' and turn > 0 own from conversations)
select conv_id as agent_id, string_agg(turn, ',' order by turn) as kept from l where not own or p >= 1 group by conv_id""")
def context_trim(spark, d):
    """The first message, others', and the user's own from the second on (2.11 #14)."""
    said = _messages(spark, d)
    first = F.col("turn") == 0
    messages = said.select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.when(first, "system").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "user", "user-1").otherwise("user-2").alias("user_id")
    )
    agents = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    agents = agents.select(F.col("conv_id").alias("agent_id"), F.transform("turns", lambda t: F.concat_ws("-", "conv_id", t)).alias("message_ids"))
    kept = context.trim(agents, messages, "user-1", 2)
    return kept.select("agent_id", F.array_join(F.transform("message_ids", lambda m: F.element_at(F.split(m, "-"), 2)), ",").alias("kept"))


@_register(_SQL_RECORDS + " select o.o_orderkey, coalesce(t.name, 'part') as label from orders o left join theirs t on t.id = o.o_custkey")
def rename_cascade(spark, d):
    _, theirs = _records(spark, d)
    bridge = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.lit("part").alias("label"))
    return maintenance.rename_cascade(bridge, theirs.withColumnRenamed("name", "label"), "id", "label").select("o_orderkey", "label")


@_register("select doc_id, concat_ws(' ', lang, source, n_chars::varchar) as content from documents")
def store_content(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("name"), F.col("source").alias("summary"), F.col("n_chars").cast("string").alias("details"))
    return docs.select("doc_id", similarity.content(docs, "semantic").alias("content"))


# Searches over stores --------------------------------------------------------------------


def _stores(spark, d) -> dict[str, DataFrame]:
    docs, said = table(spark, d, "documents"), _messages(spark, d)
    blank = F.lit(None).cast("array<float>").alias("summary_embedding")
    grade = F.when(F.col("doc_id") % 3 == 0, "high").otherwise("low").alias("sensitivity")
    key = F.col("doc_id").cast("string").alias("id")
    change = F.struct(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("timestamp"), F.lit("created").alias("operation")).alias("last_modify")
    return {
        "vault": docs.where("lang = 'de'").select(key, F.col("text").alias("caption"), F.col("n_chars").alias("created_at"), grade, change),
        "semantic": docs.where("lang = 'fr'").select(key, F.col("text").alias("summary"), F.col("n_chars").alias("created_at"), blank, change),
        "episodic": said.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("summary"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"), (F.col("conv_id") * 1000 + F.col("turn")).alias("occurred_at"), blank),
    }


_SQL_STORES = """
with epi as (select conv_id || '-' || turn id, text, conv_id * 1000 + turn created_at from conversations),
kv as (select doc_id::varchar id, text, n_chars created_at, case when doc_id % 3 = 0 then 'high' else 'low' end sensitivity from documents where lang = 'de'),
sem as (select doc_id::varchar id, text, n_chars created_at from documents where lang = 'fr')"""


def _sql_part(name: str, place: int, source: str, where: str, order: str) -> str:
    return f"select '{name}' as store, {place} as place, row_number() over (order by {order})::int as rank, id from (select * from {source} where {where}) qualify rank <= 10"


_FOUND = "contains(lower(text), 'en')"


@_register(_SQL_STORES + f"""
{_sql_part('episodic', 0, 'epi', _FOUND, 'created_at desc, id desc')} union all {_sql_part('vault', 1, 'kv', _FOUND, 'created_at desc, id desc')}
union all {_sql_part('semantic', 2, 'sem', _FOUND, 'created_at desc, id desc')}""")
def multi_store_search(spark, d):
    """Each store's newest that contain the query, stores in a fixed order (2.5 #10)."""
    return search.search_all(_stores(spark, d), "EN", "string_match").select("store", "place", "rank", "id")


@_register(_SQL_STORES + f"""
{_sql_part('episodic', 0, 'epi', 'true', 'created_at desc, id')} union all {_sql_part('vault', 1, 'kv', 'true', 'lpad(id, 9, chr(48)) desc, id')}
union all {_sql_part('semantic', 2, 'sem', 'true', 'lpad(id, 9, chr(48)) desc, id')}""")
def empty_query_search(spark, d):
    """An empty query gives each store's latest (2.5 #7)."""
    return search.search_all(_stores(spark, d), "").select("store", "place", "rank", "id")


@_register(_SQL_STORES + f"""
, hits as ({_sql_part('episodic', 0, 'epi', _FOUND, 'created_at desc, id desc')} union all {_sql_part('vault', 1, 'kv', _FOUND + " and sensitivity = 'low'", 'created_at desc, id desc')}
  union all {_sql_part('semantic', 2, 'sem', _FOUND, 'created_at desc, id desc')}),
late as (select 'episodic' as store, 0 as place, null::int as rank, id from epi order by created_at desc, id limit 10),
totals as (select 'episodic' as store, count(*) total from epi union all select 'vault', count(*) from kv where sensitivity = 'low' union all select 'semantic', count(*) from sem)
select store, rank, id, part, total from (select *, 'relevant' part from hits union all select *, 'recent' from late) join totals using (store)""")
def retrieval_bundle(spark, d):
    """What a prompt is given: relevant and latest records with their totals, high secrets left out (2.5 #12)."""
    return search.retrieval_bundle(_stores(spark, d), "EN", method="string_match").select("store", "rank", "id", "part", "total")


@_register("select event_id, ts from events where ts between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-05 00:00:00' order by ts, event_id limit 51")
def around_time(spark, d):
    """A range, one row more than its limit if there are too many (2.5 #14)."""
    return search.around_time(table(spark, d, "events"), "ts", "event_id", F.lit("2024-01-02").cast(_NTZ), F.lit("2024-01-05").cast(_NTZ)).select("event_id", "ts")


# Sinks -----------------------------------------------------------------------------------


@_register("select c_custkey, c_name from customer")
def backup_round_trip(spark, d):
    """A backup read again (2.1 #16)."""
    folder = _new_folder(spark, "backup")
    files.backup({"customer": table(spark, d, "customer"), "nation": table(spark, d, "nation")}, folder)
    return files.restore(spark, folder, ["customer", "nation"])["customer"].select("c_custkey", "c_name")


@_register("select n_nationkey::varchar as n_nationkey, n_name from nation")
def export_sheets(spark, d):
    """A sheet of an export, read again: all of it is text (2.1 #12)."""
    folder = _new_folder(spark, "sheets")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("created_at"))
    files.export_sheets({"nation": nations, "region": table(spark, d, "region").withColumn("created_at", F.lit(1))}, folder)
    return spark.read.option("header", True).csv(f"{folder}/nation").select("n_nationkey", "n_name")


@_register("select event_id, event_type from events")
def append_once(spark, d):
    """A batch that is delivered twice, with repeated keys, is there once (2.1 #15, 2.9)."""
    path = f"{_new_folder(spark, 'once')}/events"
    events = table(spark, d, "events").select("event_id", "event_type")
    write = status.idempotent_append(path, "event_id")
    write(events.unionByName(events), 0)
    write(events, 0)
    return spark.read.schema(events.schema).parquet(path)


@_register("select 'types' as sink, event_type as value, count(*) as n from events group by event_type union all select 'users', user_id::varchar, count(*) from events group by user_id")
def fan_out_sinks(spark, d):
    """One batch given to two sinks (2.9 #11)."""
    folder = _new_folder(spark, "fan")

    def sink(name: str, column: str):
        def write(batch: DataFrame) -> None:
            counted = batch.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            counted.select(F.lit(name).alias("sink"), "value", "n").write.parquet(f"{folder}/{name}")

        return write

    status.fan_out({"types": sink("types", "event_type"), "users": sink("users", "user_id")})(table(spark, d, "events"), 0)
    return spark.read.parquet(f"{folder}/types", f"{folder}/users")


@_register(_sql["frame_keep_rule"])
def frame_keep_stream(spark, d):
    """The keep rule over a stream (2.9 #1)."""
    out = _streamed(spark, d, lambda s: frames.keep_stream(s, "user_id", "ts", "event_id", "difference", force_s=3600.0), "keep", "append", _frames(spark, d))
    return out.select("user_id", "event_id", "kept")


@_register("select user_id, 1::bigint as batch, event_id from events where user_id in (select user_id from events group by user_id having count(*) >= 20)")
def absorb_stream(spark, d):
    """All that waits leaves as a batch once there are twenty (2.9 #6)."""
    return _streamed(spark, d, lambda s: absorb.absorb_stream(s, "user_id", "event_id", "event_id"), "absorb", "append")
