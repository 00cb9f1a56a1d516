"""Registered queries of streams whose state expires, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table, with_instants
from ..streaming import stateful
from .catalog import _register
from .records import _new_folder

_NTZ = "timestamp_ntz"


def _triggers(spark, batches: list[DataFrame], name: str, build) -> DataFrame:
    """What a stream has put out after a trigger for each of ``batches``, read from files, and a last one without rows."""
    folder = _new_folder(spark, name)
    for batch in batches:  # a file each, in order of their times
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = build(spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    with stateful.rocksdb(spark):
        query = stream.writeStream.outputMode("append").foreachBatch(lambda rows, _: rows.write.mode("append").parquet(f"{folder}/out"))
        query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@_register("""
with t as (select min(epoch_us(ts)) lo, max(epoch_us(ts)) hi from events),
e as (select user_id, ts, case when event_id % 20 = 0 then 3 else least(3, (4 * (epoch_us(ts) - lo)) // (hi - lo + 1)) end b from events, t),
w as (select b, (select max(x.ts) from e x where x.b < y.b) - interval 1 hour passed from (select distinct b from e) y),
r as (select user_id, time_bucket(interval 1 day, ts) as start, coalesce(time_bucket(interval 1 day, ts) + interval 1 day <= passed, false) late from e join w using (b))
select user_id, start, late, count(*) as n from r, (select max(ts) - interval 1 hour last from e) where late or start + interval 1 day <= last group by all""")
def late_windows(spark, d):
    """Days of a stream in four triggers, of which every twentieth event comes with the last: closed days, and beside them what was too late (2.9 #13)."""
    events = with_instants(table(spark, d, "events"))
    lo, hi = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    quarter = F.least(F.lit(3), F.expr(f"(4 * (unix_micros(ts) - {lo})) div ({hi} - {lo} + 1)"))
    given = events.select("user_id", "ts", F.when(F.col("event_id") % 20 == 0, 3).otherwise(quarter).alias("trigger"))
    batches = [given.where(F.col("trigger") == k).select("user_id", "ts") for k in range(4)]
    out = _triggers(spark, batches, "late", lambda s: stateful.windows_and_late(s, "ts", "user_id", 86_400, "1 hour"))
    # a window may be late in several triggers
    return out.groupBy("user_id", F.col("start").cast(_NTZ).alias("start"), "late").agg(F.sum("n").alias("n"))


@_register("""
with j as (select user_id, min(ts) ts, user_id % 5 + 1 need from events group by user_id),
d as (select user_id, least(need, 4)::int attempts, need <= 4 fine, epoch_ms(ts) + 3600000 * ((1 << (least(need, 4) - 1)::int) - 1) due from j)
select user_id, case when fine then 'done' else 'failed' end as status, attempts from d where due <= (select epoch_ms(max(ts)) from j)""")
def retry_states(spark, d):
    """A job for each user, at the first event: some fail up to five times, and four attempts are made, an hour and its doubles apart (2.9 #14)."""

    def work(payload: str, attempt: int) -> str:
        if attempt < int(payload):
            raise ValueError("not yet")
        return payload

    jobs = with_instants(table(spark, d, "events")).groupBy("user_id").agg(F.min("ts").alias("ts")).withColumn("need", (F.col("user_id") % 5 + 1).cast("string"))
    out = _triggers(spark, [jobs.where("user_id % 2 = 0"), jobs.where("user_id % 2 = 1")], "retry", lambda s: stateful.retry_stream(s, "user_id", "ts", "need", work, tries=4, base_s=3600.0, late="0 seconds"))
    return out.select("user_id", "status", "attempts")
