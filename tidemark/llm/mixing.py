"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is turned into a whole number of equal-token blocks by
highest quotients, shard by shard: the seats of a party list go to the highest
of votes / (2 k + 1), here a shard's size over its odd divisors.  Within a
shard a seeded order of the documents decides which of them fill the blocks.

Everything is DataFrame functions.  A source is dealt into shards of bounded
size by hash, so that no window ever holds a whole source; one row for each
source is all that meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..skew import HOT_KEYS, attach, hot_keys
from .store import store

#: Words of a block, documents of a shard (about), most repeats, weights in source order.
BLOCK, SHARD_DOCS, REPEATS, WEIGHTS = 32, 4096, 3, (1, 2, 3)
SEED = "mix"


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, docs, target from rows (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share the
    sum of all sizes; a target stops at ``repeats`` times its source's size and
    the excess goes to the others by weight.  That is one level: a source with
    cap c and weight w is full once level >= c / w, so in order of c / w the
    first source that stays below its cap fixes the level.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    # One row a source: these windows are over the table of sources, not of documents.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(here))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("fixed", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(all_rows))
    )
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("fixed.level", F.lit(0.0)))
    return levels.select("source", "source_size", "docs", target.alias("target"))


def _key(source: Column) -> Column:
    """A source's name, null's too, as a key that is never null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def apportion(shards: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, shard, shard_size, quota), the blocks of each shard, from rows (source, shard, shard_size, source_size, target).

    Sainte-Lague: the seats, target / block of a source, go to the highest
    quotients shard_size / (2 k + 1).  With n shards and the divisor
    D = source_size / (seats - n / 2), the quotients above D / 2 are no more
    than the seats, so all of them win; at most n seats are left, and a shard
    can win at most share * n + 1 of them.  Only that many further quotients a
    shard are ranked, however many blocks there are.

    A source may have most of the shards, so they are never brought together:
    its counts come by broadcast, and bids are dealt by ranges of their
    quotients, placed within a range and counted on from the ranges before.
    """
    keyed = store(shards.withColumn("key", _key(F.col("source"))), "shards")
    hot = hot_keys(keyed, "key", keyed.count())
    share = F.coalesce(F.try_divide(F.col("shard_size"), F.col("source_size")), F.lit(0.0))
    given = (
        attach(keyed, keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", hot)
        .withColumn("seats", F.coalesce(F.floor(F.col("target") / block + 0.5), F.lit(0)))
        .withColumn("share", share)
        .withColumn("sure", F.floor(F.greatest(F.col("seats") - F.col("n") / 2, F.lit(0.0)) * F.col("share") + 0.5))
        .withColumn("sure", F.when(F.col("shard_size") > 0, F.col("sure")).otherwise(0))
    )
    given = store(given, "seats")
    given = attach(given, given.groupBy("key").agg((F.first("seats") - F.sum("sure")).alias("left")), "key", hot)
    further = F.sequence(F.col("sure"), F.col("sure") + F.floor(F.col("share") * F.col("n")) + 1)
    bids = given.where("shard_size > 0").select("key", "source", "shard", "shard_size", "sure", "left", F.explode(further).alias("k"))
    bids = bids.withColumn("quotient", F.col("shard_size") / (2 * F.col("k") + 1))
    turn = [F.col("quotient").desc(), F.col("shard"), F.col("k")]
    dealt = store(bids.repartitionByRange("key", *turn).withColumn("range", F.spark_partition_id()), "bids")
    ahead = F.sum("held").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = dealt.groupBy("key", "range").agg(F.count(F.lit(1)).alias("held")).select("key", "range", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("key", "range").orderBy(*turn)) + F.col("ahead")
    won = dealt.join(ranges, ["key", "range"]).withColumn("place", place)
    return won.groupBy("source", "shard").agg(
        F.first("shard_size").alias("shard_size"),
        (F.first("sure") + F.sum(F.when(F.col("place") <= F.col("left"), 1).otherwise(0))).alias("quota"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block: int = BLOCK, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, size, source_size, target, taken and the columns ``keep`` for every row.

    A shard takes quota * block words, no more than three times its size: whole
    rounds of all its documents first, then documents in the order of a seeded
    hash, the last one in part.  No document exceeds three times its size.
    Rows with a null text have size 0 and are taken 0 times; a null source is a
    source of its own, the last; repeated rows count each, and tied hashes go
    by id and size, so that reruns agree whatever the partitions.
    """
    others = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), *others)
    sized = store(sized, "sizes")  # three plans read it; texts are read once
    out = mix_sized(sized, block=block, seed=seed)
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken", *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))


def mix_sized(sized: DataFrame, *, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """``mix`` for rows (doc_id, source, size), further columns kept."""
    extra = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    targets = source_targets(sized)
    parts = F.greatest(F.ceil(F.col("docs") / SHARD_DOCS), F.lit(1))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    # 13 hex digits are 52 bits: exact both as a long and as a double
    drawn = F.conv(F.substring(key, 1, 13), 16, 10).cast("long")
    targets = targets.select(_key(F.col("source")).alias("__source"), "source_size", "docs", "target")
    often = max(1, -(-sized.count() // HOT_KEYS))
    placed = attach(sized.withColumn("__source", _key(F.col("source"))), targets, "__source", targets.where(F.col("docs") >= often).select("__source")).drop("__source")
    placed = placed.withColumn("drawn", drawn).withColumn("shard", F.pmod(F.col("drawn"), parts))
    shards = placed.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    quotas = apportion(shards, block).select(F.col("source").alias("s"), F.col("shard").alias("h"), "shard_size", "quota")
    both = placed.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")), "left").drop("s", "h")
    order = Window.partitionBy("source", "shard").orderBy("drawn", "doc_id", "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    asked = F.least(F.col("quota") * block, F.col("shard_size") * REPEATS)
    rounds = F.floor(asked / F.col("shard_size"))
    rest = asked - rounds * F.col("shard_size")
    # shards without a word have no quota
    taken = F.coalesce(rounds * F.col("size") + F.greatest(F.least(rest - before, F.col("size")), F.lit(0)), F.lit(0))
    return both.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *extra)
