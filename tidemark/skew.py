"""Lookup joins that no hot key can pull into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys count as hot; each holds this share of all rows or more.
HOT_KEYS = 1000


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key) of those that hold a thousandth of ``total`` rows or more: a thousand at most, whatever the data."""
    least = max(1, -(-total // HOT_KEYS))
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return counted.where((F.col("__n") >= least) & F.col(key).isNotNull()).select(key)


def attach(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for a key; ``how`` is inner or left.

    ``table`` is read twice: it is best a stored one.  ``hot`` has the keys, bounded in number (see ``hot_keys``), whose rows are
    not brought together: they get their values from a broadcast of those keys
    alone, and go through the join of the others dealt by a salt that nothing
    there matches.  So do rows without a key.
    """
    values = [c for c in table.columns if c != key]
    hot = hot.select(F.col(key).alias("__h"))
    few = hot.join(table, hot["__h"] == table[key], "left").select("__h", F.when(F.col(key).isNotNull(), F.struct(*values)).alias("__v"))
    marked = rows.join(F.broadcast(few), rows[key] == few["__h"], "left")
    salt = F.when(F.col("__h").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int") + 1)
    marked = marked.withColumn("__s", salt)
    rest = table.select(F.col(key).alias("__k"), F.struct(*values).alias("__t"), F.lit(0).alias("__z"))
    out = marked.join(rest, (F.col(key) == F.col("__k")) & (F.col("__s") == F.col("__z")), "left")
    out = out.withColumn("__o", F.coalesce("__v", "__t"))
    if how == "inner":
        out = out.where(F.col("__o").isNotNull())
    return out.select(*rows.columns, *(F.col("__o").getField(c).alias(c) for c in values))
