"""Counts and statistics (section 2.4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_ids(df: DataFrame, owner: str, key: str) -> DataFrame:
    """Rows with an id for each owner (2.4 #2)."""
    return df.groupBy(owner).agg(F.count(key).alias("n"))


def file_statistics(files: DataFrame, size: str, kind: str) -> DataFrame:
    """Files, their size and their kinds; zeros for none (2.4 #3)."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"), F.count_distinct(kind).alias("kinds"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls): the check after a backfill (2.4 #6)."""
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return row.unpivot([], list(columns), "column", "nulls")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table, and their sum under ``total`` (2.1 #18, 2.4 #10)."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out.unionByName(out.agg(F.sum("n").alias("n")).select(F.lit("total").alias("table"), "n"))


def by_status(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def array_total(array: Column) -> Column:
    """Aggregate: members of arrays, null ones empty (2.4 #8)."""
    return F.sum(F.size(F.coalesce(array, F.array())))


def ocr_summary(tokens: Column, confidences: Column) -> Column:
    """Struct of text (non-blank tokens joined) and the mean of the confidences above zero (2.4 #5)."""
    words = F.filter(tokens, lambda t: F.trim(t) != "")
    valid = F.filter(confidences, lambda c: c > 0)
    mean = F.try_divide(F.aggregate(valid, F.lit(0.0), lambda s, x: s + x), F.size(valid))
    return F.struct(F.array_join(words, " ").alias("text"), mean.alias("confidence"))


def images_by_source(items: DataFrame, key: str, position: str, images: str, sources: str) -> DataFrame:
    """(key, source, images): images of a batch by source in order of arrival; one group ``Screenshots`` where lengths differ (2.4 #9)."""
    fits = F.size(images) == F.size(sources)
    named = F.when(fits, F.col(sources)).otherwise(F.transform(images, lambda _: F.lit("Screenshots")))
    rows = items.select(key, position, F.posexplode(F.arrays_zip(F.col(images).alias("image"), named.alias("source"))).alias("at", "x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(position, "at", F.col("x.image").alias("image")))), lambda x: x["image"])
    return rows.groupBy(key, F.col("x.source").alias("source")).agg(ordered.alias("images"))


def token_totals(df: DataFrame, owner: str, *parts: str) -> DataFrame:
    """Sum of the parts of a context window for each owner (2.4 #13)."""
    whole = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0)))
    return df.groupBy(owner).agg(F.sum(whole).alias("tokens"))


def appended(value: Column, addition: Column) -> Column:
    """A block's value with a line appended (2.4 #14)."""
    return F.concat_ws("\n", F.when(value != "", value), addition)


def within_limit(blocks: DataFrame, value: str, limit: str) -> DataFrame:
    """Blocks, an error where a value is longer than its limit (1.3)."""
    too_long = F.raise_error(F.concat(F.lit("a block exceeds its limit of "), F.col(limit).cast("string"))).cast("string")
    return blocks.withColumn(value, F.when(F.length(value) > F.col(limit), too_long).otherwise(F.col(value)))
