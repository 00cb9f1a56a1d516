"""From raw documents to a training mix: five stages, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, jaccard, langid, mixing, pii
from tidemark.llm.store import store
from tidemark.session import ship

#: A prediction less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; ``und`` and unsure ones go."""
    ship(spark)
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    # under names of their own, whatever the columns are called
    names = {c: f"kept{k}" for k, c in enumerate(docs.columns)}
    named = docs.select(F.col("text"), *(F.col(c).alias(k) for c, k in names.items()))
    found = langid.predict(named, model, keep=[*names.values()])
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select(*(F.col(k).alias(c) for c, k in names.items()))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group at five words and a similarity of 0.8.

    Rows that share an id are one document here: they stay or go together.
    """
    ship(spark)
    groups = jaccard.near_duplicates(docs, n=5, percent=80)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item or an edited copy of one."""
    ship(spark)
    leaks = decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = leaks.select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__leak"]), "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars is counted anew."""
    ship(spark)
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of the documents that the mix takes."""
    ship(spark)
    return mixing.mix(docs, keep=("source",)).where("taken > 0")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", join_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
]

#: Models, alignments and components are beyond SQL; each stage is tested against brute force or its own model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
