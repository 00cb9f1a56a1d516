"""Registered queries of stored indexes, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.postings import Postings
from ..session import table, workspace
from .catalog import _QUERY, _SQL_BM25, _SQL_TOKENS, _register, _sql


def _index(spark, d, *parts) -> Postings:
    """An index of the documents' texts: a segment for each condition."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    path = f"{workspace(spark)}/postings-{uuid.uuid4().hex}"
    index = Postings.create(docs.where(parts[0]) if parts else docs, "text", "doc_id", path)
    for part in parts[1:]:
        index.append(docs.where(part), "text", "doc_id")
    return index


def _best(index: Postings, text: str, limit: int):
    query = index.spark.range(1).select(F.col("id").alias("item_id"), F.lit(text).alias("text"))
    return index.search(query, "item_id", "text", limit).select(F.col("key").alias("doc_id"), "score")


_SQL_TOP = f"""
with {_SQL_BM25}, q as (select unnest({_SQL_TOKENS.format(repr(_QUERY))}) term),
part as (select tf.doc_id, idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(toks.t) / corpus.mean)) p
  from q join idf using (term) join tf using (term) join toks using (doc_id), corpus)
select doc_id, round(sum(p), 6) as score from part group by doc_id order by round(sum(p), 6) desc, doc_id limit 20"""


@_register(_SQL_TOP)
def postings_topk(spark, d):
    """A query over a stored index (2.5 #3)."""
    return _best(_index(spark, d), _QUERY, 20)


@_register(_SQL_TOP)
def postings_append(spark, d):
    """The same over an index of three segments, two of them appended."""
    return _best(_index(spark, d, "doc_id % 3 = 0", "doc_id % 3 = 1", "doc_id % 3 = 2"), _QUERY, 20)


@_register(_sql["bm25_batch"])
def postings_batch(spark, d):
    """Many queries over a stored index."""
    found = _index(spark, d).search(table(spark, d, "benchmark"), "item_id", "text", 3)
    return found.select("item_id", "rank", F.col("key").alias("doc_id"), "score")
