"""Ranked search (section 2.5)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..session import stored
from ..skew import HOT_KEYS, attach

#: Okapi parameters: term saturation, length normalisation, floor of an idf as a share of the mean one.
K1, B, EPSILON = 1.5, 0.75, 0.25


def idf_of(n: Column, df: Column) -> Column:
    """Okapi's idf, negative for terms of more than half of the rows."""
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _equal_to(word: str):
    return lambda t: t == word


def bm25(df: DataFrame, field: str, query: str, key: str, limit: int | None = 10) -> DataFrame:
    """``df`` with score, the best first, ties by key (2.5 #3).

    Rows without a token are dropped; zero and negative scores stay.  A query
    without tokens returns the first rows by key with a null score.  An idf
    below zero becomes EPSILON times the mean idf of the vocabulary, which is
    computed only if a query token is that frequent.  A query token counts as
    often as it is repeated.

    Two passes: one counts the rows of each term, of which the statistics
    follow, and one scores, without a shuffle of rows.  ``postings`` keeps an
    index of what is searched often.
    """
    spark = df.sparkSession
    held = df.where(X.has_token(F.col(field)))
    words = [tuple(r) for r in spark.range(1).select(F.explode(X.tokens(F.lit(query))).alias("t")).select("t", F.xxhash64("t")).collect()]
    if not words:
        out = held.withColumn("score", F.lit(None).cast("double")).orderBy(F.col(key).asc_nulls_last())
        return out if limit is None else out.limit(limit)
    terms = stored(vocabulary(held.select(hashed(F.col(field)).alias("tokens"))), "terms")
    n, mean = terms.where("term is null").agg(F.coalesce(F.first("df"), F.lit(0)), F.first(F.col("tokens") / F.col("df"))).first()
    found = {r["term"]: r["idf"] for r in terms.where(F.col("term").isin([h for _, h in words])).select("term", idf_of(F.lit(n), F.col("df")).alias("idf")).collect()}
    if any(v < 0 for v in found.values()):
        floor = EPSILON * mean_idf(terms, n)
        found = {h: floor if v < 0 else v for h, v in found.items()}
    # the row's length, and its tokens cut to the query's: all that a score needs
    cut = held.withColumn("_tokens", X.tokens(F.col(field)))
    cut = cut.withColumn("_cut", F.struct(F.size("_tokens").alias("n"), F.filter("_tokens", lambda t: t.isin(sorted({w for w, _ in words}))).alias("t"))).drop("_tokens")
    score = F.lit(0.0)
    norm = K1 * (1 - B + B * F.col("_cut.n") / F.lit(mean))
    for w, h in words:
        if h in found:
            tf = F.size(F.filter("_cut.t", _equal_to(w)))
            score = score + F.lit(found[h]) * tf * (K1 + 1) / (tf + norm)
    out = cut.withColumn("score", score).drop("_cut").orderBy(F.desc("score"), F.col(key).asc_nulls_last())
    return out if limit is None else out.limit(limit)


def hashed(text: Column) -> Column:
    """Tokens as 64-bit hashes, by which terms are told apart."""
    return F.transform(X.tokens(text), lambda t: F.xxhash64(t))


def vocabulary(held: DataFrame) -> DataFrame:
    """(term, df, tokens) of rows (tokens, as hashes): the rows of each term; under a null term their number and all their tokens."""
    each = held.select(F.size("tokens").alias("n"), F.explode(F.array_append(F.array_distinct("tokens"), F.lit(None).cast("long"))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tokens"))


def mean_idf(terms: DataFrame, n: int) -> float:
    """The mean idf of a vocabulary (term, df)."""
    return terms.where("term is not null").agg(F.avg(idf_of(F.lit(n), F.col("df")))).first()[0]


#: Terms of all queries that go to the executors as one list (8 bytes each).
WANTED = 1 << 20


def term_counts(held: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(key, len, term, tf) of rows (key, tokens as hashes), for the terms (term) that are wanted alone.

    A row's terms are counted within the row, so nothing is shuffled; beyond
    WANTED terms they are joined.
    """
    some = wanted.select("term").limit(WANTED + 1).toArrow().column(0).to_numpy()
    if len(some) > WANTED:
        met = held.select(key, F.size("tokens").alias("len"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
        return met.groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    shared = held.sparkSession.sparkContext.broadcast(np.sort(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            term = batch.column(1).values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.searchsorted(known, term)
            fine = np.flatnonzero(at < len(known))
            fine = fine[known[at[fine]] == term[fine]]
            pair, n = np.unique(row[fine] * len(known) + at[fine], return_counts=True)
            row, at = pair // max(1, len(known)), pair % max(1, len(known))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.diff(offsets)[row]), pa.array(known[at]), pa.array(n)], names=[key, "len", "term", "tf"])

    return held.select(key, "tokens").mapInArrow(run, f"`{key}` {held.schema[key].dataType.simpleString()}, len int, term long, tf long")


def bm25_batch(df: DataFrame, field: str, key: str, queries: DataFrame, query_key: str, query_text: str, limit: int = 3) -> DataFrame:
    """(query_key, rank, key, score): the best rows for each of many queries.

    The corpus is tokenised once, to hashes; rows are cut to the terms that some
    query has before anything is shuffled.  The mean idf of all terms is
    computed only if a query has a term that is in more than half of the rows.
    Keys are unique.
    """
    held = df.select(key, hashed(F.col(field)).alias("tokens")).where(F.size("tokens") > 0)
    held = stored(held, "tokens")
    asked = queries.select(query_key, F.explode(hashed(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qf"))
    asked = stored(asked, "asked")
    tf = stored(term_counts(held, key, asked.select("term").distinct()), "terms")
    corpus = held.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean")).first()
    if not corpus["n"]:
        return tf.join(asked, "term").select(query_key, F.lit(1).alias("rank"), key, F.lit(0.0).alias("score"))
    idf = stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf_of(F.lit(corpus["n"]), F.col("df"))), "idf")
    # a term that half of the rows have has as many rows of tf: its idf comes by broadcast
    total = idf.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    hot = idf.where(F.col("df") >= max(1, -(-total // HOT_KEYS))).select("term")
    if not idf.where("idf < 0").isEmpty():
        floor = EPSILON * mean_idf(vocabulary(held), corpus["n"])
        idf = idf.withColumn("idf", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(corpus["mean"]))
    part = attach(tf, idf.select("term", "idf"), "term", hot).select(key, "term", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("part"))
    scored = part.join(asked, "term").groupBy(query_key, key).agg(F.sum(F.col("part") * F.col("qf")).alias("score"))
    # the score is rounded before it orders, so that sums in another order rank alike
    scored = scored.withColumn("score", F.round("score", 6))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(query_key, "rank", key, "score")


def contains(df: DataFrame, field: str, query: str, created: str, key: str, limit: int | None = 50, wildcards: bool = False) -> DataFrame:
    """Rows whose field contains the query, the newest first (2.5 #4 fallback, 2.2 #7)."""
    out = df.where(X.contains(F.col(field), query, wildcards)).orderBy(F.col(created).desc_nulls_last(), F.col(key).desc_nulls_last())
    return out if limit is None else out.limit(limit)


def by_vector(df: DataFrame, vector: str, query: Sequence[float], key: str, created: str | None = None, limit: int = 10) -> DataFrame:
    """The nearest by cosine distance, ties by time and key, rows without a usable vector last (2.5 #5)."""
    if len(query) > V.MAX_DIMS:
        raise ValueError(f"a query has more than {V.MAX_DIMS} dimensions")
    far = V.distance_to(F.col(vector), [float(x) for x in query])
    ties = [F.col(c).asc_nulls_last() for c in (created, key) if c]
    return df.withColumn("distance", far).orderBy(F.col("distance").asc_nulls_last(), *ties).limit(limit)


def recent(df: DataFrame, time: str | Column, key: str, limit: int | None = 10) -> DataFrame:
    """The latest rows, what an empty query returns (2.5 #7)."""
    at = F.col(time) if isinstance(time, str) else time
    out = df.orderBy(at.desc_nulls_last(), F.col(key).asc_nulls_last())
    return out if limit is None else out.limit(limit)


#: What each store searches by default: text field, vector field, recency field (2.5 #3, #7, #10).
STORES = {
    "episodic": ("summary", "summary_embedding", "occurred_at"),
    "resource": ("summary", "summary_embedding", "last_modify.timestamp"),
    "procedural": ("summary", "summary_embedding", "created_at"),
    "vault": ("caption", "caption_embedding", "last_modify.timestamp"),
    "semantic": ("summary", "summary_embedding", "last_modify.timestamp"),
}
#: Fields that have no vector.
NO_VECTOR = frozenset({("resource", "content"), ("vault", "secret_value")})
METHODS = ("bm25", "embedding", "string_match", "fuzzy_match", "fulltext")


def search_store(df: DataFrame, store: str, query: str, method: str = "bm25", field: str | None = None, vector: Sequence[float] | None = None, limit: int = 10) -> DataFrame:
    """Search one store; an unknown store or method is an error whatever the store (2.5 #9, #10)."""
    from . import fulltext, fuzzy

    if store not in STORES:
        raise ValueError(f"unknown store {store}")
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    text, embedding, time = STORES[store]
    field = field or ("content" if store == "resource" and method != "embedding" and "content" in df.columns else text)
    if not query:
        return recent(df, F.col(time), "id", limit)
    if method == "bm25":
        return bm25(df, field, query, "id", limit)
    if method == "string_match":
        return contains(df, field, query, "created_at", "id", limit)
    if method == "fuzzy_match":
        return fuzzy.fuzzy(df, field, query, "id", limit)
    if method == "fulltext":
        return fulltext.search(df, [field], query, "created_at", "id", limit)
    if (store, field) in NO_VECTOR or vector is None:
        raise ValueError(f"{store}.{field} can't be searched by vector")
    return by_vector(df, embedding if field == text else f"{field}_embedding", vector, "id", "created_at", limit)


def search_all(stores: dict[str, DataFrame], query: str, method: str = "bm25", vector: Sequence[float] | None = None, limit: int = 10) -> DataFrame:
    """(store, place, rank, id, text): each store's best, stores in a fixed order (2.5 #10, 2.8 #1)."""
    unknown = set(stores) - set(STORES)
    if unknown:
        raise ValueError(f"unknown stores {sorted(unknown)}")
    out = None
    for place, name in enumerate(s for s in STORES if s in stores):
        found = search_store(stores[name], name, query, method, None, vector, limit)
        numbered = found.withColumn("_seen", F.monotonically_increasing_id())
        numbered = numbered.withColumn("rank", F.row_number().over(Window.orderBy("_seen")))  # ``limit`` rows
        part = numbered.select(F.lit(name).alias("store"), F.lit(place).alias("place"), "rank", F.col("id").cast("string").alias("id"), F.col(STORES[name][0]).alias("text"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no store to search")
    return out.orderBy("place", "rank")


def topic(messages: DataFrame, conversation: str, position: str, role: str = "role", text: str = "text") -> DataFrame:
    """Each conversation's topic: its last non-blank user message, else its last message (2.5 #11)."""
    said = (F.col(role) == "user") & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    last_user = F.max_by(F.when(said, F.col(text)), F.when(said, F.col(position)))
    return messages.groupBy(conversation).agg(F.coalesce(last_user, F.max_by(text, position)).alias("topic"))


def conversation_search(messages: DataFrame, query: str, time: str, key: str, page: int = 0, size: int = 5) -> DataFrame:
    """User messages that contain the query, one page of them (2.5 #13)."""
    found = messages.where((F.col("role") == "user") & X.contains(F.col("text"), query)).orderBy(F.col(time).asc_nulls_last(), F.col(key).asc_nulls_last())
    return found.offset(page * size).limit(size)


def around_time(df: DataFrame, time: str, key: str, start: Column, end: Column, most: int = 50) -> DataFrame:
    """Rows of an inclusive range, one more than ``most`` if there are too many (2.5 #14)."""
    return df.where(F.col(time).between(start, end)).orderBy(F.col(time).asc_nulls_last(), F.col(key).asc_nulls_last()).limit(most + 1)


def retrieval_bundle(stores: dict[str, DataFrame], query: str, sensitive: bool = False, limit: int = 10, method: str = "bm25") -> DataFrame:
    """What a prompt is given: each store's best with its total, the vault's high secrets left out unless ``sensitive``,
    and the latest events beside the relevant ones (2.5 #12).
    """
    use = dict(stores)
    if "vault" in use and not sensitive:
        use["vault"] = use["vault"].where(F.col("sensitivity").isin("low", "medium"))
    found = search_all(use, query, method, limit=limit).withColumn("part", F.lit("relevant"))
    if "episodic" in use:
        late = recent(use["episodic"], "occurred_at", "id", limit).select(
            F.lit("episodic").alias("store"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("rank"), F.col("id").cast("string").alias("id"), F.col("summary").alias("text"), F.lit("recent").alias("part")
        )
        found = found.unionByName(late)
    totals = None
    for name, df in use.items():
        row = df.agg(F.count(F.lit(1)).alias("total")).withColumn("store", F.lit(name))
        totals = row if totals is None else totals.unionByName(row)
    return found.join(totals, "store")
