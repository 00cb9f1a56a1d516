"""Nearest neighbours: inverted file, product quantisation, exact reranking, and bounds that leave nothing out.

Vectors belong to the list of their nearest coarse centroid and are coded by
the product-quantised residual.  A query looks into its nearest lists, ranks
their members by asymmetric distance tables (query against codes), and reranks
the best by the exact distance on the original vectors.

What that finds depends on how well centroids and codes fit the rows.  The
triangle inequality makes up for it: a member is left out only if its distance
by code less the error of its code is beyond the k-th best, and a list only if
the distance to its centroid less the list's radius is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import store

#: Vectors drawn, by hash of their id, to fit the index, and so many for each list (16 at least); most coarse lists, and most numbers in all their centroids; values of a code.
SAMPLE, MAX_LISTS, CENTROID_NUMBERS, CODES = 1 << 18, 1 << 14, 1 << 24, 256
#: Dimensions of a code, least number of lists that are probed, members reranked in a block.
SUB_DIMS, LEAST_PROBES, RERANK = 4, 4, 64
#: Share of true neighbours whose lists are to be probed, and vectors of the sample on which the number of probes is measured.
TARGET, TRIALS = 0.98, 256
#: Members and queries that meet in one block.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
SEED = 17


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centers**2).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (half - x[i : i + 4096] @ centers.T).argmin(axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Centres of ``x``; at most as many as it has distinct rows."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centers)
        order = np.argsort(at, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], at[order][1:] != at[order][:-1])))
        centers[at[order][cut]] = np.add.reduceat(x[order], cut, axis=0) / np.diff(np.append(cut, len(x)))[:, None]
    return centers


@dataclass
class Index:
    """Coarse centroids, and a code book (codes by dimensions) for each group of dimensions."""

    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Index:
        x = x.astype(np.float32)
        centroids = k_means(x, lists)
        residual = x - centroids[_nearest(x, centroids)]
        dims = x.shape[1]
        cuts = [(a, min(dims, a + SUB_DIMS)) for a in range(0, dims, SUB_DIMS)]
        return cls(centroids, [k_means(residual[:, a:b], CODES) for a, b in cuts], cuts)

    def probes(self, x: np.ndarray, k: int, target: float = TARGET) -> int:
        """How many lists hold ``target`` of the ``k`` nearest neighbours within the sample ``x``, measured on ``TRIALS`` of its rows.

        Clustered vectors need few of the lists, vectors without structure most
        of them.  In a larger table true neighbours are nearer than within the
        sample, so that their lists are too.
        """
        x = x.astype(np.float32)
        at = _nearest(x, self.centroids)
        trial = np.unique(np.linspace(0, len(x) - 1, TRIALS).astype(np.int64))
        half, norm = (self.centroids**2).sum(axis=1) / 2, (x**2).sum(axis=1) / 2
        needed = []
        for lo in range(0, len(trial), 16):
            mine = trial[lo : lo + 16]
            far = norm - x[mine] @ x.T
            far[np.arange(len(mine)), mine] = np.inf
            near = np.argpartition(far, min(k, len(x) - 1), axis=1)[:, : min(k, len(x) - 1)]
            order = np.argsort(half - x[mine] @ self.centroids.T, axis=1, kind="stable")
            place = np.argsort(order, axis=1)
            needed.append(np.take_along_axis(place, at[near], axis=1).ravel())
        needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0, np.int64)
        return int(needed[min(len(needed) - 1, int(target * len(needed)))]) + 1 if len(needed) else 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, code, distance to the list's centroid and error of the code of each row; the last two in double precision."""
        at = _nearest(x.astype(np.float32), self.centroids)
        residual = x.astype(np.float64) - self.centroids[at]
        single = residual.astype(np.float32)
        codes = [_nearest(single[:, a:b], book) for (a, b), book in zip(self.cuts, self.books, strict=True)]
        told = np.concatenate([book[code] for code, book in zip(codes, self.books, strict=True)], axis=1)
        return at, np.stack(codes, axis=1).astype(np.uint8), np.sqrt((residual**2).sum(axis=1)), np.sqrt(((residual - told) ** 2).sum(axis=1))

    def tables(self, queries: np.ndarray, at: int) -> list[np.ndarray]:
        """Squared distance of each query's residual to each code, by group of dimensions."""
        residual = queries - self.centroids[at]
        out = []
        for (a, b), book in zip(self.cuts, self.books, strict=True):
            part = residual[:, a:b]
            out.append((part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), flat.dtype)


def _encode(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, code, far, error = shared.value.encode(_matrix(batch.column(1)))
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(at, pa.int64()), codes, batch.column(1), pa.array(far), pa.array(error)],
                    names=["vec_id", "list", "code", "vector", "far", "error"],
                )

    return run


def _probe(shared, sizes: np.ndarray, radius: np.ndarray, probes: int, k: int, rest: bool) -> Callable:
    """Rows (vec_id, vector, bound) to a row for each list that is looked into.

    First the nearest lists, and more until k + 1 vectors are there; then, as
    ``rest``, the others that may hold a vector within ``bound``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value.centroids
        half, wide = (centers**2).sum(axis=1) / 2, centers.astype(np.float64)
        norm = np.sqrt((wide**2).sum(axis=1))
        for batch in batches:
            if not batch.num_rows:
                continue
            given = _matrix(batch.column(1))
            x = given.astype(np.float32)
            order = np.argsort(half - x @ centers.T, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            row, place = np.nonzero((np.arange(len(centers)) < probes) | (before < k + 1))
            at = order[row, place]
            if rest:
                look = np.tile(sizes > 0, (len(x), 1))
                look[row, at] = False
                x, bound = given.astype(np.float64), batch.column(2).to_numpy()
                own = np.sqrt((x**2).sum(axis=1))
                away = np.sqrt(np.maximum(0, own[:, None] ** 2 - 2 * x @ wide.T + norm**2))
                # what is not known to be beyond the bound is looked into
                beyond = away - radius > bound[:, None] + 1e-6 * (own[:, None] + norm + radius)
                row, at = np.nonzero(look & ~beyond)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(at, pa.int64()), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row))],
                names=["vec_id", "list", "vector", "bound"],
            )

    return run


def _search(shared, k: int, rerank: int) -> Callable:
    """Rows (block, is_query, list, vec_id, code, vector, bound), of a block the queries or the members first, to its nearest (query_id, vec_id, score).

    ``bound`` is the error of a member's code, and of a query the distance beyond which nothing is wanted.
    """

    def block(at: int, q_id, q, bound, m_id, code, m, error) -> pa.RecordBatch:
        index = shared.value
        order = np.argsort(m_id, kind="stable")
        m_id, code, m, error = m_id[order], code[order], m[order].astype(np.float64), error[order]
        out_q, out_m, out_s = [], [], []

        def exact(which: np.ndarray, vector: np.ndarray) -> np.ndarray:
            gap = m[which] - vector
            return np.sqrt((gap * gap).sum(axis=1))

        for lo in range(0, len(q_id), 64):
            ids, x = q_id[lo : lo + 64], q[lo : lo + 64].astype(np.float64)
            far = np.zeros((len(ids), len(m_id)))
            for s, table in enumerate(index.tables(x, at)):
                far += table[:, code[:, s]]
            far = np.sqrt(np.maximum(far, 0))
            apart = np.sqrt(((x - index.centroids[at]) ** 2).sum(axis=1))
            for row, (name, vector) in enumerate(zip(ids, x, strict=True)):
                others = m_id != name
                # what is not a number here comes last, but it comes
                best = np.argsort(np.where(others, far[row], np.inf), kind="stable")[:rerank]
                best = best[others[best]]
                score = exact(best, vector)
                limit = min(bound[lo + row], np.partition(score, k - 1)[k - 1] if len(score) >= k else np.inf)
                more = others & ~(far[row] - error > limit + 1e-6 * (limit + apart[row] + far[row]))
                more[best] = False
                more = np.flatnonzero(more)
                best, score = np.concatenate((best, more)), np.concatenate((score, exact(more, vector)))
                first = np.lexsort((m_id[best], score))[:k]
                out_q.append(np.full(len(first), name))
                out_m.append(m_id[best][first])
                out_s.append(score[first])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_m, out_s)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            asks = rows.column("is_query").to_numpy().astype(bool)
            ids, bound = rows.column("vec_id").to_numpy(), rows.column("bound").to_numpy()
            vectors = _matrix(rows.column("vector").combine_chunks())
            if asks.any() and not asks.all():
                code = np.frombuffer(b"".join(rows.column("code").filter(pa.array(~asks)).to_pylist()), np.uint8)
                at = rows.column("list")[0].as_py()
                yield block(at, ids[asks], vectors[asks], bound[asks], ids[~asks], code.reshape(int((~asks).sum()), -1), vectors[~asks], bound[~asks])

        for batch in batches:
            name = batch.column(0).to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(name[1:] != name[:-1]) + 1, [len(name)])) if len(name) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if held and name[a] != now:
                    yield from flush()
                now = name[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return run


def usable(vector) -> Column:
    """Not null, not zero, every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = 10,
    every: int = 100,
    target: float = TARGET,
    probe_share: float | None = None,
    rerank: int = RERANK,
    exact: bool = False,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest by Euclidean distance, ties to the smaller id.

    Queries are the rows of ``queries`` (same columns), by default those whose
    id is divisible by ``every``; a query's own id is no candidate.  As many
    lists are probed as hold ``target`` of the true neighbours within the
    sample, or ``probe_share`` of them where it is given; after them, those that
    may hold a nearer vector by their radius, so that the result does not
    depend on how well the index fits the rows.  ``exact`` compares
    each query with every vector instead.  Vectors
    that are null, zero, or hold a null or non-finite component take no part,
    nor rows without an id; of several vectors of an id the smallest (in array
    order) counts; vectors of another length than most are left out.  All lists
    are looked into where fewer than ``k`` candidates are near.  An empty table
    gives no rows.
    """
    spark = vectors.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        given = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v64"), F.col(vector_col).alias("vector"))
        given = given.where(usable(F.col("v64")) & F.col("vec_id").isNotNull())
        return given.groupBy("vec_id").agg(F.min("vector").alias("vector"))

    clean = store(prepared(vectors), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    counts = clean.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if counts is None:
        return spark.createDataFrame([], schema)
    dims, rows = counts
    clean = clean.where(F.size("vector") == dims)
    asked = (prepared(queries).where(F.size("vector") == dims) if queries is not None else clean.where(F.col("vec_id") % every == 0))
    lists = int(max(1, min(MAX_LISTS, CENTROID_NUMBERS // dims, round(rows**0.5))))
    share = min(1.0, min(SAMPLE, max(1 << 16, 16 * lists)) / rows)
    drawn = clean.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("vector").toArrow()
    sample = _matrix(drawn.column(0).combine_chunks())
    if not len(sample):
        sample = _matrix(clean.select("vector").limit(1).toArrow().column(0).combine_chunks())
    index = Index.fit(sample, 1 if exact else lists)
    lists = len(index.centroids)
    shared = spark.sparkContext.broadcast(index)
    rerank = BLOCK_ROWS * 16 if exact else rerank
    if exact:
        probes = lists
    elif probe_share is not None:
        probes = max(LEAST_PROBES, round(lists * probe_share))
    else:
        probes = max(LEAST_PROBES, index.probes(sample, k, target))

    kind = clean.schema["vector"].dataType.simpleString()
    coded = store(clean.mapInArrow(_encode(shared), f"vec_id long, list long, code binary, vector {kind}, far double, error double"), "coded")
    sizes, radius = np.zeros(lists, np.int64), np.zeros(lists)
    for row in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # at most MAX_LISTS rows
        sizes[row["list"]], radius[row["list"]] = row["n"], row["far"]
    columns = ["block", "is_query", "list", "vec_id", "code", "vector", "bound"]
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def found(asked: DataFrame, rest: bool) -> DataFrame:
        """The best of the lists that the rows (vec_id, vector, bound) look into."""
        looks = store(asked.mapInArrow(_probe(shared, sizes, radius, probes, k, rest), f"vec_id long, list long, vector {kind}, bound double"), "looks")
        # A list's members are dealt into parts, its queries into slices; each slice meets each part.
        parts = np.maximum(1, -(-sizes // BLOCK_ROWS))
        slices = np.zeros(lists, np.int64)
        for row in looks.groupBy("list").count().collect():
            slices[row["list"]] = -(-row["count"] // BLOCK_QUERIES)
        shape = spark.createDataFrame(pa.table({"list": np.arange(lists), "parts": parts, "slices": slices})).where("slices > 0")
        members = coded.join(F.broadcast(shape), "list").select(
            F.lit(0).alias("is_query"), "list", "vec_id", "code", "vector", F.col("error").alias("bound"), F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"),
        )
        probing = looks.join(F.broadcast(shape), "list").select(
            F.lit(1).alias("is_query"), "list", "vec_id", F.lit(None).cast("binary").alias("code"), "vector", "bound",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), F.col("slices")).alias("slice"),
        )
        both = members.unionByName(probing).withColumn("block", F.xxhash64("list", "part", "slice"))
        both = both.select(*columns).repartition("block").sortWithinPartitions("block")
        each = both.mapInArrow(_search(shared, k, rerank), "query_id long, vec_id long, score double")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    endless = F.lit(float("inf"))
    near = store(found(asked.select("vec_id", "vector", endless.alias("bound")), False), "near")
    bound = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    again = asked.join(bound, "vec_id", "left").select("vec_id", "vector", F.coalesce("bound", endless).alias("bound"))
    ranked = near.unionByName(found(again, True)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
