"""A stored inverted index for BM25 (section 2.5 #3): postings by term, block maxima, appended segments.

Rows are numbered in ranges of RANGE; a term's postings within a range are one
row of the store, with the largest count and the smallest length in it.  These
bound what any row of the range can score whatever the corpus' statistics are,
so that they hold when segments are appended.  A query reads its own terms
alone: first the bounds, then the postings of the most promising ranges, whose
k-th best score is a threshold, and then only those of ranges that can reach it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .search import EPSILON, K1, B, hashed, idf_of

#: Rows of a range, folders that terms are dealt to by hash, bytes of a row group: what a reader can skip.
RANGE, BUCKETS, GROUP_BYTES = 4096, 64, 1 << 20
#: Ranges of a query that are scored first; terms of all queries that are pushed to the scan as a list, and rows of them that are broadcast.
SEEDS, LISTED, BROADCAST_ROWS = 4, 10_000, 200_000
#: Queries whose scores of a range are held at once, about (36 KB each).
QUERIES = 1024
#: More than rounding can move a score; scores are rounded to so many digits before they order rows.
SLACK, DIGITS = 1e-5, 6

_POSTINGS = "term long, range long, n int, tf_max int, len_min int, rows array<int>, counts array<int>, lengths array<int>"
_MANIFEST = "segment string, docs long, tokens long"


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tokens as hashes), ids ascending, to a row for each term and range.

    A range whose rows come in several tasks or batches has several rows a
    term, each with bounds of its own.
    """
    for batch in batches:
        ids = batch.column(0).to_numpy()
        column = batch.column(1)
        offsets, terms = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(ids)), np.diff(offsets))
        terms = terms[offsets[0] : offsets[-1]]
        edge = np.concatenate(([0], np.flatnonzero(ids[1:] // RANGE != ids[:-1] // RANGE) + 1, [len(ids)])) if len(ids) else [0]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            mine = slice(*np.searchsorted(of, [lo, hi]))
            row, term = of[mine], terms[mine]
            if not len(term):
                continue
            order = np.lexsort((row, term))
            row, term = row[order], term[order]
            first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (row[1:] != row[:-1]))))
            count = np.diff(np.append(first, len(term))).astype(np.int32)
            row, term = row[first], term[first]
            length = np.diff(offsets)[row].astype(np.int32)
            head = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
            ends = np.append(head, len(term)).astype(np.int32)

            def lists(values: np.ndarray, ends=ends) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(term[head]),
                    pa.array(np.full(len(head), ids[lo] // RANGE)),
                    pa.array(np.diff(ends)),
                    pa.array(np.maximum.reduceat(count, head)),
                    pa.array(np.minimum.reduceat(length, head)),
                    lists(ids[row] % RANGE),
                    lists(count),
                    lists(length),
                ],
                names=["term", "range", "n", "tf_max", "len_min", "rows", "counts", "lengths"],
            )


def _part(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def _scorer(limit: int, mean: float):
    """Rows (part, segment, range, side, q, rows, counts, lengths, qs, weights) sorted by the first four to (q, segment, range, row, score): each query's best rows of a range.

    Side 0 names the queries of a range, side 1 has its postings with the
    queries that ask for their term.  All rows that rounding may put level with
    the ``limit``-th stay.
    """

    def best(now: tuple, queries: list[int], score: np.ndarray, hit: np.ndarray) -> Iterator[pa.RecordBatch]:
        for q, mine, met in zip(queries, score, hit, strict=True):
            row = np.flatnonzero(met)
            s = mine[row]
            if len(row) > limit:
                fine = s >= np.partition(s, -limit)[-limit] - 2 * 10.0**-DIGITS
                row, s = row[fine], s[fine]
            if len(row):
                columns = [pa.array(np.full(len(row), q)), pa.array([now[1]] * len(row), pa.string()), pa.array(np.full(len(row), now[2])), pa.array(row.astype(np.int32)), pa.array(s)]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "segment", "range", "row", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, score, hit = None, [], None, None
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            side, q = batch.column(3).to_numpy(), batch.column(4).to_pylist()
            lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in batch.columns[5:]]
            for i, place in enumerate(places):
                if place != now:
                    if score is not None:
                        yield from best(now, queries, score, hit)
                    now, queries, score = place, [], None
                if side[i] == 0:
                    queries.append(q[i])
                    continue
                if not queries:  # others ask for the range
                    continue
                if score is None:
                    queries.sort()
                    names = np.array(queries, np.int64)
                    score, hit = np.zeros((len(queries), RANGE)), np.zeros((len(queries), RANGE), bool)
                row, tf, length, qs, weight = (values[offsets[i] : offsets[i + 1]] for offsets, values in lists)
                at = np.minimum(np.searchsorted(names, qs), len(names) - 1)
                mine = names[at] == qs
                spot = np.ix_(at[mine], row)
                score[spot] += np.outer(weight[mine], tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)))
                hit[spot] = True
        if score is not None:
            yield from best(now, queries, score, hit)

    return run


@dataclass
class Postings:
    """An index of one text field in a folder that driver and executors share; see ``create`` and ``open``."""

    spark: SparkSession
    path: str
    key_type: str
    _floors: dict[tuple[str, ...], float] = field(default_factory=dict)

    @classmethod
    def create(cls, df: DataFrame, text: str, key: str, path: str) -> Postings:
        """The index of ``df``: one segment, more by ``append``.  Rows without a token are left out."""
        out = cls(df.sparkSession, path, df.select(key).schema[0].dataType.simpleString())
        out.append(df, text, key)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Postings:
        segment = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").first()["segment"]
        return cls(spark, path, spark.read.parquet(f"{path}/docs/segment={segment}").schema["key"].dataType.simpleString())

    def append(self, df: DataFrame, text: str, key: str) -> str:
        """Index the rows of ``df`` as a segment of its own; the manifest names it last, so readers see all of it or nothing.

        Returns its name.  A row number is a segment's own.
        """
        name = uuid.uuid4().hex
        given = df.select(F.col(key).cast(self.key_type).alias("key"), hashed(F.col(text)).alias("tokens"))
        numbered = stored(given.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("id"), "key", "tokens"), "tokens")
        docs = numbered.select(F.shiftright("id", 12).alias("range"), F.pmod("id", F.lit(RANGE)).cast("int").alias("row"), "key", F.size("tokens").alias("length"))
        docs.write.parquet(f"{self.path}/docs/segment={name}")
        inverted = numbered.select("id", "tokens").mapInArrow(_invert, _POSTINGS).withColumn("bucket", F.pmod("term", F.lit(BUCKETS)).cast("int"))
        # by range of term and range of rows: a frequent term is no task's alone, and row groups hold few terms each
        dealt = inverted.repartitionByRange("bucket", "term", "range").sortWithinPartitions("bucket", "term", "range")
        dealt.write.partitionBy("bucket").option("parquet.block.size", GROUP_BYTES).parquet(f"{self.path}/postings/segment={name}")
        total = self.spark.read.parquet(f"{self.path}/docs/segment={name}").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        self.spark.createDataFrame([(name, total[0], total[1])], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return name

    def _segments(self) -> list[tuple[str, int, int]]:
        return sorted(tuple(r) for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect())

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        """Rows of the segments that the manifest names, with segment."""
        reader = self.spark.read.schema(f"{schema}, segment string").option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*(f"{self.path}/{kind}/segment={n}" for n in names))

    def postings(self, names: list[str]) -> DataFrame:
        return self._read("postings", names, f"{_POSTINGS}, bucket int")

    def _floor(self, names: list[str], docs: int) -> float:
        """What a negative idf becomes: the mean over the vocabulary, from counts alone; kept for a set of segments."""
        if tuple(names) not in self._floors:
            terms = self.postings(names).groupBy("term").agg(F.sum("n").alias("df"))
            self._floors[tuple(names)] = EPSILON * terms.agg(F.avg(idf_of(F.lit(docs), F.col("df")))).first()[0]
        return self._floors[tuple(names)]

    def of_terms(self, names: list[str], asked: DataFrame) -> DataFrame:
        """Postings of the asked terms: only their folders are read, and of these the row groups that may hold them."""
        terms = asked.select("term").distinct()
        listed = [r["term"] for r in terms.limit(LISTED + 1).collect()]
        out = self.postings(names)
        if len(listed) > LISTED:
            return out.join(terms, "term", "left_semi")
        return out.where(F.col("bucket").isin(sorted({t % BUCKETS for t in listed})) & F.col("term").isin(listed))

    def search(self, queries: DataFrame, query_key: str, query_text: str, limit: int = 10) -> DataFrame:
        """(query_key, rank, key, score): each query's best rows of those that share a term with it, ties by key.

        Scores are those of ``search.bm25``, rounded.  A term counts as often as
        the query repeats it; queries without a token have no rows.  Exact:
        ranges are left out only where their bounds stay below what ``limit``
        rows are known to reach.
        """
        segments = self._segments()
        names, docs, tokens = [s[0] for s in segments], sum(s[1] for s in segments), sum(s[2] for s in segments)
        words = queries.select(F.col(query_key).alias("q"), F.explode(hashed(F.col(query_text))).alias("term"))
        words = stored(words.where("q is not null").groupBy("q", "term").agg(F.count(F.lit(1)).alias("qf")), "words")
        names_of = stored(words.select("q").distinct().select(F.monotonically_increasing_id().alias("number"), "q"), "queries")
        asked = stored(words.join(names_of, "q").select(F.col("number").alias("q"), "term", "qf"), "asked")
        mean = tokens / max(1, docs)
        mine = self.of_terms(names, asked)
        place = ["segment", "range"]
        heads = stored(mine.select(*place, "term", "n", "tf_max", "len_min"), "heads")
        idf = stored(heads.groupBy("term").agg(idf_of(F.lit(docs), F.sum("n")).alias("idf")), "idf")
        if not idf.where("idf < 0").isEmpty():
            idf = idf.withColumn("idf", F.when(F.col("idf") < 0, self._floor(names, docs)).otherwise(F.col("idf")))
        weights = stored(asked.join(idf, "term").select("q", "term", (F.col("idf") * F.col("qf")).alias("weight")), "weights")
        few = weights.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        weights = F.broadcast(weights) if few else weights
        # a range may have several rows of a term; a term that counts against a row bounds it by nothing
        most = F.greatest(F.col("weight"), F.lit(0.0)) * _part(F.col("tf_max"), F.col("len_min"), mean)
        bounds = heads.join(weights, "term").groupBy("q", *place, "term").agg(F.max(most).alias("most")).groupBy("q", *place).agg(F.sum("most").alias("bound"))
        first = Window.partitionBy("q").orderBy(F.desc("bound"), *place)
        seeds = stored(bounds.withColumn("at", F.row_number().over(first)).where(F.col("at") <= SEEDS).select("q", *place), "seeds")

        parts = -(-names_of.count() // QUERIES) or 1
        part = F.pmod(F.xxhash64("q"), F.lit(parts)).alias("part")
        askers = stored(weights.groupBy(part, "term").agg(F.collect_list(F.struct("q", "weight")).alias("x")).select("part", "term", F.col("x.q").alias("qs"), F.col("x.weight").alias("weights")), "askers")
        askers = F.broadcast(askers) if few else askers

        def scored(pairs: DataFrame) -> DataFrame:
            """(q, segment, range, row, score) of the best rows of each of the ranges in ``pairs``: a posting is shuffled once, however many queries ask for its term."""
            wanted = mine.join(F.broadcast(pairs.select(*place).distinct()) if few_seeds(pairs) else pairs.select(*place).distinct(), place, "left_semi")
            met = wanted.join(askers, "term").select("part", *place, F.lit(1).alias("side"), "rows", "counts", "lengths", "qs", "weights")
            named = pairs.select(part, *place, F.lit(0).alias("side"), "q")
            order = ["part", *place, "side", "q", "rows", "counts", "lengths", "qs", "weights"]
            dealt = named.unionByName(met, allowMissingColumns=True).select(order).repartition("part", *place).sortWithinPartitions("part", *place, "side")
            each = dealt.mapInArrow(_scorer(limit, mean), "q long, segment string, range long, row int, score double")
            return each.withColumn("score", F.round("score", DIGITS))

        def few_seeds(pairs: DataFrame) -> bool:
            return pairs is seeds and seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

        known = stored(scored(seeds), "known")
        best = Window.partitionBy("q").orderBy(F.desc("score"))
        least = known.withColumn("at", F.row_number().over(best)).where(F.col("at") == limit).select("q", F.col("score").alias("least"))
        open_ = bounds.join(seeds, ["q", *place], "left_anti").join(least, "q", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
        found = known.unionByName(scored(stored(open_.select("q", *place), "open")))
        # ties are told apart by key, so all rows of the last score stay until the keys are there
        top = found.withColumn("at", F.rank().over(best)).where(F.col("at") <= limit).drop("at")
        keys = self._read("docs", names, f"range long, row int, key {self.key_type}, length int").select(*place, "row", "key")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
        out = top.join(keys, [*place, "row"]).join(names_of.select(F.col("number").alias("q"), F.col("q").alias("name")), "q").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        return out.select(F.col("name").alias(query_key), "rank", "key", "score")
