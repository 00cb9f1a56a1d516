"""Vector code compression: product codes whose codebooks are kept by a delta-maintained Lloyd iteration.

Vectors become integers, are cut into equal parts, and each part is replaced by
the index of its codebook's nearest entry.  A round writes each vector's codes
beside those of the round before; only parts whose code changed contribute,
with a minus to the entry they left and a plus to the one they joined, to
running integer sums, from which the entries of the next round are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import HOT_KEYS, attach
from .store import discard, store

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest absolute integer: larger ones are taken as it, so that the squares of 4,096 dimensions add up within 64 bits.
LARGEST = 1 << 24
#: Vectors that are compared with a codebook at once.
ROWS = 4096

_STATE = "vec_id {id}, label {label}, whole array<int>, old binary, code binary, error long, books string"
_SUMS = "dims int, part int, entry int, place int, total long"


def cuts(dims: int, parts: int) -> list[int]:
    """Borders of the parts of a vector: equal where ``parts`` divides ``dims``, else as near as integers go."""
    return [k * dims // parts for k in range(parts + 1)]


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, ties to the lower, and its squared distance; integers, exactly."""
    most = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if most * most * max(1, x.shape[1]) < 1 << 52 else np.int64
    book = book.astype(kind)
    square = (book * book).sum(axis=1)
    at, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for i in range(0, len(x), ROWS):
        rows = x[i : i + ROWS].astype(kind)
        gap = square - 2 * (rows @ book.T)
        best = gap.argmin(axis=1)
        at[i : i + ROWS] = best
        far[i : i + ROWS] = gap[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)
    return at, far


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, rows, matrix of their integers) of each length of list in a column."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    for dims in np.unique(length).tolist():
        rows = np.flatnonzero(length == dims)
        yield dims, rows, flat[offsets[rows][:, None] + np.arange(dims)].astype(np.int64)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _assign(shared, parts: int) -> Callable:
    """Rows of a state to those with the code of the books at hand, the former one as old."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, names = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            name = np.zeros(n, object)
            for dims, rows, x in _by_length(batch.column(2)):
                edge = cuts(dims, parts)
                for p in range(parts):
                    at, far = nearest_entries(x[:, edge[p] : edge[p + 1]], books[dims][:, edge[p] : edge[p + 1]])
                    code[rows, p] = at
                    error[rows] += far
                name[rows] = names[dims]
            made = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(4), made, pa.array(error), pa.array(name, pa.string())],
                names=["vec_id", "label", "whole", "old", "code", "error", "books"],
            )

    return run


def _moves(parts: int, entries: int) -> Callable:
    """Rows (whole, old, code) to what their changed parts add to and take from the sums; place -1 counts.  One set of sums for each length leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.array([x is None for x in batch.column(1).to_pylist()], bool)
            new = _codes(batch.column(2), parts)
            old = new.copy()
            if not first.all():
                old[~first] = _codes(batch.column(1).filter(pa.array(~first)), parts)
            for dims, rows, x in _by_length(batch.column(0)):
                # by entry: each dimension's sum, then how many parts of each position
                mine = total.setdefault(dims, np.zeros((entries, dims + parts), np.int64))
                edge = cuts(dims, parts)
                for p in range(parts):
                    for sign, codes, moved in ((1, new, first[rows] | (old[rows, p] != new[rows, p])), (-1, old, ~first[rows] & (old[rows, p] != new[rows, p]))):
                        at = codes[rows[moved], p]
                        np.add.at(mine[:, edge[p] : edge[p + 1]], at, sign * x[moved, edge[p] : edge[p + 1]])
                        mine[:, dims + p] += sign * np.bincount(at, minlength=entries)
        for dims, mine in total.items():
            edge = cuts(dims, parts)
            part = np.concatenate([np.repeat(np.arange(parts), np.diff(edge)), np.arange(parts)])
            place = np.concatenate([np.arange(dims) - np.repeat(edge[:-1], np.diff(edge)), np.full(parts, -1)])
            entry, at = np.nonzero(mine)
            columns = [np.full(len(at), dims, np.int32), part[at].astype(np.int32), entry.astype(np.int32), place[at].astype(np.int32), mine[entry, at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dims", "part", "entry", "place", "total"])

    return run


def _moved(books: dict[int, np.ndarray], sums: list, parts: int, entries: int) -> dict[int, np.ndarray]:
    """The books whose entries are floor(sum / count); entries that no part has stay."""
    out = {}
    for dims, book in books.items():
        edge = cuts(dims, parts)
        total, count = np.zeros((entries, dims), np.int64), np.zeros((entries, parts), np.int64)
        for r in sums:
            if r["dims"] == dims and r["place"] < 0:
                count[r["entry"], r["part"]] = r["total"]
            elif r["dims"] == dims:
                total[r["entry"], edge[r["part"]] + r["place"]] = r["total"]
        count, total = np.repeat(count, np.diff(edge), axis=1)[: len(book)], total[: len(book)]
        out[dims] = np.where(count > 0, np.floor_divide(total, np.maximum(count, 1)), book)
    return out


def digest(book: np.ndarray, parts: int = PARTS) -> str:
    """SHA-256 of all entries' integers by part, entry, place."""
    edge = cuts(book.shape[1], parts)
    flat = [v for p in range(parts) for row in book[:, edge[p] : edge[p + 1]].tolist() for v in row]
    return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """id_col, code, error, label_error, codebooks_sha256 of every vector whose components are all there and finite.

    Components become floor(scale * x), beyond +-2^24 that limit.  The
    codebooks (at most 256 entries) start as the parts of the ``entries``
    smallest ids (null ids last, ties by the integers), fewer where there are
    fewer vectors.  code has two hex digits for each part; error is the squared
    distance to the final entries, label_error its sum over equal labels (nulls
    together).

    Vectors of each length have codebooks of their own; where the parts do not
    divide the length they differ by one in size, and may be empty.  Repeated
    rows and ids each give a row and count each.  Other columns are ignored; an
    empty table gives no rows.  On the driver are the codebooks and their sums
    alone: ``entries`` rows for each length.
    """
    spark = vectors.sparkSession
    id_type, label_type = (vectors.select(c).schema[0].dataType.simpleString() for c in (id_col, label_col))
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector")).where(F.col("vector").isNotNull() & fine)
    integer = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LARGEST).cast("long")), F.lit(-LARGEST).cast("long")).cast("int")
    none = F.lit(None).cast("binary")
    state = given.select("vec_id", "label", F.transform("vector", integer).alias("whole"), none.alias("old"), none.alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("books"))
    state = store(state, "whole")
    lengths = [r["dims"] for r in state.groupBy(F.size("whole").alias("dims")).count().collect()]
    books = {}
    for dims in lengths:
        first = state.where(F.size("whole") == dims).orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(entries).collect()
        books[dims] = np.array([r["whole"] for r in first], np.int64).reshape(len(first), dims)

    def assigned(books: dict[int, np.ndarray], names: dict[int, str]) -> DataFrame:
        shared = spark.sparkContext.broadcast((books, names))
        return store(state.mapInArrow(_assign(shared, parts), _STATE.format(id=id_type, label=label_type)), "codes")

    sums = spark.createDataFrame([], _SUMS)
    for _ in range(rounds):
        after = assigned(books, dict.fromkeys(books))
        discard(state)
        state = after
        changed = state.where("old is null or old != code").select("whole", "old", "code")
        both = sums.unionByName(changed.mapInArrow(_moves(parts, entries), _SUMS))
        sums = store(both.groupBy("dims", "part", "entry", "place").agg(F.sum("total").alias("total")), "sums")
        books = _moved(books, sums.collect(), parts, entries)
    final = assigned(books, {dims: digest(book, parts) for dims, book in books.items()})
    discard(state)
    final = final.withColumn("tag", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    by_label = store(final.groupBy("tag").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    least = max(1, -(-(by_label.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS))
    rows = final.select("vec_id", F.lower(F.hex("code")).alias("hexed"), "error", "books", "tag")
    out = attach(rows, by_label.select("tag", "label_error"), "tag", by_label.where(F.col("n") >= least).select("tag"))
    return out.select(F.col("vec_id").alias(id_col), F.col("hexed").alias("code"), "error", "label_error", F.col("books").alias("codebooks_sha256"))
