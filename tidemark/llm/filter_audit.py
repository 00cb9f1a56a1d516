"""Filter interaction audit: what each text filter removes, alone, after others, and over all orders.

Texts are read as the byte buffers of their Arrow columns: a table of byte
classes and prefix sums over it count words, capitals and symbols of all rows
at once, and the words' hashes, sorted within each document and verified byte
by byte, give the distinct ones.  A document is then a mask of the filters it
fails.  Masks are counted by part, and every order of the filters follows from
those counts.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import store

#: The filters by letter, in order of their bits.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
#: Bytes of a long text that are looked at together; it is cut between words.
PIECE_BYTES = 1 << 21

_SPACE, _CAPITAL, _SYMBOL, _LATER = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[K.WHITE] |= _SPACE
_CLASS[0x41:0x5B] |= _CAPITAL
_CLASS[list(SYMBOLS)] |= _SYMBOL
_CLASS[0x80:0xC0] |= _LATER  # bytes that continue a code point


def _same_bytes(body: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes at ``a`` and at ``b`` are equal, eight bytes at a time."""
    eight = np.ndarray((len(body) + 1,), "<u8", np.concatenate((body, np.zeros(8, np.uint8))), strides=(1,))
    same = np.ones(len(a), bool)
    on, done = np.arange(len(a)), 0
    while len(on):
        left = size[on] - done
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.clip(left, 0, 7)).astype(np.uint64)) - np.uint64(1))
        equal = ((eight[a[on] + done] ^ eight[b[on] + done]) & mask) == 0
        same[on[~equal]] = False
        done += 8
        on = on[equal & (left > 8)]
    return same


def distinct_words(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """How many different words each row has; ``first`` is the first-word index of each row.

    Equal hashes stand side by side once sorted within a row; neighbours of
    equal hash are compared byte by byte, and a run that is not all alike is
    counted as the set of its words.
    """
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if hashes is None:
        hashes = K.span_hashes(body, starts, ends)
    order = np.lexsort((hashes, rows))
    h, r, s, size = hashes[order], rows[order], starts[order], (ends - starts)[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    at = np.flatnonzero(again)
    alike = (size[at] == size[at - 1]) & _same_bytes(body, s[at], s[at - 1], np.minimum(size[at], size[at - 1]))
    out = np.bincount(r[~again], minlength=len(first) - 1)
    if not alike.all():  # different words of one hash: the whole run is counted by its bytes
        run = np.cumsum(~again) - 1
        for k in np.unique(run[at[~alike]]).tolist():
            mine = np.flatnonzero(run == k)
            words = {body[s[i] : s[i] + size[i]].tobytes() for i in mine}
            out[r[mine[0]]] += len(words) - 1
    return out


def _counts(body: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Per row: words, distinct words, capitals, code points and symbols."""
    kinds = _CLASS[body]
    sums = {}
    for name, bit in (("capitals", _CAPITAL), ("symbols", _SYMBOL), ("later", _LATER)):
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum((kinds & bit) != 0, dtype=np.int64)))
        sums[name] = total[at[1:]] - total[at[:-1]]
    starts, ends, first = K.word_bounds(body, at)
    return {
        "words": np.diff(first),
        "distinct": distinct_words(body, starts, ends, first),
        "capitals": sums["capitals"],
        "points": np.diff(at) - sums["later"],
        "symbols": sums["symbols"],
    }


def _long_counts(body: np.ndarray) -> dict[str, np.ndarray]:
    """The same of one long row, piece by piece; only its different words are held."""
    total = dict.fromkeys(("words", "capitals", "points", "symbols"), 0)
    seen: set[bytes] = set()
    lo = 0
    while lo < len(body):
        hi = min(len(body), lo + PIECE_BYTES)
        while hi < len(body) and not K.WHITE[body[hi]]:  # to the end of the word, block by block
            block = np.flatnonzero(K.WHITE[body[hi : hi + 4096]])
            hi = hi + int(block[0]) if len(block) else min(len(body), hi + 4096)
        piece = body[lo:hi]
        kinds = _CLASS[piece]
        starts, ends, _ = K.word_bounds(piece, np.array([0, len(piece)]))
        total["words"] += len(starts)
        total["capitals"] += int(np.count_nonzero(kinds & _CAPITAL))
        total["symbols"] += int(np.count_nonzero(kinds & _SYMBOL))
        total["points"] += len(piece) - int(np.count_nonzero(kinds & _LATER))
        seen.update(piece.tobytes().split())  # bytes.split() parts at the same six white bytes
        lo = hi
    return {k: np.array([v]) for k, v in (total | {"distinct": len(seen)}).items()}


def failing(count: dict[str, np.ndarray]) -> np.ndarray:
    """Mask of the filters A to D that each row fails."""
    fails = (
        count["words"] < LEAST_WORDS,
        100 * count["distinct"] < LEAST_DISTINCT_PERCENT * count["words"],
        100 * count["capitals"] > MOST_CAPITALS_PERCENT * count["points"],
        count["symbols"] > 0,
    )
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, text) to (id, part, finger, mask, n_words, n_distinct, n_capitals, n_symbols, n_points)."""
    for batch in batches:
        for i, j, body, at in K.chunks(batch.column(2)):
            count = _long_counts(body) if j - i == 1 and len(body) > PIECE_BYTES else _counts(body, at)
            finger = [hashlib.sha256(body[at[k] : at[k + 1]]).digest() for k in range(j - i)]
            columns = [pa.array(count[c].astype(np.int64)) for c in ("words", "distinct", "capitals", "symbols", "points")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(finger, pa.binary()), pa.array(failing(count)), *columns],
                names=["id", "part", "finger", "mask", "n_words", "n_distinct", "n_capitals", "n_symbols", "n_points"],
            )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row: id, part, finger (SHA-256 of the text), mask (bits A to D), n_words, n_distinct, n_capitals, n_symbols, n_points.

    A null text is empty, a null part the empty string.  Repeated rows stay;
    other columns are ignored; texts are read whole.
    """
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), part.alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(_masks, f"id {kind}, part string, finger binary, mask int, n_words long, n_distinct long, n_capitals long, n_symbols long, n_points long")


def part_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of ``mask``; bit E is set for texts that a smaller id has too.

    A label that repeats counts if any of its rows has quality or toxic 1;
    labels without a document are ignored.  A null id is not larger than any,
    nor is another row of the smallest id: neither fails E.
    """
    rows = measure(docs, id_col, text_col, part_col).select("id", "part", "finger", "mask")
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.groupBy(F.col(id_col).alias("of")).agg(flag("quality").alias("is_good"), flag("toxic").alias("is_toxic"))
    rows = rows.join(marks, rows["id"] == marks["of"], "left")
    is_ = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    # rows of an id and a text first: it is the number of those that have the smallest id that does not fail E
    group = ("finger", "mask", "part", "is_good", "is_toxic")
    each = rows.select("id", "finger", "mask", "part", is_("is_good"), is_("is_toxic")).groupBy("id", *group).agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    copies = each.groupBy(*group).agg(F.sum("n").alias("n"), F.min(named).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    copies = store(copies, "copies")
    # copies of a text are as many rows here as they have parts and labels
    least = copies.groupBy(F.col("finger").alias("of")).agg(F.min(F.col("first.id")).alias("least"))
    found = copies.join(least.hint("shuffle_hash"), copies["finger"] == least["of"])
    passes = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    last = 1 << LETTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("mask").alias("m"), passes.alias("k")), F.struct((F.col("mask") + last).alias("m"), (F.col("n") - passes).alias("k"))))
    split = found.select("part", "is_good", "is_toxic", both.alias("e")).where("e.k > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("e.k")).otherwise(0))
    return split.groupBy("part", F.col("e.m").alias("mask")).agg(F.sum("e.k").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each part, order of the five filters and step.

    A part is a value of ``part_col``, null the empty string.  A filter removes
    what fails it and is still there; redundant is what it would have removed
    but an earlier one did; shapley sums what it removes over all 120 orders.
    See ``measure`` and ``part_masks`` for null, empty and repeated rows; no
    documents give no rows.
    """
    masks = part_masks(docs, labels, id_col, text_col, part_col)
    # a state is the set of filters applied before and the one at hand: 80 of them stand for the 600 steps
    states = [(before, k) for k in range(len(LETTERS)) for before in range(1 << len(LETTERS)) if not before >> k & 1]
    state = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(k).alias("at")) for b, k in states]))
    met = masks.withColumn("s", state).select("part", "mask", "n", "good", "toxic", F.col("s.before").alias("before"), F.col("s.at").alias("at"))
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(len(LETTERS))]), F.col("at") + 1)
    fails, earlier = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    orders = math.factorial(len(LETTERS))
    # of the filters that a document fails, each comes first in the same share of all orders
    share = F.element_at(F.array(*[F.lit(orders // max(1, k)) for k in range(len(LETTERS) + 1)]), F.bit_count("mask") + 1)
    add = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0).cast("long"))
    by_state = met.groupBy("part", "before", "at").agg(
        add(~fails & ~earlier).alias("kept"),
        add(fails & ~earlier).alias("removed"),
        add(fails & earlier).alias("redundant"),
        add(F.col("mask") == bit).alias("unique_fails"),
        add(fails & ~earlier, "good").alias("good_lost"),
        add(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share).otherwise(0).cast("long")).alias("shapley"),
    )
    # the steps of all orders, by their state
    steps: dict[tuple[int, int], list[tuple[str, int]]] = {s: [] for s in states}
    for order in itertools.permutations(range(len(LETTERS))):
        for k, at in enumerate(order):
            steps[sum(1 << x for x in order[:k]), at].append(("".join(LETTERS[x] for x in order), k + 1))
    listed = docs.sparkSession.createDataFrame([(b, k, o, n) for (b, k), mine in steps.items() for o, n in mine], "b int, k int, filter_order string, step int")
    out = by_state.join(F.broadcast(listed), (F.col("before") == F.col("b")) & (F.col("at") == F.col("k")))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
