"""Removal of repeated byte strings by threshold-bounded interval expansion on a BWT.

A string of ``length`` bytes that starts in two places is repeated.  Which
places have to be compared is decided by content alone: of the ``anchor``-byte
strings in a window of ``length`` bytes, the one with the smallest hash is the
window's anchor, and equal windows have equal anchors.  A document falls into
segments, the stretches whose windows share an anchor.  Segments meet by
anchor; equal ones collapse to one with a count, and those that occur twice
are repeated as a whole.

Where different segments share an anchor, their bytes are joined to a text of
bounded size, and the expansion runs on its Burrows-Wheeler transform: from
all intervals of a common prefix, backward extension by each preceding byte
gives the intervals of prefixes longer by one, breadth first.  The end of an
interval that is reached for the first time is a border with just that common
prefix, so borders fall in order of length; at ``length`` the expansion stops,
and what is still no border joins suffixes with ``length`` bytes in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import HOT_KEYS, attach, hot_keys
from . import kernels as K
from .store import discard, store

#: Bytes of a repeated string, and of an anchor.
LENGTH, ANCHOR = 200, 64
#: Bytes of a transform, about; different segments of an anchor beyond which they would outgrow one text: their windows are counted one by one, over all tasks.
TEXT_BYTES, HOT = 1 << 20, 8192


def segments(body: np.ndarray, at: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Row, first byte, end byte (in the chunk), anchor hash and content hash of each segment."""
    n = len(body)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    with np.errstate(over="ignore"):
        run = np.empty(n + 1, np.uint64)
        run[0] = 0
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * K._power("p", K._P, n), out=run[1:])
        back = K._power("i", K._P_INV, n)
        value = K.mix64((run[anchor:] - run[:-anchor]) * back[: n - anchor + 1])
        # The least value of each window of anchors, the leftmost of equal ones, by doubling.
        least, place, span, width = value, np.arange(len(value), dtype=np.int32), 1, length - anchor + 1
        while span < width:
            step = min(span, width - span)
            right = least[step:] < least[:-step]
            place = np.where(right, place[step:], place[:-step])
            least = np.minimum(least[:-step], least[step:])
            span += step
        size = np.diff(at)
        windows = np.maximum(size - length + 1, 0)
        base = np.concatenate((np.zeros(1, np.int64), np.cumsum(windows)))
        start = np.arange(base[-1]) + np.repeat(at[:-1] - base[:-1], windows)
        if not len(start):
            return none, none, none, none, none
        mine = place[start]
        new = np.ones(len(start), bool)
        new[1:] = (mine[1:] != mine[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        a = start[first]
        e = start[np.append(first[1:], len(start)) - 1] + length
        p = mine[first].astype(np.int64)
        content = K.mix64((run[e] - run[a]) * back[a] + K.mix64(((e - a) * (1 << 20) + (p - a)).astype(np.uint64)))
    return np.searchsorted(at, a, "right") - 1, a, e, value[p].view(np.int64), content.view(np.int64)


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, body, at in K.chunks(batch.column(2)):
            row, a, e, h, c = segments(body, at)
            take = pa.array(row + i)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), batch.column(1).take(take), pa.array((a - at[row]).astype(np.int32)),
                    pa.array((e - at[row]).astype(np.int32)), pa.array(h), pa.array(c),
                ],
                names=["id", "tag", "a", "e", "h", "c"],
            )


def _dense(key: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys and the rank of each; those ``alone`` share their rank with none.

    They stand by position, so that suffixes up to a separator are in the order
    of their separators whatever their length: expansion relies on one order.
    """
    order = np.argsort(key, kind=None if alone is None else "stable")
    there = key[order]
    new = np.ones(len(key), bool)
    new[1:] = there[1:] != there[:-1]
    if alone is not None:
        new |= alone[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank


def repeated_starts(symbols: np.ndarray, length: int = LENGTH, floor: int = 64) -> np.ndarray:
    """Positions of ``symbols`` (uint8; 0 separates and never matches) at which a string of ``length`` starts that also starts elsewhere."""
    n = len(symbols)
    # Suffixes in order of their first 8 symbols, then of twice as many in each round.
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)
    padded = np.concatenate((symbols, np.zeros(8, np.uint8)))
    for j in range(8):
        here = np.where(alive, padded[j : j + n], 0)
        key = (key << np.uint64(8)) | here.astype(np.uint64)
        alive &= here != 0
    order, rank = _dense(key, ~alive)
    known, seed = 8, None
    while known < length:
        if known == floor:
            seed = rank
        further = np.zeros(n, np.int64)
        further[: n - known] = rank[known:] + 1
        order, rank = _dense(rank * np.int64(n + 1) + further)
        known *= 2
    suffix = order
    of = np.empty(n, np.int64)  # where each suffix stands
    of[suffix] = np.arange(n)
    before = suffix - 1  # the transform: what precedes each suffix
    symbol = np.where(before >= 0, symbols[before], 0)
    goes = np.where(before >= 0, of[before], -1)

    level = seed if seed is not None else rank
    border = np.ones(n + 1, bool)
    border[1:n] = level[suffix[1:]] != level[suffix[:-1]]
    edge = np.flatnonzero(border)
    lo, hi = edge[:-1], edge[1:]
    for _ in range(floor, length):
        if not len(lo):
            break
        size = hi - lo
        parent = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(parent)) + np.repeat(lo - (np.cumsum(size) - size), size)
        use = symbol[at] != 0
        at, parent = at[use], parent[use]
        target = goes[at]
        by = np.argsort(target)
        target, parent, first = target[by], parent[by], symbol[at[by]]
        new = np.ones(len(target), bool)
        new[1:] = (target[1:] != target[:-1] + 1) | (parent[1:] != parent[:-1]) | (first[1:] != first[:-1])
        begin = np.flatnonzero(new)
        if not len(begin):
            break
        child_lo = target[begin]
        child_hi = target[np.append(begin[1:], len(target)) - 1] + 1
        fresh = ~border[child_hi]
        lo, hi = child_lo[fresh], child_hi[fresh]
        border[hi] = True
    joined = np.flatnonzero(~border[1:n]) + 1
    return np.unique(np.concatenate((suffix[joined], suffix[joined - 1])))


def runs(starts: np.ndarray, length: int) -> list[dict]:
    """Stretches of bytes that the strings at the sorted ``starts`` cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    s = starts[np.concatenate(([0], gap + 1))]
    e = starts[np.append(gap, len(starts) - 1)] + length
    return [{"s": int(x), "e": int(y)} for x, y in zip(s, e, strict=True)]


_RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _transforms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, copies, bytes) sorted by h, to (h, c, runs): the repeated stretches of each segment."""

    def work(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        unique = {(h, c): (n, raw) for h, c, n, raw in rows}
        text = np.frombuffer(b"\xff".join([b"", *(raw for _, raw in unique.values()), b""]), np.uint8)
        symbols = text + np.uint8(1)  # UTF-8 has no byte 255: the separators, and they only, are 0 now
        starts = repeated_starts(symbols)
        begin = np.flatnonzero(symbols == 0)[:-1] + 1
        cut = np.searchsorted(starts, np.append(begin, len(symbols)))
        out = []
        for k, (copies, raw) in enumerate(unique.values()):
            found = starts[cut[k] : cut[k + 1]] - begin[k]
            out.append([{"s": 0, "e": len(raw)}] if copies > 1 else runs(found, LENGTH))
        keys = list(unique)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(out, _RUNS)], names=["h", "c", "runs"]
        )

    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if size >= TEXT_BYTES and row[0] != held[-1][0]:
                yield work(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield work(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, copies, bytes) to (w, h, c, s): each window's hash and start."""
    for batch in batches:
        for h, c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            start = np.arange(len(raw) - LENGTH + 1)
            w = K.span_hashes(np.frombuffer(raw, np.uint8), start, start + LENGTH).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w), pa.array(np.full(len(w), h)), pa.array(np.full(len(w), c)), pa.array(start.astype(np.int32))], names=["w", "h", "c", "s"]
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, runs) to (id, n_bytes, n_removed, n_spans, kept_sha256, kept)."""
    for batch in batches:
        total, removed, spans, digest = [], [], [], []
        body, at = K.utf8_rows(batch.column(1))
        for k, found in enumerate(batch.column(2).to_pylist()):
            raw = body[at[k] : at[k + 1]].tobytes()
            kept, end, gone, count = [], 0, 0, 0
            for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                if s > end or not count:
                    kept.append(raw[end:s])
                    count += 1
                    gone += e - s
                    end = e
                elif e > end:
                    gone += e - end
                    end = e
            kept.append(raw[end:])
            total.append(len(raw))
            removed.append(gone)
            spans.append(count)
            digest.append(hashlib.sha256(b"".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (total, removed, spans)), pa.array(digest, pa.string())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, text, runs) of every row: the stretches of its UTF-8 bytes that a repeated string covers (null: none).

    ``tag`` tells rows with one id but different texts apart; equal rows repeat
    each other like any two.  Runs may overlap.
    """
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    cut = store(given.mapInArrow(_segment_rows, f"id {kind}, tag long, a int, e int, h long, c long"), "segments")
    groups = cut.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    groups = store(groups.select("h", "n", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    # an anchor, or a segment, that stands in a share of all texts is looked up by broadcast
    often = max(1, -(-cut.count() // HOT_KEYS))
    met = store(attach(cut, groups, "h", groups.where(F.col("n") >= often).select("h")), "met")
    discard(cut)

    # One segment for all equal ones, with the place of one of them to fetch its bytes.
    place = F.min(F.struct("id", "tag", "a", "e")).alias("at")
    kinds = met.where("mixed").groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), place)
    kinds = kinds.select("h", "c", "copies", F.col("at.id").alias("i"), F.col("at.tag").alias("t"), "at.a", "at.e")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t"))
    fetched = given.join(kinds.hint("shuffle_hash"), same)
    fetched = fetched.select("h", "c", "copies", F.expr("substring(cast(text as binary), a + 1, e - a)").alias("bytes"))
    fetched = store(fetched, "kinds")
    few, found = fetched, None
    crowded = store(fetched.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "crowded")
    if not crowded.isEmpty():
        told = store(attach(fetched, crowded, "h", hot_keys(fetched, "h", fetched.count()), "left"), "kinds")
        few, found = told.where("n is null"), _hot(told.where("n is not null"))
    few = few.select("h", "c", "copies", "bytes").repartition("h").sortWithinPartitions("h")
    settled = few.mapInArrow(_transforms, "h long, c long, runs array<struct<s: int, e: int>>")
    found = store(settled if found is None else settled.unionByName(found), "found")

    whole = F.array(F.struct(F.col("a").alias("s"), F.col("e").alias("e")))
    shifted = F.transform("runs", lambda r: F.struct((F.col("a") + r["s"]).alias("s"), (F.col("a") + r["e"]).alias("e")))
    every = met.where("not mixed").select("id", "tag", whole.alias("runs"))
    key = F.struct("h", "c").alias("hc")
    found = found.select(key, "runs")
    mixed = attach(met.where("mixed").select("id", "tag", "a", key), found, "hc", fetched.where(F.col("copies") >= often).select(key))
    every = every.unionByName(mixed.select("id", "tag", shifted.alias("runs")))
    every = every.select(F.col("id").alias("i"), F.col("tag").alias("t"), F.explode("runs").alias("r")).groupBy("i", "t").agg(F.collect_set("r").alias("runs"))
    return given.join(every.hint("shuffle_hash"), same, "left").select("id", "tag", "text", "runs")


def _hot(hot: DataFrame) -> DataFrame:
    """Repeated stretches of the segments of anchors with too many different ones for one text: their windows are counted by hash."""
    windows = hot.mapInArrow(_windows, "w long, h long, c long, s int")
    twice = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
    some = windows.join(twice, "w").groupBy("h", "c").agg(F.collect_set("s").alias("starts"))
    part = F.transform(F.sort_array("starts"), lambda s: F.struct(s.alias("s"), (s + LENGTH).cast("int").alias("e")))
    once = some.join(hot.where("copies = 1").select("h", "c"), ["h", "c"], "left_semi").select("h", "c", part.alias("runs"))
    full = F.array(F.struct(F.lit(0).alias("s"), F.length("bytes").alias("e")))
    return once.unionByName(hot.where("copies > 1").select("h", "c", full.alias("runs")))


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Every byte covered by a 200-byte string that also starts anywhere else, in
    this document or another, is removed; strings are judged on the input and
    never cross documents.  A null or empty text has 0 bytes and the hash of
    nothing.  Texts of fewer than 200 bytes lose nothing.  Equal rows each
    lose what the other repeats; other columns are ignored.
    """
    found = repeats(docs, id_col, text_col)
    kind = found.schema["id"].dataType.simpleString()
    out = found.select("id", "text", "runs").mapInArrow(_digests, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
