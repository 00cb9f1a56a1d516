"""Vectorised numpy kernels over Arrow string columns.

Every function here works on a *chunk*: the UTF-8 bytes of some rows laid end
to end, with row offsets.  Nothing ever crosses a row border.  Rows are never
cut; a chunk holds whole rows and is as large as its longest row needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls and grown by doubling."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, base, np.uint64))))
        _powers[which] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def utf8_rows(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets) with about ``limit`` bytes, whole rows only."""
    body, at = utf8_rows(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, body[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def separator_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


#: ``[^\x20\x09-\x0D]+`` are the words.
WHITE = separator_table(bytes([0x20, *range(0x09, 0x0E)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_bounds(body: np.ndarray, at: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and first-word index of each row (len rows + 1)."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~separators[body]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    rows = at[:-1][at[:-1] < at[1:]]
    start[rows] = inside[rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = at[1:][at[:-1] < at[1:]] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, at)


_G = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Lanes of eight bytes that all spans are hashed by together; what a longer span has beyond is summed up by itself.
_LANES = 4


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span body[start:end]: equal bytes, equal hash.

    Lanes of eight bytes are mixed one by one, each with its place, and added
    up; nothing is linear in the bytes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((body, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(body) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts

    def lane(at: np.ndarray, left: np.ndarray, place) -> np.ndarray:
        return mix64((eight[at] & _MASKS[np.minimum(left, 8)]) + place * _G)

    with np.errstate(over="ignore"):
        total = lane(starts, size, np.uint64(1))
        for k in range(1, _LANES):
            on = np.flatnonzero(size > 8 * k)
            if not len(on):
                break
            total[on] += lane(starts[on] + 8 * k, size[on] - 8 * k, np.uint64(k + 1))
        long = np.flatnonzero(size > 8 * _LANES)
        if len(long):
            many = (size[long] + 7) // 8 - _LANES
            first = np.cumsum(many) - many
            place = np.arange(many.sum()) - np.repeat(first, many) + _LANES
            parts = lane(np.repeat(starts[long], many) + 8 * place, np.repeat(size[long], many) - 8 * place, (place + 1).astype(np.uint64))
            total[long] += np.add.reduceat(parts, first)
        return mix64(total + size.astype(np.uint64))


def word_hashes(body: np.ndarray, at: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and the first-word index of each row."""
    low = LOWER[body]
    s, e, first = word_bounds(low, at, separators)
    return span_hashes(low, s, e), first


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a row, and the first-gram index of each row.

    A row of fewer than ``n`` words has none here.
    """
    count = np.diff(first)
    grams = np.maximum(count - n + 1, 0)
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(out)]
    index = np.concatenate(([0], np.cumsum(grams)))
    keep = np.arange(index[-1]) + np.repeat(first[:-1] - index[:-1], grams)
    return mix64(out[keep]), index


def shingle_sets(body: np.ndarray, at: np.ndarray, n: int, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles of each row as hashes, and the first index of each row.

    A row with 1 to n-1 words has its whole sequence as its one shingle; a row
    without words has none.
    """
    words, first = word_hashes(body, at, separators)
    grams, index = gram_hashes(words, first, n)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(index))
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n - 1):
                has = count[short] > k
                whole[has] = whole[has] * np.uint64(0xD6E8FEB86659FD93) + words[first[short[has]] + k]
            whole = mix64(whole + count[short].astype(np.uint64))
        grams, rows = np.concatenate((grams, whole)), np.concatenate((rows, short))
    # Sorting by value and then stably by row would sort twice; rows come in order
    # but for the short ones, so each row is sorted by one key of row and value.
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    grams, rows = grams[new], rows[new]
    return grams, np.searchsorted(rows, np.arange(len(at)))


def code_points(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all rows, row offsets in them, and the byte at which each begins (one more at the end)."""
    lead = np.flatnonzero((body & 0xC0) != 0x80)
    points = np.frombuffer(body.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.searchsorted(lead, at), np.append(lead, len(body))
