"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol a byte.  Adjacent pairs wait in a heap by
rank; the lowest is popped, its two symbols become one in a linked list, and
the two new neighbours are pushed.  The count is the number of initial symbols
minus the number of merges: no identifier is ever emitted.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Pre-tokens whose counts a worker keeps; beyond it the memory starts anew.
REMEMBERED = 1 << 20

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """Letter, number, white space or other for each code point."""
    table = np.full(0x110000, _OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    index = np.array(points)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[index[m.start() : m.end()]] = kind
    return table


def pretoken_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code-point positions at which a pre-token begins, rows apart.

    Runs of letters, of numbers and of others, each with one space before it if
    there is one; white space otherwise, its last character left to what
    follows; and the endings 's 't 'm 'd 're 've 'll where an apostrophe begins
    a run.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    opens = np.zeros(n, bool)
    opens[at[:-1][at[:-1] < n]] = True
    # a character goes on with the one before if it has the same class
    start = opens.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = np.ones(n, bool)  # last of its row
    last[:-1] = opens[1:]
    # a white-space character before something visible stands alone
    lone = space & ~last
    lone[:-1] &= ~space[1:]
    lone[-1] = False
    start |= lone
    # and a plain space there belongs to what follows
    joins = np.flatnonzero(lone & (points == 0x20)) + 1
    start[joins] = False
    quote = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & ~last[:-1])
    if len(quote):
        padded = np.concatenate((points, np.zeros(3, points.dtype)))
        ends = np.concatenate((last, np.ones(3, bool)))
        one = np.isin(padded[quote + 1], [ord(c) for c in "stmd"])
        a, b = padded[quote + 1], padded[quote + 2]
        two = ~ends[quote + 1] & ((((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for hit, size in ((one, 2), (two & ~one, 3)):
            q = quote[hit]
            start[q + 1] = False
            after = q + size
            after = after[(after < n)]
            # what follows begins a new one unless a space was to join it (then it begins already)
            start[after] = True
    return np.flatnonzero(start)


class Merges:
    """Ranked merges of a byte-level vocabulary file."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
        if model["type"] != "BPE" or any(model.get(k) not in (v, None, "", False) for k, v in plain.items()):
            raise ValueError("only plain byte-pair models are counted")
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level pre-tokenization without a prefix space is counted")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options are not counted")
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        # byte-level alphabets show the printable Latin-1 bytes as themselves and the others from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        names = {}
        for letter, b in byte_of.items():
            names[letter] = b
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[names[left] << 20 | names[right]] = k
            self.made.append(names.setdefault(left + right, len(names)))
        self.memory: dict[int, int] = {}

    def count(self, word: bytes) -> int:
        """Symbols that are left of ``word`` after all merges."""
        n = len(word)
        symbol = list(word)
        rank, made = self.rank, self.made
        waits = [-1] * n  # rank of the pair that begins here
        heap = []
        for i in range(n - 1):
            if (r := rank.get(symbol[i] << 20 | symbol[i + 1])) is not None:
                waits[i] = r
                heap.append(r << 32 | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            top = heapq.heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if waits[i] != r:
                continue  # one of the two was merged meanwhile
            j = after[i]
            symbol[i] = made[r]
            waits[j] = -1
            left -= 1
            k = after[i] = after[j]
            waits[i] = -1
            if k < n:
                before[k] = i
                if (r := rank.get(symbol[i] << 20 | symbol[k])) is not None:
                    waits[i] = r
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                waits[h] = -1
                if (r := rank.get(symbol[h] << 20 | symbol[i])) is not None:
                    waits[h] = r
                    heapq.heappush(heap, r << 32 | h)
        return left

    def counts(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each row of a chunk, added tokens aside."""
        points, rows, begins = K.code_points(body, at)
        start = pretoken_starts(points, rows)
        lo = begins[start]
        hi = np.append(lo[1:], len(body))
        # rows end pre-tokens too, as each row's first character begins one
        name = K.span_hashes(body, lo, hi).view(np.int64)
        names, first, back = np.unique(name, return_index=True, return_inverse=True)
        known = self.memory
        if len(known) + len(names) > REMEMBERED:
            known.clear()
        raw = body.tobytes()
        each = np.empty(len(names), np.int64)
        for k, (w, f) in enumerate(zip(names.tolist(), first.tolist(), strict=True)):
            if (c := known.get(w)) is None:
                c = known[w] = self.count(raw[lo[f] : hi[f]])
            each[k] = c
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(each[back])))
        edge = np.searchsorted(start, rows)
        return total[edge[1:]] - total[edge[:-1]]


_loaded: dict[bytes, Merges] = {}


def _counter(blob) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        name = hashlib.sha256(blob.value).digest()
        if name not in _loaded:  # a reused worker keeps its merges and what it has counted
            _loaded.clear()
            _loaded[name] = Merges(blob.value)
        merges = _loaded[name]
        for batch in batches:
            for i, j, body, at in K.chunks(batch.column(1)):
                tokens, inner = np.zeros(j - i, np.int64), None
                if merges.added is not None:
                    raw = body.tobytes().decode("utf-8", "surrogatepass")
                    if merges.added.search(raw):
                        inner = _split(merges.added, body, at)
                if inner is None:
                    tokens += merges.counts(body, at)
                else:
                    parts, cut, owner, found = inner
                    tokens += np.bincount(owner, merges.counts(parts, cut), j - i).astype(np.int64) + found
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(tokens)], names=["id", "n_bytes", "n_tokens"]
                )

    return run


def _split(added, body: np.ndarray, at: np.ndarray):
    """The rows cut at their added tokens: bytes, offsets, row of each part, added tokens of each row."""
    parts, owner, found = [], [], np.zeros(len(at) - 1, np.int64)
    for k in range(len(at) - 1):
        text = body[at[k] : at[k + 1]].tobytes().decode("utf-8", "surrogatepass")
        pieces = added.split(text)
        found[k] = len(pieces) - 1
        parts += [p.encode("utf-8", "surrogatepass") for p in pieces]
        owner += [k] * len(pieces)
    cut = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(p) for p in parts])))
    return np.frombuffer(b"".join(parts), np.uint8), cut, np.array(owner), found


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 1024
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is the path, on the driver, of a byte-level BPE file in the
    JSON layout; its bytes go to the executors (a file of a megabyte or two).
    Counts are those of its library without begin and end tokens; the strings
    of added tokens inside a text count one each, as by default there.  A null
    or empty text has 0 bytes and 0 tokens.  Repeated rows and ids stay; other
    columns are ignored.
    """
    with open(vocabulary, "rb") as file:
        data = file.read()
    Merges(data)  # refuse on the driver what can't be counted
    blob = docs.sparkSession.sparkContext.broadcast(data)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    out = given.mapInArrow(_counter(blob), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
