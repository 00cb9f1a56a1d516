"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the test items are looked up in the training documents.  A
passage of a document with a seed is aligned with the item word by word, so
that copies with replaced, added or dropped words still score.  Passages that
hold too few of the item's words to reach the least score, as those that meet
it in a common phrase do, are not aligned; that loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import store
from .licenses import SEPARATORS

#: Words of a seed; least score.
SEED_WORDS, LEAST = 4, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of test items that go to the executors at once (8 bytes each, and as much for n-grams); more items take further passes.
SLICE_WORDS = 1 << 21
_FILTER_BITS = 22
#: Pairs, and words of all their texts, that are aligned at once; a longer text goes alone.
_ALIGN, _ALIGN_WORDS = 512, 1 << 19


@dataclass
class Index:
    """Test items: word hashes with offsets, and their n-grams sorted by hash."""

    items: list[int]
    words: np.ndarray
    first: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray

    @classmethod
    def build(cls, ids: list[int], texts: pa.Array) -> Index:
        body, at = K.utf8_rows(texts)
        words, first = K.word_hashes(body, at, SEPARATORS)
        gram, index = K.gram_hashes(words, first, SEED_WORDS)
        item = np.repeat(np.arange(len(ids)), np.diff(index))
        place = np.arange(len(gram)) - index[item]
        order = np.argsort(gram, kind="stable")
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[gram >> np.uint64(64 - _FILTER_BITS)] = True
        return cls(ids, words, first, gram[order], item[order], place[order], bits)


def passages(index: Index, body: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, item, first word, words) of stretches that share n-grams with an item.

    An alignment that scores half of its item or more spans at most twice the
    item's words.  Longer stretches, as where a text repeats an item, come as
    windows of four times the item, every two times the item: each such
    alignment lies in one.
    """
    words, first = K.word_hashes(body, at, SEPARATORS)
    gram, of_row = K.gram_hashes(words, first, SEED_WORDS)
    met = np.flatnonzero(index.filter[gram >> np.uint64(64 - _FILTER_BITS)])
    if not len(met) or not len(index.gram):
        return
    lo, hi = np.searchsorted(index.gram, gram[met], "left"), np.searchsorted(index.gram, gram[met], "right")
    met, lo, hi = met[hi > lo], lo[hi > lo], hi[hi > lo]
    times = hi - lo
    entry = np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
    row = np.repeat(np.searchsorted(of_row, met, "right") - 1, times)
    word = np.repeat(met, times) - of_row[row]
    item = index.item[entry]
    order = np.lexsort((word, item, row))
    row, word, item, entry = row[order], word[order], item[order], entry[order]
    size = np.diff(index.first)[item]
    cut = np.ones(len(row), bool)
    cut[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (word[1:] - word[:-1] > size[1:])
    edge = np.append(np.flatnonzero(cut), len(row))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        begin = word[a:b] - index.place[entry[a:b]]
        pad = int(size[a]) // 4 + 2
        lo_word = max(0, int(begin.min()) - pad)
        hi_word = min(int(first[row[a] + 1] - first[row[a]]), int(begin.max() + size[a]) + pad)
        stride = 2 * max(1, int(size[a]))
        for at_word in range(lo_word, max(lo_word + 1, hi_word - stride), stride):
            to = min(hi_word, at_word + 2 * stride)
            yield int(row[a]), int(item[a]), at_word, words[first[row[a]] + at_word : first[row[a]] + to]


def reachable(item: np.ndarray, text: np.ndarray, least: float) -> bool:
    """Whether an alignment can score ``least``: each matched word takes one occurrence in both, and edits only cost."""
    kinds, many = np.unique(item, return_counts=True)
    spot = np.minimum(np.searchsorted(kinds, text), len(kinds) - 1)
    held = np.bincount(spot[kinds[spot] == text], minlength=len(kinds))
    return int(np.minimum(many, held).sum()) / len(item) >= least


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its text, and where in the text it ends (exclusive).

    All pairs advance together, one item word a step; a gap along the text is a
    running maximum.
    """
    n = len(items)
    wide = max(map(len, texts))
    text = np.zeros((n, wide), np.uint64)
    real = np.zeros((n, wide), bool)
    for k, t in enumerate(texts):
        text[k, : len(t)] = t
        real[k, : len(t)] = True
    tall = max(map(len, items))
    item = np.zeros((n, tall), np.uint64)
    length = np.array([len(x) for x in items])
    for k, x in enumerate(items):
        item[k, : len(x)] = x
    slope = np.arange(wide, dtype=np.int32) * -GAP
    row = np.zeros((n, wide + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for step in range(tall):
        same = (text == item[:, step : step + 1]) & real
        new = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        new[step >= length] = 0
        row[:, 1:] = new
        top = new.argmax(axis=1)
        value = new[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
    return best, end


def _groups(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of texts of like length, so many as can be aligned at once."""
    group: list[int] = []
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        if group and (len(group) == _ALIGN or (len(group) + 1) * len(texts[k]) > _ALIGN_WORDS):
            yield group
            group = []
        group.append(k)
    if group:
        yield group


def _search(shared, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        ids = np.array([x if x is not None else 0 for x in index.items], np.int64)
        null = np.array([x is None for x in index.items], bool)
        for batch in batches:
            for i, _, body, at in K.chunks(batch.column(1)):
                met = [(r, k, lo, text, index.words[index.first[k] : index.first[k + 1]]) for r, k, lo, text in passages(index, body, at)]
                out = [x for x in met if reachable(x[4], x[3], least)]
                for group in _groups([x[3] for x in out]):
                    row, item, begin = (np.array([out[k][c] for k in group]) for c in range(3))
                    best, end = align([out[k][4] for k in group], [out[k][3] for k in group])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(i + row)),
                            pa.array(ids[item], mask=null[item]),
                            pa.array(best / (MATCH * np.diff(index.first)[item])),
                            pa.array(begin, pa.int32()),
                            pa.array(begin + end, pa.int32()),
                        ],
                        names=["id", "item_id", "score", "word_start", "word_end"],
                    )

    return run


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_words: int) -> Iterator[tuple[list[int], pa.Array]]:
    """Items in id order, in slices of about ``slice_words`` words; a slice alone is ever on the driver."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(1, -(-total // (slice_words * 4)))
    for k in range(many):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k).orderBy("item", "text").toArrow()
        if part.num_rows:
            yield part.column(0).to_pylist(), part.column(1).combine_chunks()


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    least: float = LEAST,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """(id_col, item_id, score, word_start, word_end), one row for a document and an item it contains.

    score is the best local alignment over that of the whole item (1: a full
    copy), at least ``least``; the words are those of the stretch that was
    aligned up to the alignment's end, A-Z lower-cased, ASCII punctuation
    aside.  Null and empty texts and items of fewer than four words match
    nothing; items without an id have a null one; repeated documents of one id
    give one row for an item, the best.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = given.schema["id"].dataType.simpleString()
    out = None
    for ids, texts in _slices(benchmark, item_col, item_text_col, slice_words):
        index = Index.build(ids, texts)
        shared = spark.sparkContext.broadcast(index)
        scored = given.mapInArrow(_search(shared, least), f"id {kind}, item_id long, score double, word_start int, word_end int")
        scored = store(scored.where(F.col("score") >= least), "aligned")
        shared.destroy()
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return spark.createDataFrame([], f"{id_col} {kind}, item_id long, score double, word_start int, word_end int")
    best = F.max_by(F.struct("word_start", "word_end"), F.struct("score", -F.col("word_start"))).alias("at")
    out = out.groupBy("id", "item_id").agg(F.max("score").alias("score"), best)
    return out.select(F.col("id").alias(id_col), "item_id", "score", "at.word_start", "at.word_end")
