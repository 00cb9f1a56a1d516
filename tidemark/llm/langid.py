"""Language identification: multinomial naive Bayes over hashed character n-grams.

A feature is a letter with its two neighbours, anything but a letter counting
as a space; it is hashed into one of 2**BITS buckets.  The matrix of
log-probabilities (buckets by languages) goes to the executors once and scores
whole batches with numpy.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BITS = 16
#: About as many labelled documents are drawn, by hash of their text, to fit the model.
TRAIN_DOCS = 20_000
SMOOTHING = 0.5
UNKNOWN = "und"


@functools.cache
def _fold() -> np.ndarray:
    """Lower-cased letter for each code point, 32 for anything else."""
    table = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def features(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all rows, and the first of each row."""
    points, rows, _ = K.code_points(body, at)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    here = _fold()[points]
    before = np.concatenate((np.full(1, 0x20, np.uint32), here[:-1]))
    after = np.concatenate((here[1:], np.full(1, 0x20, np.uint32)))
    inner = rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] < n)]
    before[inner] = 0x20
    after[inner - 1] = 0x20
    letters = np.flatnonzero(here != 0x20)
    with np.errstate(over="ignore"):
        mixed = before[letters] * np.uint32(0x9E3779B1) + here[letters] * np.uint32(0x85EBCA77) + after[letters] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(letters, rows)


@dataclass
class Model:
    """languages in code-point order; weight[bucket, language] are log-probabilities, prior those of the languages."""

    languages: list[str]
    weight: np.ndarray
    prior: np.ndarray

    def score(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language of each row (-1: no letters or no model) and its posterior probability."""
        bucket, first = features(body, at)
        rows, kinds = len(at) - 1, len(self.languages)
        best, sure = np.full(rows, -1), np.zeros(rows)
        if not kinds or not len(bucket):
            return best, sure
        total = np.tile(self.prior, (rows, 1))
        step = max(1, (1 << 22) // kinds)
        owner = np.repeat(np.arange(rows), np.diff(first))
        for lo in range(0, len(bucket), step):
            part, own = bucket[lo : lo + step], owner[lo : lo + step]
            cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            total[own[cut]] += np.add.reduceat(self.weight[part], cut, axis=0, dtype=np.float64)
        some = np.diff(first) > 0
        best[some] = total[some].argmax(axis=1)
        odds = np.exp(total[some] - total[some].max(axis=1, keepdims=True))
        sure[some] = 1 / odds.sum(axis=1)
        return best, sure


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang) to summed (lang, bucket, n); bucket -1 counts documents."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column(1).to_pylist(), dtype=object)
        for i, j, body, at in K.chunks(batch.column(0)):
            bucket, first = features(body, at)
            owner = np.repeat(np.arange(j - i), np.diff(first))
            for name in sorted(set(lang[i:j])):
                mine = lang[i:j] == name
                have = sums.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))
                have[:-1] += np.bincount(bucket[mine[owner]], minlength=1 << BITS)
                have[-1] += mine.sum()
    for name, have in sums.items():
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at)), pa.array(np.where(at == 1 << BITS, -1, at).astype(np.int32)), pa.array(have[at])], names=["lang", "bucket", "n"]
        )


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on about ``train_docs`` of the rows with a text and a language, drawn by hash of the text (all, if fewer)."""
    given = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    rows = labelled.where(F.col(lang_col).isNotNull()).count()
    share = min(1.0, train_docs / max(1, rows))
    drawn = given.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counted = drawn.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (counted.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    languages = sorted(set(lang))
    row = np.searchsorted(np.array(languages, dtype=object), lang) if languages else np.zeros(0, int)
    seen = np.zeros((1 << BITS, len(languages)))
    docs = np.zeros(len(languages))
    word = bucket >= 0
    seen[bucket[word], row[word]] = n[word]
    docs[row[~word]] = n[~word]
    seen += SMOOTHING
    with np.errstate(divide="ignore"):
        return Model(languages, np.log(seen / seen.sum(axis=0)).astype(np.float32), np.log(docs / max(1, docs.sum())))


def _predict(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.value.languages, UNKNOWN], dtype=object)
        for batch in batches:
            text, others = batch.column(0), batch.columns[1:]
            for i, j, body, at in K.chunks(text):
                best, sure = model.value.score(body, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[best], pa.string()), pa.array(sure), *(c.slice(i, j - i) for c in others)],
                    names=["lang_pred", "score", *batch.schema.names[1:]],
                )

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``keep`` with lang_pred and score (the posterior probability of lang_pred).

    A null text, one without letters, or a model without languages gives
    ``und`` with score 0.  The whole text counts, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [docs[c] for c in (keep or [])]
    renamed = [c.alias(f"c{k}") for k, c in enumerate(kept)]
    given = docs.select(docs[text_col].alias("text"), *renamed)
    fields = "".join(f", c{k} {given.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(kept)))
    out = given.mapInArrow(_predict(shared), f"lang_pred string, score double{fields}")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(keep or [])), "lang_pred", "score")


def held_out(id_col: str | Column = "doc_id", fold: int = 2) -> Column:
    """Whether crc32 of the id as text, modulo 4, is ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == fold, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred and score of every row; learned from the rows that are not held out.

    Repeated rows stay; other columns are ignored; an empty table gives none.
    """
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    out = predict(docs, model, text_col, [id_col])
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
