"""Partial-ratio search (section 2.5 #6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _common(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each window b[s : s + len(a)], all windows at once.

    The bits of a word stand for up to 64 characters of ``a``; a longer one has
    several words, and the carry of each goes to the next.
    """
    size = len(a)
    letters, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    code_a, code_b = code[:size], code[size:]
    words = -(-size // 64)
    where = np.zeros((words, len(letters) + 1), np.uint64)
    for k, c in enumerate(code_a):
        where[k // 64, c] |= np.uint64(1) << np.uint64(k % 64)
    padded = np.full(len(b) + 2 * size, len(letters), np.int64)
    padded[size : size + len(b)] = code_b
    state = np.full((words, len(starts)), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(size):
        letter = padded[starts + size + j]
        carry = np.zeros(len(starts), np.uint64)
        for w in range(words):
            v = state[w]
            u = v & where[w, letter]
            total = v + u
            over = total < v
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            state[w] = total | (v & ~u)
    zeros = np.zeros(len(starts), np.int64)
    for w in range(words):
        bits = min(64, size - 64 * w)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(64 - bits)
        zeros += np.bitwise_count(~state[w] & mask)
    return zeros


def partial_ratio(query: str, text: str) -> float:
    """100 times the best similarity 2 * common / (sum of lengths) of the shorter string with a window of the longer.

    Windows have the shorter one's length, and less at either end.  0 if one is empty and the other isn't.
    """
    short, long = sorted((query, text), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    a, b = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (short, long))
    starts = np.arange(1 - len(a), len(b))
    lengths = np.minimum(starts + len(a), len(b)) - np.maximum(starts, 0)
    return float((200.0 * _common(a, b, starts) / (len(a) + lengths)).max())


#: Scores at which a search stops looking for more rows, the best first, and characters that a piece needs to leave many rows out.
LEVELS, PIECE = (95.0, 89.0), 4


def seeds(query: str, least: float) -> list[str]:
    """Pieces of the query of which a window scoring ``least`` holds one.

    Such a window lacks or adds at most 2 * n * (1 - least / 100) characters in
    all, each of which breaks one piece; of one piece more, one is whole.
    """
    n = len(query)
    pieces = min(n, int(2 * n * (1 - least / 100) + 1e-9) + 1)
    cuts = [n * k // pieces for k in range(pieces + 1)]
    return sorted({query[a:b] for a, b in zip(cuts, cuts[1:], strict=False)})


def fuzzy(df: DataFrame, field: str, query: str, key: str, limit: int | None = 10) -> DataFrame:
    """``df`` with score, the best first, ties by key; a null text scores 0.

    With a limit, rows that can't reach a level are left to Spark's ``contains``
    (see ``seeds``) and only the others scored; when enough rows reach it, the
    answer is complete, else the next level is tried, and at last all rows.
    """
    low = query.lower()

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(lambda t: 0.0 if t is None else partial_ratio(low, t.lower())).astype(float)

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", score(F.col(field)))

    order = [F.desc("score"), F.col(key).asc_nulls_last()]
    if limit is None or not low:
        out = ranked(df).orderBy(*order)
        return out if limit is None else out.limit(limit)
    text = F.lower(F.col(field))
    for least in LEVELS:
        parts = seeds(low, least)
        if min(map(len, parts)) < PIECE:
            break
        # a text shorter than the query is the one that is looked for, so it always counts
        near = F.length(text) < len(low)
        for part in parts:
            near = near | F.contains(text, F.lit(part))
        found = stored(ranked(df.where(near)).where(F.col("score") >= least), "fuzzy")
        if found.limit(limit).count() >= limit:
            return found.orderBy(*order).limit(limit)
    return ranked(df).orderBy(*order).limit(limit)
