"""Weighted full-text search with cover-density rank (section 2.5 #4)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import STOP_WORDS, stem
from ..session import stored
from .search import contains

#: Weights of the classes A to D, and the fields of each store in that order.
WEIGHTS = (1.0, 0.4, 0.2, 0.1)
FIELDS = {
    "episodic": ("summary", "details", "actor", "event_type"),
    "semantic": ("name", "summary", "details", "source"),
    "resource": ("title", "summary", "content", "resource_type"),
    "procedural": ("summary", "steps", "entry_type"),
    "vault": ("caption", "secret_value"),
}
_WORD = re.compile(r"[^\W_]+")


def lexemes(query: str) -> list[tuple[str, bool]]:
    """(stem, prefix too) of the query's words: one-letter words go, words of three letters or more match as prefixes."""
    out = []
    for word in _WORD.findall(query.lower()):
        if len(word) > 1 and word not in STOP_WORDS:
            out.append((stem(word), len(word) >= 3))
    return list(dict.fromkeys(out))


def positions(fields: Sequence[str | None]) -> list[tuple[str, float]]:
    """(stem, weight) at each position, fields one after another; stop words keep their place as ''."""
    out = []
    for text, weight in zip(fields, WEIGHTS, strict=False):
        for word in _WORD.findall((text or "").lower()):
            out.append(("" if word in STOP_WORDS else stem(word), weight))
    return out


def cover_rank(places: list[tuple[str, float]], query: list[tuple[str, bool]], need_all: bool) -> float:
    """Cover density (Clarke, Cormack and Tudhope): shortest stretches with all terms (any term: each hit), each
    worth its weights over its slack, then r / (r + 1).
    """
    hits = [(k, t, w) for k, (word, w) in enumerate(places) if word for t, (lexeme, prefix) in enumerate(query) if word == lexeme or (prefix and word.startswith(lexeme))]
    if not hits or (need_all and len({t for _, t, _ in hits}) < len(query)):
        return 0.0
    need = len(query) if need_all else 1
    rank, lo = 0.0, 0
    seen: dict[int, int] = {}
    for hi, (_, term, _) in enumerate(hits):
        seen[term] = seen.get(term, 0) + 1
        while len(seen) >= need and lo <= hi:
            first = hits[lo][1]
            if seen[first] == 1 and len(seen) == need or lo == hi:
                span = hits[lo : hi + 1]
                slack = hits[hi][0] - hits[lo][0] - (len({k for k, _, _ in span}) - 1)
                rank += len(span) / sum(1 / w for _, _, w in span) / (1 + slack)
            seen[first] -= 1
            if not seen[first]:
                del seen[first]
            lo += 1
    return rank / (rank + 1)


def _begins(terms: Sequence[tuple[str, bool]]) -> str:
    """A pattern of words that may match a term.  Stemming leaves all but the last letters of a stem as they are in the word: three at most differ."""
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(lexeme[: max(1, len(lexeme) - 3)]) for lexeme, _ in terms) + ")"


def search(df: DataFrame, fields: Sequence[str], query: str, created: str, key: str, limit: int | None = 50) -> DataFrame:
    """``df`` with score: rows with all terms if there are enough of them, else rows with any term, the best first.

    Enough is the smaller of ten and the limit.  One scan: rows in which no
    word begins like a term are dropped before Python sees them, ranks of both
    kinds are computed side by side for the others and those above zero kept;
    a count of them decides.  A query without words falls back to contains.
    """
    terms = lexemes(query)
    if not terms:
        return contains(df, fields[0], query, created, key, limit).withColumn("score", F.lit(0.0))
    columns = [F.col(f) if dict(df.dtypes)[f] == "string" else F.array_join(f, " ") for f in fields]

    @F.pandas_udf("every double, some double")
    def ranks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [positions(r) for r in part.itertuples(index=False)]
            yield pd.DataFrame({"every": [cover_rank(p, terms, True) for p in rows], "some": [cover_rank(p, terms, False) for p in rows]})

    likely = F.lower(F.concat_ws(" ", *columns)).rlike(_begins(terms))
    ranked = df.where(likely).withColumn("_rank", ranks(F.struct(*(c.alias(f"f{k}") for k, c in enumerate(columns)))))
    found = stored(ranked.where((F.col("_rank.every") > 0) | (F.col("_rank.some") > 0)), "ranked")
    full = found.where(F.col("_rank.every") > 0).limit(min(limit or 10, 10)).count() >= min(limit or 10, 10)
    out = found.withColumn("score", F.col("_rank.every" if full else "_rank.some")).where(F.col("score") > 0).drop("_rank")
    out = out.orderBy(F.desc("score"), F.col(created).desc_nulls_last(), F.col(key).desc_nulls_last())
    return out if limit is None else out.limit(limit)


def store_search(df: DataFrame, store: str, query: str, field: str | None = None, limit: int | None = 50) -> DataFrame:
    """A store's search in its fields by weight, or in one field."""
    return search(df, [field] if field else [f for f in FIELDS[store] if f in df.columns], query, "created_at", "id", limit)
