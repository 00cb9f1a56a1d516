"""Tokens of a byte-level vocabulary: counts, and cuts that end with a token (section 2.10 #22, #27)."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: How a text is parted before its bytes are merged; each vocabulary has its own.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_made: dict[str, tiktoken.Encoding] = {}


def encoding(ranks: dict[bytes, int], pattern: str = PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def cut(known: tiktoken.Encoding, text: str, most: int) -> str:
    """The longest prefix that ends with one of the first ``most`` tokens of a text and has no more than ``most`` by itself.

    A prefix is parted and merged anew, and a token may hold a part of a
    character, so not every token is an end: these are left out one by one.
    """
    tokens = known.encode_ordinary(text)
    if len(tokens) <= most:
        return text
    body = known.decode_bytes(tokens[: max(0, most)])
    for k in range(most, 0, -1):
        try:
            prefix = body.decode()
        except UnicodeDecodeError:
            prefix = None
        if prefix is not None and len(known.encode_ordinary(prefix)) <= most:
            return prefix
        body = body[: len(body) - len(known.decode_single_token_bytes(tokens[k - 1]))]
    return ""


@dataclass
class Vocabulary:
    """A merge table that the executors get once, by broadcast (some MB, whatever the data); ``load`` reads it on the driver."""

    spark: SparkSession
    ranks: dict[bytes, int]
    pattern: str = PATTERN
    _shared: object = field(init=False)
    _name: str = field(init=False)

    def __post_init__(self) -> None:
        self._name = uuid.uuid4().hex
        self._shared = self.spark.sparkContext.broadcast((self.ranks, self.pattern))

    @classmethod
    def load(cls, spark: SparkSession, path: str, pattern: str = PATTERN) -> Vocabulary:
        return cls(spark, read_ranks(path), pattern)

    def _each(self, work: Callable[[tiktoken.Encoding, str], object], kind: str, text: Column) -> Column:
        shared, name = self._shared, self._name

        def run(texts: pd.Series) -> pd.Series:
            if name not in _made:  # once a worker
                _made[name] = encoding(*shared.value)
            known = _made[name]
            return pd.Series([work(known, t) if isinstance(t, str) else None for t in texts], dtype=object)

        return F.pandas_udf(run, kind)(text)

    def count(self, text: Column) -> Column:
        """Tokens of a text; null has none.  Strings of special tokens are ordinary text."""
        return F.coalesce(self._each(lambda known, t: len(known.encode_ordinary(t)), "long", text), F.lit(0).cast("long"))

    def first(self, text: Column, most: int) -> Column:
        """A text cut to ``most`` tokens (see ``cut``); null stays null."""
        return self._each(lambda known, t: cut(known, t, most), "string", text)
