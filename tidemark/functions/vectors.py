"""Vector functions (sections 2.5 #5, 2.10, 2.12 #1)."""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DIMS = 4096


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a null vector, a zero norm or lengths that differ."""
    fits = F.size(a) == F.size(b)
    return F.when(fits, 1 - F.try_divide(dot(a, b), norm(a) * norm(b)))


def distance_to(v: Column, query: list[float]) -> Column:
    """``cosine_distance`` to one vector, a single array literal whose norm is known beforehand."""
    length = math.sqrt(math.fsum(x * x for x in query))
    whole = F.lit(query) if query else F.array().cast("array<double>")
    return F.when(F.size(v) == len(query), 1 - F.try_divide(dot(v, whole), norm(v) * F.lit(length)))


def padded(v: Column, dims: int = MAX_DIMS) -> Column:
    """Zero-padded to ``dims``: changes neither dot products nor norms; a longer vector is an error."""
    too_long = F.raise_error(F.lit(f"a vector has more than {dims} dimensions")).cast("array<float>")
    rest = F.array_repeat(F.lit(0.0).cast("float"), dims - F.size(v))
    return F.when(F.size(v) > dims, too_long).otherwise(F.concat(v.cast("array<float>"), rest))


def of_length(v: Column, dims: int) -> Column:
    """The vector, or an error where it has another length (2.10)."""
    return F.when(F.size(v) == dims, v).otherwise(F.raise_error(F.concat(F.lit("vector length "), F.size(v).cast("string"))).cast("array<float>"))


def parse_text(text: Column) -> Column:
    """A vector from ``[1, 2]``, ``1,2`` or ``1 2``; null if a part is no number (2.10)."""
    parts = F.split(F.trim(F.regexp_replace(text, r"[\[\]]", " ")), r"\s*,\s*|\s+")
    numbers = F.transform(parts, lambda p: p.try_cast("float"))
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)


def to_base64(vector: list[float]) -> str:
    """The form that ``from_base64`` reads."""
    return base64.b64encode(np.asarray(vector, "<f4").tobytes()).decode()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_base64(text: pd.Series) -> pd.Series:
    """Little-endian float32 bytes in base64 (1.2)."""
    return text.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), "<f4").tolist())


def register(spark: SparkSession) -> None:
    """``cosine_distance(a, b)`` as a SQL function of the session (2.12 #1)."""
    spark.sql(
        """create or replace temporary function cosine_distance(a array<double>, b array<double>) returns double return
        case when size(a) = size(b) then 1 - try_divide(
          aggregate(zip_with(a, b, (x, y) -> x * y), 0d, (s, x) -> s + x),
          sqrt(aggregate(a, 0d, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0d, (s, x) -> s + x * x))) end"""
    )
