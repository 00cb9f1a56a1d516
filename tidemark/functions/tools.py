"""Python functions as tools: typed signatures, coerced arguments, a registry of UDFs (section 2.12)."""

from __future__ import annotations

import dataclasses
import inspect
import json
import re
import types
import typing
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: JSON and Spark types by Python type.
JSON_TYPES = {int: "integer", str: "string", bool: "boolean", float: "number", type(None): "null", list: "array", dict: "object"}
SPARK_TYPES = {int: T.LongType(), str: T.StringType(), bool: T.BooleanType(), float: T.DoubleType(), type(None): T.NullType()}


def _without_none(annotation: Any) -> tuple[Any, bool]:
    """The annotation without None, and whether None was allowed; other unions are errors."""
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(annotation) if a is not type(None)]
        if len(rest) != 1 or len(rest) == len(typing.get_args(annotation)):
            raise TypeError(f"a union of types has no schema: {annotation}")
        return rest[0], True
    return annotation, False


def json_type(annotation: Any) -> dict:
    """JSON schema of a type: numbers, text, lists, mappings, dataclasses (2.12 #3)."""
    kind, _ = _without_none(annotation)
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if kind in (list, dict) or origin is dict:
        return {"type": JSON_TYPES[origin or kind]}
    if origin is list:
        return {"type": "array", "items": json_type(args[0])}
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind)
        needed = [f.name for f in dataclasses.fields(kind) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
        return {"type": "object", "properties": {f.name: json_type(hints[f.name]) for f in dataclasses.fields(kind)}, "required": needed}
    if kind in JSON_TYPES:
        return {"type": JSON_TYPES[kind]}
    raise TypeError(f"no schema for {annotation}")


def spark_type(annotation: Any) -> T.DataType:
    """Spark type of a type; mappings have text keys and values unless they say otherwise."""
    kind, _ = _without_none(annotation)
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if kind is list or origin is list:
        return T.ArrayType(spark_type(args[0]) if args else T.StringType())
    if kind is dict or origin is dict:
        return T.MapType(*(spark_type(a) for a in args)) if args else T.MapType(T.StringType(), T.StringType())
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind)
        return T.StructType([T.StructField(f.name, spark_type(hints[f.name])) for f in dataclasses.fields(kind)])
    if kind in SPARK_TYPES:
        return SPARK_TYPES[kind]
    raise TypeError(f"no Spark type for {annotation}")


_ARGUMENT = re.compile(r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:\s*(.*)$")


def described(doc: str) -> tuple[str, dict[str, str]]:
    """The first paragraph of a docstring, and the descriptions under ``Args:``."""
    doc = inspect.cleandoc(doc)
    head = doc.split("\n\n")[0].replace("\n", " ").strip()
    found: dict[str, str] = {}
    inside, name = False, None
    for line in doc.splitlines():
        if re.match(r"^\w+:\s*$", line):
            inside = line.strip() in ("Args:", "Arguments:", "Parameters:")
            continue
        if inside and (m := _ARGUMENT.match(line)) and line.startswith(" "):
            name = m[1]
            found[name] = m[2].strip()
        elif inside and name and line.strip():
            found[name] += " " + line.strip()
    return head, found


def schema(function: Callable) -> dict:
    """Name, description and parameters of a function; it needs a docstring, types and a description of each argument (2.12 #2)."""
    if not function.__doc__:
        raise ValueError(f"{function.__name__} has no docstring")
    head, arguments = described(function.__doc__)
    hints = typing.get_type_hints(function)
    properties, needed = {}, []
    for name, parameter in inspect.signature(function).parameters.items():
        if name == "self":
            continue
        if name not in hints:
            raise TypeError(f"{function.__name__}: {name} has no type")
        if name not in arguments:
            raise ValueError(f"{function.__name__}: {name} is not described")
        properties[name] = json_type(hints[name]) | {"description": arguments[name]}
        if parameter.default is inspect.Parameter.empty:
            needed.append(name)
    return {"name": function.__name__, "description": head, "parameters": {"type": "object", "properties": properties, "required": needed}}


def coerced(text: Column, annotation: Any) -> Column:
    """An argument given as text, as its type; what doesn't fit is null (2.12 #4).

    Lists, mappings and records are JSON; numbers and truth values as Spark reads them.
    """
    kind = spark_type(annotation)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.from_json(text, kind)
    if isinstance(kind, T.NullType):
        return F.lit(None)
    if isinstance(kind, T.LongType):
        return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long"))
    return F.trim(text).try_cast(kind)


class Registry:
    """Tools of a session by name: their schema, and a UDF that runs in the Python workers, apart from the driver (2.12 #2, #5).

    Code comes from the caller alone, never from data.  An error of one row is
    that row's status; the others go on.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._tools: dict[str, tuple[dict, Callable]] = {}

    def add(self, function: Callable) -> dict:
        """Register a function, in place of one of the same name."""
        told = schema(function)
        self._tools[told["name"]] = (told, function)
        return told

    def drop(self, name: str) -> None:
        del self._tools[name]

    def table(self) -> DataFrame:
        """(name, description, json_schema) in order."""
        rows = [(n, t["description"], json.dumps(t, sort_keys=True)) for n, (t, _) in sorted(self._tools.items())]
        return self.spark.createDataFrame(rows, "name string, description string, json_schema string")

    def run(self, calls: DataFrame, name: str, arguments: str) -> DataFrame:
        """``calls`` with status (success or error) and result (text, or the error's) of a tool on its JSON arguments."""
        if name not in self._tools:
            raise LookupError(f"no tool {name}")
        told, function = self._tools[name]
        needed, known = told["parameters"]["required"], set(told["parameters"]["properties"])

        @F.udf("status string, result string")
        def call(text: str | None):
            try:
                given = json.loads(text or "{}")
                lost, strange = [n for n in needed if n not in given], sorted(set(given) - known)
                if lost or strange:
                    return "error", f"missing {lost}, unknown {strange}"
                return "success", str(function(**given))
            except Exception as e:  # a tool may raise anything: it is the row's result
                return "error", f"{type(e).__name__}: {e}"

        return calls.withColumn("_out", call(F.col(arguments))).select(*calls.columns, "_out.status", "_out.result")
