"""Connected components of an edge list, wholly distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import HOT_KEYS, attach, hot_keys
from .store import discard, store

EDGE = "a long, b long"
FOREST_EDGES = 1 << 20


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all but those smallest ones."""
    names, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = code[: len(a)], code[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(names))
    return names[other], names[label[other]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    rows = 0

    def flush():
        pair = np.concatenate(held, axis=1)
        a, b = star_forest(pair[0], pair[1])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        rows += batch.num_rows
        if rows >= FOREST_EDGES:
            yield flush()
            rows = 0
    if held:
        yield flush()


def connected(edges: DataFrame) -> DataFrame:
    """Label the nodes of ``edges`` (a long, b long; any order, repeats allowed).

    Returns (a, b): every node that is not the smallest of its component, with
    that smallest node.  Rounds of hooking (all labels of a node are joined to
    the least) and pointer jumping halve the depth; each round is a written
    table.  No step gathers a component in one place: minima are aggregated
    before the shuffle, and labels are looked up with joins in which nodes with
    many labels, and labels that many nodes share, are broadcast.

    Empty edges give an empty result; loops (a = b) are ignored.
    """
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b")
    now = store(edges.mapInArrow(_forests, EDGE).select("a", "b", F.lit(True).alias("moved")), "edges")
    while True:
        total = now.count()
        often = max(1, -(-total // HOT_KEYS))
        parent = store(now.groupBy("a").agg(F.min("b").alias("p"), F.count(F.lit(1)).alias("n")), "parents")
        hooked = attach(now.select("a", "b"), parent.select("a", "p"), "a", parent.where(F.col("n") >= often).select("a"))
        # (a, b) with p = least label of a: keep (a, p), and join b to p where they differ
        both = hooked.select(
            F.explode(
                F.when(
                    F.col("b") == F.col("p"), F.array(F.struct("a", F.col("p").alias("b"), F.lit(False).alias("moved")))
                ).otherwise(F.array(F.struct(F.col("b").alias("a"), F.col("p").alias("b"), F.lit(True).alias("moved"))))
            ).alias("e")
        ).select("e.*")
        up = parent.select(F.col("a").alias("b"), F.col("p").alias("q"))
        shared = hot_keys(parent.select(F.col("p").alias("b")), "b", total)
        jumped = attach(both, up, "b", shared, "left").select(
            "a", F.coalesce("q", "b").alias("b"), (F.col("moved") | F.col("q").isNotNull()).alias("moved")
        )
        after = store(jumped.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.max("moved").alias("moved")), "edges")
        discard(now)
        discard(parent)
        now = after
        if now.where("moved").isEmpty():
            return now.select("a", "b")
