"""Connected components of a graph of any size: alternating large and small stars over DataFrames.

Rounds go on until the edges are settled or no more than FEW (16 MB of numbers) are left, which one task joins to the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import scratch, written

FEW = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the edges but the roots; a root is the least node of its component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, n = np.arange(len(names)), len(a)
    left, right = at[:n], at[n:]
    while len(left):  # each root goes below the least one that it meets; then paths are cut short
        low, high = np.minimum(left, right), np.maximum(left, right)
        np.minimum.at(up, high, low)
        while True:
            above = up[up]
            if np.array_equal(above, up):
                break
            up = above
        left, right = up[left], up[right]
        open_ = left != right
        left, right = left[open_], right[open_]
    return names[up != np.arange(len(names))], names[up[up != np.arange(len(names))]]


def _finished(edges: DataFrame) -> DataFrame:
    """The stars of edges that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if held:
            node, root = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    return edges.coalesce(1).mapInArrow(run, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (the larger ones, or the smaller ones) are tied to the least of its neighbours and itself."""
    ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    ways = ways.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else ways.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = written(least, "least")  # so that a hub's join can be split
    tied = ways.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return written(out.where("a != b").distinct(), "edges")


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead from a node to its root: one edge a node, and no root with an edge of its own."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    return n == nodes and edges.join(edges.select(F.col("a").alias("_root")).distinct(), F.col("b") == F.col("_root"), "left_semi").isEmpty()


def components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the least node of the component, and its own root."""
    with scratch(edges.sparkSession) as kept:
        edges = written(edges.where("a != b").distinct(), "edges")
        for _ in range(rounds):
            if edges.count() <= few:
                edges = written(_finished(edges), "edges")
                break
            edges = _star(_star(edges, True), False)
            if _settled(edges):
                break
        else:
            raise RuntimeError(f"components didn't settle in {rounds} rounds")
        kept.append(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
