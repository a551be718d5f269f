"""Connected components of a written edge table: at once in one task where the edges are few, else by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluice.llm.scratch import Scratch
from sluice.llm.spread import attached

AT_ONCE = 200_000  #: edges that one task takes


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of ``batches``, by union-find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    if root:
        nodes = sorted(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array([find(x) for x in nodes], np.int64))], names=["node", "root"])


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the smallest node that it reaches.

    Up to ``AT_ONCE`` edges go to one task, since a step costs as many small tasks whatever it holds. Beyond that the work of a step is a few shuffles of edges; the number of steps grows with the logarithm of the graph, and a node with very many edges is dealt to many tasks. Nothing goes to the driver but a
    count and a checksum. Nodes without an edge are absent; loops and repeated edges do no harm.
    """
    plain = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    if plain.count() <= AT_ONCE:
        return plain.coalesce(1).mapInArrow(_at_once, "node long, root long")
    plain = plain.distinct()
    edges = scratch.table(plain, "edges")
    path, state = scratch.paths[-1], _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("c")), "least")
        least_path = scratch.paths[-1]
        large = attached(both, least, ["a"], F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.table(large.where("a <> b").distinct(), "large")
        large_path = scratch.paths[-1]
        least = scratch.table(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")), "least")
        small = attached(large, least, ["a"], F.col("b")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = scratch.table(small.where("a <> b").distinct(), "edges")
        scratch.drop(path, large_path, least_path, scratch.paths[-2])
        edges, path, before = after, scratch.paths[-1], state
        state = _state(edges)
        if state == before:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
