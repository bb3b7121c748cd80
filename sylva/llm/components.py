"""Connected components of an edge table, by alternating large-star and small-star steps; nothing is collected.

A table of at most LOCAL edges, a bounded piece of work, is closed by one task with union-find instead; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.session import shared_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u moves to the least of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below u, and u, move to the least of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


LOCAL = 100_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["id", "component"])


def connected(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """edges: a, b (bigint). A row (id, component) for every id of an edge; component is its least reachable id."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    sign = [F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")]
    edges = shared_table(edges, name)
    if edges.count() <= LOCAL:
        return edges.coalesce(1).mapInArrow(_union_find, "id bigint, component bigint")
    before = edges.agg(*sign).first()
    for _ in range(rounds):
        edges = shared_table(_small_star(_large_star(edges).distinct()).distinct(), name)
        now = edges.agg(*sign).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixpoint after {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
