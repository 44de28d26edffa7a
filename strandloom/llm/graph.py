"""Connected components as DataFrame joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import staged

MAX_ROUNDS = 60
#: Edges (16 bytes each) that one task joins at most; beyond, rounds of joins do.
LOCAL_EDGES = 250_000


def _union(table: pa.Table) -> pa.Table:
    """Union-find over a bounded number of edges."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    return pa.table({"id": pa.array(ids, pa.int64()), "label": pa.array([find(x) for x in ids], pa.int64())})


def components(edges: DataFrame, local: bool = True) -> DataFrame:
    """(id, label): for each end of an edge (a, b), the smallest id of its component.

    Up to LOCAL_EDGES edges are joined in one task.  More go through
    alternating large-star and small-star contraction: each round shortens every
    path towards its smallest end, and rows never outnumber the edges by more than
    the nodes.  Each round is written to the shared folder; nothing is collected but its
    row count and checksum.
    """
    state = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if local and state.count() <= LOCAL_EDGES:
        return staged(state.groupBy(F.lit(0).alias("g")).applyInArrow(_union, "id long, label long"), "components")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        state = staged(small.where("a <> b").distinct(), "edges")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    tops = state.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return staged(state.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(tops), "components")
