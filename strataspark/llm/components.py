"""Connected components of an undirected graph, distributed: alternating large-star and small-star steps.

A large-star step joins every larger neighbour of a node to the least node that it knows, a small-star step joins the
smaller neighbours and the node itself to the least of them. The edges end as stars around the least node of each
component. A graph of few edges, which are counted first, is settled by union-find in one task instead, where Python
may be used. Each step takes a minimum a node, pre-aggregated before the shuffle, and a join that Spark may split where
a node has very many edges. Only a count and a checksum of each round reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.base import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) -> (u, v, m) with m the least of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs.u == least.k).select("u", "v", "m")


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            x, y = find(u), find(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(x) for x in nodes], pa.int64())})


def components(edges: DataFrame, a: str, b: str, most_small: int = 0) -> DataFrame:
    """(node, root) for every node of an edge, root the least node of its component. Nulls and loops are dropped.
    most_small: number of edges (of whole numbers) up to which one task settles them."""
    edges = materialize(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where(F.col("u") > F.col("v")).distinct())
    if most_small and edges.count() <= most_small:
        return edges.coalesce(1).mapInArrow(_union_find, "node long, root long")
    seen = None
    while True:  # the steps have a fixed point, which they reach in a logarithmic number of rounds, or its square
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where((F.col("v") > F.col("u"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(large)
        edges = materialize(
            small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v")).distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
