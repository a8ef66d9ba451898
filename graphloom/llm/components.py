"""Connected components of a table of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import written

#: Edges that one task takes at once.
ONE_TASK = 1 << 20


def _least_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): nodes and the least node of their component, of all edges that come."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    nodes, ends = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    a, b = np.split(ends, 2)
    low = np.arange(len(nodes))
    while True:
        least, then = np.minimum(low[a], low[b]), low.copy()
        np.minimum.at(then, low[a], least)
        np.minimum.at(then, low[b], least)
        while not np.array_equal(then[then], then):
            then = then[then]
        if np.array_equal(then, low):
            break
        low = then
    for x in range(0, len(nodes), 1 << 16):
        s = slice(x, x + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[s]), pa.array(nodes[low[s]])], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of edges; a component has the name of its least node.

    Large-star and small-star rounds (Kiveris et al., 2014) until no edge changes: the number of rounds
    grows with the logarithm of the longest path, and each round's edges are a written table. Up to ONE_TASK
    edges are settled in one task, without rounds. Null ends make no edge; loops and repeated edges change nothing.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = both.select(F.col("u").alias("node")).union(both.select("v")).distinct()
    now = written(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    few = now.count() <= ONE_TASK
    if few:
        now = written(now.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).coalesce(1).mapInArrow(_least_of_each, "u bigint, v bigint"), "edges")
    while not few:
        # Large star: each node's greater neighbours go to the least of its neighbourhood.
        near = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its lesser neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        then = written(small.where("u <> v").distinct(), "edges")
        sums = [x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first() for x in (now, then)]
        now = then
        if sums[0] == sums[1]:
            break
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
