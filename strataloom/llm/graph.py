"""Connected components: union-find inside tasks over bounded parts of the edges, then large-star and small-star steps in joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, ship

#: Edges of one task's union-find, 16 bytes each, about.
PART_EDGES = 1_000_000


def merged(batches: Iterator[pa.RecordBatch], roots: bool) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) -> each node with the smallest node of its tree in this part; the roots themselves only if asked for."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    keep = np.arange(len(nodes)) if roots else np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[label[keep]])], names=["id", "component"] if roots else ["u", "v"])


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v): v joins the smallest of u and its neighbours. Grouped minima combine before the shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, most: int = 60, part_edges: int = PART_EDGES) -> DataFrame:
    """edges (u, v) of longs -> (id, component): the smallest id reachable, for every id that has an edge.

    Loops and repeated edges are allowed; an empty table gives an empty one. Each task first merges a bounded part of the edges;
    if there is one part, that is all. Else rounds of joins go on from the parts' trees, each ended in the shared
    folder, and only counts and sums come to the driver.
    """
    ship(edges.sparkSession)
    now = cut(edges.where("u is not null and v is not null and u != v").select("u", "v"))
    parts = -(-now.count() // part_edges)
    now = now.coalesce(max(1, parts))
    if parts <= 1:
        return cut(now.mapInArrow(lambda it: merged(it, True), "id long, component long"))
    now = cut(now.mapInArrow(lambda it: merged(it, False), "u long, v long").distinct())
    sums = (F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)")))
    before = tuple(now.agg(*sums).first())
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = _star(down)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = cut(small)
        # A star forest is a fixed point: every u has one edge and no v is a u. The sum of labels falls until then.
        state = tuple(now.agg(*sums).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
