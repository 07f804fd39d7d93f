"""Bounded walks over module graphs, and aggregates of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import closure, cut


def walked(edges: DataFrame, roots: DataFrame, known: DataFrame, most: int | None = 500) -> DataFrame:
    """(root, node, depth, kind) of the modules reached from each root, breadth first, each once.

    edges: a, b; roots: node; known: node (the modules that can be resolved). An unresolved one is a stub and isn't gone through. Beyond
    ``most`` modules of a root, by (depth, id), nodes are stubs of kind limit (None: no limit). Rounds end with the last new node.
    """
    step = edges.select("a", "b").distinct()
    resolved = known.select("node").distinct().withColumn("_k", F.lit(1))
    rows = roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0))
    found = cut(rows.join(resolved, "node", "left").select("root", "node", "depth", F.when(F.col("_k").isNull(), "unresolved").otherwise("module").alias("kind")))
    front, depth = found, 0
    while True:
        depth += 1
        new = front.where("kind = 'module'").select("root", F.col("node").alias("a")).join(step, "a").select("root", F.col("b").alias("node")).distinct()
        new = new.join(found.select("root", "node"), ["root", "node"], "left_anti").join(resolved, "node", "left")
        kind = F.when(F.col("_k").isNull(), "unresolved")
        if most is not None:
            new = new.join(found.groupBy("root").agg(F.count_if(F.col("kind") == "module").alias("_n")), "root")
            place = F.sum(F.col("_k")).over(Window.partitionBy("root").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
            kind = kind.when(F.col("_n") + place > most, "limit")
        kind = kind.otherwise("module")
        front = cut(new.select("root", "node", F.lit(depth).alias("depth"), kind.alias("kind")))
        if front.isEmpty():
            return found
        found = cut(found.unionByName(front))


def rolled_up(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, leaves, total, height) of every inner node of a forest. edges: a (parent), b; leaves: node, value."""
    below = closure(edges).select(F.col("a").alias("node"), F.col("b").alias("leaf"), "hops")
    own = leaves.select(F.col("node").alias("leaf"), "value")
    got = below.join(own, "leaf", "left").groupBy("node")
    return got.agg(F.count("value").alias("leaves"), F.coalesce(F.sum("value"), F.lit(0)).alias("total"), F.max("hops").alias("height"))
