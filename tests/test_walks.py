"""Walks over modules without a limit."""

from strataloom.operators import trees as W


def test_walk_without_limit(spark):
    e = spark.createDataFrame([(0, i) for i in range(1, 700)] + [(699, 700), (5, 701)], "a long, b long")
    roots = spark.createDataFrame([(0,)], "node long")
    known = spark.createDataFrame([(i,) for i in range(702) if i != 5], "node long")
    got = {r["node"]: (r["depth"], r["kind"]) for r in W.walked(e, roots, known, most=None).collect()}
    assert got == {0: (0, "module")} | {i: (1, "module") for i in range(1, 700)} | {5: (1, "unresolved"), 700: (2, "module")}
