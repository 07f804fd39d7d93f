"""Contracts: weaknesses, likeness and merging on cases made by hand."""

import pytest
from pyspark.sql import functions as F

from strataloom.operators import contracts as K

SCHEMA = "id string, behavior string, preconditions array<string>, postconditions array<string>, invariants array<string>, effects array<string>, errors array<struct<description:string,type:string>>, inputs array<struct<name:string,type:string>>, outputs array<struct<name:string,type:string>>, functional struct<purity:string,time:string,space:string>"
ROWS = [
    ("full", "Adds.", ["x > 0"], ["Sum is  right."], ["i"], ["writes"], [("Bad x", "Range")], [("x", "number")], [("s", "number")], ("io", "O(1)", None)),
    ("bare", "", [], [], [], [], None, [], [], None),
    ("pure", "Adds", ["X > 0!"], ["sum is right", "b"], ["i", "j"], [], [], [("X", "Number"), ("y", "number")], [("s", "number")], ("pure", None, None)),
    ("null", None, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_weaknesses(table):
    present, clear = K.weaknesses(K.of())
    got = {r["id"]: (r["p"], r["c"]) for r in table.select("id", present.alias("p"), clear.alias("c")).collect()}
    assert got["full"] == ([], list(K.WEAKNESSES))
    assert got["bare"] == got["null"] == (["CWE-474", "CWE-440", "CWE-573", "CWE-710"], ["CWE-684"])
    assert got["pure"][0] == ["CWE-684"]


def test_dimensions(table):
    side = lambda p: table.select(*[F.col(c).alias(f"{p}{c}") for c in table.columns])
    pairs = side("a_").crossJoin(side("b_"))
    found = K.dimensions(K.of("a_"), K.of("b_"))
    got = {(r["a_id"], r["b_id"]): tuple(round(r[d], 6) for d in K.DIMENSIONS) for r in pairs.select("a_id", "b_id", *[c.alias(d) for d, c in found.items()]).collect()}
    assert got["full", "full"] == got["bare", "null"] == (1, 1, 1, 1, 1)
    assert got["full", "pure"] == (0.8, 0.5, 0, 0.5, 0.75)
    assert got["full", "bare"] == (0.2, 0, 0, 0, 0)
    assert got["pure", "bare"] == (0, 0, 1, 0, 0)
    total = pairs.where("a_id = 'full' and b_id = 'pure'").select(K.variance(K.of("a_"), K.of("b_")).alias("v")).first()["v"]
    assert round(total, 9) == round(0.35 * 0.8 + 0.25 * 0.5 + 0.1 * 0.5 + 0.1 * 0.75, 9)
    with pytest.raises(ValueError, match="sum to 1"):
        K.variance(K.of(), K.of(), dict.fromkeys(K.DIMENSIONS, 0.3))
    with pytest.raises(ValueError, match="no weight"):
        K.variance(K.of(), K.of(), {"security": 1.0})


def test_merged(table):
    rows = table.withColumn("g", F.when(F.col("id").isin("full", "pure"), "a").otherwise("b"))
    got = {r["g"]: r.asDict() for r in K.merged(rows, "g").collect()}
    assert got["a"] == {"g": "a", "contributors": 2, "behavior": "Adds", "ties": 2, "preconditions": ["x > 0"], "invariants": ["i"], "clear": ["CWE-440", "CWE-474", "CWE-573", "CWE-710"], "postconditions": ["b", "sum is right"], "effects": ["writes"]}
    assert got["b"]["behavior"] is None and got["b"]["ties"] == 0 and got["b"]["clear"] == ["CWE-684"] and got["b"]["postconditions"] == []


def test_likest_is_the_best_of_all_pairs(spark, sf):
    from strataloom.plans import similar

    c = similar.contracts(spark, sf).where("id < 120")
    c = c.unionByName(c.withColumn("id", c["id"] + 1000))  # each contract twice
    side = lambda key, p: c.select(c["id"].alias(key), *[c[f].alias(f"{p}{f}") for f in K.FIELDS])
    rows = side("a", "x_").where("a % 10 = 0").crossJoin(side("b", "y_")).where("a != b").select("a", "b", K.variance(K.of("x_"), K.of("y_")).alias("s")).collect()
    want = {(x, r.b, round(r.s, 6), i + 1) for x in {r.a for r in rows} for i, r in enumerate(sorted((r for r in rows if r.a == x), key=lambda r: (-round(r.s, 9), r.b))[:3])}
    assert {(r.a, r.b, round(r.score, 6), r["rank"]) for r in K.likest(c.where("id % 10 = 0"), c, 3).collect()} == want
