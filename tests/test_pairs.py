"""Pairs that are found by an index or counted by parts, against all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataloom.operators import matching as M
from strataloom.operators import similarity as S


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_alike(spark, threshold):
    rng = random.Random(int(threshold * 10))
    sets = [sorted(set(rng.choices("abcdefghijklmnop", weights=[40, 20, 10, 8, *[3] * 12], k=rng.randint(0, 9)))) for _ in range(200)] + [["a"]] * 30 + [[], []]
    rows = spark.createDataFrame(list(enumerate(sets)), "b int, y array<string>").repartition(4)
    asked = rows.where("b % 5 = 0").select(F.col("b").alias("a"), F.col("y").alias("x"))
    got = {(r["a"], r["b"]): r["jaccard"] for r in S.alike(asked, rows, threshold).collect()}
    want = {}
    for a in range(0, len(sets), 5):
        for b, y in enumerate(sets):
            x, y = set(sets[a]), set(y)
            j = len(x & y) / len(x | y) if x | y else 1.0
            if j >= threshold:
                want[a, b] = j
    assert got == want


def test_reason_counts(spark):
    rng = random.Random(2)
    some = lambda k: rng.choices("abc", k=rng.randint(0, k))
    rows = [(i, some(2), some(1), some(2), rng.choice([0, 1, 2, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, ins array<string>, outs array<string>, errs array<string>, purity int, thread int, time int")
    a = df.where("id % 7 = 0").select(*[F.col(c).alias(f"w_{c}") for c in df.columns])
    pairs = a.crossJoin(df.select(*[F.col(c).alias(f"h_{c}") for c in df.columns]))
    told = M.reasons(*[F.col(f"{s}_{c}") for c in ("ins", "outs", "errs", "purity", "thread") for s in ("w", "h")], costs={"time": (F.col("w_time"), F.col("h_time"))})
    want = Counter(x for r in pairs.select(told.alias("r")).collect() for x in r["r"])
    assert {r["reason"]: r["n"] for r in M.reason_counts(df.where("id % 7 = 0"), df).collect()} == want


def test_search_makes_no_pairs(spark):
    rng = random.Random(4)
    some = lambda k: None if rng.random() < 0.05 else rng.choices("abc", k=rng.randint(0, k))
    rows = [(i, some(2), some(1), some(2) or [], rng.choice([0, 1, 2, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, ins array<string>, outs array<string>, errs array<string>, purity int, thread int, time int")
    a = df.where("id % 7 = 0").select(*[F.col(c).alias(f"w_{c}") for c in df.columns])
    told = M.reasons(*[F.col(f"{s}_{c}") for c in ("ins", "outs", "errs", "purity", "thread") for s in ("w", "h")], costs={"time": (F.col("w_time"), F.col("h_time"))})
    pairs = a.crossJoin(df.select(*[F.col(c).alias(f"h_{c}") for c in df.columns])).select("w_id", "h_id", F.size(told).alias("n")).collect()
    want = {(x, b, n, r + 1) for x in {p.w_id for p in pairs} for r, (n, b) in enumerate(sorted((p.n, p.h_id) for p in pairs if p.w_id == x)[:4])}
    found = M.search(df.where("id % 7 = 0"), df, 4)
    assert {tuple(r) for r in found.select("a", "b", "n", "rank").collect()} == want


def test_alike_shuffles_no_pairs(spark):
    """Copies meet at the end: no shuffle lies above the last join."""
    rows = spark.range(400).selectExpr("id AS b", "array('a', 'b', concat('c', id % 3)) AS y")
    found = S.alike(rows.selectExpr("b AS a", "y AS x"), rows, 0.3)
    assert found.count() == 400 * 400
    plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert [line for line in plan if "Join" in line or "Aggregate" in line][0].lstrip("+- :").startswith("SortMergeJoin [y#")
