"""The permutation index against brute force: exact rows where all is looked at, recall elsewhere."""

import math
from collections import defaultdict

import numpy as np
import pytest

from strataloom.llm import pivots, registry


def brute(rows, queries, k):
    """query id -> (score, id) of the k best; ties to the smaller id."""
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    rows = sorted({(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and fine(v)})
    out = {}
    for q, v in queries:
        if q is None or not fine(v):
            continue
        own = [(-float((np.array(x) * np.array(v, float)).sum()), i) for i, x in rows if i != q and len(x) == len(v)]
        if own:
            out[q] = [(-s, i) for s, i in sorted(own)[:k]]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return dict(out)


def recall(found, true):
    hit = total = 0
    for q, want in true.items():
        got = found.get(q, [])
        assert len(got) == len(want)
        least = want[-1][0]
        hit += sum(s >= least - 1e-12 for s, _ in got)
        total += len(want)
    return hit / total


def made(kind, n, dim, seed=5):
    rng = np.random.default_rng(seed)
    if kind == "flat":
        return rng.normal(size=(n, dim)) / math.sqrt(dim)
    if kind == "lengths":
        return rng.normal(size=(n, dim)) * rng.lognormal(0, 1, (n, 1))
    if kind == "mean":
        return rng.normal(size=(n, dim)) * 0.3 + 2
    centres = rng.normal(size=(40, dim))
    return centres[rng.integers(0, 40, n)] + 0.2 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("kind,dim", [("flat", 64), ("cells", 32), ("lengths", 16), ("mean", 48), ("cells", 300)])
def test_recall(spark, monkeypatch, kind, dim):
    for name, v in (("HOME_ROWS", 500), ("SAMPLE", 1500), ("QUERY_BLOCK", 64), ("SHARD", 700)):
        monkeypatch.setattr(pivots, name, v)
    x = made(kind, 4000, dim).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    true = {}
    for q in range(0, 4000, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        top = np.lexsort((np.arange(len(x)), -s))[:20]
        true[q] = list(zip(s[top].tolist(), top.tolist(), strict=True))
    found = answers(pivots.largest_products(df, df.where("vec_id % 20 = 0")))
    assert recall(found, true) >= 0.95
    for q, own in found.items():
        assert [s for s, _ in own] == sorted((s for s, _ in own), reverse=True)
        assert all(s == float((x[q] * x[i]).sum()) for s, i in own)
    if kind == "cells":
        assert answers(pivots.largest_products(df, df.where("vec_id % 20 = 0"), exact=True)) == true


def test_query_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    true = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert recall(answers(registry.QUERIES["op12_nearest_neighbours"](spark, sf)), true) >= 0.95


def test_share_is_small_where_data_have_cells():
    x = made("cells", 4000, 32)
    longest = float(np.sqrt((x * x).sum(1)).max()) * (1 + 1e-12)
    assert pivots.Pivots(x, x[::20], longest, 1, 20, False).share <= 0.1
    found = pivots.Pivots(x, x[::20], longest, 16, 20, False)
    assert found.share * found.probes / 16 <= 0.3


def test_odd(spark):
    copies = [(i, [1.0, 2.0]) for i in range(100, 160)]
    rows = [*copies, (20, [1.0, 2.0]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (0, []), (1, [None, 1.0]), (2, [float("inf"), 1.0]), (None, [1.0, 1.0]), (3, [3.0, 1.0]), (3, [3.0, 1.0]), (4, [-0.0, 5.0]), (5, [0.0, 5.0]), (6, [1.0, 2.0, 3.0]), (200, [1.0, 0.0, 0.0]), (220, [4.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    asked = df.where("vec_id % 20 = 0")
    for exact in (False, True):
        assert answers(pivots.largest_products(df, asked, exact=exact)) == brute(rows, [(r["vec_id"], r["embedding"]) for r in asked.collect()], 20)
    assert pivots.largest_products(df.limit(0), asked).collect() == []
    assert pivots.largest_products(df, asked.limit(0)).collect() == []
