"""Exact nearest rows against brute force, in one block and over many cells; and the package on workers that don't see the repository."""

import os
import pathlib
import subprocess
import sys

import numpy as np
import pytest

from strataloom.operators import nearest as N

ROOT = pathlib.Path(__file__).resolve().parent.parent


def small(monkeypatch):
    for name, v in (("CELL_ROWS", 60), ("BLOCK_ROWS", 40), ("BLOCK_QUERIES", 7), ("SHELLS", 3)):
        monkeypatch.setattr(N, name, v)


def brute(x, ids, queries, k, metric="l2"):
    x = np.asarray(x, float)
    if metric == "cosine":
        n = np.sqrt((x * x).sum(1))
        u = x / np.where(n > 0, n, 1)[:, None]
        d = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T))
        d[np.arange(len(x)), np.arange(len(x))] = np.where(n > 0, 0, np.sqrt(2))
        same = (u[:, None, :] == u[None]).all(2) & (n > 0)[:, None] & (n > 0)[None]
        d[same] = 0
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d = np.round(d, 6)
    return {(ids[q], ids[i], float(d[q, i]), r + 1) for q in queries for r, i in enumerate(sorted(range(len(x)), key=lambda i: (d[q, i], ids[i]))[:k])}


def tuples(df):
    return {(r["query_id"], r["id"], r["distance"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("kind", ["flat", "cells", "copies", "strings", "large"])
@pytest.mark.parametrize("blocks", [False, True])
def test_l2(spark, monkeypatch, kind, blocks):
    if blocks:
        small(monkeypatch)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 8))
    if kind == "cells":
        x = rng.standard_normal((12, 8))[rng.integers(0, 12, 600)] * 10 + 0.1 * x
    if kind == "copies":
        x[:250] = x[0]
    if kind == "large":
        x = x * 0.01 + 1000
    ids = [f"é{i % 7}-{i}" if kind == "strings" else i for i in range(600)]
    table = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, x, strict=True)], f"vec_id {'string' if kind == 'strings' else 'long'}, embedding array<double>, distance string").repartition(5)
    queries = range(0, 600, 10)
    asked = table.where(table.vec_id.isin([ids[q] for q in queries]))
    for k in (7, 700) if kind == "flat" else (7,):
        assert tuples(N.knn(table, asked, k)) == brute(x, ids, queries, k), k


@pytest.mark.parametrize("blocks", [False, True])
def test_cosine(spark, monkeypatch, blocks):
    if blocks:
        small(monkeypatch)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6)) * rng.lognormal(0, 3, (400, 1))
    x[5:12] = 0
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert tuples(N.knn(table, table.where("vec_id % 5 = 0"), 9, metric="cosine")) == brute(x, range(400), range(0, 400, 5), 9, "cosine")


def test_cells_are_ruled_out():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 8)) * 10
    x = centres[rng.integers(0, 20, 4000)] + 0.1 * rng.standard_normal((4000, 8))
    c = N.fitted(x, 20)
    home = N._squares(x, c).argmin(1)
    far = np.sqrt(((x - c[home]) ** 2).sum(1))
    shells = N.Shells(c, [(int(h), 0, far[home == h].min(), far[home == h].max(), int((home == h).sum())) for h in np.unique(home)])
    d = shells.distances(x[::50])
    meets = shells.best_case(d) <= 1.0
    assert meets.sum(1).mean() < 6
    true = np.sqrt(N._squares(x[::50], x))
    for q, own in enumerate(meets):
        assert set(home[true[q] <= 1.0]) <= set(shells.cell[own])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, []), (None, [1.0, 0.0]), (7, [0.0, 0.0]), (8, [1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in N.knn(table, table.where("vec_id in (1, 2, 3, 5, 7, 8) or vec_id is null"), 3).collect())
    assert got == [(1, 1, 1, 0.0), (1, 2, 9, 0.0), (1, 3, 9, 0.0), (7, 1, 7, 0.0), (7, 2, 1, 1.0), (7, 3, 9, 1.0), (8, 1, 8, 0.0)]
    assert N.knn(table.limit(0), table, 3).collect() == [] and N.knn(table, table.limit(0), 3).collect() == []


def test_from_another_folder(tmp_path, sf):
    """Workers get the package from the driver, not from the folder it runs in."""
    code = f"""
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
spec = importlib.util.spec_from_file_location("__spark_entry__", {str(ROOT / "__spark_entry__.py")!r})
e = importlib.util.module_from_spec(spec)
spec.loader.exec_module(e)
print("ROWS", e.entry(spark).count(), *[e.queries()[n](spark, {sf!r}).count() for n in ("canonical_texts", "expression_value", "drift_stream", "canonical_sources")])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"TMPDIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert run.returncode == 0, run.stderr[-2000:]
    assert all(int(n) > 0 for n in run.stdout.rpartition("ROWS")[2].split())
