"""Exact percentiles, compensated moments, interval joins over many lengths, and writes that touch only what changed."""

import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strataloom.operators import moments as MO
from strataloom.operators import ranks as R
from strataloom.operators import registry as RG
from strataloom.operators import telemetry as T


def test_percentiles(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([1.0, 1.0, 1.0, 2.0, 5.0, 7.5, rng.random()])) for g in "aaaaab" * 80] + [("c", 3.0), ("d", None), (None, 4.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = {"mid": ("middle", 0), "p50": ("rank", 0.5), "p95": ("rank", 0.95), "most": ("rank", 1.0), "f90": ("floor", 0.9)}
    got = {r["g"]: tuple(r)[1:] for r in R.percentiles(df, ["g"], "x", **wanted).collect()}

    def plain(v):
        v = sorted(v)
        rank = lambda p: v[max(1, math.ceil(len(v) * p - 1e-9)) - 1]
        floor = math.floor(len(v) * 0.9 + 1e-9)
        return statistics.median(v), rank(0.5), rank(0.95), v[-1], v[floor] if floor < len(v) else None

    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    assert {g: v for g, v in got.items() if g is not None} == {g: plain(v) for g, v in by.items() if g is not None}
    assert tuple(R.percentiles(df, [], "x", **wanted).first()) == plain([x for _, x in rows if x is not None])
    assert R.percentiles(df.where("false"), [], "x", m=("middle", 0)).collect() == []


def test_moments(spark):
    rng = random.Random(2)
    values = {"big": [1e16 + rng.random() * 100 for _ in range(900)] + [1.0, -1e16] * 50, "small": [rng.gauss(1e9, 1e-3) for _ in range(1000)], "one": [5.0], "mixed": [1e100, 1.0, -1e100, 2.0]}
    rows = [(k, repr(v)) for k, own in values.items() for v in own] + [("big", "x"), ("big", None), ("none", "nan"), ("none", "inf"), (None, "2"), (None, "4")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x string").repartition(7)
    got = {r["k"]: r for r in MO.moments(df, "k", "x").collect()}
    for k, own in values.items():
        r = got[k]
        assert (r["n"], r["lo"], r["hi"]) == (len(own), min(own), max(own)) and r["total"] == math.fsum(own)
        if len(own) > 1 and k != "mixed":
            assert math.isclose(r["variance"], float(statistics.variance(map(__import__("fractions").Fraction, own))), rel_tol=1e-9)
    assert got["big"]["errors"] == 2 and got["one"]["variance"] is None
    assert (got["none"]["n"], got["none"]["errors"], got["none"]["mean"], got["none"]["total"]) == (0, 2, None, 0.0)
    assert (got[None]["n"], got[None]["mean"], got[None]["variance"]) == (2, 3.0, 2.0)
    assert MO.moments(df.where("false"), "k", "x").collect() == []


def test_tasks_of_all_lengths(spark):
    rng = random.Random(3)
    tasks = [(rng.choice("ab"), i, b, b + rng.choice([0, 5, 60, 10_000, 40_000_000])) for i, b in enumerate(rng.randrange(50_000_000) for _ in range(60))]
    events = [(rng.choice("ab"), rng.randrange(90_000_000)) for _ in range(400)] + [(k, b) for k, _, b, _ in tasks] + [(k, e) for k, _, _, e in tasks]
    got = T.within(spark.createDataFrame(tasks, "k string, slug int, begin long, end long"), spark.createDataFrame(events, "k string, t long"), "k").select("slug", "t").collect()
    assert sorted(map(tuple, got)) == sorted((s, t) for k, s, b, e in tasks for x, t in events if x == k and b <= t <= e)
    none = spark.createDataFrame([], "k string, slug int, begin long, end long")
    assert T.within(none, spark.createDataFrame(events, "k string, t long"), "k").collect() == []


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_rewrite(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda changed=(), keys=range(60): spark.createDataFrame([(k, j, f"{k}-{k in changed}", float(j)) for k in keys for j in range(3)], "f long, n int, digest string, v double")
    part = F.col("f") % 6
    content = lambda: sorted(map(tuple, spark.read.parquet(path).select("f", "n", "digest", "v").collect()))
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert RG.rewrite(rows(), path, ["f"], "digest", part) == [0, 1, 2, 3, 4, 5]
    first = files(path)
    assert RG.rewrite(rows(), path, ["f"], "digest", part) == [] and files(path) == first
    assert RG.rewrite(rows({7, 13}), path, ["f"], "digest", part) == [1]
    assert content() == plain(rows({7, 13})) and {f for f in files(path) if "_part=1/" not in f} <= first
    less = rows({8}, [8, 70]).where("n < 2")  # fewer rows of a changed file, and a new one; files that aren't named stay
    assert RG.rewrite(less, path, ["f"], "digest", part) == [2, 4]
    assert content() == sorted([r for r in plain(rows({7, 13})) if r[0] != 8] + plain(less))


def test_a_failed_rewrite_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40).select(F.col("id").alias("f"), F.lit("a").alias("digest"))
    RG.rewrite(rows, path, ["f"], "digest", F.col("f") % 4)
    before = files(path)
    bad = rows.withColumn("digest", F.when(F.col("f") == 13, F.raise_error(F.lit("torn"))).otherwise(F.lit("b")))
    with pytest.raises(Exception, match="torn"):
        RG.rewrite(bad, path, ["f"], "digest", F.col("f") % 4)
    assert files(path) == before


def test_small_files_are_spread(spark, sf):
    """What costs much a row runs on all cores, though the file is one task."""
    from strataloom.plans import records

    for query in (records.canonical_texts, records.schema_checks):
        assert query(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
