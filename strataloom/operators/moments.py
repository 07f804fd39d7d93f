"""Sums and variances that keep what doubles lose: partial states with a compensation term that merge pairwise."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import ship

#: total and lost: the sum and what it lost to rounding; about: a value near the mean; rest, square: sums of the differences from it and of their squares.
STATE = "n long, errors long, total double, lost double, about double, rest double, square double, lo double, hi double"
#: States of one group that meet in a task; more go through a round of merging before.
SHARES = 256


def merged(states: np.ndarray) -> tuple:
    """One state of several (rows as in STATE). Sums are exact but for the last rounding, whatever the order; differences of near means are exact."""
    n, errors = int(states[:, 0].sum()), int(states[:, 1].sum())
    some = states[states[:, 0] > 0]
    if not n:
        return 0, errors, 0.0, 0.0, 0.0, 0.0, 0.0, None, None
    parts = [*some[:, 2].tolist(), *some[:, 3].tolist()]
    total = math.fsum(parts)
    lost = math.fsum([*parts, -total])
    about = total / n + lost / n
    k, d, r = some[:, 0], some[:, 4] - about, some[:, 5]
    rest = math.fsum([*r.tolist(), *(k * d).tolist()])
    square = math.fsum([*some[:, 6].tolist(), *(2 * d * r).tolist(), *(k * d * d).tolist()])
    return n, errors, total, lost, about, rest, square, float(some[:, 7].min()), float(some[:, 8].max())


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, x; null x: an error) -> a state a key and batch."""
    for b in batches:
        key = b.column(0).dictionary_encode()
        x = b.column(1).to_numpy(zero_copy_only=False).astype(float)
        bad = ~np.isfinite(x)
        number = key.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(number[order], prepend=-1)), len(order))
        out = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, wrong = x[order[lo:hi]], bad[order[lo:hi]]
            good = own[~wrong]
            if not len(good):
                out.append((0, int(wrong.sum()), 0.0, 0.0, 0.0, 0.0, 0.0, None, None))
                continue
            total = math.fsum(good.tolist())
            lost = math.fsum([*good.tolist(), -total])
            about = total / len(good) + lost / len(good)
            d = good - about
            out.append((len(good), int(wrong.sum()), total, lost, about, math.fsum(d.tolist()), math.fsum((d * d).tolist()), float(good.min()), float(good.max())))
        keys = key.dictionary.take(pa.array(number[order][cuts[:-1]]))
        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 7]
        yield pa.RecordBatch.from_arrays([keys, *[pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=["key", *(f.split()[0] for f in STATE.split(", "))]) if out else pa.RecordBatch.from_pylist([], schema=pa.schema([("key", b.column(0).type), *zip([f.split()[0] for f in STATE.split(", ")], kinds, strict=True)]))


def moments(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, errors, total, mean, variance (of a sample), deviation, lo, hi for each value of ``by``.

    Values are numbers or texts; those that can't be read as a finite double are errors and don't count. variance and deviation are null for fewer than two values,
    total is 0 and the rest null for none. The sum carries its compensation through all merging. A null in ``by`` is a group of its own.
    """
    ship(rows.sparkSession)
    kind = rows.schema[by].dataType.simpleString()
    columns = [f.split()[0] for f in STATE.split(", ")]
    read = rows.select(F.col(by).cast("string").alias("key"), F.col(value).cast("string").try_cast("double").alias("x")) if dict(rows.dtypes)[value] == "string" else rows.select(F.col(by).cast("string").alias("key"), F.col(value).cast("double").alias("x"))
    read = read.select(F.concat(F.when(F.col("key").isNull(), "n").otherwise("k"), F.coalesce("key", F.lit(""))).alias("key"), "x")
    states = read.mapInArrow(_states, f"key string, {STATE}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["key"].iloc[0], *merged(pdf[columns].to_numpy(float)))], columns=["key", *columns])

    shared = states.withColumn("share", F.pmod(F.xxhash64(*columns), F.lit(SHARES)))
    some = shared.groupBy("key", "share").applyInPandas(lambda p: one(p), f"key string, {STATE}")
    done = some.groupBy("key").applyInPandas(lambda p: one(p), f"key string, {STATE}")
    held = F.col("n") > 0
    variance = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.col("square") - F.col("rest") * F.col("rest") / F.col("n")) / (F.col("n") - 1))
    name = F.when(F.col("key").startswith("k"), F.substring("key", F.lit(2), F.length("key"))).cast(kind)
    return done.select(name.alias(by), "n", "errors", (F.col("total") + F.col("lost")).alias("total"), F.when(held, F.col("about") + F.col("rest") / F.col("n")).alias("mean"), variance.alias("variance"), F.sqrt(variance).alias("deviation"), "lo", "hi")
