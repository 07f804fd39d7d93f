"""Approximate nearest neighbours by inner product with a permutation index.

A vector is represented by its nearest pivots in order. So that the largest inner product is the nearest place, a row gets one more
component that brings it to the length of the longest row, a query a zero there. Each shard of rows keeps an inverted file: a pivot's list
holds the rows that have it among their first PREFIX pivots, with its place. A query goes through the lists of its own first
pivots; what two prefixes have in common gives their footrule distance (a pivot that is missing counts as at place PREFIX), the
rows with the least distance are scored exactly on the original vectors, and the best k of each query are kept.

Rows lie in the shards of the home they are nearest to; a query visits the homes that are nearest to it. How many homes and what share of a shard
are looked at is not guessed: a sample of bounded size is searched exactly on the driver, and the smallest values that find
TARGET of the true neighbours there are taken. The sample's neighbours are farther than those among all rows, so the values err on the
safe side. ``exact`` looks at all homes and all rows. Every row is indexed, and equal vectors are one entry with the k + 1
smallest of their ids, which are all that any result can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, ship

PIVOTS, PREFIX = 256, 64
#: Rows of the sample, numbers in it, and queries searched in it.
SAMPLE, SAMPLE_NUMBERS, SAMPLE_QUERIES = 16_384, 1 << 22, 256
TARGET = 0.985
SHARES = (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.14, 0.2, 0.28, 0.4, 0.55, 0.75)
#: Rows and numbers of a shard, rows of a home and of the sample in it, at least, and queries that meet a shard in one group.
SHARD, SHARD_NUMBERS, HOME_ROWS, HOME_SAMPLE, QUERY_BLOCK = 16_384, 1 << 22, 8192, 128, 4096
FINE = "vec_id is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x != 0)"


def widened(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows over the longest length, with the component that makes them of length 1."""
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))])


def prefixes(scores: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the pivots with the highest scores, in order; of equals the first."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :length].astype(np.int32)


class Pivots:
    """Pivots, homes and what a sample said of them."""

    def __init__(self, sample: np.ndarray, queries: np.ndarray, longest: float, homes: int, k: int, exact: bool, seed: int = 11):
        rng = np.random.default_rng(seed)
        wide = widened(sample, longest)
        order = rng.permutation(len(wide))
        self.longest, self.places = longest, wide[order[:PIVOTS]]
        self.length = min(PREFIX, len(self.places))
        self.homes = wide[order[-homes:]]
        self.probes, self.share = len(self.homes), 1.0
        if exact or len(sample) <= 2 * k or not len(queries):
            return
        true = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, : k + 1]
        home = (wide @ self.homes.T).argmax(1)
        rank = np.argsort(np.argsort(-self.to_homes(queries), axis=1), axis=1)
        needed = np.take_along_axis(rank, home[true], 1)
        self.probes = int(np.quantile(needed, (1 + TARGET) / 2, method="higher")) + 1
        shard, prefix = Shard(sample, prefixes(wide @ self.places.T, self.length), len(self.places)), self.of_queries(queries)
        # Shares count within a row's own home, as homes are what shards are cut from.
        at = []
        for p, t in zip(prefix, true, strict=True):
            common = shard.common(p)
            own = home[None, :] == home[t][:, None]
            at.append((own & (common[None, :] >= common[t][:, None])).sum(1) / own.sum(1))
        found = [s for s in SHARES if (np.array(at) <= s).mean() >= TARGET]
        self.share = found[0] if found else 1.0

    def to_homes(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.homes[:, :-1].T

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return prefixes(widened(x, self.longest) @ self.places.T, self.length)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return prefixes(q @ self.places[:, :-1].T, self.length)


class Shard:
    """The inverted file of some rows. A place p of a prefix of length l weighs l - p, a missing pivot 0; as a + b - |a - b| is
    2 min(a, b), the footrule distance of two prefixes is l (l + 1) less twice the sum of the smaller weights."""

    def __init__(self, rows: np.ndarray, prefix: np.ndarray, pivots: int):
        self.rows, self.length = rows, prefix.shape[1]
        flat = prefix.reshape(-1)
        order = np.argsort(flat, kind="stable")
        self.first = np.searchsorted(flat[order], np.arange(pivots + 1))
        self.row = (order // self.length).astype(np.int32)
        self.weight = (self.length - order % self.length).astype(np.float64)

    def common(self, prefix: np.ndarray) -> np.ndarray:
        """Sum of the smaller weights for each row; the footrule distance falls by two for each."""
        lists = [slice(self.first[p], self.first[p + 1]) for p in prefix.tolist()]
        rows = np.concatenate([self.row[s] for s in lists])
        weights = np.concatenate([np.minimum(self.weight[s], self.length - place) for place, s in enumerate(lists)])
        return np.bincount(rows, weights, minlength=len(self.rows))

    def nearest(self, query: np.ndarray, prefix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, inner products) of the rows with the least footrule distance, ``most`` of them and their equals."""
        n = len(self.rows)
        if most < n:
            common = self.common(prefix)
            some = np.flatnonzero(common >= np.partition(common, n - most)[n - most])
        else:
            some = np.arange(n)
        return some, (self.rows[some] * query).sum(1)


FOUND = "query_id long, query_key long, vec_id long, score double"


def searched(batches: Iterator[pa.RecordBatch], pivots: Pivots, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (home, shard, block, is_query): a shard's rows stand before the queries that visit it."""
    now, held, ids, shard = None, [], [], None
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in ("home", "shard", "block")), strict=True))
        is_query = b.column("is_query").to_numpy(zero_copy_only=False)
        raw, names, query_key = b.column("e").to_pylist(), b.column("ids").to_pylist(), b.column("query_key").to_numpy(zero_copy_only=False)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, key in enumerate(keys):
            if key != now:
                now, held, ids, shard = key, [], [], None
            x = np.frombuffer(raw[i], np.float64)
            if not is_query[i]:
                held.append(x)
                ids.append(names[i])
                continue
            if not held:
                continue
            if shard is None:
                rows = np.stack(held)
                shard = Shard(rows, pivots.of_rows(rows), len(pivots.places))
            some, score = shard.nearest(x, pivots.of_queries(x[None, :])[0], max(k + 1, int(np.ceil(pivots.share * len(shard.rows)))))
            if len(some) > k + 1:
                top = np.flatnonzero(score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1])
                some, score = some[top], score[top]
            own = [(-s, v) for r, s in zip(some.tolist(), score.tolist(), strict=True) for v in ids[r] if v != names[i][0]]
            for s, v in sorted(own)[:k]:
                for c, value in zip(out, (names[i][0], query_key[i], v, -s), strict=True):
                    c.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 3 else pa.int64()) for k, c in enumerate(out)], names=["query_id", "query_key", "vec_id", "score"])


def routed(batches: Iterator[pa.RecordBatch], pivots: Pivots, is_query: bool) -> Iterator[pa.RecordBatch]:
    """Rows (ids, e) -> with the vector as bytes and the homes they go to: the nearest for rows, ``probes`` for queries."""
    dim = pivots.homes.shape[1] - 1
    for whole in batches:
        for a in range(0, whole.num_rows, 4096):
            b = whole.slice(a, 4096)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if is_query:
                homes = prefixes(pivots.to_homes(x), pivots.probes)
            else:
                homes = (widened(x, pivots.longest) @ pivots.homes.T).argmax(1).astype(np.int32)[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(homes), pa.list_(pa.int32()))], names=["ids", "e", "homes"])


def largest_products(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, rank from 1, vec_id, score: for each query the k rows with the largest inner product that the index finds, ties to the smaller id.

    Rows with the query's id are no candidates. Null, zero and non-finite vectors and null ids take no part; vectors of
    another length than the query's are no candidates. Rows that repeat id and vector are one; queries that share an id and differ
    are answered each. Fewer than k candidates give fewer rows, an empty table none; other columns aren't read.
    """
    spark = table.sparkSession
    ship(spark)
    read = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e")).where(FINE).withColumn("e", F.expr("transform(e, x -> x + 0D)")).distinct()
    smallest = F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))
    entries = cut(read(table).withColumn("r", smallest).where(F.col("r") <= k + 1).groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "e"))  # k + 1 ids at most
    asked = cut(read(queries).select(F.array("vec_id").alias("ids"), "e"))
    found = spark.createDataFrame([], FOUND)
    length = F.expr("sqrt(aggregate(e, 0D, (s, x) -> s + x * x))")
    sizes = entries.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n"), F.max(length).alias("longest")).orderBy("dim").collect()  # one row a length
    for dim, n, longest in sizes:
        found = found.unionByName(_found(entries.where(F.size("e") == dim), asked.where(F.size("e") == dim), dim, n, longest * (1 + 1e-12), k, exact))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sample(rows: DataFrame, total: int, most: int, dim: int) -> np.ndarray:
    share = min(1.0, 1.2 * most / max(1, total))
    some = (rows.sample(fraction=share, seed=7) if share < 1 else rows).select("e").limit(most).toArrow().column(0).combine_chunks()
    return (some.flatten().to_numpy(zero_copy_only=False) if len(some) else np.zeros(0)).reshape(-1, dim)


def _found(entries: DataFrame, asked: DataFrame, dim: int, n: int, longest: float, k: int, exact: bool) -> DataFrame:
    spark = entries.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = asked.count()
    sample = _sample(entries, n, max(k + 1, min(SAMPLE, SAMPLE_NUMBERS // dim)), dim)
    homes = max(1, min(n // HOME_ROWS, len(sample) // HOME_SAMPLE))
    given = spark.sparkContext.broadcast(Pivots(sample, _sample(asked, many, SAMPLE_QUERIES, dim), longest, homes, k, exact))  # PIVOTS + SAMPLE / HOME_SAMPLE rows at most
    kinds = "ids array<long>, e binary, homes array<int>"
    rows = cut(entries.mapInArrow(lambda it: routed(it, given.value, False), kinds).select("ids", "e", F.col("homes")[0].alias("home")))
    visits = cut(asked.mapInArrow(lambda it: routed(it, given.value, True), kinds).select("ids", "e", F.explode("homes").alias("home")))
    most = max(1, min(SHARD, SHARD_NUMBERS // dim, max(1024, -(-n // n_parts))))
    count = lambda df, name, size: df.groupBy("home").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    plan = F.broadcast(count(rows, "shards", most).join(count(visits, "blocks", QUERY_BLOCK), "home"))  # a row a home
    dealt = lambda parts: F.pmod(F.xxhash64("e", "ids"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = rows.join(plan, "home").withColumn("shard", dealt("shards")).select("home", "shard", every("blocks").alias("block"), F.lit(False).alias("is_query"), "ids", F.lit(0).cast("long").alias("query_key"), "e")
    right = visits.join(plan, "home").withColumn("block", dealt("blocks")).select("home", every("shards").alias("shard"), "block", F.lit(True).alias("is_query"), "ids", F.xxhash64("e").alias("query_key"), "e")
    keys = ["home", "shard", "block"]
    return left.unionByName(right).repartition(n_parts, *keys).sortWithinPartitions(*keys, "is_query").mapInArrow(lambda it: searched(it, given.value, k), FOUND)


def op12_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return largest_products(rows, rows.where("vec_id % 20 = 0"), 20)
