"""Exact nearest rows by L2 or cosine distance, over cells that the triangle inequality can rule out.

Rows belong to the nearest of a bounded number of centres, and within a cell to a shell by their distance from the centre. From a query's
distance to a centre and the least and largest distance of a shell follows how near a row of the shell can be at best. Each query first
meets the cells nearest to it that hold k rows; the k-th distance found there is a bound, and then it meets only shells whose best case is
within it. Where vectors have no structure no shell is ruled out, and all queries meet all rows, in blocks.

Rows are read once, go to the shared folder with their cell and are dealt to blocks of bounded size; queries stream past a block. What a
block gives is k rows a query. Nothing but the sample for the centres and a row a shell comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut, ship

DIGITS = 6
#: Vectors of the sample, and numbers in it.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 22
#: Rows of a cell, about; cells, and shells of a cell, at most.
CELL_ROWS, MOST_CELLS, SHELLS = 4096, 1024, 8
#: Rows (and numbers) of a block, and queries that stream past it in one group.
BLOCK_ROWS, BLOCK_NUMBERS, BLOCK_QUERIES = 8192, 1 << 21, 8192
#: Distances are compared after rounding; bounds are loosened by more than that.
SLACK = 2e-6


def fitted(sample: np.ndarray, cells: int, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """Centres by k-means on a sample; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds if len(c) > 1 else 0):
        home = _squares(sample, c).argmin(1)
        new = np.zeros_like(c)
        np.add.at(new, home, sample)
        size = np.bincount(home, minlength=len(c))
        c = np.where(size[:, None] > 0, new / np.maximum(size, 1)[:, None], c)
    return c


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def _vectors(column: pa.Array, dim: int, metric: str, is_query: bool) -> np.ndarray:
    """Rows as doubles. Cosine: unit rows; zero rows of the two sides get a component each, which makes their cosine to all others 0."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    if metric != "cosine":
        return x
    most = np.abs(x).max(1)
    zero = most == 0
    x = x / np.where(zero, 1, most)[:, None]
    x = x / np.where(zero, 1, np.sqrt((x * x).sum(1)))[:, None]
    more = np.zeros((len(x), 2))
    more[:, int(is_query)] = zero
    return np.column_stack([x, more])


class Shells:
    """Of each shell: its cell, least and largest distance from the centre, rows."""

    def __init__(self, centres: np.ndarray, rows: list[tuple[int, int, float, float, int]]):
        self.centres = centres
        self.cell, self.shell, self.low, self.high, self.n = (np.array(c) for c in zip(*sorted(rows), strict=True))
        self.rows_of = np.bincount(self.cell, self.n, minlength=len(centres))

    def distances(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(_squares(q, self.centres))

    def nearest_cells(self, d: np.ndarray, k: int) -> np.ndarray:
        """Which cells a query meets first: the nearest ones, until they hold k rows."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.rows_of[order], axis=1) - self.rows_of[order]
        first = np.zeros(d.shape, bool)
        np.put_along_axis(first, order, before < k, 1)
        return first

    def best_case(self, d: np.ndarray) -> np.ndarray:
        """How near a row of each shell can be; loosened for rounding."""
        own = d[:, self.cell]
        bound = np.maximum(self.low[None, :] - own, own - self.high[None, :])
        return bound - SLACK - 1e-7 * (own + self.high[None, :])


def assigned(batches: Iterator[pa.RecordBatch], centres: np.ndarray, dim: int, metric: str) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) -> id, vector as bytes, cell, distance from its centre."""
    for whole in batches:
        for a in range(0, whole.num_rows, 4096):
            b = whole.slice(a, 4096)
            x = _vectors(b.column(1), dim, metric, False)
            cell = _squares(x, centres).argmin(1)
            far = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"])


def routed(batches: Iterator[pa.RecordBatch], shells: Shells, dim: int, metric: str, k: int, bounded: bool) -> Iterator[pa.RecordBatch]:
    """Queries (query_id, q[, bound]) -> with the shells they meet: first those of the nearest cells, then, with a bound, what else it leaves."""
    for whole in batches:
        for a in range(0, whole.num_rows, 1024):
            b = whole.slice(a, 1024)
            q = _vectors(b.column(1), dim, metric, True)
            d = shells.distances(q)
            meets = shells.nearest_cells(d, k)[:, shells.cell]
            if bounded:
                bound = b.column(2).to_numpy(zero_copy_only=False).astype(float)
                meets = ~meets & (shells.best_case(d) <= np.where(np.isnan(bound), np.inf, bound)[:, None])
            lists = [np.flatnonzero(m).astype(np.int32) for m in meets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "v", "shells"])


def _plain(ids: pa.Array) -> np.ndarray:
    """Ids as an array that sorts: strings by code point."""
    return np.array(ids.to_pylist(), dtype=str) if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type) else ids.to_numpy(zero_copy_only=False)


def _top(q: np.ndarray, x: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, rounded distances) of its k nearest, ties to the smaller id. Products only preselect; distances are computed from the differences."""
    near = np.sqrt(_squares(q, x))
    slack = SLACK + 1e-7 * (np.sqrt((q * q).sum(1))[:, None] + np.sqrt((x * x).sum(1))[None, :])
    if x.shape[0] > k:
        limit = np.partition(near + slack, k - 1, axis=1)[:, k - 1]
        chosen = near - slack <= limit[:, None]
    else:
        chosen = np.ones(near.shape, bool)
    for row, own in zip(q, chosen, strict=True):
        at = np.flatnonzero(own)
        d = np.round(np.sqrt(((x[at] - row) ** 2).sum(1)), DIGITS)
        order = np.lexsort((names[at], d))[:k]
        yield names[at[order]], d[order]


def met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shell, block, asking, is_query): a block's rows stand before the queries that pass it."""
    now, held, ids, kind = None, [], [], None
    rows = names = None
    for b in batches:
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("shell", "block", "asking", "is_query")]
        new = np.ones(b.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in keys], axis=0)
        at = np.append(np.flatnonzero(new), b.num_rows)
        kind = b.column("id").type
        out_q, out_id, out_d = [], [], []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            key = tuple(c[lo] for c in keys[:3])
            if key != now:
                now, held, ids, rows = key, [], [], None
            x = np.frombuffer(b"".join(b.column("v").slice(lo, hi - lo).to_pylist()), np.float64).reshape(hi - lo, -1)
            if not keys[3][lo]:
                held.append(x)
                ids.append(_plain(b.column("id").slice(lo, hi - lo)))
                continue
            if not held:
                continue
            if rows is None:
                rows, names = np.concatenate(held), np.concatenate(ids)
            asked = b.column("query_id").slice(lo, hi - lo)
            for a in range(0, len(x), 256):
                for i, (found, d) in enumerate(_top(x[a : a + 256], rows, names, k), a):
                    out_q += [i + lo] * len(found)
                    out_id += found.tolist()
                    out_d += d.tolist()
        yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(out_q, pa.int64())), pa.array(out_id, kind), pa.array(out_d, pa.float64())], names=["query_id", "id", "distance"])


def fine(c: str) -> str:
    """Whether a vector can be compared: not null, not empty, without null, NaN and infinite components."""
    return f"{c} is not null and size({c}) > 0 and forall({c}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """query_id, id, distance (rounded to DIGITS), rank 1..k by (distance, id) for every query vector.

    metric cosine: the distance is that of unit vectors, sqrt(max(0, 2 - 2 cos)), with a cosine of 0 for zero vectors.
    Vectors that are null, empty or hold null, NaN or infinite components, and rows with a null id, drop out on either side; vectors of
    another length than the query's are skipped. Queries with the same id share one ranking.
    """
    spark = vectors.sparkSession
    ship(spark)
    q = cut(queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("q")).where(f"query_id is not null and {fine('q')}"))
    rows = cut(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(f"id is not null and {fine('v')}"))
    found = spark.createDataFrame([], f"query_id {q.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double")
    asked = {r[0]: r[1] for r in q.groupBy(F.size("q")).count().collect()}  # one row a length
    for dim, n in sorted(rows.groupBy(F.size("v")).count().collect()):  # one row a length
        if dim in asked:
            found = found.unionByName(_of_length(rows.where(F.size("v") == dim), q.where(F.size("q") == dim), dim, n, asked[dim], k, metric))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _of_length(rows: DataFrame, q: DataFrame, dim: int, n: int, asked: int, k: int, metric: str) -> DataFrame:
    spark = rows.sparkSession
    kind_q, kind = q.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    cells = max(1, min(MOST_CELLS, n // CELL_ROWS, SAMPLE_NUMBERS // dim))
    share = min(1.0, 1.2 * SAMPLE / n)
    if cells > 1:
        sample = (rows.sample(fraction=share, seed=5) if share < 1 else rows).select("v").limit(min(SAMPLE, max(1, SAMPLE_NUMBERS // dim))).toArrow().column(0).combine_chunks()
        centres = fitted(_vectors(sample, dim, metric, False), cells)
    else:
        centres = np.zeros((1, dim + 2 * (metric == "cosine")))
    given = spark.sparkContext.broadcast(centres)  # MOST_CELLS rows at most
    placed = rows.mapInArrow(lambda it: assigned(it, given.value, dim, metric), f"id {kind}, v binary, cell int, far double")
    if cells == 1:
        return _meet(placed.select("id", "v", F.lit(0).alias("shell")), q.mapInArrow(lambda it: whole(it, dim, metric), f"query_id {kind_q}, v binary, shell int"), {0: n}, {0: asked}, dim, k, kind_q, kind)
    placed = cut(placed)
    edges = placed.groupBy("cell").agg(F.percentile_approx("far", [i / SHELLS for i in range(1, SHELLS)], 1000).alias("edges"))
    placed = cut(placed.join(F.broadcast(edges), "cell").select("id", "v", "cell", "far", F.size(F.filter("edges", lambda e: e < F.col("far"))).alias("ring")))  # a row a cell
    seen = placed.groupBy("cell", "ring").agg(F.min("far"), F.max("far"), F.count("*")).collect()  # MOST_CELLS * SHELLS rows at most
    shells = Shells(centres, [tuple(r) for r in seen])
    numbers = {(int(c), int(s)): i for i, (c, s) in enumerate(zip(shells.cell, shells.shell, strict=True))}
    number = F.broadcast(spark.createDataFrame([(*key, i) for key, i in numbers.items()], "cell int, ring int, shell int"))  # as many
    placed = placed.join(number, ["cell", "ring"]).select("id", "v", "shell")
    sizes = dict(enumerate(shells.n.tolist()))
    table = spark.sparkContext.broadcast(shells)
    out = f"query_id {kind_q}, v binary, shells array<int>"
    visits = lambda df, bounded: cut(df.mapInArrow(lambda it: routed(it, table.value, dim, metric, k, bounded), out).select("query_id", "v", F.explode("shells").alias("shell")))
    counts = lambda df: {r[0]: r[1] for r in df.groupBy("shell").count().collect()}  # noqa: E731  a row a shell
    first = visits(q, False)
    near = cut(_meet(placed, first, sizes, counts(first), dim, k, kind_q, kind))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    bound = near.withColumn("r", rank).where(F.col("r") == k).select("query_id", F.col("distance").alias("bound"))
    second = visits(q.join(bound, "query_id", "left").select("query_id", "q", "bound"), True)
    return near.unionByName(_meet(placed, second, sizes, counts(second), dim, k, kind_q, kind))


def whole(batches: Iterator[pa.RecordBatch], dim: int, metric: str) -> Iterator[pa.RecordBatch]:
    """Queries for a table of one shell."""
    for b in batches:
        q = _vectors(b.column(1), dim, metric, True)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(np.zeros(len(q), np.int32))], names=["query_id", "v", "shell"])


def _meet(rows: DataFrame, visits: DataFrame, sizes: dict[int, int], asked: dict[int, int], dim: int, k: int, kind_q: str, kind: str) -> DataFrame:
    """k rows a query and block. A shell's rows are dealt to blocks and its queries to groups; each block meets each group in a task."""
    spark = rows.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // dim, max(1024, -(-sum(sizes.values()) // n_parts))))
    plan = [(s, -(-n // most), -(-asked[s] // BLOCK_QUERIES)) for s, n in sizes.items() if asked.get(s)]
    dealt = F.broadcast(spark.createDataFrame(plan, "shell int, blocks int, askings int"))  # MOST_CELLS * SHELLS rows at most
    by = lambda parts: F.pmod(F.xxhash64("id", "v"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = rows.join(dealt, "shell").withColumn("block", by("blocks")).select("shell", "block", every("askings").alias("asking"), F.lit(False).alias("is_query"), F.lit(None).cast(kind_q).alias("query_id"), "id", "v")
    right = visits.join(dealt, "shell").withColumn("asking", F.pmod(F.xxhash64("query_id", "v"), F.col("askings")).cast("int")).select("shell", every("blocks").alias("block"), "asking", F.lit(True).alias("is_query"), "query_id", F.lit(None).cast(kind).alias("id"), "v")
    key = ["shell", "block", "asking"]
    both = left.unionByName(right).repartition(n_parts, *key).sortWithinPartitions(*key, "is_query")
    return both.mapInArrow(lambda it: met(it, k), f"query_id {kind_q}, id {kind}, distance double")
