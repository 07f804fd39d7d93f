"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one vector kept per group.

Equal vectors form one class with a count. Centroids are fitted on a bounded sample (SAMPLE vectors), from which a mean that dominates
is taken off first; every class belongs to its nearest cell, and is also shown to each cell whose cosine is within a margin of that of its
own. A pair is compared in the home cell of one of the two if the other is shown there, so it is lost only if both miss the
other's home cell. The margin comes from the data: sampled vectors are turned by the angle of the threshold towards other vectors, half of these
from the cell next to their own, and the QUANTILE of what such pairs need is taken, with HEADROOM. Directions within the data are the ones that
change cells, whatever the number of dimensions. ``exact`` shows a vector to every cell that any vector of that angle could be at home in: the
difference of its scores on two centroids moves by no more than their distance times that of the pair. Recall is measured in the tests.

Cells are split into blocks of BLOCK homes and SHOWN shown vectors; a block pair is compared by matrix products of bounded
size and emits sums of links and a spanning forest, not the links. So a cell of any size is many bounded groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .minhash import Forest, bounds, grouped
from .store import cut, ship

SAMPLE = 16_384
CELL = 512
MOST_CELLS = 4096
BLOCK, SHOWN = 1024, 8192
#: Vectors that are turned to fit the margin, the share of these pairs that it must hold, and what it is widened by.
TURNED, QUANTILE, HEADROOM = 4096, 0.999, 1.1
#: A mean of unit vectors longer than this is taken off.
DOMINANT = 0.3
#: Numbers of the sample and of the centroids.
NUMBERS = 1 << 23


def unit_rows(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of length 1; the largest component is divided out first, so squares neither overflow nor vanish."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell takes the row that its own cell fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        s = x @ c.T
        home = s.argmax(1)
        new = np.zeros_like(c)
        np.add.at(new, home, x)
        size = np.bincount(home, minlength=k)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            new[empty] = x[np.argsort(s.max(1))[: len(empty)]]
        norm = np.sqrt((new * new).sum(1))
        c = np.where(norm[:, None] > 0, new / np.maximum(norm, 1e-300)[:, None], c)
    return c


class Cells:
    """Centroids, the mean that is taken off, and to which cells a vector is shown."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, exact: bool = False, seed: int = 5):
        mean = sample.mean(0)
        self.mean = mean if not exact and np.sqrt(mean @ mean) > DOMINANT else None
        z = self.moved(sample)
        self.centroids = spherical_kmeans(z, min(k, len(z)))
        self.reach, self.margin = None, 2.0
        if exact:
            far = np.sqrt(np.maximum(0, 2 - 2 * self.centroids @ self.centroids.T) + 1e-12)
            self.reach = far * math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
        elif len(self.centroids) > 1 and -1 < threshold < 1:
            self.margin = self.needed(sample, threshold, np.random.default_rng(seed))

    def moved(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return x
        z = x - self.mean
        return z / np.maximum(np.sqrt((z * z).sum(1)), 1e-12)[:, None]

    def needed(self, sample: np.ndarray, threshold: float, rng: np.random.Generator) -> float:
        x = sample[rng.choice(len(sample), min(TURNED, len(sample)), replace=False)]
        s = self.moved(sample) @ self.centroids.T
        home = s.argmax(1)
        first = np.argsort(home, kind="stable")
        start, size = np.searchsorted(home[first], np.arange(len(self.centroids))), np.bincount(home, minlength=len(self.centroids))
        own = self.moved(x) @ self.centroids.T
        second = np.argsort(own, axis=1)[:, -2]
        beside = first[np.minimum(start[second] + (rng.random(len(x)) * size[second]).astype(np.int64), len(sample) - 1)]
        to = np.where((rng.random(len(x)) < 0.5) & (size[second] > 0), beside, rng.integers(0, len(sample), len(x)))
        u = sample[to] - (sample[to] * x).sum(1)[:, None] * x
        length = np.sqrt((u * u).sum(1))
        some = length > 1e-9
        if not some.any():
            return 2.0
        x, u, own = x[some], u[some] / length[some, None], own[some]
        y = threshold * x + math.sqrt(1 - threshold * threshold) * u
        other = self.moved(y) @ self.centroids.T
        at = np.arange(len(x))
        lost = np.minimum(other.max(1) - other[at, own.argmax(1)], own.max(1) - own[at, other.argmax(1)])
        return float(np.quantile(lost, QUANTILE, method="higher")) * HEADROOM + 1e-9

    def shown(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own cell of each row, which cells it is shown to)."""
        s = self.moved(x) @ self.centroids.T
        home = s.argmax(1)
        below = s.max(1)[:, None] - s
        return home, below <= (self.margin if self.reach is None else self.reach[home])


def dealt(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    """Rows (cid, copies, embedding) -> a row per cell the class is shown to: cell, home."""
    dim = cells.centroids.shape[1]
    for whole in batches:
        for a in range(0, whole.num_rows, 4096):
            b = whole.slice(a, 4096)
            x = unit_rows(b.column(2), dim)
            home, shown = cells.shown(x)
            row, cell = np.nonzero(shown)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32)), pa.array([x[i].tobytes() for i in row], pa.binary())], names=["cid", "copies", "cell", "home", "unit"])


LINKS = "u long, v long, n long"
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, hb, ob) -> sums of links (u, null, n) and a spanning forest (u, v, 0).

    A pair of two homes counts in its one cell from the lower id; a home and a shown vector count in the home's
    cell, unless the other's home cell sees the pair too and has the lower number.
    """
    key = ["cell", "hb", "ob"]
    for t in grouped(batches, key, 4096):
        at = bounds(t, key)
        cid, copies = t.column("cid").to_numpy(), t.column("copies").to_numpy()
        cell, home = t.column("cell").to_numpy(), t.column("home").to_numpy()
        is_home = t.column("as_home").to_numpy(zero_copy_only=False)
        cells = t.column("cells").combine_chunks()
        unit = t.column("unit").to_pylist()
        us, vs, ns = [], [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            hs, os = a + np.flatnonzero(is_home[a:b]), a + np.flatnonzero(~is_home[a:b])
            if not len(hs) or not len(os):
                continue
            x = np.frombuffer(b"".join(unit[i] for i in hs), np.float64).reshape(len(hs), -1)
            y = np.frombuffer(b"".join(unit[i] for i in os), np.float64).reshape(len(os), -1)
            here = int(cell[a])
            found = [np.nonzero(x @ y[k : k + BLOCK].T >= threshold) for k in range(0, len(os), BLOCK)]
            p = hs[np.concatenate([i for i, _ in found])]
            q = os[np.concatenate([j + k * BLOCK for k, (_, j) in enumerate(found)])]
            inner = home[q] == here
            ok = np.where(inner, cid[p] < cid[q], True)
            far = np.flatnonzero(~inner)
            if len(far):
                # The home cell of the other sees the pair as well if this vector is shown there.
                lower = far[home[q[far]] < here]
                for one in np.unique(p[lower]).tolist():
                    own = lower[p[lower] == one]
                    ok[own] = ~np.isin(home[q[own]], cells[one].values.to_numpy())
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            sums = np.zeros(b - a, np.int64)
            np.add.at(sums, p - a, copies[q])
            np.add.at(sums, q - a, copies[p])
            some = np.flatnonzero(sums)
            us += cid[a + some].tolist()
            vs += [None] * len(some)
            ns += sums[some].tolist()
            names, inv = np.unique(np.concatenate([cid[p], cid[q]]), return_inverse=True)
            forest = Forest(len(names))
            half = len(p)
            for f, g in zip(inv[:half].tolist(), inv[half:].tolist(), strict=True):
                if forest.join(f, g):
                    us.append(int(names[f]))
                    vs.append(int(names[g]))
                    ns.append(0)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int64())], schema=_LINKS)


def near_vectors(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Null and zero vectors, and those with null or non-finite components, link with nothing. Only
    vectors of one length are compared; each length has cells of its own. Rows with equal ids are vectors of their own but share a component;
    null ids link with nothing. exact: no pair is lost, for more comparisons. An empty table gives an empty one; other columns aren't read.
    """
    spark = table.sparkSession
    ship(spark)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    fine = "vec_id is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x != 0)"
    rows = cut(rows.withColumn("e", F.expr(f"CASE WHEN {fine} THEN transform(e, x -> x + 0D) END")))
    good = rows.where("e is not null")
    classes = cut(good.groupBy("e").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")).select("cid", "copies", "e"))
    links, known = spark.createDataFrame([], LINKS), None
    for r in classes.groupBy(F.size("e").alias("dim")).count().orderBy("dim").collect():  # one row a length
        dim, total = r["dim"], r["count"]
        some = classes.where(F.size("e") == dim)
        k = max(1, min(MOST_CELLS, -(-total // CELL), NUMBERS // dim))
        most = max(1, min(SAMPLE, NUMBERS // dim))
        share = min(1.0, 1.2 * most / total)
        seen = (some.sample(fraction=share, seed=7) if share < 1 else some).select("e").limit(most).toArrow().column(0).combine_chunks()
        own = _links(some, Cells(unit_rows(seen, dim), k, threshold, exact), threshold)
        sums = own.groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("n"))
        counted = some.join(sums, "cid", "left")
        known = counted if known is None else known.unionByName(counted)
        links = links.unionByName(own)
    known = known if known is not None else classes.withColumn("n", F.lit(0).cast("long"))
    found = components(links.where("v is not null").select("u", "v")).select(F.col("id").alias("cid"), "component")
    known = known.join(found, "cid", "left").select("e", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    out = good.join(known, "e").select("vec_id", "n_links", "component_id")
    rest = rows.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, cells: Cells, threshold: float) -> DataFrame:
    spark = classes.sparkSession
    given = spark.sparkContext.broadcast(cells)  # MOST_CELLS rows at most
    shown = cut(classes.select("cid", "copies", "e").mapInArrow(lambda it: dealt(it, given.value), "cid long, copies long, cell int, home int, unit binary"))
    size = shown.groupBy("cell").agg(F.sum(F.expr("int(cell = home)")).alias("homes"), F.count("*").alias("all"))
    plan = F.broadcast(size.select("cell", F.ceil(F.col("homes") / BLOCK).cast("int").alias("nh"), F.ceil(F.col("all") / SHOWN).cast("int").alias("no")))  # MOST_CELLS rows at most
    lists = shown.where("cell != home").groupBy("cid").agg(F.collect_list("cell").alias("cells"))  # bounded by MOST_CELLS
    part = shown.join(plan, "cell").withColumns({"own_h": F.expr("int(pmod(xxhash64(cid), greatest(nh, 1)))"), "own_o": F.expr("int(pmod(xxhash64(cid), no))")})
    as_home = part.where("cell = home").join(lists, "cid", "left").select("cell", F.col("own_h").alias("hb"), F.explode(F.expr("sequence(0, no - 1)")).alias("ob"), F.lit(True).alias("as_home"), "cid", "copies", "home", "unit", F.coalesce("cells", F.array().cast("array<int>")).alias("cells"))
    as_other = part.where("nh > 0").select("cell", F.explode(F.expr("sequence(0, nh - 1)")).alias("hb"), F.col("own_o").alias("ob"), F.lit(False).alias("as_home"), "cid", "copies", "home", "unit", F.array().cast("array<int>").alias("cells"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = as_home.unionByName(as_other).repartition(n_parts, "cell", "hb", "ob").sortWithinPartitions("cell", "hb", "ob")
    return cut(both.mapInArrow(lambda it: linked(it, threshold), LINKS))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
