"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find.

SuperMinHash gives every element of a set a random permutation of the registers; the register at rank j gets
j plus a uniform number, and each register keeps its least. The ranks of an element are correlated, which lowers
the variance against independent hashes, and a text stops as soon as all registers are below the next rank.

Texts of equal shingle sets form one class, so exact copies meet nowhere again. Two steps look alike: classes that
share a band are compared by their signatures, and the clusters of these links are confirmed on full sets. In
both a group (a bucket, a cluster) of any size is dealt to blocks of bounded rows. First each block is compared within
itself, with a few rows of the group (anchors) shown to all its blocks, and gives the trees of its links as
stars, so rows stay in proportion to the group; components label each class with its tree. Then only groups that
still hold several labels go on: their classes outside the commonest label meet all others, and a block
pair gives at most one link less than it has labels. So no link is lost, and a group that is one tree after the first
step, as groups of copies are, costs nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .graph import components
from .store import cut, ship

U = np.uint64
REGISTERS, BAND = 128, 4
#: Two classes go on to verification if at least this share of their registers agrees. At a true similarity of
#: 0.8 the share has a standard deviation under 0.036, so 0.6 lies 5.6 deviations below.
SOFT = 0.6
#: Rows of a block, and shingles of a block of full sets, about.
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
#: Rows of a group that are shown to all its blocks, about.
ANCHORS = 8


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text's words are one shingle, no words none."""
    h, _, _, first = tv.words(data, off)
    with np.errstate(over="ignore"):
        odd = [U(0x9E3779B97F4A7C15) * U(2 * i + 1) | U(1) for i in range(width)]
        if len(h) >= width:
            n = len(h) - width + 1
            rolled = np.zeros(n, U)
            for i in range(width):
                rolled += tv.mix(h[i : i + n] + odd[i])
            rolled = tv.mix(rolled)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                one = U(b - a)
                for i in range(a, b):
                    one = one + tv.mix(h[i : i + 1] + odd[i - a])[0]
                out.append(tv.mix(np.array([one], U)))
            else:
                out.append(np.zeros(0, U))
    return out


def super_minhash(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Signatures (uint32: rank in the high bits, uniform part below), one row per non-empty set.

    Rank by rank over all sets at once: Fisher-Yates gives each element its next register, and sets whose
    registers are all below the next rank stop. After rank 0 only sets with open registers need permutations.
    """
    bits = 32 - (m - 1).bit_length()
    sig = np.full((len(sets), m), np.uint32(0xFFFFFFFF))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, U)

    def draw(h: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        x = tv.mix(h + U(0x632BE59BD9B4E019) * U(j + 1))
        return (x >> U(64 - bits)).astype(np.uint32) | np.uint32(j << bits), j + ((x & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)

    def lower(owner: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        flat = owner * m + place
        order = np.lexsort((value, flat))
        flat, value = flat[order], value[order]
        head = np.ones(len(flat), bool)
        head[1:] = flat[1:] != flat[:-1]
        at = flat[head]
        view = sig.reshape(-1)
        view[at] = np.minimum(view[at], value[head])

    with np.errstate(over="ignore"):
        value, k0 = draw(h, 0)
        lower(owner, k0, value)
        open_sets = (sig >= np.uint32(1 << bits)).any(1)
        keep = open_sets[owner]
        h, owner, k0 = h[keep], owner[keep], k0[keep]
        for a in range(0, len(h), 1 << 17):  # elements of one set may fall into two parts: minima don't mind
            hh, oo, kk = h[a : a + (1 << 17)], owner[a : a + (1 << 17)], k0[a : a + (1 << 17)]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(hh), 1))
            rows = np.arange(len(hh))
            perm[rows, kk], perm[rows, 0] = perm[rows, 0], kk
            for j in range(1, m):
                value, k = draw(hh, j)
                place = perm[rows, k].copy()
                perm[rows, k] = perm[rows, j]
                perm[rows, j] = place
                lower(oo, place.astype(np.int64), value)
                go = (sig >= np.uint32(min((j + 1) << bits, 0xFFFFFFFF))).any(1)[oo]
                if not go.all():
                    hh, oo, perm = hh[go], oo[go], perm[go]
                    rows = np.arange(len(hh))
                if not len(hh):
                    break
    return sig


def band_keys(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    """One key per band and row, the band's number mixed in."""
    n, m = sig.shape
    parts = sig[:, : m // band * band].reshape(n, m // band, band).astype(U)
    with np.errstate(over="ignore"):
        key = np.arange(m // band, dtype=U)[None, :] * U(0x9E3779B97F4A7C15) + U(1)
        for i in range(band):
            key = tv.mix(key ^ parts[:, :, i])
    return key.astype(np.int64)


SIGNED = "doc_id long, n long, hi long, lo long, bands array<long>, short binary"


def signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) -> set size, 128-bit identity of the set, band keys and a byte of each register."""
    for whole in batches:
        for batch in tv.slices(whole, "text"):
            sets = shingles(*tv.utf8(batch.column(1)), width)
            n = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            sig = super_minhash(full)
            keys = band_keys(sig)
            short = (tv.mix(sig.astype(U)) & U(0xFF)).astype(np.uint8)
            hi, lo = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            at = np.flatnonzero(n)
            with np.errstate(over="ignore"):
                hi[at] = np.array([np.add.reduce(tv.mix(s)) for s in full], U).astype(np.int64)
                lo[at] = np.array([np.bitwise_xor.reduce(tv.mix(s ^ U(0xA5A5A5A5A5A5A5A5))) for s in full], U).astype(np.int64)
            offsets = np.append(0, np.cumsum(np.where(n > 0, keys.shape[1], 0))).astype(np.int32)
            shorts: list[bytes | None] = [None] * len(sets)
            for i, row in zip(at.tolist(), short, strict=True):
                shorts[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(hi), pa.array(lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))), pa.array(shorts, pa.binary())], names=["doc_id", "n", "hi", "lo", "bands", "short"])


def grouped(batches: Iterator[pa.RecordBatch], key: list[str], most: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``key``: one table may hold many small groups, none is cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(t.num_rows, bool)
        for c in key:
            v = t.column(c).to_numpy()
            last &= v == v[-1]
        first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if first:
            yield t.slice(0, first)
            held, rows = t.slice(first).to_batches(), t.num_rows - first
        else:
            held = t.to_batches()
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(t: pa.Table, key: list[str]) -> np.ndarray:
    """First row of each group, and the number of rows."""
    head = np.zeros(t.num_rows, bool)
    head[0] = True
    for c in key:
        v = t.column(c).to_numpy()
        head[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(head), t.num_rows)


class Forest:
    """Union-find over the rows of one table."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(us: list[int], vs: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=EDGES)


class Signatures:
    """Links of classes that agree in at least ``least`` registers."""

    def __init__(self, least: int):
        self.least, self.held = least, 1 << 15

    def of(self, t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t.column("payload").to_pylist()), np.uint8).reshape(t.num_rows, -1)

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which rows of x are linked with which of y."""
        out = np.empty((len(x), len(y)), bool)
        for k, row in enumerate(x):
            out[k] = (y == row).sum(1) >= self.least
        return out


class Sets:
    """Links of full sets with 100 * both >= percent * either."""

    def __init__(self, percent: int):
        self.percent, self.held = percent, 64

    def of(self, t: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(r, U) for r in t.column("payload").to_pylist()]

    def between(self, x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        both = overlaps(x, y).astype(np.float64)
        n, m = (np.array([len(s) for s in sets], np.float64) for sets in (x, y))
        return 100 * both >= self.percent * (n[:, None] + m[None, :] - both)


def overlaps(x: list[np.ndarray], y: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of each set of x with each other one of y: products of 0/1 matrices over the shingles that both sides hold."""
    parts = [np.concatenate(sets) if sets else np.zeros(0, U) for sets in (x, y)]
    if x is y:
        shared, times = np.unique(parts[0], return_counts=True)
        shared = shared[times > 1]
    else:
        shared = np.intersect1d(*parts)
    out = np.zeros((len(x), len(y)), np.float32)
    if not len(shared):
        return out
    placed = []
    for sets, flat in ((x, parts[0]), (y, parts[1])):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        keep = shared[at] == flat
        owner, at = owner[keep], at[keep]
        order = np.argsort(at, kind="stable")
        placed.append((len(sets), owner[order], at[order]))
    for a in range(0, len(shared), columns):
        m = []
        for n, owner, at in placed:
            lo, hi = np.searchsorted(at, (a, a + columns))
            part = np.zeros((n, min(columns, len(shared) - a)), np.float32)
            part[owner[lo:hi], at[lo:hi] - a] = 1
            m.append(part)
        out += m[0] @ m[1].T  # counts under 2**24 are exact
    return out


def within(batches: Iterator[pa.RecordBatch], kind: Signatures | Sets) -> Iterator[pa.RecordBatch]:
    """Rows (key, b, cid, payload) sorted by these -> each tree of the links within a block as a star around its lowest id."""
    key = ["key", "b"]
    said: set[tuple[int, int]] = set()
    for t in grouped(batches, key, kind.held):
        cid, at, payload = t.column("cid").to_numpy(), bounds(t, key), kind.of(t)
        us, vs = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            forest = Forest(b - a)
            own = payload[a:b]
            ok = kind.between(own, own)
            for i, j in np.argwhere(np.triu(ok, 1)).tolist():
                forest.join(i, j)
            for i in range(b - a):
                e = (int(cid[a + i]), int(cid[a + forest.root(i)]))
                if e[0] != e[1] and e not in said:
                    said.add(e)
                    us.append(e[0])
                    vs.append(e[1])
        if len(said) > 500_000:
            said.clear()
        yield _edges(us, vs)


def across(batches: Iterator[pa.RecordBatch], kind: Signatures | Sets) -> Iterator[pa.RecordBatch]:
    """Rows (key, li, aj, few, cid, label, payload) sorted by these -> links that join two labels, from the few to all."""
    key = ["key", "li", "aj"]
    for t in grouped(batches, key, kind.held):
        label, few, at, payload = t.column("label").to_numpy(), t.column("few").to_numpy(), bounds(t, key), kind.of(t)
        us, vs = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            mid = a + int((few[a:b] == 0).sum())
            if a == mid or mid == b:
                continue
            names, number = np.unique(label[a:b], return_inverse=True)
            forest = Forest(len(names))
            ok = kind.between(payload[mid:b], payload[a:mid])
            ok &= number[mid - a :, None] != number[None, : mid - a]
            i, j = np.nonzero(ok)
            pairs = np.unique(number[mid - a + i] * len(names) + number[j])
            for p in pairs.tolist():
                if forest.join(p // len(names), p % len(names)):
                    us.append(int(names[p // len(names)]))
                    vs.append(int(names[p % len(names)]))
        yield _edges(us, vs)


def _blocks(rows: str, weight: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(weight) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _parts(df: DataFrame, *key: str) -> DataFrame:
    """Dealt by ``key`` and sorted by all columns but the payload."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *key).sortWithinPartitions(*[c for c in df.columns if c != "payload"])


def _within(members: DataFrame, kind: Signatures | Sets) -> DataFrame:
    """Links of members (key, cid, w, payload, s and t: rows and weight of the key) inside blocks."""
    own = F.pmod(F.xxhash64("cid"), "n").cast("int")
    anchor = F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 30)) * F.col("s") < ANCHORS << 30
    b = F.explode(F.when(anchor & (F.col("n") > 1), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(own)))
    dealt = members.withColumn("n", _blocks("s", "t")).select("key", b.alias("b"), "cid", "payload")
    return _parts(dealt, "key", "b").mapInArrow(lambda it: within(it, kind), "u long, v long")


#: Rows of what is known of each key, about 60 bytes each, that may be broadcast; then the members of a large group needn't meet in one place.
BROADCAST_KEYS = 200_000


def _small(per_key: DataFrame) -> DataFrame:
    per_key = cut(per_key)
    return F.broadcast(per_key) if per_key.count() <= BROADCAST_KEYS else per_key


def _across(members: DataFrame, labels: DataFrame, kind: Signatures | Sets) -> DataFrame:
    """Links between the labels of keys that hold several."""
    known = members.join(labels.withColumnRenamed("id", "cid"), "cid", "left").select("key", "cid", "w", "payload", F.coalesce("component", "cid").alias("label"))
    per = known.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("w").alias("t"))
    most = F.max(F.struct("c", "t", "label"))
    open_keys = per.groupBy("key").agg(F.count("*").alias("k"), F.sum("c").alias("s"), F.sum("t").alias("t"), most.alias("top")).where("k > 1")
    sized = open_keys.select("key", F.col("top.label").alias("common"), _blocks("s", "t").alias("na"), F.col("s") - F.col("top.c"), F.col("t") - F.col("top.t")).toDF("key", "common", "na", "ls", "lt").withColumn("nl", _blocks("ls", "lt"))
    both = known.join(_small(sized), "key").withColumns({"own_a": F.pmod(F.xxhash64("cid"), "na").cast("int"), "own_l": F.pmod(F.xxhash64("cid", F.lit(2)), "nl").cast("int")})
    every = F.transform(F.sequence(F.lit(0), F.col("nl") - 1), lambda i: F.struct(i.alias("li"), F.col("own_a").alias("aj"), F.lit(0).alias("few")))
    light = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda j: F.struct(F.col("own_l").alias("li"), j.alias("aj"), F.lit(1).alias("few")))
    place = F.explode(F.when(F.col("label") != F.col("common"), F.concat(every, light)).otherwise(every))
    dealt = both.select("key", place.alias("p"), "cid", "label", "payload").select("key", "p.li", "p.aj", "p.few", "cid", "label", "payload")
    return _parts(dealt, "key", "li", "aj").mapInArrow(lambda it: across(it, kind), "u long, v long")


def _trees(members: DataFrame, kind: Signatures | Sets) -> DataFrame:
    """(id, component) of all links inside the keys of ``members``, a table that is cut already."""
    first = cut(_within(members, kind))
    labels = components(first)
    large = members.where(_blocks("s", "t") > 1)
    if large.isEmpty():
        return labels
    more = components(_across(large, labels, kind))
    if more.isEmpty():
        return labels
    new = more.select(F.col("id").alias("label"), F.col("component").alias("joined"))
    known = labels.join(new, labels["component"] == new["label"], "left").select("id", F.coalesce("joined", "component").alias("component"))
    return cut(known.unionByName(more.join(labels.select("id"), "id", "left_anti")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (component_id = doc_id), for every row.

    Texts without words (null, empty) have no shingles and link with nothing. Rows with equal ids get the same
    component; a null id takes part in nothing and is kept. An empty table gives an empty one. A text is never
    cut; other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sign = cut(rows.mapInArrow(lambda it: signed(it, width), SIGNED))
    small = sign.select("doc_id", "n", "hi", "lo")
    full = sign.where("n > 0 and doc_id is not null")
    same = ["hi", "lo", "n"]
    classes = cut(full.groupBy(*same).agg(F.min("doc_id").alias("cid")))
    heads = full.join(classes.withColumnRenamed("cid", "doc_id"), [*same, "doc_id"]).select(F.col("doc_id").alias("cid"), "bands", "short")
    bands = heads.select("cid", F.explode("bands").alias("key"))
    crowd = bands.groupBy("key").agg(F.count("*").alias("s")).where("s > 1")
    none = F.lit(0).cast("long")
    shared = bands.join(crowd, "key").join(heads.select("cid", F.col("short").alias("payload")), "cid").select("key", "cid", none.alias("w"), "payload", "s", none.alias("t"))
    cluster = _trees(cut(shared), Signatures(int(SOFT * REGISTERS)))
    found = _trees(_full_sets(rows, cluster, width), Sets(percent)).select(F.col("id").alias("cid"), "component")
    known = classes.join(found, "cid", "left").select(*same, F.coalesce("component", "cid").alias("component"))
    out = small.where("n > 0 and doc_id is not null").join(known, same).select("doc_id", "n", "component")
    alone = small.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    both = out.unionByName(alone)
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


#: Ids of clustered classes are broadcast up to this many (16 MB of longs); beyond it the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _full_sets(rows: DataFrame, cluster: DataFrame, width: int) -> DataFrame:
    """The members of each cluster with their sets."""
    wanted = cluster.select(F.col("id").alias("doc_id"), F.col("component").alias("key"))
    texts = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tv.slices(whole, "text"):
                sets = shingles(*tv.utf8(b.column("text")), width)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "cid", "w", "payload"])

    sets = cut(texts.select("doc_id", "key", "text").mapInArrow(full, "key long, cid long, w long, payload binary").where("w > 0"))
    return sets.join(_small(sets.groupBy("key").agg(F.count("*").alias("s"), F.sum("w").alias("t"))), "key")


def keep_firsts(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, all columns as they came: rows whose id is their group's smallest.

    Rows of a null id and texts without words are kept. An empty table gives an empty one.
    """
    found = near_duplicates(docs, width, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("key"))
    left = packed.join(found, packed["key"] == found["gone"], "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
