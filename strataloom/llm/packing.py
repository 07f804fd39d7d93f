"""Best-fit packing of token sequences.

Best-two-fit over lengths: a bin takes the longest piece left, then the longest that fits its gap, again and
again; at the end its smallest piece goes back if two unpacked pieces fill the widened gap more tightly.
Only the number of pieces of each length matters to that, so the driver packs a histogram (at most ``width``
numbers) and gets bin patterns with repeat counts; the pieces then take places in the patterns by their rank
within their length, on the executors. Packing is global, and what the driver holds doesn't grow with the data.
"""

from __future__ import annotations

import base64
import json
import pathlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .store import cut, ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, slot long"
#: Unicode white space outside ASCII, as UTF-8. A text with any of it, or with an added token, is coded whole, as segments would not be independent.
WIDE_SPACE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_vocabularies: dict = {}


def bpe(ranks_path: str):
    """Encoder of the byte-level vocabulary: the ids of texts without added tokens are those of tokenizers with the same vocabulary's .json (tested)."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Tokens of a vocabulary's .json that are taken out of a text before anything else, special ones too."""
    with open(vocabulary, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if odd := [t["content"] for t in found if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]:
        raise ValueError(f"added tokens with rules for what stands beside them: {odd}")
    return {t["content"]: t["id"] for t in found}


def with_added(text: str, encode, added: dict[str, int]) -> list[int]:
    """Ids of a text: added tokens are ids of their own (the first place, then the longest one), each part between them is coded for itself."""
    if not added:
        return encode(text)
    out: list[int] = []
    parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
    for k, part in enumerate(parts):
        if k % 2:
            out.append(added[part])
        elif part:
            out += encode(part)
    return out


def token_ids(data: np.ndarray, off: np.ndarray, coder: tv.Coded, added: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and each text's first id (one more than texts)."""
    keys, checks, starts, first = tv.segments(data, off)
    raw = data.tobytes()
    if not len(keys):
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    whole = [*WIDE_SPACE, *(t.encode() for t in added)]
    odd = any(s in raw for s in whole)
    ends = np.append(starts[1:], len(raw))
    uniq, check, where, inverse = tv.distinct(keys, checks)
    at = coder.look(uniq, check, lambda i: raw[starts[where[i]] : ends[where[i]]].decode("utf-8", "replace"))[inverse]
    size = coder.size[at]
    ids = tv.ragged(coder.flat, coder.first[at], size)
    bounds = np.append(0, np.cumsum(size))[first]
    if odd:
        runs = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in range(len(runs)):
            own = raw[off[k] : off[k + 1]]
            if any(s in own for s in whole):
                runs[k] = np.asarray(with_added(own.decode("utf-8", "replace"), lambda t: coder.code([t])[0], added), np.uint32)
        ids = np.concatenate(runs)
        bounds = np.append(0, np.cumsum([len(r) for r in runs]))
    return ids, bounds


def coder_of(ranks_path: str) -> tv.Coded:
    """A table for one task; only the vocabulary outlives it."""
    if ranks_path not in _vocabularies:
        _vocabularies[ranks_path] = bpe(ranks_path)
    enc = _vocabularies[ranks_path]
    return tv.Coded(lambda texts: [enc.encode_ordinary(t) for t in texts])


def cut_pieces(batches: Iterator[pa.RecordBatch], ranks_path: str, added: dict[str, int], width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) -> pieces with their rank (slot) among this task's pieces of the same length."""
    coder = coder_of(ranks_path)
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    seen = np.zeros(width + 1, np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("slot", pa.int64())])
    for whole in batches:
        for batch in tv.slices(whole, "text"):
            ids, bounds = token_ids(*tv.utf8(batch.column(1)), coder, added)
            n = np.diff(bounds) + 1
            pieces = -(-n // width)
            doc = np.repeat(np.arange(len(n)), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = n - (pieces - 1) * width
            start = np.where(number == 0, 0, head[doc] + (number - 1) * width)
            length = np.where(number == 0, head[doc], width)
            tail = np.array([end_id], "<u4").tobytes()
            ids = np.ascontiguousarray(ids, "<u4")
            last = number == pieces[doc] - 1
            begin = bounds[doc] + start
            crc = [zlib.crc32(tail, zlib.crc32(ids[a : a + k - 1])) if z else zlib.crc32(ids[a : a + k]) for a, k, z in zip(begin.tolist(), length.tolist(), last.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sizes, first = np.unique(length[order], return_index=True)
            many = np.diff(np.append(first, len(order)))
            slot = np.empty(len(order), np.int64)
            slot[order] = np.arange(len(order)) - np.repeat(first, many) + np.repeat(seen[sizes], many)
            seen[sizes] += many
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(slot)], schema=schema)


def best_two_fit(counts: dict[int, int], width: int) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths, longest first, and how many bins are filled so) that use up ``counts``.

    A pattern is repeated while its lengths last, as the same greedy choices would come again.
    """
    left = np.zeros(width + 2, np.int64)
    for size, n in counts.items():
        left[size] = n
    bins: list[tuple[list[int], int]] = []

    def longest(most: int, taken: dict[int, int]) -> int:
        own = left[1 : most + 1]
        for size in (np.flatnonzero(own)[::-1] + 1).tolist() if most > 0 else ():
            if left[size] > taken.get(size, 0):
                return size
        return 0

    def two(most: int, least: int, taken: dict[int, int]) -> tuple[int, int] | None:
        """The unpacked pair of the largest sum in least+1..most."""
        free = left[: most + 1].copy()
        for size, n in taken.items():
            if size <= most:
                free[size] -= n
        has = free > 0
        sizes = np.flatnonzero(has)
        for total in range(most, least, -1):
            a = sizes[(sizes * 2 >= total) & (sizes < total)]
            b = total - a
            ok = a[has[b] & ((a != b) | (free[a] > 1))]
            if len(ok):
                return int(ok[-1]), int(total - ok[-1])
        return None

    while left.any():
        taken: dict[int, int] = {}
        gap = width
        while size := longest(gap, taken):
            taken[size] = taken.get(size, 0) + 1
            gap -= size
        if gap and taken:
            small = min(taken)
            if len(taken) > 1 or taken[small] > 1:
                taken[small] -= 1
                pair = two(gap + small, small, taken)
                if pair:
                    for size in pair:
                        taken[size] = taken.get(size, 0) + 1
                else:
                    taken[small] += 1
        taken = {k: v for k, v in taken.items() if v}
        times = int(min(left[k] // v for k, v in taken.items()))
        for k, v in taken.items():
            left[k] -= v * times
        bins.append((sorted((k for k, v in taken.items() for _ in range(v)), reverse=True), times))
    return bins


def places(bins: list[tuple[list[int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs (first rank, sequences, first sequence, offset): rank r of the run sits in sequence first + (r - first rank)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for sizes, times in bins:
        offset = 0
        for size in sizes:
            out.setdefault(size, []).append((used.get(size, 0), times, sequence, offset))
            used[size] = used.get(size, 0) + times
            offset += size
        sequence += times
    return out


def pack(docs: DataFrame, ranks_path: str, width: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Pieces of all rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    vocabulary: the .json with the added tokens, beside the ranks and of the same name unless given. Their strings in a text are these tokens.
    Null and empty texts are the end id alone. A null id stays null. Repeated rows are packed each for itself,
    an empty table gives an empty one, a text of any length is cut whole; other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    added = added_tokens(vocabulary or str(pathlib.Path(ranks_path).with_suffix(".json")))
    pieces = cut(rows.mapInArrow(lambda it: cut_pieces(it, ranks_path, added, width, end_id), PIECES))
    per = pieces.groupBy("length", "part").agg((F.max("slot") + 1).alias("n"))
    base = cut(per.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "part", "n", F.coalesce("base", F.lit(0)).alias("base")))
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `width` rows
    table = places(best_two_fit(counts, width))
    firsts = {k: np.array([r[0] for r in v]) for k, v in table.items()}
    runs = {k: np.array(v, np.int64).reshape(-1, 4) for k, v in table.items()}
    given = spark.sparkContext.broadcast((firsts, runs))  # bounded by the number of patterns, whatever the rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, runs = given.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                run = runs[size][np.searchsorted(firsts[size], rank[at], "right") - 1]
                seq[at] = run[:, 2] + rank[at] - run[:, 0]
                offset[at] = run[:, 3]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base.drop("n"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("slot")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
