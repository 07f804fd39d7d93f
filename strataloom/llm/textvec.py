"""Words and white-space segments of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; a segment is a run of such white space
followed by a word. Both get 64-bit hashes: the sum, over blocks of eight bytes, of the mixed block and its number,
mixed again with the length. The mixing is no polynomial in the bytes, so regular words collide no more often than
others do, a pair with a chance near 2**-64. Tables of coded segments hold a second hash of the kind, and a segment
counts as known only if both are equal. No text is cut or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array."""
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The low bytes of a block that belong to it, by their number.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and each text's first byte (one offset more than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    off = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (a longer text is a part of its own)."""
    column = batch.column(batch.schema.get_field_index(text))
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """A hash of the bytes of each (not empty) run for each seed."""
    many = (ends - starts + 7) >> 3
    first = np.cumsum(many) - many
    number = np.arange(int(many.sum())) - np.repeat(first, many)
    at = np.repeat(starts, many) + 8 * number
    padded = np.append(data, np.zeros(8, np.uint8))
    block = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at]
    block &= _OWN[np.minimum(np.repeat(ends, many) - at, 8)]
    size = (ends - starts).astype(U)
    out = []
    for seed in seeds:
        place = mix(np.arange(int(many.max()), dtype=U) * U(0xD6E8FEB86659FD93) + U(seed))
        out.append(mix(np.add.reduceat(mix(block ^ place[number]), first) ^ mix(size + U(seed))))
    return out


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, its first byte, the byte after it, first word of each text: one more than texts)."""
    n, none = len(data), np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, U), none, none, np.zeros(len(off), np.int64)
    ws = _WS[data]
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = ws[:-1]
    fresh[off[off < n]] = True
    starts = np.flatnonzero(fresh & ~ws)
    first = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, U), none, none, first
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ws[1:]
    last[off[off > 0] - 1] = True
    ends = np.flatnonzero(last & ~ws) + 1
    return _hash(_LOWER[data], starts, ends, (1,))[0], starts, ends, first


def segments(data: np.ndarray, off: np.ndarray, space: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes of each segment, its first byte, first segment of each text: one more than texts). Segments cover all bytes.

    ``space`` says of each byte whether it counts as white space here.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ws = space[data]
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = ws[1:] & ~ws[:-1]
    fresh[off[off < n]] = True
    starts = np.flatnonzero(fresh)
    key, check = _hash(data, starts, np.append(starts[1:], n), (1, 2))
    return key, check, starts, np.searchsorted(starts, off)


def ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + size], one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first - (ends - size), size) + np.arange(total)]


class Known:
    """Numbers, from 0, of the keys seen so far. A key is two hashes; equal first and unequal second hashes are different keys."""

    def __init__(self):
        self.keys, self.slot, self.check = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, U)
        self.asked = np.zeros(0, np.int32)

    def again(self) -> np.ndarray:
        """Numbers of the keys that were asked for twice or more; only they are kept, under new numbers in this order."""
        kept = np.flatnonzero(self.asked > 1)
        new = np.full(len(self.check), -1)
        new[kept] = np.arange(len(kept))
        there = new[self.slot] >= 0
        self.keys, self.slot = self.keys[there], new[self.slot[there]]
        self.check, self.asked = self.check[kept], np.ones(len(kept), np.int32)
        return kept

    def __len__(self) -> int:
        return len(self.check)

    def look(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each key, places of those that are new, in the order of their numbers). ``keys`` rise and are distinct."""
        at = np.searchsorted(self.keys, keys)
        slot, there = np.full(len(keys), -1), np.zeros(len(keys), bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            there = self.keys[near] == keys
            old = self.slot[near]
            slot = np.where(there & (self.check[old] == checks), old, -1)
        new = np.flatnonzero(slot < 0)
        slot[new] = len(self.check) + np.arange(len(new))
        self.check = np.append(self.check, checks[new])
        self.asked = np.append(self.asked, np.zeros(len(new), np.int32))
        self.asked[slot] += 1
        fresh = np.flatnonzero(~there)  # of two keys with one first hash only the older one is kept
        self.keys = np.insert(self.keys, at[fresh], keys[fresh])
        self.slot = np.insert(self.slot, at[fresh], slot[fresh])
        return slot, new


class Coded:
    """What a slow function makes of distinct segments, kept between the batches of a task.

    Each value is a run of uint32 ids; the function gives them as a list, or one after another with the size of each. Beyond ``most`` segments or 16 * ``most`` ids only those that came in several batches stay, or none
    if these are many as well, so memory stays bounded and every segment is still coded in full.
    """

    def __init__(self, code, most: int = 200_000):
        self.code, self.most = code, most
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def _trim(self) -> None:
        kept = self.known.again()
        first, size = self.first[kept], self.size[kept]
        if len(kept) > self.most // 2 or size.sum() > 8 * self.most:
            self.clear()
            return
        self.flat = ragged(self.flat, first, size)
        self.used = len(self.flat)
        self.size, self.first = size, np.cumsum(size) - size

    def _grow(self, name: str, n: int) -> None:
        old = getattr(self, name)
        if n > len(old):
            new = np.zeros(max(n, len(old) + len(old) // 2), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def look(self, keys: np.ndarray, checks: np.ndarray, text_of) -> np.ndarray:
        """Place in first/size of each key; ``text_of(i)`` gives the i-th key's segment. Keys rise and are distinct."""
        if len(self.known) > self.most or self.used > 16 * self.most:
            self._trim()
        got, new = self.known.look(keys, checks)
        if len(new):
            runs = self.code([text_of(i) for i in new.tolist()])
            if not isinstance(runs, tuple):
                runs = np.concatenate([np.asarray(r, np.uint32) for r in runs]), np.fromiter(map(len, runs), np.int64, len(runs))
            coded, sizes = runs
            total, n = int(sizes.sum()), len(self.known)
            base = n - len(new)
            self._grow("flat", self.used + total)
            self._grow("first", n)
            self._grow("size", n)
            if total:
                self.flat[self.used : self.used + total] = coded
            self.size[base:n] = sizes
            self.first[base:n] = self.used + np.cumsum(sizes) - sizes
            self.used += total
        return got


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first hashes that occur, rising, their second hashes, a place of each, the number of each key among them).

    Where two unequal keys share their first hash, each takes a first hash of its own.
    """
    uniq, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
    if (checks != checks[where][inverse]).any():
        return distinct(mix(keys ^ mix(checks)), checks)
    return uniq, checks[where], where, inverse
