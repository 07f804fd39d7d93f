"""Language-model scores: a causal self-attention model in numpy over subword ids, and a unigram base.

A text is its words (A-Z lower-cased) and an end. Base: add-half word probabilities from counts over all training
texts. Model: the subword ids of " word" for each word, then the end id; an id has a class (the most frequent ids have
their own), the model gives the class from the ids before (its group, then the class within the group), and counts over
the whole training corpus give the id within its class. One attention layer with a ReLU layer reads windows of WINDOW ids; windows overlap, the
first scores all its ids and each later one its last STRIDE, so every id is scored once, with context.

Word counts, subword counts and classes come from all training texts by grouped sums. Parameters are fitted on all training
texts, in ROUNDS rounds that share them out: each task trains a copy on all windows of its texts, and grouped means over the
tasks are the next start. The TOP most frequent words are broadcast; the others meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .packing import bpe
from .store import cut, ship
from .toxicity import held_out

END = " "
END_ID = 50256
VOCAB = 50257
TOP = 200_000
#: Classes are GROUPS * MEMBERS: the model gives the group, then the member of the group.
GROUPS, MEMBERS = 32, 32
CLASSES = GROUPS * MEMBERS
OWN = CLASSES - MEMBERS
WINDOW, STRIDE = 64, 56
DIM, HIDDEN = 16, 32
#: Windows of a training step, and of a scored batch.
BATCH, SCORE_BATCH = 128, 256
ROUNDS, RATE = 2, 0.01
#: Longer words aren't broadcast, so what is has a bound in bytes; they meet their counts in the join.
TOP_CHARS = 40
HELD = 1
_vocabularies: dict = {}


def keep_freed() -> None:
    """Let this process use freed memory of large arrays again (up to 64 MB of it) instead of handing each back to the system: its pages
    would have to be made anew for every batch. Without such a C library nothing changes but the time."""
    import ctypes

    try:
        library = ctypes.CDLL(None)
        for setting, value in ((-3, 32 << 20), (-1, 64 << 20), (-2, 16 << 20)):  # largest block kept, kept at the end, added at once
            library.mallopt(setting, value)
    except (OSError, AttributeError):
        pass


def vocabulary(ranks_path: str) -> tuple:
    """(encoder, whether each id's bytes begin with a space); it outlives a task."""
    if ranks_path not in _vocabularies:
        enc = bpe(ranks_path)
        opens = np.zeros(enc.max_token_value + 1, bool)
        opens[[enc.encode_single_token(b) for b in enc.token_byte_values() if b[:1] == b" "]] = True
        _vocabularies[ranks_path] = enc, opens
    return _vocabularies[ranks_path]


def coded(ranks_path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of " word" for all words, one after another, and how many each has.

    The words are coded as one text: its pieces end before a space that a word follows, so they are those of the words alone, and only a
    word's first id begins with a space. Words with other white space in them (Unicode has more of it) are coded one by one.
    """
    enc, opens = vocabulary(ranks_path)
    text = " ".join(["", *words])
    if text.split() == words:
        ids = np.array(enc.encode_ordinary(text), np.uint32)
        return ids, np.diff(np.append(np.flatnonzero(opens[ids]), len(ids)))
    odd = [i for i, w in enumerate(words) if w.split() != [w]]
    ids, size = coded(ranks_path, [w if w.split() == [w] else "a" for w in words])
    runs = np.split(ids, np.cumsum(size)[:-1])
    for i in odd:
        runs[i] = np.array(enc.encode_ordinary(" " + words[i]), np.uint32)
    return np.concatenate(runs), np.array([len(r) for r in runs], np.int64)


def coder_of(ranks_path: str) -> tv.Coded:
    """Subword ids of " word", for one task."""
    return tv.Coded(lambda words: coded(ranks_path, words))


def numbered_coder(ranks_path: str, number: dict[str, int]) -> tv.Coded:
    """A word's number, 0 if it has none, and then the subword ids of " word", for one task."""

    def code(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, size = coded(ranks_path, words)
        return np.insert(ids, np.cumsum(size) - size, [number.get(w, 0) for w in words]), size + 1

    return tv.Coded(code)


class BatchWords:
    """The distinct words of a batch: their hashes (rising), each word's number among them, the first word of each text."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        keys, starts, ends, self.first = tv.words(data, off)
        found = pa.array(keys).dictionary_encode()
        seen, number = found.dictionary.to_numpy(), found.indices.to_numpy()
        where = np.empty(len(seen), np.int64)
        where[number] = np.arange(len(number))
        order = np.argsort(seen)
        rank = np.empty(len(seen), np.int64)
        rank[order] = np.arange(len(seen))
        self.keys, where, self.inverse = seen[order], where[order], rank[number]
        self._raw, self._starts, self._ends = data.tobytes().lower(), starts[where].tolist(), ends[where].tolist()

    def __len__(self) -> int:
        return len(self.keys)

    def name(self, i: int) -> str:
        """A word, A-Z lower-cased."""
        return self._raw[self._starts[i] : self._ends[i]].decode("utf-8", "replace")


def word_counts(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Rows (text) -> word, count, in parts of bounded size; the end counts once a text."""
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    for whole in batches:
        for b in tv.slices(whole, "text"):
            found = BatchWords(*tv.utf8(b.column(0)))
            for w, n in zip(map(found.name, range(len(found))), np.bincount(found.inverse, minlength=len(found)).tolist(), strict=True):
                held[w] = held.get(w, 0) + n
            held[END] = held.get(END, 0) + b.num_rows
            if len(held) > most:
                yield out()
                held = {}
    if held:
        yield out()


def id_counts(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    """Rows (word, c) -> subword id, count."""
    total = np.zeros(VOCAB, np.int64)
    for b in batches:
        words, c = b.column(0).to_pylist(), b.column(1).to_numpy()
        own = np.array([w != END for w in words], bool)
        total[END_ID] += c[~own].sum()
        ids, size = coded(ranks_path, [w for w in words if w != END])
        np.add.at(total, ids, np.repeat(c[own], size))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "c"])


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each id, log of its share of the class, log of the class's share). Rarer ids share classes of like mass."""
    c = counts + 0.5
    order = np.argsort(-c, kind="stable")
    cls = np.empty(len(c), np.int64)
    cls[order[:OWN]] = np.arange(OWN)
    rest = order[OWN:]
    mass = np.cumsum(c[rest]) - c[rest] / 2
    cls[rest] = OWN + np.minimum((mass / c[rest].sum() * (CLASSES - OWN)).astype(np.int64), CLASSES - OWN - 1)
    size = np.bincount(cls, weights=c, minlength=CLASSES)
    size = np.maximum(size, 1e-9)
    return cls, np.log(c / size[cls]), np.log(size / size.sum())


# The model: parameters are one flat float32 vector, cut into named parts.

SHAPES = {"emb": (CLASSES, DIM), "pos": (WINDOW, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM), "w1": (DIM, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, DIM), "grp": (DIM, GROUPS), "gb": (GROUPS,), "out": (GROUPS, DIM, MEMBERS), "b": (GROUPS, MEMBERS)}


_SIZES = {k: int(np.prod(s)) for k, s in SHAPES.items()}
_FIRST = dict(zip(SHAPES, np.cumsum([0, *_SIZES.values()]).tolist(), strict=False))


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {k: flat[_FIRST[k] : _FIRST[k] + _SIZES[k]].reshape(s) for k, s in SHAPES.items()}


def fresh(prior: np.ndarray, seed: int = 11) -> np.ndarray:
    """Parameters to start with: the class shares of the corpus, whatever the context."""
    rng = np.random.default_rng(seed)
    spread = {"emb": 0.3, "pos": 0.05, "grp": 0.05, "out": 0.05, "b1": 0.0, "gb": 0.0, "b": 0.0}
    flat = np.concatenate([(rng.standard_normal(int(np.prod(s))) * spread.get(k, s[0] ** -0.5)).astype(np.float32) for k, s in SHAPES.items()])
    p, each = parts(flat), prior.reshape(GROUPS, MEMBERS)
    top = each.max(1)
    p["gb"][:] = top + np.log(np.exp(each - top[:, None]).sum(1))
    p["b"][:] = each - p["gb"][:, None]
    return flat


#: Places of half a window: the earlier half asks itself, the later half both, so what lies later is mostly not computed.
ASKING = WINDOW // 2
#: Windows whose weights are made and used at once, so that they stay in the cache.
NEAR = 32
_EARLIER = np.tril(np.ones((ASKING, ASKING), np.float32))
#: A column of ones: sums over the last axis are products with it.
_ONES = {n: np.ones((n, 1), np.float32) for n in (GROUPS, MEMBERS)}


def _beside(*columns: np.ndarray) -> np.ndarray:
    return np.concatenate(columns, -1)


def joined(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parameters for states that end with a one: what is added stands below what multiplies, and the one stays.

    ``qkv`` takes a state to its query (scaled), key and value, side by side, and a one.
    """
    dtype = p["q"].dtype
    qkv = np.zeros((DIM + 1, 3 * DIM + 1), dtype)
    qkv[:DIM, :-1], qkv[DIM, -1] = asking(p), 1
    none = {n: np.zeros((n, 1), dtype) for n in (WINDOW, DIM, HIDDEN)}
    return {
        "emb": _beside(p["emb"], np.ones((CLASSES, 1), dtype)),
        "pos": _beside(p["pos"], none[WINDOW]),
        "qkv": qkv,
        "o": _beside(p["o"], none[DIM]),
        "w1": np.concatenate([p["w1"], p["b1"][None]]),
        "w2": _beside(p["w2"], none[HIDDEN]),
        "grp": np.concatenate([p["grp"], p["gb"][None]]),
        "out": np.concatenate([p["out"], p["b"][:, None]], 1),
    }


def asking(p: dict[str, np.ndarray]) -> np.ndarray:
    """What takes a state to its query (scaled), key and value, side by side."""
    return _beside(p["q"] * np.asarray(DIM**-0.5, p["q"].dtype), p["k"], p["v"])


def _cut(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x[:, :, :DIM], x[:, :, DIM : 2 * DIM], x[:, :, 2 * DIM :]


def _weights(q: np.ndarray, k: np.ndarray) -> np.ndarray:
    e = q @ k.transpose(0, 2, 1)
    if e.max(initial=0) > 60:
        np.minimum(e, 60, out=e)
    np.exp(e, out=e)
    e[:, :ASKING] *= _EARLIER
    return e


def attended(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Means of values over the places so far, a state's length a place, and what the backward pass needs: queries, keys and values with ones, shares of sums, weights.

    Scores stay small (they are scaled, and parameters are fitted from small ones), so the exponentials need a bound but no shift. Weights are
    divided by their sums after the means; the ones beside the values give the sums. Weights are held for the keys of the first half of a
    window (all places ask them) and for those of the second (its own places ask them).
    """
    qkv = (x @ w).reshape(-1, WINDOW, 3 * DIM + 1)
    q, k, v = _cut(qkv)
    z, weights = np.empty((len(qkv), WINDOW, DIM + 1), x.dtype), []
    for i in (slice(i, i + NEAR) for i in range(0, len(qkv), NEAR)):
        e, late = _weights(q[i], k[i, :ASKING]), _weights(q[i, ASKING:], k[i, ASKING:])
        np.matmul(e, v[i, :ASKING], out=z[i])
        z[i, ASKING:] += late @ v[i, ASKING:]
        weights.append((i, e, late))
    z = z.reshape(-1, DIM + 1)
    share = 1 / z[:, DIM:]
    return z[:, :DIM] * share, (qkv, share, weights)


def attended_back(dz: np.ndarray, z: np.ndarray, given: tuple) -> np.ndarray:
    """Gradient of queries, keys and values, side by side, from that of the means."""
    qkv, share, weights = given
    q, k, v = _cut(qkv)
    both = np.empty((len(dz), DIM + 1), dz.dtype)
    np.multiply(dz, share, out=both[:, :DIM])
    both[:, DIM] = -np.einsum("ij,ij->i", both[:, :DIM], z)  # z is the weights' product with the values
    both = both.reshape(-1, WINDOW, DIM + 1)
    dz = both[:, :, :DIM]
    out = np.empty((len(qkv), WINDOW, 3 * DIM), z.dtype)
    dq, dk, dv = _cut(out)
    for i, e, late in weights:
        de = both[i] @ v[i, :ASKING].transpose(0, 2, 1)
        de *= e
        np.matmul(e.transpose(0, 2, 1), dz[i], out=dv[i, :ASKING])
        np.matmul(de.transpose(0, 2, 1), q[i], out=dk[i, :ASKING])
        np.matmul(de, k[i, :ASKING], out=dq[i])
        de = both[i, ASKING:] @ v[i, ASKING:].transpose(0, 2, 1)
        de *= late
        np.matmul(late.transpose(0, 2, 1), dz[i, ASKING:], out=dv[i, ASKING:])
        np.matmul(de.transpose(0, 2, 1), q[i, ASKING:], out=dk[i, ASKING:])
        dq[i, ASKING:] += de @ k[i, ASKING:]
    return out.reshape(-1, 3 * DIM)


def hidden(w: dict[str, np.ndarray], x_in: np.ndarray) -> tuple:
    """States (B * WINDOW, DIM and a one) of windows of input classes under joined parameters, and what the backward pass needs."""
    x = w["emb"].take(x_in, axis=0)
    x += w["pos"]
    x = x.reshape(-1, DIM + 1)
    z, a = attended(x, w["qkv"])
    y = z @ w["o"]
    y += x
    u = y @ w["w1"]
    np.maximum(u, 0, out=u)
    h = u @ w["w2"]
    h += y
    return h, (x, a, z, y, u)


def by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the places by the group of their target, and the first place of each group in it."""
    group = (target // MEMBERS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(group, minlength=GROUPS)))


def _softmax(logits: np.ndarray, at: np.ndarray, shares: bool = True) -> np.ndarray:
    """Log-softmax at one place a row; ``logits``, taken within +-60 so that no exponential or sum leaves the range, become the probabilities (with ``shares``)."""
    if logits.max(initial=0) > 60 or logits.min(initial=0) < -60:
        np.clip(logits, -60, 60, out=logits)
    got = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    total = logits @ _ONES[logits.shape[1]].astype(logits.dtype)
    if shares:
        logits *= 1 / total
    return got - np.log(total[:, 0])


def _members(w: dict[str, np.ndarray], h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Logits of the members of each row's group, for rows in order of groups; and the rows of each group."""
    out = np.empty((len(h), MEMBERS), h.dtype)
    some = [(j, slice(first[j], first[j + 1])) for j in np.flatnonzero(np.diff(first)).tolist()]
    for j, at in some:
        np.matmul(h[at], w["out"][j], out=out[at])
    return out, some


def log_probs(p: dict[str, np.ndarray], x_in: np.ndarray, target: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
    """Natural log of each target class's probability, (B, WINDOW); with ``asked`` only at these places, and 0 elsewhere."""
    places = np.arange(target.size) if asked is None else np.flatnonzero(asked)
    t = target.reshape(-1)[places]
    order, first = by_group(t)
    t, places, w = t[order], places[order], joined(p)
    h = hidden(w, x_in)[0].take(places, axis=0)
    got = _softmax(h @ w["grp"], t // MEMBERS, False)
    got += _softmax(_members(w, h, first)[0], t % MEMBERS, False)
    out = np.zeros(target.size, got.dtype)
    out[places] = got
    return out.reshape(target.shape)


def gradient(flat: np.ndarray, x_in: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross-entropy over the masked places and its gradient."""
    p = parts(flat)
    out = np.zeros_like(flat)
    g, w = parts(out), joined(p)
    h, (x, a, z, y, u) = hidden(w, x_in)
    places = np.flatnonzero(mask)
    t = target.reshape(-1)[places]
    order, first = by_group(t)
    t, places = t[order], places[order]
    h = h.take(places, axis=0)
    rows = np.arange(len(t))
    group, member = t // MEMBERS, t % MEMBERS
    d = h @ w["grp"]
    loss = -float(_softmax(d, group).sum())
    d[rows, group] -= 1
    both = h.T @ d
    g["grp"][:], g["gb"][:] = both[:DIM], both[DIM]
    part = d @ p["grp"].T
    d, some = _members(w, h, first)
    loss -= float(_softmax(d, member).sum())
    d[rows, member] -= 1
    for j, at in some:
        both = h[at].T @ d[at]
        g["out"][j], g["b"][j] = both[:DIM], both[DIM]
        part[at] += d[at] @ p["out"][j].T
    dh = np.zeros((x_in.size, DIM), flat.dtype)
    dh[places] = part
    du = dh @ p["w2"].T
    du *= u > 0
    g["w2"][:] = u.T @ dh
    both = y.T @ du
    g["w1"][:], g["b1"][:] = both[:DIM], both[DIM]
    dy = du @ p["w1"].T
    dy += dh
    g["o"][:] = z.T @ dy
    d = attended_back(dy @ p["o"].T, z, a)
    each = x.T @ d
    g["q"][:], g["k"][:], g["v"][:] = each[:DIM, :DIM] * np.asarray(DIM**-0.5, flat.dtype), each[:DIM, DIM : 2 * DIM], each[:DIM, 2 * DIM :]
    dy += d @ asking(p).T  # now of x
    g["pos"][:] = dy.reshape(-1, WINDOW, DIM).sum(0)
    ids = x_in.reshape(-1).astype(np.uint16)
    order = np.argsort(ids, kind="stable")
    many = np.bincount(ids, minlength=CLASSES)
    seen = np.flatnonzero(many)
    g["emb"][seen] = np.add.reduceat(dy.take(order, axis=0), (np.cumsum(many) - many)[seen])
    n = max(1, len(t))
    out *= np.asarray(1 / n, flat.dtype)
    return loss / n, out


def windows(n: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of n ids: (text, first id, first id that is scored) of each window."""
    many = np.where(n > 0, 1 + -(-np.maximum(n - WINDOW, 0) // stride), 0)
    text = np.repeat(np.arange(len(n)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin = number * stride
    return text, begin, np.where(number == 0, 0, begin + WINDOW - stride)


def streams(data: np.ndarray, off: np.ndarray, coder: tv.Coded, lead: int = 0) -> tuple[np.ndarray, np.ndarray, BatchWords, np.ndarray]:
    """(subword ids of all texts with an end each, first id of each text, the words, place of each distinct word in the coder's ids).

    ``lead`` entries stand before a word's ids in the coder.
    """
    found = BatchWords(data, off)
    at = coder.look(found.keys, found.keys, found.name) if len(found) else np.zeros(0, np.int64)
    first, size = coder.first[at], coder.size[at] - lead
    each = size[found.inverse]
    ids = tv.ragged(coder.flat, (first + lead)[found.inverse], each) if len(each) else np.zeros(0, np.uint32)
    cuts = np.append(0, np.cumsum(each))[found.first]
    return np.insert(ids, cuts[1:], END_ID), cuts + np.arange(len(cuts)), found, first


def classed(ids: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Classes of the end, of the ids, and of a window of ends: the class before each id, and that of it one place on. Every text ends with an end, as one stands before the first."""
    return cls[np.concatenate([[END_ID], ids, np.full(WINDOW, END_ID)])]


def shown(of: np.ndarray, first: np.ndarray, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input classes, target classes, whether the targets lie in the text) of windows; places that don't are later than all that do."""
    at = (first[text] + begin)[:, None] + np.arange(WINDOW)
    return of[at], of[at + 1], np.arange(WINDOW) < (np.diff(first)[text] - begin)[:, None]


def cut_windows(b: pa.RecordBatch, coder: tv.Coded, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (text) -> training windows, one after another without overlap: input classes, target classes, and which places count."""
    ids, first, _, _ = streams(*tv.utf8(b.column(0)), coder)
    text, begin, _ = windows(np.diff(first), WINDOW)
    return shown(classed(ids, cls), first, text, begin)


def train_part(batches: Iterator[pa.RecordBatch], ranks_path: str, cls: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (text) -> this task's parameters after Adam over all windows of its texts, weighted by their number: place, value, weight."""
    keep_freed()
    coder, flat = coder_of(ranks_path), start.copy()
    mom, var, step, seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0
    for whole in batches:
        for b in tv.slices(whole, "text"):
            x, y, m = cut_windows(b, coder, cls)
            order = np.random.default_rng(len(x)).permutation(len(x))
            seen += len(x)
            for a in range(0, len(x), BATCH):
                i = order[a : a + BATCH]
                _, g = gradient(flat, x[i], y[i], m[i])
                step += 1
                mom += (g - mom) * np.float32(0.1)
                var += (g * g - var) * np.float32(0.01)
                rate = RATE * min(1.0, step / 20) * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
                flat -= np.float32(rate) * mom / (np.sqrt(var) + np.float32(1e-8))
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * seen), pa.array(np.full(len(flat), float(seen)))], names=["i", "s", "n"])


def fitted(train: DataFrame, prior: np.ndarray, ranks_path: str, cls: np.ndarray) -> np.ndarray:
    """Parameters after ROUNDS rounds of training in parallel and averaging; the driver holds one parameter vector.

    Each training text is read in one of the rounds, by its hash.
    """
    flat = fresh(prior)
    sc = train.sparkSession.sparkContext
    for r in range(ROUNDS):
        given = sc.broadcast((cls, flat))
        own = train.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == r).select("text")
        mean = own.mapInArrow(lambda it, given=given: train_part(it, ranks_path, *given.value), "i int, s double, n double").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("v"))
        got = mean.toPandas()  # one row a parameter
        if len(got):
            flat = got.sort_values("i").v.to_numpy(np.float32)
    return flat


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<w:string,k:long>>"


def scored(batches: Iterator[pa.RecordBatch], ranks_path: str, given) -> Iterator[pa.RecordBatch]:
    """Rows (id, held_out, text) -> token counts, the base over the broadcast words, the model's score, and the other words."""
    keep_freed()
    top, total, distinct, cls, within, flat = given.value
    p, coder = parts(flat), numbered_coder(ranks_path, {w: i for i, w in enumerate(top, 1)})
    count_of = np.fromiter((0, *top.values()), np.int64, len(top) + 1)
    low = np.log10(total + 0.5 * (distinct + 1))
    end = np.log10(top.get(END, 0) + 0.5) - low
    rid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    rare_type = pa.list_(pa.struct([("w", pa.string()), ("k", pa.int64())]))
    for whole in batches:
        for b in tv.slices(whole, "text"):
            rows = b.num_rows
            ids, first, found, where = streams(*tv.utf8(b.column(2)), coder, 1)
            n_words = np.diff(found.first)
            doc = np.repeat(np.arange(rows), n_words)
            c = count_of[coder.flat[where]]
            known = c > 0
            base = np.bincount(doc, weights=np.where(known, np.log10(c + 0.5) - low, 0.0)[found.inverse], minlength=rows) + end
            other = np.flatnonzero(~known[found.inverse])
            n_known = n_words - np.bincount(doc[other], minlength=rows) + (top.get(END, 0) > 0)
            pair, k = np.unique(doc[other] * max(1, len(found)) + found.inverse[other], return_counts=True)
            who, what = pair // max(1, len(found)), pair % max(1, len(found))
            offsets = np.searchsorted(who, np.arange(rows + 1)).astype(np.int32)
            new, what = np.flatnonzero(~known), (np.cumsum(~known) - 1)[what]
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array([found.name(i) for i in new.tolist()], pa.string()).take(pa.array(what)), pa.array(k.astype(np.int64))], names=["w", "k"]))
            score = np.bincount(np.repeat(np.arange(rows), np.diff(first)), weights=within[ids], minlength=rows)
            text, begin, fresh_from = windows(np.diff(first))
            of = classed(ids, cls)
            for a in range(0, len(text), SCORE_BATCH):
                own, start = text[a : a + SCORE_BATCH], begin[a : a + SCORE_BATCH]
                x, y, inside = shown(of, first, own, start)
                inside &= start[:, None] + np.arange(WINDOW) >= fresh_from[a : a + SCORE_BATCH, None]
                lp = log_probs(p, x, y, inside)
                score += np.bincount(own, weights=lp.sum(1, dtype=np.float64), minlength=rows)
            out = [pa.array(rid + np.arange(rows)), b.column(0), b.column(1), pa.array(n_words + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score / np.log(10)), rare.cast(rare_type)]
            rid += rows
            yield pa.RecordBatch.from_arrays(out, names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])


def frequent(counts: DataFrame) -> DataFrame:
    """The words over a count that at most TOP words reach, from a histogram of eighths of powers of two (a few hundred rows), but for long ones."""
    counts = counts.where(F.length("word") <= TOP_CHARS)
    step = F.floor(8 * F.log2("c")).cast("int")
    seen, least = 0, None
    for r in counts.groupBy(step.alias("k")).count().orderBy(F.desc("k")).collect():
        if seen + r["count"] > TOP:
            break
        seen, least = seen + r["count"], r["k"]
    return counts.where("false") if least is None else counts.where(step >= least)


def lm_scores(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, repeated rows too.

    Null and empty texts are the end alone; null ids are training rows. An empty table gives an empty one.
    Without training rows all counts are 0 and the model is the one it starts with.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, HELD).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    train = rows.where("not held_out").select("text", "doc_id")
    counts = cut(train.select("text").mapInArrow(word_counts, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = {r["word"]: r["c"] for r in frequent(counts).collect()}  # TOP rows at most
    if END not in top and total:
        top[END] = counts.where(F.col("word") == END).first()["c"]
    subword = np.zeros(VOCAB, np.int64)
    for r in counts.mapInArrow(lambda it: id_counts(it, ranks_path), "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():  # VOCAB rows at most
        subword[r["id"]] = r["c"]
    cls, within, prior = classes_of(subword)
    flat = fitted(train, prior, ranks_path, cls)
    model = spark.sparkContext.broadcast((top, int(total), int(distinct), cls, within, flat))
    out = cut(rows.mapInArrow(lambda it: scored(it, ranks_path, model), SCORED))
    asked = out.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.w").alias("word"), F.col("r.k").alias("k"))
    low = float(total + 0.5 * (distinct + 1))
    c = F.coalesce("c", F.lit(0))
    found = asked.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.col("k") * F.log10((c + 0.5) / low)).alias("more"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("also"))
    both = out.drop("rare").join(found, "rid", "left")
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
