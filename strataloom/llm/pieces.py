"""SentencePiece encoding and decoding for merge-type (BPE) models, exactly, by backtracking.

A text is cut into segments (white space and the word after it), which are coded apart: a segment may begin
with a space, as no piece has a space mark after another character (checked when a model is loaded), or with
such other ASCII white space as no piece of two or more characters holds. Within a segment the encoder
takes the longest piece that starts at a position (Aho-Corasick), keeps it if the merges of the two last pieces'
joined text end in just these two, else tries the next shorter piece, and goes back when none is left; positions
that led nowhere are marked in a bitfield. Runs of two or more space marks have merges of equal score, which
the library settles by place and pairwise checks can't see: such segments are merged step by step instead.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import ship

MARK = "▁"
NORMAL, BYTE = 1, 6
_models: dict[str, PieceModel] = {}


class PieceModel:
    """Pieces, scores and byte ids of a model file, and the encoder built on them."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, spec = proto.normalizer_spec, proto.trainer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are handled")
        self.piece = [p.piece for p in proto.pieces]
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.odd = frozenset(i for i, p in enumerate(proto.pieces) if p.type != NORMAL)
        self.control = {i for i, p in enumerate(proto.pieces) if p.type not in (NORMAL, BYTE)}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece joins over a space")
        joined = set("".join(p for p in self.id if len(p) > 1))
        self.space = np.zeros(256, bool)
        self.space[[b for b in (0x20, 9, 10, 11, 12, 13) if chr(b) not in joined]] = True
        self.char = {p for p in self.id if len(p) == 1}
        self.agree: dict[tuple[str, str], bool] = {}
        own = [p for p in self.id if self.merged(p) == [p]]  # the others never come out of merging
        self.words = ahocorasick.Automaton()
        for p in own:
            self.words.add_word(p, p)
        self.words.make_automaton()
        real = set(own)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in real), None) for p in own}

    def merged(self, text: str) -> list[str]:
        """The pieces after merging the pair of the best score, leftmost first, until no pair is a piece."""
        n = len(text)
        if n <= 40:
            return self._merged_short(text)
        ends, live = list(range(1, n + 1)), [True] * n
        before = list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < n:
                joined = text[i : ends[j]]
                score = self.score.get(joined)
                if score is not None:
                    heapq.heappush(heap, (-score, i, j, joined))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if not (live[i] and ends[i] == j and j < n and live[j] and text[i : ends[j]] == joined):
                continue
            live[j] = False
            ends[i] = ends[j]
            if ends[i] < n:
                before[ends[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [text[i : ends[i]] for i in range(n) if live[i]]

    def _merged_short(self, text: str) -> list[str]:
        get, none = self.score.get, float("-inf")
        parts = list(text)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging left + right anew ends in these two pieces."""
        key = (left, right)
        found = self.agree.get(key)
        if found is None:
            if len(self.agree) > 300_000:
                self.agree.clear()
            found = self.agree[key] = self.merged(left + right) == [left, right]
        return found

    def known(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all pieces."""
        if not text:
            return []
        if text in self.shorter:
            return [text]
        if MARK * 2 in text:
            return self.merged(text)
        words, shorter, fits, agree = self.words, self.shorter, self.fits, self.agree
        # The longest pieces one after another, as far as each fits the one before; from there on with ways back.
        found = [p for _, p in words.iter_long(text)]
        for k in range(1, len(found)):
            pair = (found[k - 1], found[k])
            ok = agree.get(pair)
            if not (fits(*pair) if ok is None else ok):
                break
        else:
            return found
        n = len(text)
        out = found[:k]
        failed = 0  # bit p: no valid sequence starts at p after what stood before it
        at = sum(map(len, out))
        want: str | None = found[k]
        while want is not None:
            end = at + len(want)
            ok = not failed >> end & 1
            if ok and out:
                pair = (out[-1], want)
                ok = agree.get(pair)
                if ok is None:
                    ok = fits(*pair)
            if ok:
                out.append(want)
                at = end
                if at == n:
                    return out
                want = next(words.iter_long(text, at))[1]
                continue
            want = shorter[want]
            if want is None:
                failed |= 1 << at
                if not out:
                    break
                want = out.pop()
                at -= len(want)
        return self.merged(text)  # no compatible sequence: can't be for a consistent merge list

    def encode(self, text: str) -> list[int]:
        """Ids of a segment in which spaces are marks already; characters outside the vocabulary give byte ids."""
        char, out = self.char, []
        if set(text) <= char:
            return [self.id[p] for p in self.known(text)]
        run = 0
        for i, c in enumerate(text):
            if c not in char:
                out += [self.id[p] for p in self.known(text[run:i])]
                out += [self.byte[b] for b in c.encode("utf-8")]
                run = i + 1
        return out + [self.id[p] for p in self.known(text[run:])]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids: marks to spaces, runs of byte ids read as UTF-8, the dummy space in front dropped."""
        if self.odd.isdisjoint(ids):
            text = "".join(map(self.piece.__getitem__, ids))
            return (text[1:] if first and text.startswith(MARK) else text).replace(MARK, " ")
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_read(raw))
                raw = bytearray()
            if i in self.control:
                if i == 0:
                    out.append(" ⁇ ")
                continue
            p = self.piece[i]
            if first and not out and p.startswith(MARK):
                p = p[1:]
            first = False
            out.append(p.replace(MARK, " "))
        if raw:
            out.append(_read(raw))
        return "".join(out)


def _read(raw: bytearray) -> str:
    """UTF-8 with one U+FFFD for each byte that isn't part of a character."""
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4
        try:
            out.append(raw[i : i + n].decode("utf-8"))
            i += n
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


def model_of(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


class _Segments:
    """Coded segments: ids as text ("1,2,3"), their number and their decoded bytes. Bounded like textvec.Coded; what came in several
    batches outlives a task, as coding it anew costs more than all else."""

    def __init__(self, model: PieceModel, most: int = 200_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.known, self.held = tv.Known(), 0
        self.ids: list[bytes] = []
        self.text: list[bytes] = []
        self.count: list[int] = []

    def trim(self) -> None:
        kept = self.known.again().tolist()
        self.ids, self.text, self.count = ([x[k] for k in kept] for x in (self.ids, self.text, self.count))
        self.held = sum(map(len, self.ids)) + sum(map(len, self.text))
        if len(kept) > self.most // 2 or self.held > 32 * self.most:
            self.clear()

    def look(self, keys: np.ndarray, checks: np.ndarray, raw: bytes, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> list[int]:
        if len(self.known) > self.most or self.held > 64 * self.most:
            self.trim()
        got, new = self.known.look(keys, checks)
        for a, b, f in zip(begin[new].tolist(), end[new].tolist(), first[new].tolist(), strict=True):
            s = raw[a:b].decode("utf-8", "replace").replace(" ", MARK)
            ids = self.model.encode(MARK + s if f else s)
            self.ids.append(",".join(map(str, ids)).encode())
            self.count.append(len(ids))
            self.text.append(self.model.decode(ids, first=f).encode())
            self.held += len(self.ids[-1]) + len(self.text[-1])
        return got.tolist()


_tables: dict[str, _Segments] = {}
_MARK = MARK.encode()
_FIRST = np.uint64(0x5851F42D4C957F2D)


def digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) -> id, number of ids, sha256 of the ids and of the decoded text."""
    table = _tables.setdefault(path, _Segments(model_of(path)))
    for whole in batches:
        for batch in tv.slices(whole, "text"):
            data, off = tv.utf8(batch.column(1))
            keys, checks, starts, first = tv.segments(data, off, table.model.space)
            raw = data.tobytes()
            marked = _MARK in raw
            n_tokens, ids_sha, text_sha = [], [], []
            if len(keys):
                heads = np.zeros(len(keys), bool)
                heads[first[:-1][np.diff(first) > 0]] = True
                keys = np.where(heads, tv.mix(keys ^ _FIRST), keys)
                checks = np.where(heads, ~checks, checks)
                uniq, check, where, inverse = tv.distinct(keys, checks)
                ends = np.append(starts[1:], len(raw))
                got = table.look(uniq, check, raw, starts[where], ends[where], heads[where])
                count = np.array([table.count[j] for j in got], np.int64)[inverse]
                total = np.append(0, np.cumsum(count))[first]
                n_tokens = np.diff(total).tolist()
                parts, texts = [table.ids[j] for j in got], [table.text[j] for j in got]
                inv = inverse.tolist()
            for k in range(batch.num_rows):
                own = inv[first[k] : first[k + 1]] if len(keys) else []
                if marked and _MARK in raw[off[k] : off[k + 1]]:
                    ids = whole_ids(table.model, raw[off[k] : off[k + 1]].decode("utf-8", "replace"))
                    n_tokens[k] = len(ids)
                    ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(table.model.decode(ids).encode()).hexdigest())
                    continue
                ids_sha.append(hashlib.sha256(b",".join([parts[j] for j in own])).hexdigest())
                text_sha.append(hashlib.sha256(b"".join([texts[j] for j in own])).hexdigest())
            n_tokens = n_tokens or [0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    table.trim()


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>) and decoded (string) of every row; null text counts as empty, other columns aren't read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for b in batches:
            ids = [whole_ids(model, t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def whole_ids(model: PieceModel, text: str) -> list[int]:
    """Ids of one text, segment by segment."""
    if not text:
        return []
    if MARK in text:  # a mark in the text itself may join the space after it
        return model.encode(MARK + text.replace(" ", MARK))
    data = np.frombuffer(text.encode(), np.uint8)
    _, _, starts, _ = tv.segments(data, np.array([0, len(data)]), model.space)
    raw, ends = data.tobytes(), [*starts[1:].tolist(), len(data)]
    out: list[int] = []
    for k, (a, b) in enumerate(zip(starts.tolist(), ends, strict=True)):
        s = raw[a:b].decode().replace(" ", MARK)
        out += model.encode(MARK + s if k == 0 else s)
    return out


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, repeated rows too.

    Null and empty texts have no ids and the digests of empty strings; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: digests(it, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
