"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length.

Folding: lower case, accents off, letters of other scripts that look like Latin ones, and digits or signs that stand
for letters inside a word. Lexicon entries are whole words or beginnings of words; their weights are log odds of
labelled documents, learned from rows outside the held-out fold. Matches inside an exception phrase don't count.
The score is a logistic function of the weighted sum and of that sum per length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import cut, ship

#: Labelled rows that the lexicon and the two coefficients are fitted on, at most, chosen by hash of the id.
TRAIN_ROWS = 20_000
ENTRIES = 3_000
PREFIXES = (4, 5, 6)
LEAST_DOCS = 4
LEAST_GAIN = 20.0
LEAST_ODDS = 2.5
#: Words that count without labels, with their weight.
SEED = dict.fromkeys("idiot moron stupid loser pathetic worthless disgusting scum trash clown dumb imbecile cretin bastard scumbag".split(), 3.0)
#: Harmless phrases with such words.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "class clown", "sore loser rule", "pond scum")
#: Letters of other scripts by the Latin letters that they look like.
LOOKS = dict(zip("аеорсухіјѕѵԁһкмтвнαεορτυνικβκ", "aeopcyxijsvdhkmtbhaeoptuvikbk", strict=True))
#: Digits and signs by the letters that they stand for.
STANDS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_STAND = str.maketrans(STANDS)
_INNER = re.compile(r"(?<=[a-z])[013457@$]{1,2}(?=[a-z])")
_FIRST = re.compile(r"(?<![a-z0-9@$])[13457@$](?=[a-z]{2})")


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(k): v for k, v in LOOKS.items()}
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(c))[0]
        if base != chr(c) and base.isalpha():
            out[c] = base.lower()
    for c in range(0xFF01, 0xFF5F):
        out[c] = chr(c - 0xFEE0).lower()
    for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, *range(0x300, 0x370)):
        out[c] = None
    return out


_FOLD = _table()
_GAP = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})


def _letters(found: re.Match) -> str:
    return found.group().translate(_STAND)


def fold(text: str) -> str:
    """Folded words with single spaces between and around."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    for signs in (_INNER, _FIRST):
        t = signs.sub(_letters, t)
    return f" {' '.join(t.translate(_GAP).split())} "


def entries_of(words: set[str]) -> set[str]:
    """Lexicon candidates of a text's words: " word " whole, " begin" for beginnings."""
    out = {f" {w} " for w in words if 2 < len(w) <= 24}
    for k in PREFIXES:
        out.update(f" {w[:k]}" for w in words if len(w) > k)
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) -> entry, documents with it of either label, in parts of bounded size."""
    pos: Counter = Counter()
    neg: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(pos.keys() | neg.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["entry", "pos", "neg"])

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            (pos if toxic else neg).update(entries_of(set(fold(text or "").split())))
            if len(pos) + len(neg) > 400_000:
                yield out()
                pos.clear()
                neg.clear()
    if pos or neg:
        yield out()


def chosen(rows: list[tuple[str, float]]) -> dict[str, float]:
    """Entries (by falling gain, with odds) without those that begin another chosen one or go on from it."""
    out: dict[str, float] = {}
    begins: set[str] = set()
    for entry, odds in rows:
        if entry in begins or any(entry[:k] in out for k in range(3, len(entry))):
            continue
        out[entry] = min(odds, 6.0)
        begins.update(entry[:k] for k in range(3, len(entry)))
    return out


class Matcher:
    """The automaton of a lexicon and the exceptions."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.a = ahocorasick.Automaton()
        for e, w in lexicon.items():
            self.a.add_word(e, (len(e), w))
        for e in EXCEPTIONS:
            self.a.add_word(f" {e} ", (len(e) + 2, 0.0))
        self.a.make_automaton()

    def measure(self, text: str) -> tuple[float, float]:
        """(sum of the weights of all matches outside exceptions, the sum per root of length)."""
        folded = fold(text)
        hits = [(end - n + 1, end, w) for end, (n, w) in self.a.iter(folded)]
        free = sorted((a, b) for a, b, w in hits if not w)
        if free:
            begins, reach = [a for a, _ in free], list(accumulate((b for _, b in free), max))
            inside = lambda a, b: (k := bisect_right(begins, a)) > 0 and reach[k - 1] >= b
            hits = [h for h in hits if not inside(h[0], h[1])]
        total = sum(w for _, _, w in hits)
        return total, total / math.sqrt(1 + folded.count(" ") / 100)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(b))
        b += np.clip(np.linalg.solve(h, z.T @ (y - p) - 1e-2 * b), -5, 5)
    return b


def features(total: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(total), np.log1p(rate)])


def held_out(col: str, fold_of: int = 0):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == fold_of, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], np.ndarray]:
    """Lexicon (entry -> weight) and coefficients (constant, sum, rate), from rows outside the held-out fold. Of rows that share an id, the text with
    the least hash is learned from."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("toxic")).where("i is not null and toxic is not null")
    known = known.where(~held_out("i")).groupBy("i").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("i"), "i").limit(TRAIN_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text"))
    own = texts.join(F.broadcast(known), "i").groupBy("i").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))  # TRAIN_ROWS ids at most
    rows = cut(own.select("text", "toxic"))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    lexicon = {f" {w} ": v for w, v in SEED.items()}
    if not pos or not neg:
        return lexicon, np.array([-3.0, 1.5, 1.5])
    seen = rows.mapInArrow(counted, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(f"pos >= {LEAST_DOCS}")
    odds = F.log((F.col("pos") + 0.5) / (pos - F.col("pos") + 0.5)) - F.log((F.col("neg") + 0.5) / (neg - F.col("neg") + 0.5))
    xlogx = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    both = F.col("pos") + F.col("neg")
    gain = 2 * (xlogx(F.col("pos"), both * pos / (pos + neg)) + xlogx(F.col("neg"), both * neg / (pos + neg)))
    best = seen.withColumns({"odds": odds, "gain": gain}).where(f"odds >= {LEAST_ODDS} and gain >= {LEAST_GAIN}").orderBy(F.desc("gain"), F.length("entry"), "entry").limit(ENTRIES)
    lexicon |= chosen([(r["entry"], r["odds"]) for r in best.collect()])
    spread = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(spread.value)
        for b in batches:
            got = [m.measure(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names=["toxic", "total", "rate"])

    got = rows.mapInArrow(measured, "toxic int, total double, rate double").toPandas()  # TRAIN_ROWS rows at most
    return lexicon, fit(features(got.total.to_numpy(), got.rate.to_numpy()), got.toxic.to_numpy(np.float64))


def score(docs: DataFrame, lexicon: dict[str, float], coef: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row; null and empty texts score as texts without a match."""
    ship(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast((lexicon, coef))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c = Matcher(spread.value[0]), spread.value[1]
        for b in batches:
            got = np.array([m.measure(t or "") for t in b.column(1).to_pylist()], np.float64).reshape(-1, 2)
            z = np.column_stack([np.ones(len(got)), features(got[:, 0], got[:, 1])]) @ c
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, repeated rows too; null ids aren't held out, null and empty
    texts score as texts without a match. Labels of several rows of one id count as the highest. An empty table gives an empty
    one; other columns aren't read."""
    lexicon, coef = train(docs, labels, id_col, text_col)
    found = score(docs, lexicon, coef, id_col, text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, all columns as they came; null and empty texts stay if texts without a match do."""
    lexicon, coef = train(docs, labels, id_col, text_col)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    found = score(packed, lexicon, coef, "_row", "_text")
    return found.where("score < 0.5").select(*[F.col("doc_id").getField(c).alias(c) for c in names])


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
