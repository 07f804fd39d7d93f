"""Groups of spelling variants: words that differ by one edit, found by two-dimensional range reporting.

A word t of length L arises from q by an edit at place i exactly if t starts with the part of q before the edit and ends with the part
after it. Among words of one length the first ones are an interval in forward order and the last ones an interval in the order of the
reversed words; a word is a point (forward rank, reverse rank), and a wavelet tree over the reverse ranks in forward order reports the points
of a rectangle. Insertions are looked for from the shorter word, and give the deletions of the longer one.

Words are dealt to buckets by length and half: an edit in the second half leaves the first one as it is, so q and t meet by the
first half; for edits in the first half they meet by the second one, with all words reversed, so that the same code serves both.
A bucket with too many words is dealt to blocks of words and of asking words; reporting is decomposable, so each block of words has a
tree of its own. No pair is compared that isn't in a common rectangle.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import bounds, grouped
from .store import cut, ship

#: Words of a bucket, about; words of a tree and words that ask it, at most, about.
BUCKET, TREE, ASKING = 8192, 32_768, 65_536
LAST = 0x10FFFF


class Wavelet:
    """A wavelet tree over a permutation of 0..n-1, level by level from the highest bit; zeros stand before ones."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels = []
        for bit in range(max(1, (self.n - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            self.levels.append((bit, np.append(0, np.cumsum(ones)), self.n - int(ones.sum())))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the rectangle, value) of every value within c..d-1 at a place within a..b-1; all rectangles go down together."""
        who, base = np.arange(len(a)), np.zeros(len(a), np.int64)
        for bit, ones, zeros in self.levels:
            x, y = ones[a], ones[b]
            a, b = np.concatenate([a - x, zeros + x]), np.concatenate([b - y, zeros + y])
            base = np.concatenate([base, base + (1 << bit)])
            who = np.concatenate([who, who])
            keep = np.flatnonzero((a < b) & (base < d[who]) & (base + (1 << bit) > c[who]))
            a, b, base, who = a[keep], b[keep], base[keep], who[keep]
        return who, base


def _matrix(words: list[str], length: int) -> np.ndarray:
    """Code points, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)


def _text(m: np.ndarray) -> np.ndarray:
    """Rows as strings that compare by code point."""
    return np.ascontiguousarray(m).view(f"<U{m.shape[1]}")[:, 0]


def _interval(ordered: np.ndarray, asked: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ordered`` (strings of one length) of those that start with the first ``size`` code points of each row."""
    low = np.zeros((len(asked), length), "<u4")
    low[:, : min(length, asked.shape[1])] = asked[:, :length]
    rest = np.arange(length)[None, :] >= size[:, None]
    low[rest] = 0
    a = np.searchsorted(ordered, _text(low))
    low[rest] = LAST
    return a, np.searchsorted(ordered, _text(low), "right")


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many first code points of the rows are equal."""
    other = x != y
    return np.where(other.any(1), other.argmax(1), x.shape[1])


class Tree:
    """Words of one length, as code points."""

    def __init__(self, words: np.ndarray):
        self.length = words.shape[1]
        self.order = np.argsort(_text(words), kind="stable")
        self.words = words[self.order]
        self.forward = _text(self.words)
        back = _text(self.words[:, ::-1])
        self.at = np.argsort(back, kind="stable")  # of a reverse rank: the forward rank
        self.backward = back[self.at]
        rank = np.empty(len(words), np.int64)
        rank[self.at] = np.arange(len(words))
        self.wavelet = Wavelet(rank)

    def near(self, asked: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``asked``, row of the words, place) for edits at ``least`` or later: replacements where lengths are equal, else insertions,
        each at its last possible place.

        A word leaves the interval of the first i code points at the place where it differs, so only places at which an interval shrinks are visited.
        """
        n, size = asked.shape
        who = np.arange(n)
        place = np.full(n, least)
        a, b = _interval(self.forward, asked, place, self.length)
        out = [(np.zeros(0, np.int64),) * 3]
        while True:
            live = np.flatnonzero(a < b)
            who, place, a, b = who[live], place[live], a[live], b[live]
            if not len(who):
                break
            own = asked[who]
            place = np.maximum(place, np.minimum(_agree(own, self.words[a, :size]), _agree(own, self.words[b - 1, :size])))
            rest = size - place - (size == self.length)  # code points after the edit
            some = np.flatnonzero(rest >= 0)  # else only the word itself is left
            who, place, a, b, rest = who[some], place[some], a[some], b[some], rest[some]
            if not len(who):
                break
            own = asked[who]
            c, d = _interval(self.backward, own[:, ::-1], rest, self.length)
            r, value = self.wavelet.report(a, b, c, d)
            word = self.at[value]
            at = place[r]
            fresh = (at == size) | (self.words[word, at] != own[r, np.minimum(at, size - 1)])
            out.append((who[r[fresh]], word[fresh], at[fresh]))
            go = np.flatnonzero(place < size)
            who, place = who[go], place[go] + 1
            a, b = _interval(self.forward, asked[who], place, self.length)
        rows, words, places = (np.concatenate(x) for x in zip(*out, strict=True))
        return rows, self.order[words], places


FOUND = "word string, near string, near_n long"


def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, tree, asking, kind, length, role) -> near words. role: 0 a word of the tree, 1 asks for replacements, 2 for insertions."""
    key = ["bucket", "tree", "asking", "kind", "length"]
    for t in grouped(batches, key, 4096):
        at = bounds(t, key)
        role, kind, length, n = (t.column(c).to_numpy() for c in ("role", "kind", "length", "n"))
        texts = t.column("word").to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            first = lo + np.searchsorted(role[lo:hi], [0, 1, 2, 3])
            size, back = int(length[lo]), bool(kind[lo])
            if first[0] == first[1] or first[1] == first[3]:
                continue
            turned = lambda m, back=back: m[:, ::-1] if back else m
            tree = Tree(turned(_matrix(texts[first[0] : first[1]], size)))
            least = size - size // 2 if back else size // 2
            for r in (1, 2):
                if first[r] == first[r + 1]:
                    continue
                asked = np.ascontiguousarray(turned(_matrix(texts[first[r] : first[r + 1]], size - (r == 2))))
                rows, words, places = tree.near(asked, least)
                if r == 2 and back:
                    # The insertion can also stand in the other half if its code point is repeated up to there; that half reports it.
                    full = turned(_matrix(texts[first[0] : first[1]], size))[words]
                    run = np.arange(size)[None, :]
                    same = (full == full[np.arange(len(words)), places][:, None]) | (run < least - 1) | (run > places[:, None])
                    keep = ~same.all(1)
                    rows, words = rows[keep], words[keep]
                rows, words = rows + first[r], words + first[0]
                for x, y in ((rows, words), (words, rows))[: 1 + (r == 2)]:
                    out[0].extend(texts[i] for i in x.tolist())
                    out[1].extend(texts[i] for i in y.tolist())
                    out[2].extend(n[y].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of distinct words that differ by exactly one inserted, deleted or replaced code point.

    words: word (distinct, not null, without U+0000), n. Words of one code point and empty ones take no part.
    """
    spark = words.sparkSession
    ship(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(words.where("char_length(word) >= 2").select("word", "n", F.char_length("word").alias("own")))
    buckets = max(n_parts, -(-2 * rows.count() // BUCKET))
    role = lambda r, length: F.struct(F.lit(r).alias("role"), length.alias("length"))
    posted = rows.select("word", "n", F.explode(F.array(role(0, F.col("own")), role(1, F.col("own")), role(2, F.col("own") + 1))).alias("r")).select("word", "n", "r.*")
    # Halves of the longer word: its first length div 2 code points and the rest, which an insertion before it shifts by one.
    half = F.when(F.col("kind") == 0, F.expr("substring(word, 1, length div 2)")).otherwise(F.expr("substring(word, length div 2 + if(role = 2, 0, 1))"))
    posted = posted.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bucket", F.pmod(F.xxhash64("length", "kind", half), F.lit(buckets)).cast("int"))
    posted = cut(posted)
    plan = posted.groupBy("bucket").agg(F.ceil(F.count_if(F.col("role") == 0) / TREE).cast("int").alias("trees"), F.ceil(F.count_if(F.col("role") > 0) / ASKING).cast("int").alias("askings"))
    posted = posted.join(plan.where("trees > 0 and askings > 0"), "bucket")
    dealt = lambda parts: F.pmod(F.xxhash64("word"), F.col(parts)).cast("int")
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    is_word = F.col("role") == 0
    posted = posted.withColumn("tree", F.explode(F.when(is_word, F.array(dealt("trees"))).otherwise(every("trees")))).withColumn("asking", F.explode(F.when(is_word, every("askings")).otherwise(F.array(dealt("askings")))))
    key = ["bucket", "tree", "asking"]
    columns = [*key, "kind", "length", "role", "word", "n"]
    return posted.select(columns).repartition(n_parts, *key).sortWithinPartitions(*key, "kind", "length", "role").mapInArrow(reported, FOUND)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, misspelt: int = 97) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased. Where ``misspelt`` divides the crc32 of "<id>:<run>", the run loses a code point chosen by it; 0: never."""
    run = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least_length},}}"), 0))
    word: Column = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", word.alias("word"))
    if misspelt:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        place = F.expr("cast(pmod(h, char_length(word)) as int)")
        shorter = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.char_length("word")))
        rows = rows.select(F.when(F.col("h") % misspelt == 0, shorter).otherwise(F.col("word")).alias("word"))
    return rows.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the end of each chain of forms. Pointers double their reach each round, so chains of 2**k steps take k rounds."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words (word, n).

    The form is the near word of largest n (ties: the smallest in code-point order) if that is ``factor`` (2 or more) times the word's own n or more,
    so chains have no cycle. An empty table gives an empty one.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("near_n")).alias("o"), "near")).alias("b")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    takes = -F.col("b.o") >= factor * F.col("n")
    rows = cut(words.join(near, "word", "left").select("word", F.when(takes, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("b.o")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """All words of all texts. Null texts have none, a null id counts as one without digits, repeated rows count again; other columns aren't read."""
    return spelling_variants(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
