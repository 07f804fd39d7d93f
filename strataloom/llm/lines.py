"""Line deduplication: repeated runs of lines found in a suffix array over line ids, built by distributed prefix doubling.

The corpus is one sequence of lines, document after document in id order; lines without a word have no place in it. A
suffix array holds the places sorted by the lines from there on. Round 0 sorts all places by the hash of their line;
the rank of a place is the number of places before its class. Round k + 1 sorts the pairs (rank here, rank 2**k lines further
in the same document), so ranks then order places by 2**(k + 1) lines. Each sort is one range exchange with the place as last
key: a line as common as may be is split over tasks, and a class that goes on in the next partition is joined by a
few numbers a partition that pass through the driver. Places alone in their class drop out: no longer run from there repeats.

Only runs of ``min_words`` words or more count. The shortest such run from a place, or up to it, has L lines with
2**k <= L < 2**(k + 1); it is ordered by the ranks k of its first and its last 2**k lines, in the same sort as round
k + 1. Neighbours in that order with equal ranks have a longest common prefix of L lines or more, and an interval of such
neighbours is one repeated run; all its places but the first are later copies. Their union in each document gives the maximal
repeated runs, which are deleted. Rounds end at log2(min_words), whatever the length of the runs, since the sort need
not tell apart what is equal for that long. A copy that overlaps its first copy in one document isn't one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import bounds, grouped
from .store import cut, release, ship

#: White space as the word rules have it; a line is a part between \n.
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
#: Documents with lines to delete, and lines of these, that may be broadcast (a byte a line); beyond it the texts are joined by shuffle.
BROADCAST_DOCS, BROADCAST_LINES = 100_000, 8_000_000
#: A null id counts as the least one.
NO_ID = -(2**63)

KEY, PLACE = ["size", "r", "s"], ["doc", "twin", "place"]
ROWS = "size int, r long, s long, doc long, twin long, place int, line int, words int"
_ROWS = pa.schema([("size", pa.int32()), ("r", pa.int64()), ("s", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("place", pa.int32()), ("line", pa.int32()), ("words", pa.int32())])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, twin (a hash that tells texts of equal ids apart) and text; equal rows are one document here."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("twin"), text.alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: 128 bits of its hash, place (its number among these lines), line (its number in the text) and words."""
    parts = F.expr("filter(transform(split(text, '\\n'), (x, i) -> struct(i AS line, x AS x)), p -> p.x rlike '[^\\\\x20\\\\x09-\\\\x0D]')")
    rows = docs.select("doc", "twin", F.posexplode(parts).alias("place", "p"))
    line = F.col("p.x")
    words = F.size(F.filter(F.split(line, SPACE), lambda w: w != ""))
    return rows.select(F.lit(0).alias("size"), F.xxhash64(line).alias("r"), F.xxhash64(F.lit(7), line).alias("s"), "doc", "twin", "place", F.col("p.line").alias("line"), words.alias("words"))


def _numbers(t: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    return np.array([t.column(c).to_numpy() for c in names], np.int64)


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without repeated ones."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = _numbers(b, [*KEY, *PLACE])
        fresh = np.ones(b.num_rows, bool)
        fresh[1:] = (k[:, 1:] != k[:, :-1]).any(0)
        fresh[0] = last is None or (k[:, 0] != last).any()
        last = k[:, -1]
        yield b.filter(pa.array(fresh))


ENDS = "part int, n long, first array<long>, last array<long>, head long, at array<long>"


def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's number of rows, first and last key, and where the last key's rows begin."""
    n, first, last, head, at = 0, None, None, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        k, place = _numbers(b, KEY), _numbers(b, PLACE)
        fresh = np.ones(b.num_rows, bool)
        fresh[1:] = (k[:, 1:] != k[:, :-1]).any(0)
        fresh[0] = last is None or (k[:, 0] != last).any()
        if fresh.any():
            i = int(np.flatnonzero(fresh)[-1])
            head, at = n + i, place[:, i]
        first = k[:, 0] if first is None else first
        last = k[:, -1]
        n += b.num_rows
    if n:
        long = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([first.tolist()], long), pa.array([last.tolist()], long), pa.array([head]), pa.array([at.tolist()], long)], names=["part", "n", "first", "last", "head", "at"])


def _borders(found: list) -> dict[int, tuple]:
    """For each partition: rows before it, the class that goes on from the one before (first row, place) or None, whether its last class goes on."""
    out, total, before, last = {}, 0, None, None
    found = sorted(found, key=lambda e: e["part"])
    for e, after in zip(found, [*found[1:], None], strict=False):
        goes_on = before if last == e["first"] else None
        out[e["part"]] = (total, goes_on, after is not None and after["first"] == e["last"])
        before = (total + e["head"], e["at"]) if e["first"] != e["last"] or goes_on is None else goes_on
        last = e["last"]
        total += e["n"]
    return out


CLASSES = "size int, doc long, twin long, place int, line int, words int, rank long, f_doc long, f_twin long, f_place int"


def classes(batches: Iterator[pa.RecordBatch], borders: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> those whose key has two rows or more, with the rank and the first place of the key."""
    done, goes_on, more = borders.get(TaskContext.get().partitionId(), (0, None, False))
    head, at = goes_on or (0, [0, 0, 0])
    last = None
    held = None

    def out(b: pa.RecordBatch, k: np.ndarray, follows: bool) -> pa.RecordBatch:
        nonlocal done, head, at, last
        place = _numbers(b, PLACE)
        fresh = np.ones(b.num_rows, bool)
        fresh[1:] = (k[:, 1:] != k[:, :-1]).any(0)
        fresh[0] = goes_on is None if last is None else (k[:, 0] != last).any()
        own = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), -1))
        rank = np.where(own >= 0, done + own, head)
        first = np.where(own >= 0, place[:, own], np.array(at)[:, None])
        keep = pa.array(~fresh | np.append(~fresh[1:], follows))
        done, head, at, last = done + b.num_rows, int(rank[-1]), first[:, -1], k[:, -1]
        cols = [b.column(c) for c in ("size", *PLACE, "line", "words")] + [pa.array(rank), pa.array(first[0]), pa.array(first[1]), pa.array(first[2].astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CLASSES.split(", ")]).filter(keep)

    for b in batches:
        if not b.num_rows:
            continue
        k = _numbers(b, KEY)
        if held is not None:
            yield out(*held, bool((held[1][:, -1] == k[:, 0]).all()))
        held = (b, k)
    if held is not None:
        yield out(*held, more)


def _ranked(rows: DataFrame, repeats: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``classes`` of the rows, the sorted table that they are read from). The driver gets a row for each partition."""
    spark, by = rows.sparkSession, [*KEY, *PLACE]
    table = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    table = cut(table.mapInArrow(once, ROWS) if repeats else table)
    borders = spark.sparkContext.broadcast(_borders(table.mapInArrow(ends, ENDS).collect()))
    return table.mapInArrow(lambda it: classes(it, borders.value), CLASSES), table


def _by_document(rows: DataFrame) -> DataFrame:
    """Rows of a document together, those of size 0 first."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "twin").sortWithinPartitions("doc", "twin", "size", "place")


def wanted(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Repeated lines by document -> the shortest run of ``min_words`` words from each place and up to each place, where unbroken lines give one."""
    for t in grouped(batches, ["doc", "twin"]):
        place, words = _numbers(t, ["place", "words"])
        begins = np.diff(place, prepend=-2) != 1
        begins[bounds(t, ["doc", "twin"])[:-1]] = True
        island = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)
        end = np.append(first[1:], len(place))
        upto = np.cumsum(words)
        before = upto - words
        i = np.arange(len(place))
        j = np.searchsorted(upto, before + min_words)
        ahead = np.flatnonzero(j < end[island])
        k = np.searchsorted(before, upto - min_words, "right") - 1
        back = np.flatnonzero(k >= first[island])
        start, size = np.append(i[ahead], k[back]), np.append(j[ahead] - i[ahead], i[back] - k[back]) + 1
        runs = np.unique(start * (min_words + 1) + size)  # a line has a word at least
        at = pa.array(runs // (min_words + 1))
        yield pa.RecordBatch.from_arrays([pa.array((runs % (min_words + 1)).astype(np.int32)), *(t.column(c).take(at).combine_chunks() for c in PLACE)], names=["size", *PLACE])


class _Places:
    """Rows of size 0 of whole documents, found by document and place."""

    def __init__(self, t: pa.Table, reach: int):
        head = np.zeros(t.num_rows, np.int64)
        head[bounds(t, ["doc", "twin"])[:-1]] = 1
        self.size, place = _numbers(t, ["size", "place"])
        self.code = (np.cumsum(head) - 1) * (int(place.max()) + reach + 1) + place
        self.own = np.flatnonzero(self.size == 0)
        self.codes = self.code[self.own]

    def find(self, code: np.ndarray) -> np.ndarray:
        """Number among the own rows, -1 where there is none."""
        if not len(self.codes):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, -1)


def paired(batches: Iterator[pa.RecordBatch], k: int, more: bool) -> Iterator[pa.RecordBatch]:
    """Ranks of round k (size 0) and runs of 2**k lines or more, by document -> rows of the next sort: pairs of ranks, and the runs with two ranks."""
    for t in grouped(batches, ["doc", "twin"]):
        places = _Places(t, 2 ** (k + 1))
        rank = t.column("rank").to_numpy()[places.own]
        runs = np.flatnonzero(places.size > 0)
        rows, begin, end = [runs], [places.find(places.code[runs])], [places.find(places.code[runs] + places.size[runs] - 2**k)]
        if more:
            rows.append(places.own)
            begin.append(np.arange(len(places.own)))
            end.append(places.find(places.codes + 2**k))
        rows, begin, end = map(np.concatenate, (rows, begin, end))
        ok = (begin >= 0) & (end >= 0)
        at, none = pa.array(rows[ok]), pa.array(np.zeros(int(ok.sum()), np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(places.size[rows[ok]].astype(np.int32)), pa.array(rank[begin[ok]]), pa.array(rank[end[ok]]), *(t.column(c).take(at).combine_chunks() for c in PLACE), none, none], schema=_ROWS)


def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated lines (size 0) and later copies, by document -> maximal runs: for each document, whether each line goes, up to the last that does."""
    for t in grouped(batches, ["doc", "twin"]):
        places = _Places(t, 0)
        line = t.column("line").to_numpy()[places.own]
        copies = np.flatnonzero(places.size > 0)
        step = np.zeros(len(places.own) + 1, np.int64)
        first = places.find(places.code[copies])
        np.add.at(step, first, 1)
        np.add.at(step, first + places.size[copies], -1)
        inside = np.cumsum(step[:-1]) > 0
        at = bounds(t, ["doc", "twin"])
        cuts = np.searchsorted(places.own, at)
        docs, runs, gone = [], [], []
        for d, a, b in zip(at[:-1].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = inside[a:b]
            if own.any():
                flags = np.zeros(int(line[a:b][own].max()) + 1, bool)
                flags[line[a:b][own]] = True
                docs.append(d)
                joined = own[1:] & own[:-1] & (np.diff(places.codes[a:b]) == 1)
                runs.append(int(own.sum() - joined.sum()))
                gone.append(flags)
        offsets = np.append(0, np.cumsum([len(g) for g in gone])).astype(np.int32)
        flat = pa.array(np.concatenate(gone) if gone else np.zeros(0, bool))
        yield pa.RecordBatch.from_arrays([*(t.column(c).take(pa.array(docs, pa.int64())).combine_chunks() for c in ("doc", "twin")), pa.array(runs, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc", "twin", "runs", "gone"])


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, twin, runs, gone: the documents with later copies of runs of ``min_words`` words or more, the number of maximal
    runs in these, and for each line whether it goes.

    The first copy by (id, line) stays whole. Null text has no lines; a null id counts as the least long. Rows of equal id
    and text are one document. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    lines = cut(_lines(_documents(docs, id_col, text_col)))
    found, table = _ranked(lines, repeats=True)
    repeated = cut(found.drop("f_doc", "f_twin", "f_place"))
    release(lines, table)
    runs = cut(_by_document(repeated).mapInArrow(lambda it: wanted(it, min_words), "size int, doc long, twin long, place int"))
    longest = runs.agg(F.max("size")).first()[0] or 0
    level = repeated.select(*PLACE, "size", "rank")
    copies = repeated.where("false").select(*PLACE, "size")
    k = 0
    while 2**k <= longest:
        more = 2 ** (k + 1) <= longest
        own = runs.where(f"size >= {2**k} and size < {2 ** (k + 1)}").select(*PLACE, "size", F.lit(0).cast("long").alias("rank"))
        rows = cut(_by_document(level.unionByName(own)).mapInArrow(lambda it, k=k, more=more: paired(it, k, more), ROWS))
        found, table = _ranked(rows)
        found = cut(found)
        release(rows, table)
        own_copy = "doc = f_doc and twin = f_twin and place < f_place + size"
        copies = copies.unionByName(found.where(f"size > 0 and not ({own_copy})").select(*PLACE, "size"))
        level = found.where("size = 0").select(*PLACE, "size", "rank")
        k += 1
    both = repeated.select(*PLACE, "size", "line").unionByName(copies.withColumn("line", F.lit(0)))
    return cut(_by_document(both).mapInArrow(covered, "doc long, twin long, runs int, gone array<boolean>"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with later copies deleted from the text, all rows and columns kept; ``length_col``, where present, is counted anew.

    A text of which every line goes becomes empty. Null texts stay null.
    """
    gone = repeated_lines(docs, min_words, id_col, text_col).select("doc", "twin", "gone")
    text = F.col(f"`{text_col}`")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("twin"))
    n, total = gone.agg(F.count("*"), F.sum(F.size("gone"))).first()
    if n <= BROADCAST_DOCS and (total or 0) <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    joined = packed.join(gone, ["doc", "twin"], "left")
    left = F.expr("array_join(filter(split(_text, '\\n'), (x, i) -> NOT coalesce(get(gone, i), false)), '\\n')")
    new = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(left)
    out = joined.select("_row", new.alias("_new"))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("_new").alias(c))
        elif c == length_col:
            cols.append(F.coalesce(F.length("_new").cast(docs.schema[c].dataType), F.col("_row").getField(c)).alias(c))
        else:
            cols.append(F.col("_row").getField(c).alias(c))
    return out.select(*cols)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d),
b AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM a),
l AS (SELECT *, row_number() OVER o - 1 AS place, sum(words) OVER o AS upto FROM b WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
w AS (
  SELECT p.doc_id, p.place AS i, min(q.place) AS j FROM l p JOIN l q ON p.doc_id = q.doc_id AND q.place BETWEEN p.place AND p.place + 49 AND q.upto - p.upto + p.words >= 50 GROUP BY ALL
  UNION
  SELECT q.doc_id, max(p.place) AS i, q.place AS j FROM l p JOIN l q ON p.doc_id = q.doc_id AND q.place BETWEEN p.place AND p.place + 49 AND q.upto - p.upto + p.words >= 50 GROUP BY ALL),
r AS (SELECT w.doc_id, i, j, string_agg(x, chr(10) ORDER BY place) AS run FROM w JOIN l ON w.doc_id = l.doc_id AND place BETWEEN i AND j GROUP BY ALL),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi FROM r WINDOW o AS (PARTITION BY run ORDER BY doc_id, i)),
g AS (SELECT DISTINCT l.doc_id, line FROM f JOIN l ON f.doc_id = l.doc_id AND place BETWEEN i AND j WHERE NOT (fd = f.doc_id AND i <= fi + j - i)),
k AS (SELECT a.doc_id, string_agg(x, chr(10) ORDER BY a.line) AS t, count(*) AS n FROM a ANTI JOIN g ON a.doc_id = g.doc_id AND a.line = g.line GROUP BY ALL)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, CASE WHEN coalesce(t, '') = '' THEN 0 ELSE n END::BIGINT AS n_lines_left, length(coalesce(t, ''))::BIGINT AS n_chars_left, sha256(coalesce(t, '')) AS text_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_lines_left, n_chars_left and the sha256 of the text that is left, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    before = docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")))
    left = drop_repeated_lines(before, length_col=None)
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines_left"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
