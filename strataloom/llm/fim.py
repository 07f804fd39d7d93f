"""Fill-in-the-middle transformation: a text is cut twice at unit bounds and its parts change places.

A unit is white space and the word after it, or white space at the end (``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``).
While units are counted, block by block of the UTF-8 bytes, every EVERY-th unit leaves a checkpoint: its number, its byte and its code
point. So the index of a text of any length is a small fraction of it. The cuts depend on the number of units, which is known only
after the count; then a binary search finds the checkpoint before a cut, and a scan of a few units from there finds the cut itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import ship

#: Units between checkpoints, and bytes that are counted or scanned at once.
EVERY, COUNTED, SCANNED = 256, 1 << 20, 2048
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True


def _starts(data: np.ndarray, before: bool, fresh: np.ndarray) -> np.ndarray:
    """Places of unit starts. before: whether the byte in front is white space; fresh: places where a text starts."""
    ws = _WS[data]
    start = np.empty(len(data), bool)
    start[0] = ws[0] and not before
    start[1:] = ws[1:] & ~ws[:-1]
    start[fresh] = True
    return np.flatnonzero(start)


class Checkpoints:
    """Sparse index over the units of many texts, given as bytes and the texts' bounds."""

    def __init__(self, data: np.ndarray, off: np.ndarray, every: int = EVERY):
        self.data, self.off = data, off
        texts = len(off) - 1
        self.units, self.chars = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        numbers, places, points = [], [], []
        seen, told = 0, 0  # units and code points of the blocks before
        first = np.zeros(texts, np.int64)  # number of each text's first unit, counted over all texts
        base = np.zeros(texts, np.int64)  # code points before each text
        bounds = off[:-1]
        for a in range(0, len(data), COUNTED):
            block = data[a : a + COUNTED]
            lo, hi = np.searchsorted(bounds, [a, a + len(block)])
            own = np.arange(lo, hi)
            own = own[off[own + 1] > off[own]]
            at = _starts(block, bool(a and _WS[data[a - 1]]), off[own] - a)
            lead = np.cumsum((block & 0xC0) != 0x80)
            point = told + lead[at] - 1
            number = seen + np.arange(len(at))
            k = np.searchsorted(at, off[own] - a)
            first[own], base[own] = number[k], point[k]
            text = np.searchsorted(off, at + a, "right") - 1
            kept = np.flatnonzero((number - first[text]) % every == 0)
            numbers.append(number[kept])
            places.append(at[kept] + a)
            points.append(point[kept] - base[text[kept]])
            np.add.at(self.units, text, 1)
            seen, told = seen + len(at), told + int(lead[-1])
        full = np.flatnonzero(np.diff(off) > 0)
        self.first = first
        self.chars[full] = np.append(base[full][1:], told) - base[full]
        self.numbers, self.places, self.points = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, places, points))

    def cut(self, text: int, unit: int) -> tuple[int, int]:
        """(byte in the text, code points before it) of the start of a unit; the text's end for the number of its units."""
        begin, end = int(self.off[text]), int(self.off[text + 1])
        if unit >= self.units[text]:
            return end - begin, int(self.chars[text])
        k = int(np.searchsorted(self.numbers, self.first[text] + unit, "right")) - 1
        left = int(self.first[text] + unit - self.numbers[k])
        at, point = int(self.places[k]), int(self.points[k])
        while left:
            window = self.data[at + 1 : min(end, at + 1 + SCANNED)]
            found = _starts(window, bool(_WS[self.data[at]]), np.zeros(0, np.int64))
            stop = int(found[left - 1]) if left <= len(found) else len(window) - 1
            point += int(((window[: stop + 1] & 0xC0) != 0x80).sum())
            at += stop + 1
            left -= min(left, len(found))
        return at - begin, point


def choices(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that depend on the id and the seed alone; a null id counts as no digits."""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(x[k : k + 8], 16) for k in (0, 8, 16, 24))


def arranged(batches: Iterator[pa.RecordBatch], seed: int, rate: int, spm_rate: int, every: int = EVERY) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) -> id, n, form, prefix_chars, middle_chars, output."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for whole in batches:
        for batch in tv.slices(whole, "text"):
            data, off = tv.utf8(batch.column(1))
            index = Checkpoints(data, off, every)
            forms, before, between, out = [], [], [], []
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                own = data[off[k] : off[k + 1]].tobytes()
                h1, h2, h3, h4 = choices(doc_id, seed)
                if not own or h3 % 100 >= rate or p in own or s in own or m in own:
                    forms.append("plain")
                    before.append(None)
                    between.append(None)
                    out.append(own)
                    continue
                n = int(index.units[k]) + 1
                (a, x), (b, y) = index.cut(k, min(h1 % n, h2 % n)), index.cut(k, max(h1 % n, h2 % n))
                spm = h4 % 100 < spm_rate
                forms.append("spm" if spm else "psm")
                before.append(x)
                between.append(y - x)
                out.append(b"".join((s, own[b:], p, own[:a], m, own[a:b]) if spm else (p, own[:a], s, own[b:], m, own[a:b])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index.units), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row.

    rate: percent of texts that are cut; spm_rate: percent of these with the suffix in front. Cuts depend on id, seed and text alone, so a
    lost task gives the same rows again. Null and empty texts, texts that hold a marker and those not chosen are plain and stay as they are (null:
    empty). Repeated rows each give a row, a null id counts as one without digits, an empty table gives an empty one; other columns aren't read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: arranged(it, seed, rate, spm_rate), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: its parts between the markers, in their first order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    put = lambda *k: F.concat(*[parts[i] for i in k])
    return F.when(form == "spm", put(2, 3, 1)).when(form == "psm", put(1, 3, 2)).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT doc_id, t, n, form, coalesce(array_to_string(us[1:a], ''), '') AS p, coalesce(array_to_string(us[a + 1:b], ''), '') AS m, coalesce(array_to_string(us[b + 1:], ''), '') AS e FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""
