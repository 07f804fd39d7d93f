"""Fill-in-the-middle against a plain version on random and odd texts; its SQL is compared in test_llm_ops."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < spm_rate
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def texts(n, seed):
    rng = random.Random(seed)
    letters = ["a", "b", "é", "漢", "🙂", " ", " ", "\n", "\t", "\x0b", "\x0c", "\r", " ", "　", "<", "P>", "S", ">", "\x00"]
    out = [None, "", " ", "  \n", "x", "🙂", "<P>", "a <S> b", "a<M>", "<", "<P", "P>", " x ", "é" * 9000, " " * 9000, "ab " * 5000, " 漢" * 3000]
    return out + ["".join(rng.choices(letters, k=rng.choice((1, 3, 9, 60, 900)))) for _ in range(n)]


@pytest.mark.parametrize("every,counted,scanned", [(1, 7, 1), (3, 64, 5), (256, 1 << 20, 2048)])
def test_checkpoints_find_every_cut(monkeypatch, every, counted, scanned):
    monkeypatch.setattr(fim, "COUNTED", counted)
    monkeypatch.setattr(fim, "SCANNED", scanned)
    some = [t or "" for t in texts(40, 5) if len(t or "") < 2000]
    raw = [t.encode() for t in some]
    off = np.append(0, np.cumsum([len(r) for r in raw]))
    index = fim.Checkpoints(np.frombuffer(b"".join(raw), np.uint8), off, every)
    for k, t in enumerate(some):
        units = UNIT.findall(t)
        assert index.units[k] == len(units)
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert index.cut(k, u) == (len(head.encode()), len(head))
    assert len(index.numbers) <= sum(-(-len(UNIT.findall(t)) // every) for t in some)


def test_equals_plain_version(spark):
    docs = [(k, t) for k, t in enumerate(texts(300, 9))] + [(None, "no id at all"), (3, " again"), (3, " again")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, output string, n int").repartition(5)
    for given in ({}, {"rate": 100, "spm_rate": 0}, {"rate": 100, "spm_rate": 100, "seed": 7}):
        got = fim.fill_in_middle(df, **given)
        found = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(map(repr, (tuple(r)[:-1] for r in found))) == sorted(repr(plain(*d, **given)) for d in docs)
        assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in docs)
    assert {r["form"] for r in fim.fill_in_middle(df).collect()} == {"plain", "spm", "psm"}


def test_odd(spark, odd_docs, no_docs):
    got = fim.fill_in_middle(odd_docs, rate=100)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain(r.doc_id, r.text, rate=100)) for r in odd_docs.collect())
    assert fim.fill_in_middle(no_docs).collect() == []
