"""Spelling variants against a plain version that tries every edit."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strataloom.llm import registry, variants


def plain_words(docs, least_length=5, least_count=3, misspelt=97):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % misspelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= least_count}


def plain_near(n):
    letters = sorted(set("".join(n)))
    out = {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        out[w] = sorted(e for e in edits if e in n and e != w)
    return out


def plain_rows(n):
    form = {}
    near = plain_near(n)
    for w, own in near.items():
        top = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_wavelet():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 200):
        values = rng.permutation(n)
        a, c = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        b, d = np.minimum(n, a + rng.integers(0, n + 1, 50)), c + rng.integers(0, n + 1, 50)
        who, found = variants.Wavelet(values).report(a, b, c, d)
        want = sorted((k, int(v)) for k in range(50) for v in values[a[k] : b[k]] if c[k] <= v < d[k])
        assert sorted(zip(who.tolist(), found.tolist(), strict=True)) == want


@pytest.mark.parametrize("letters,lengths,limits", [("ab", (2, 8), (8192, 32768, 65536)), ("abcÿÀ", (2, 6), (64, 7, 11)), ("ab🙂", (3, 7), (64, 100, 3)), ("aaaab", (5, 40), (8192, 32768, 65536))])
def test_near_words(spark, monkeypatch, letters, lengths, limits):
    for name, v in zip(("BUCKET", "TREE", "ASKING"), limits, strict=True):
        monkeypatch.setattr(variants, name, v)
    rng = random.Random(4)
    n = {"".join(rng.choices(letters, k=rng.randint(*lengths))): rng.choice((3, 4, 8, 20, 50)) for _ in range(500)}
    df = spark.createDataFrame([(w, k, "x") for w, k in n.items()], "word string, n long, near string")
    pairs = variants.near_words(df).collect()
    assert len(pairs) == len({(r["word"], r["near"]) for r in pairs})
    assert {(r["word"], r["near"], r["near_n"]) for r in pairs} == {(w, x, n[x]) for w, own in plain_near(n).items() for x in own}
    assert {tuple(r) for r in variants.spelling_variants(df).collect()} == plain_rows(n)


def test_chains(spark):
    n = {"a" * (5 + k): 3 * 2**k for k in range(40)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {tuple(r) for r in variants.spelling_variants(df).collect()} == plain_rows(n)


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = registry.QUERIES["op11_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain_rows(plain_words(docs))


def test_counted(spark):
    words = ["Straße", "ÉTUDE", "étude", "HELLO", "hello", "Hell×o", "x" * 3000, "abcd", "漢字", "hello漢hello", "i̇stanbul", "ABCDEF"]
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choices(words, k=30))) for k in range(400)] + [(None, "hello hello HELLO"), (7, None), (8, ""), (9, "hello"), (9, "hello"), (-5, "hello etude")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    found = {r["word"]: r["n"] for r in variants.counted(df).collect()}
    assert found == plain_words(docs)
    assert len(found) > 8
    assert {tuple(r) for r in variants.spelling_variants(variants.counted(df)).collect()} == plain_rows(found)


def test_odd(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    n = plain_words(docs)
    assert {r["word"]: r["n"] for r in variants.counted(odd_docs).collect()} == n
    assert {tuple(r) for r in variants.spelling_variants(variants.counted(odd_docs)).collect()} == plain_rows(n)
    assert variants.spelling_variants(variants.counted(no_docs)).collect() == []
    # Three copies of a word of 100 000 letters, and two of them with an edit.
    long = "ab" * 50_000
    some = spark.createDataFrame([(long, 9), (long[:70_000] + "z" + long[70_000:], 4), ("q" + long[1:], 3)], "word string, n long")
    assert {r["word"][:1] + str(len(r["word"])): (r["n_near"], r["form_n"]) for r in variants.spelling_variants(some).collect()} == {"a100000": (2, None), "a100001": (1, 9), "q100000": (1, 9)}
