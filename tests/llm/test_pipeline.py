"""The pipeline's stages against plain versions on the smallest table."""

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from strataloom.llm import rules, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    after = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out = spark.createDataFrame(out.collect(), out.schema)
        after.append(out)
        if name != "packing":
            assert out.columns == cols
            docs = out
    start = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in rules.quality(start).where("kept").collect()}
    assert {r.doc_id for r in after[0].collect()} == good
    lexicon, coef = toxicity.train(after[0], spark.read.parquet(f"{sf}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(after[0], lexicon, coef).where("score < 0.5").collect()}
    assert {r.doc_id for r in after[1].collect()} == clean
    assert {r.doc_id for r in after[2].collect()} == clean
    assert all(r.n_chars == len(r.text) for r in after[2].collect())
    runs = Counter()
    for r in after[2].collect():
        for line in set(r.text.split("\n")):
            if len(line.split()) >= 50:
                runs[line] += 1
    assert not runs or max(runs.values()) == 1
    ids = {r.doc_id for r in after[3].collect()}
    assert ids <= clean
    assert {r.doc_id for r in after[4].collect()} == ids
    assert corpus_pipeline.run(spark, sf).count() == after[4].count()


SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text) if w]


def plain_quality(text):
    """Whether a text breaks no rule, by plain loops."""
    w = words_of(text)
    if not w:
        return False
    lines = [x for x in text.split("\n") if words_of(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + o for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for o in range(3)}
    n = len(w)
    checks = [
        n >= 50,
        100 * len(covered) <= 50 * n,
        n <= 10_000_000,
        2.0 <= sum(map(len, w)) / n <= 12.0,
        sum(text.count(c) for c in rules.SYMBOLS) / n <= 0.1,
        sum(x.lower().rstrip(".,") in rules.STOP_WORDS for x in w) / n >= 0.1,
        sum(x == x.upper() and x != x.lower() for x in w) / n <= 0.5,
        (len(lines) - len(set(lines))) / len(lines) <= 0.45,
    ]
    return all(checks)


def plain_lines(docs, least=50):
    """Texts by id without later copies of runs of ``least`` words or more."""
    seen, gone = {}, {}
    rows = {}
    for i in sorted(docs):
        lines = docs[i].split("\n")
        rows[i] = [(k, x, len(words_of(x))) for k, x in enumerate(lines) if words_of(x)]
    windows = []
    for i, own in rows.items():
        spans = set()
        for a in range(len(own)):
            total = 0
            for b in range(a, len(own)):
                total += own[b][2]
                if total >= least:
                    spans.add((a, b))
                    break
        for b in range(len(own)):
            total = 0
            for a in range(b, -1, -1):
                total += own[a][2]
                if total >= least:
                    spans.add((a, b))
                    break
        windows += [(i, a, b) for a, b in sorted(spans)]
    for i, a, b in sorted(windows):
        seen.setdefault(tuple(x for _, x, _ in rows[i][a : b + 1]), (i, a))
    for i, a, b in windows:
        fi, fa = seen[tuple(x for _, x, _ in rows[i][a : b + 1])]
        if not (fi == i and a <= fa + b - a):
            gone.setdefault(i, set()).update(k for k, _, _ in rows[i][a : b + 1])
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs.items()}


def plain_firsts(docs, width=5):
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()) for i, w in ((i, t.encode().lower().split()) for i, t in docs.items())}
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: t for i, t in docs.items() if root(i) == i}


def test_pipeline_brute(spark, sf):
    """All stages against plain loops; only the lexicon's weights come from the library."""
    import math
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    start = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in start.collect()}
    good = {i: t for i, t in texts.items() if plain_quality(t)}
    assert good and len(good) < len(texts)
    lexicon, coef = toxicity.train(start.where(F.col("doc_id").isin(list(good))), spark.read.parquet(f"{sf}/labels.parquet"))

    def toxic(t):
        folded = toxicity.fold(t)
        inside = [(m, m + len(e) + 1) for e in toxicity.EXCEPTIONS for m in range(len(folded)) if folded.startswith(f" {e} ", m)]
        total = sum(w for e, w in lexicon.items() for m in range(len(folded)) if folded.startswith(e, m) and not any(a <= m and m + len(e) - 1 <= b for a, b in inside))
        return coef @ [1, math.log1p(total), math.log1p(total / math.sqrt(1 + folded.count(" ") / 100))] >= 0

    clean = {i: t for i, t in good.items() if not toxic(t)}
    left = plain_firsts(plain_lines(clean))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in left.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    found = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want


def test_stages_on_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        before = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            kept = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(kept, out.schema)
        assert before.count() or not kept
    stages = dict(corpus_pipeline.STAGES)
    by_id = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    assert by_id(stages["line dedup"](spark, odd_docs, sf)) == by_id(odd_docs)
    firsts = [i for none, i in by_id(stages["near dedup"](spark, odd_docs, sf)) if not none]
    assert firsts == [1, 2, 3, 6, 7, 8, 9]
    ids = Counter(r.doc_id for r in stages["packing"](spark, odd_docs, sf).where("piece = 0").collect())
    assert ids == Counter(r.doc_id for r in odd_docs.collect())
