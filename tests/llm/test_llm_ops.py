"""Each operator against brute force on small tables, and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from test_pipeline import plain_lines

from strataloom.llm import embed, graph, licenses, lines, lm, minhash, packing, pieces, registry, rules, textvec, toxicity, warc

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def rows(df, *by):
    return [r.asDict() for r in df.orderBy(*by).collect()] if by else [r.asDict() for r in df.collect()]


def reach(ids, edges):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(registry.SQL[name]).fetchdf()
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = "page_id" if "page_id" in cols else "doc_id"
    a, b = got[cols].sort_values(key).reset_index(drop=True), want[cols].sort_values(key).reset_index(drop=True)
    for c in cols:
        assert (a[c].fillna(-1) == b[c].fillna(-1)).all(), c


def packed_whole(found, width):
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= width
    return len(by)


def test_packing_equals_tokenizers(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf, "documents")
    want = {}
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    found = rows(packing.pack(docs, BPE))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want
    total = sum(r["length"] for r in found)
    assert packed_whole(found, 1024) <= math.ceil(total / 1024 * 1.02) + 1


def test_packing_odd(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    found = rows(packing.pack(odd_docs, BPE, width=64))
    assert packed_whole(found, 64)
    assert Counter(r["doc_id"] for r in found)[1] == 1
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in odd_docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 64 or min(len(ids), 64)
        cuts = [0, *range(head, len(ids) + 1, 64)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    assert rows(packing.pack(no_docs, BPE)) == []


def test_two_fit_replaces_the_smallest():
    # Greedy makes 6+3 with a gap of 1; the 3 goes back for 2+2, which fill the gap of 4.
    bins = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert bins[0] == ([6, 2, 2], 1)
    rng = random.Random(3)
    for _ in range(30):
        counts = Counter(rng.randint(1, 50) for _ in range(300))
        used = Counter()
        for sizes, times in packing.best_two_fit(dict(counts), 64):
            assert sum(sizes) <= 64
            for s in sizes:
                used[s] += times
        assert used == counts


def test_pieces_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    model = pieces.model_of(PIECE)
    rng = random.Random(1)
    signs = list("abcdehnorst THE   .,'\n\t▁éñü漢字🙂0123456789<>s/_-\r;)")
    texts = ["", " ", "   two  spaces ", "<s>", "▁", "▁ x", "a b", "x" * 300, " " * 60, ");\r\n });\r", "\x00"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 50))) for _ in range(1500)]
    for t in texts:
        ids = sp.encode(t)
        assert pieces.whole_ids(model, t) == ids, t
        assert model.decode(ids) == sp.decode(ids), t


def test_piece_digests(spark, sf, odd_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for docs in (table(spark, sf, "documents"), odd_docs):
        texts = Counter()
        for r in docs.collect():
            ids = sp.encode(r.text or "")
            texts[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(pieces.encode_digests(docs, PIECE))) == texts
    assert rows(pieces.encode_digests(no_docs, PIECE)) == []
    back = {r["doc_id"]: r["decoded"] for r in rows(pieces.encode_texts(odd_docs, PIECE))}
    assert back[1] == "" and back[9] == "x" * 200_000


def brute_sets(docs, width):
    out = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        out[r.doc_id] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    return out


def test_near_duplicates_brute(spark, sf):
    docs = table(spark, sf, "documents")
    sets = brute_sets(docs, 4)
    ids = sorted(sets)
    edges = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                edges.append((a, b))
    want = reach(ids, edges)
    found = rows(minhash.near_duplicates(docs, width=4))
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_large_group(spark):
    """A group of over two blocks of copies, in a chain: each has one more word than the one before."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    data = []
    for i in range(600):
        w = list(words)
        for k in rng.sample(range(120), i % 5):
            w[k] = f"z{i}-{k}"
        data.append((i, " ".join(w)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    sets = brute_sets(docs, 4)
    ids = sorted(sets)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(docs, width=4))}
    assert found == reach(ids, edges)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_hashes_tell_regular_words_apart():
    """Sums of byte values times powers modulo 2**64 are equal for a Thue-Morse word and its complement."""
    for n in (1024, 2048, 4096):
        a = thue_morse(n)
        data = f"{a} {a.translate(str.maketrans('ab', 'ba'))}".encode()
        found = textvec.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        assert len(found) == 2 and found[0] != found[1]
    rng = random.Random(8)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(5000)}
    data = " ".join(words).encode()
    key, check, starts, _ = textvec.segments(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(np.unique(key)) == len(np.unique(check)) == len(starts) == len(words)


def test_known_keys_with_clashing_first_hashes():
    known = textvec.Known()
    a, b, c = (np.array([x], np.uint64) for x in (5, 70, 80))
    assert known.look(a, b)[0].tolist() == [0]
    slot, new = known.look(a, c)
    assert slot.tolist() == [1] and new.tolist() == [0]
    assert known.look(a, b)[0].tolist() == [0]
    keys, checks, where, inverse = textvec.distinct(np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64))
    assert len(keys) == 3 and sorted(checks[inverse].tolist()) == [1, 2, 3]


def test_tables_keep_what_comes_again():
    """Tables far smaller than the vocabulary give the same ids, and keep the segments of several batches."""
    rng = random.Random(11)
    often = [f"often{i}" for i in range(30)]
    coder = textvec.Coded(lambda words: [[len(w), *w.encode()] for w in words], most=100)
    asked = 0
    for _ in range(40):
        words = [rng.choice(often) if rng.random() < 0.5 else f"once{rng.random()}" for _ in range(60)]
        data = " ".join(words).encode()
        raw = np.frombuffer(data, np.uint8)
        key, check, starts, first = textvec.segments(raw, np.array([0, len(raw)]))
        uniq, checks, where, inverse = textvec.distinct(key, check)
        ends = np.append(starts[1:], len(data))
        before = len(coder.known)
        at = coder.look(uniq, checks, lambda i: data[starts[where[i]] : ends[where[i]]].decode())[inverse]
        asked += len(coder.known) > before
        got = textvec.ragged(coder.flat, coder.first[at], coder.size[at]).tolist()
        assert got == [x for a, b in zip(starts, ends, strict=True) for x in (b - a, *data[a:b])]
        assert len(coder.known) < 300


def test_near_duplicates_several_trees_in_a_large_cluster(spark, monkeypatch):
    """Clusters of several blocks that hold several components: only links over block borders join some of them."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "ANCHORS", 2)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    data = []
    for family in range(12):
        own = list(base)
        for k in rng.sample(range(150), 7):
            own[k] = f"f{family}-{k}"
        for i in range(25):
            w = list(own)
            for k in rng.sample(range(150), rng.randrange(5)):
                w[k] = f"z{family}-{i}-{k}"
            data.append((len(data), " ".join(w)))
    rng.shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    sets = brute_sets(docs, 4)
    ids = sorted(sets)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = reach(ids, edges)
    assert 1 < len(set(want.values())) < 300
    assert {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(docs, width=4))} == want


def test_keep_firsts_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 1, 2, 3, 4), (3, None, 1, 2, 3, 4)], "doc_id long, text string, gone int, _gone int, row int, `key` int")
    out = minhash.keep_firsts(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    found = rows(minhash.near_duplicates(odd_docs, width=4))
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 11
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[6]["kept"] and by[None]["kept"]
    assert by[4]["component_id"] == by[5]["component_id"] == 3
    assert rows(minhash.near_duplicates(no_docs)) == []
    kept = minhash.keep_firsts(odd_docs, width=4)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 6, 7, 8, 9]


def test_super_minhash_is_exact_and_estimates():
    rng = np.random.default_rng(2)
    universe = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = universe[:2000], universe[200:2200]
    sig = minhash.super_minhash([np.sort(a), np.sort(b), np.sort(a)[:1], np.sort(a)[:50]])
    assert abs((sig[0] == sig[1]).mean() - 1800 / 2200) < 0.12
    bits = 32 - (minhash.REGISTERS - 1).bit_length()
    assert sorted(sig[2] >> bits) == list(range(minhash.REGISTERS))  # one element: a permutation of ranks
    parts = minhash.super_minhash([np.sort(a)[:25], np.sort(a)[25:50]])
    assert (np.minimum(parts[0], parts[1]) == sig[3]).all()  # minima of parts: early stopping changed nothing


def test_quality_odd(odd_docs, no_docs):
    found = rows(rules.quality(odd_docs).select("doc_id", "n_words", "base_failed", "kept"))
    assert len(found) == 11
    assert all(r["base_failed"] and not r["kept"] for r in found if r["doc_id"] in (1, 2, 6))
    assert rules.keep_good(odd_docs).columns == odd_docs.columns
    assert rules.keep_good(no_docs).count() == 0


def test_quality_follows_labels(spark, sf):
    found = rules.quality(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").where("not base_failed").toPandas()
    assert found.kept[found.quality == 1].mean() > 0.98
    assert found.kept[found.quality == 0].mean() < 0.1


def test_line_dedup_small(spark):
    run = "\n".join(f"line {i} " + "with several words in it here" for i in range(8))  # 8 lines of 8 words
    short = "one short line"
    docs = spark.createDataFrame(
        [(1, f"first\n{run}\nlast"), (2, f"{short}\n{run}\nother\n\nend"), (3, short), (4, run), (5, "\n".join(["again and again ten words make up this line here"] * 12)), (None, None)],
        "doc_id long, text string",
    )
    left = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()}
    assert left[1] == f"first\n{run}\nlast"
    assert left[2] == f"{short}\nother\n\nend"
    assert left[3] == short and left[4] == "" and left[None] is None
    assert left[5].count("\n") == 4


def test_line_dedup_odd(spark, odd_docs, no_docs):
    out = lines.drop_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 11
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in out.collect():
        # 4 repeats 3 (twice, as equal rows); the second of 7's equal lines is a later copy; null stays null.
        assert r.text == {4: "", 7: texts[7].split("\n")[0]}.get(r.doc_id, texts[r.doc_id])
        assert r.n_chars == (len(r.text) if r.text is not None else None)
    run = "alpha beta gamma delta " * 20
    clash = spark.createDataFrame([(1, run, 1, 2, "x"), (2, f"{run}\nrest", 3, 4, "y")], "doc_id long, text string, doc int, gone int, _row string")
    assert lines.drop_repeated_lines(no_docs).count() == 0
    left = sorted(tuple(r) for r in lines.drop_repeated_lines(clash, length_col=None).collect())
    assert left == [(1, run, 1, 2, "x"), (2, "rest", 3, 4, "y")]


def test_line_dedup_over_partition_borders(spark):
    """Classes that go on over many sorted partitions, and runs of many lengths, against plain loops."""
    rng = random.Random(7)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 30))) for _ in range(40)]
    data = {}
    for i in range(120):
        own = []
        while len(own) < 12:
            a = rng.randrange(len(pool))
            own += pool[a : a + rng.randint(1, 9)] if rng.random() < 0.7 else [f"only {i} {len(own)}", ""]
        data[i] = "\n".join(own)
    docs = spark.createDataFrame(sorted(data.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()} == plain_lines(data)


def test_licenses(spark, odd_docs, no_docs):
    body = [t for n, t in licenses.TEMPLATES if n == "MIT"][3]
    docs = spark.createDataFrame([(1, "some text\nReleased under the  MIT license!\nmore"), (2, "intro\n\n" + body.replace("copies", "issues", 1) + "\n\nend"), (3, "a license of no kind at all"), (4, "")], "doc_id long, text string")
    found = {r["doc_id"]: [(m["license"], m["first_line"]) for m in r["matches"]] for r in rows(licenses.scan_licenses(docs))}
    assert found == {1: [("MIT", 1)], 2: [("MIT", 0), ("MIT", 2)], 3: [], 4: []}  # the whole text is a unit too
    assert licenses.scan_licenses(odd_docs).count() == 11 and licenses.scan_licenses(no_docs).count() == 0


def test_licenses_over_blank_lines_and_within_lines():
    scan = licenses.Scanner().scan
    body = [t for n, t in licenses.TEMPLATES if n == "MIT"][3]
    paragraphs = body.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    assert paragraphs.count("\n\n") == 2
    filler = "\n".join(f"alpha{i} beta{i} gamma{i}" for i in range(200))
    found = scan(f"{filler}\n\n{paragraphs}\n\n{filler}")
    assert [m[:3] for m in found] == [("MIT", 201, 205)]
    gpl = [t for n, t in licenses.TEMPLATES if n == "GPL-3.0"][1].split()
    wrapped = "\n".join("# " + " ".join(gpl[i : i + 9]) for i in range(0, len(gpl), 9))
    assert {m[0] for m in scan(f"{wrapped}\nimport os\n{filler}")} == {"GPL-3.0"}
    line = "see the notes of the authors for more; released under the MIT License. All the rest is told in another file of this folder"
    assert [m[:3] for m in scan(f"one\n{line}\ntwo")] == [("MIT", 1, 1)]
    assert scan("the notes of the authors are under the table\n" + filler) == []


def test_license_bounds_prune_nothing():
    """The pruned scan against all templates weighed without bounds or index."""
    rng = random.Random(4)
    scanner = licenses.Scanner()
    for _ in range(400):
        name, text = rng.choice(licenses.TEMPLATES)
        words = licenses.words_of(text)
        words = [w if rng.random() > 0.06 else "noise" for w in words][: rng.randint(2, len(words))]
        grams = licenses.bigrams(words)
        n = sum(grams.values())
        want = {i: 2 * sum((grams & g).values()) / (n + scanner.size[i]) for i, g in enumerate(scanner.grams)}
        assert dict(scanner.weigh(words)) == {i: v for i, v in want.items() if v >= scanner.least}


def test_whole_licenses_are_found():
    scanner = licenses.Scanner(licenses.all_templates())
    rng = random.Random(2)
    other = "\n".join(" ".join(f"alpha{rng.randrange(400)}" for _ in range(12)) for _ in range(60))
    wanted = {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Artistic-1.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MIT"}
    longest = {}
    for name, text in licenses.all_templates():
        if len(text) > len(longest.get(name, "")):
            longest[name] = text
    assert wanted <= longest.keys()
    for name in sorted(wanted):
        words = longest[name].split(" ")
        for k in rng.sample(range(len(words)), len(words) // 40):
            words[k] = f"changed{k}"
        found = scanner.scan(f"{other}\n\nCopyright of the authors\n{' '.join(words)}\n{other}")
        assert name in {m[0] for m in found}, name
    assert scanner.scan(other) == []


def test_license_spans_brute():
    """Spans against all pairs of shared bigrams, each weighed anew."""
    rng = random.Random(12)
    templates = [("A", "a b c d e f a b g h"), ("B", "c d e f g h i j k l m n"), ("C", "a a a b b"), ("A", "x y z")]
    scanner = licenses.Scanner(templates)
    for _ in range(400):
        words = []
        while len(words) < 40:
            words += rng.choice([t.split() for _, t in templates])[rng.randrange(3) :] if rng.random() < 0.6 else [rng.choice("abcdefghijklmnxyz") for _ in range(rng.randrange(6))]
        words = [w if rng.random() > 0.05 else "noise" for w in words]
        want = []
        for i, g in enumerate(scanner.grams):
            h = [at for at in range(len(words) - 1) if (words[at], words[at + 1]) in g]
            for a in h:
                best = None
                for b in (x for x in h if x >= a):
                    own = licenses.bigrams(words[a : b + 2])
                    c, size = sum((own & g).values()), b - a + 1
                    dice = 2 * c / (size + scanner.size[i])
                    if dice >= scanner.least and (best is None or dice > best[4] + 1e-12):
                        best = (i, a, b + 1, c, dice)
                if best:
                    want.append(best)
        got = scanner.spans(words)
        assert [m[:4] for m in sorted(got)] == [m[:4] for m in sorted(want)]


def test_licenses_of_odd_rows(spark, odd_docs):
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["matches"])) for r in rows(licenses.scan_licenses(odd_docs)))
    assert found == sorted((r.doc_id is None, r.doc_id or 0, 0) for r in odd_docs.collect())
    tie = [("First", "one two three four five"), ("Second", "one two three four five")]
    docs = spark.createDataFrame([(1, "one two three four five", 2, 3)], "doc_id long, text string, matches int, license int")
    assert [m["license"] for m in rows(licenses.scan_licenses(docs, tie))[0]["matches"]] == ["First"]


def test_vectors_brute(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((150, 16))
    x = np.concatenate([c + 0.05 * rng.standard_normal((rng.integers(1, 30), 16)) for c in centers] + [rng.standard_normal((1200, 16))])
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    n = len(data)
    data += [(n, data[0][1]), (n + 1, [2 * v for v in data[0][1]]), (n + 2, None), (n + 3, [0.0] * 16), (n + 4, [float("nan")] * 16), (n + 5, [None] * 16), (n + 6, [1.0]), (n + 7, [])]
    got = {r["vec_id"]: r for r in rows(embed.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")))}
    full = np.array([d[1] for d in data[: n + 2]])
    full /= np.linalg.norm(full, axis=1)[:, None]
    near = full @ full.T >= 0.95
    want = near.sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(n + 2)])
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()
    a, b = np.nonzero(np.triu(near, 1))
    parts = reach(range(n + 2), list(zip(a.tolist(), b.tolist(), strict=True)))
    assert sum(got[i]["component_id"] != parts[i] for i in range(n + 2)) <= 2
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(n + 2, n + 8))


def test_vectors_of_each_length(spark):
    data = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.01]), (6, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [3.0]), (9, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(embed.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")))}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (2, 4), 7: (0, 7), 8: (0, 8), 9: (0, 9)}


def test_vectors_of_odd_sizes_and_repeated_ids(spark):
    data = [(1, [1e200, 2e200], 0), (2, [1.01e200, 2e200], 0), (3, [1e-200, -2e-200], 0), (4, [1e-200, -2.01e-200], 0), (5, [0.0, 1.0], 0), (5, [0.0, 1.0], 0), (None, [0.0, 1.0], 0), (6, [float("inf"), 1.0], 0)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, n_links int").withColumn("cid", F.lit(1)).withColumn("e", F.lit("x"))
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in rows(embed.near_vectors(table)))
    assert got == [(0, 0, None, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (5, 1, 5, True), (6, 0, 6, True)]


def test_vectors_real(spark, sf):
    t = table(spark, sf, "embeddings")
    got = embed.near_vectors(t).toPandas().set_index("vec_id")
    pdf = t.toPandas()
    x = np.array(pdf.embedding.tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert (got.n_links[pdf.vec_id].to_numpy() == (x @ x.T >= 0.95).sum(1) - 1).all()
    assert embed.near_vectors(t.where("false")).count() == 0


def test_warc_streams_chunks(spark, tmp_path):
    big = "".join(f"<p>{i} é</p>\r\n\r\nWARC/1.1\r\n" for i in range(60_000))
    data = [(3, "http://a", big), (1, "http://b", big), (2, None, None), (4, "x", "short"), (5, "x", "short"), (6, "u", "y" * 100), (7, "u", "y" * 100), (None, "n", "y" * 100)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    archives = warc.archive_pages(pages, folder)
    chunks = rows(warc.read_chunks(archives, folder, chunk=1 << 16), "record_id", "chunk")
    whole = defaultdict(bytes)
    for c in chunks:
        assert c["chunk_bytes"] <= 1 << 16
        whole[c["page_id"]] += c["payload"] or b""
    assert whole[1] == big.encode() and whole[3] == b"" and whole[5] == b"short" and whole[2] == b""
    last = {c["page_id"]: c for c in chunks if c["last"]}
    assert last[3]["record_type"] == "revisit" and last[3]["refers_to"] == 1 and last[3]["payload_bytes"] == len(big.encode())
    assert last[1]["payload_sha256"] == hashlib.sha256(big.encode()).hexdigest()
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in rows(warc.round_trip(spark, pages))}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("revisit", 6), None: ("response", None)}
    assert warc.round_trip(spark, pages.where("false")).count() == 0
    import glob

    heads = [h for f in glob.glob(f"{folder}/*.warc") for h in open(f, "rb").read().split(b"WARC/1.1\r\nWARC-Type: ")[1:]]
    records = [dict(line.split(b": ", 1) for line in (b"WARC-Type: " + h).split(b"\r\n\r\n")[0].split(b"\r\n")) for h in heads]
    by_id = {r[b"WARC-Record-ID"]: r for r in records}
    assert len(by_id) == len(records) and sum(r[b"WARC-Type"] == b"warcinfo" for r in records) == len(glob.glob(f"{folder}/*.warc"))
    for r in records:
        if r[b"WARC-Type"] == b"revisit":
            target = by_id[r[b"WARC-Refers-To"]]
            assert target[b"WARC-Type"] == b"response" and target[b"WARC-Payload-Digest"] == r[b"WARC-Payload-Digest"] and target[b"X-Page-ID"] == r[b"X-Refers-To-Page-ID"]
    clash = pages.withColumns({"digest": F.lit("x"), "first": F.lit(1), "n_bytes": F.lit(2), "refers_to": F.lit(3)})
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in rows(warc.round_trip(spark, clash))) == sorted((k or 0, v[0]) for k, v in got.items())


def test_folding():
    assert toxicity.fold("You 1d10t, ЅТUРІD m0r​on!") == " you idiot stupid moron "
    assert toxicity.fold("in 1955 a $5 fee") == " in 1955 a 5 fee "
    m = toxicity.Matcher({" trash ": 3.0})
    assert m.measure("a trash can")[0] == 0 and m.measure("such trash")[0] == 3
    assert m.measure("trash " * 2 + "x " * 500)[1] < m.measure("trash " * 2)[1]


def test_toxicity_scores_brute(spark, sf, odd_docs):
    """The automaton and the exceptions against plain searches, through the whole score."""
    lexicon = {" trash ": 3.0, " idio": 2.5, " scum ": 3.0, " an": 0.5, " the ": 0.25, " a ": 0.125, " clown ": 3.0}
    coef = np.array([-2.0, 0.7, 0.9])
    extra = [(10**6, "a trash can and a trash bin, pond scum, 1d10t trash"), (10**6 + 1, "trash " * 300 + "trash can " * 300), (10**6 + 2, "clown fish clown class clown fish")]
    docs = table(spark, sf, "documents").select("doc_id", "text").union(odd_docs.select("doc_id", "text")).union(spark.createDataFrame(extra, "doc_id long, text string"))

    def places(t, entry):
        at = t.find(entry)
        while at >= 0:
            yield at, at + len(entry) - 1
            at = t.find(entry, at + 1)

    want = Counter()
    for r in docs.collect():
        t = toxicity.fold(r.text or "")
        free = [x for e in toxicity.EXCEPTIONS for x in places(t, f" {e} ")]
        total = sum(w for e, w in lexicon.items() for a, b in places(t, e) if not any(x <= a and b <= y for x, y in free))
        z = coef @ [1, math.log1p(total), math.log1p(total / math.sqrt(1 + t.count(" ") / 100))]
        want[r.doc_id, round(1 / (1 + math.exp(-z)), 9)] += 1
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in rows(toxicity.score(docs, lexicon, coef))) == want


def test_toxicity_held_out(spark, sf, odd_docs, no_docs):
    big = sf.replace("sf0.001", "sf0.1")
    found = toxicity.toxicity(table(spark, big, "documents"), table(spark, big, "labels"))
    pdf = found.join(table(spark, big, "labels"), "doc_id").where("held_out").toPandas()
    assert (pdf.predicted == pdf.toxic).mean() > 0.95
    assert pdf.predicted[pdf.toxic == 0].mean() < 0.01
    labels = spark.createDataFrame([(3, 1), (7, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    odd = rows(toxicity.toxicity(odd_docs, labels))
    assert len(odd) == 11 and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.toxicity(no_docs, labels.where("false")).count() == 0
    assert toxicity.keep_clean(odd_docs, labels).columns == odd_docs.columns


def test_lm_gradient():
    rng = np.random.default_rng(0)
    flat = lm.fresh(np.zeros(lm.CLASSES)).astype(np.float64)
    x, y, m = rng.integers(0, lm.CLASSES, (2, lm.WINDOW)), rng.integers(0, lm.CLASSES, (2, lm.WINDOW)), rng.random((2, lm.WINDOW)) > 0.3
    _, g = lm.gradient(flat, x, y, m)
    for i in rng.choice(len(flat), 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (lm.gradient(up, x, y, m)[0] - lm.gradient(down, x, y, m)[0]) / 2e-5
        assert abs(slope - g[i]) < 1e-5 + 1e-3 * abs(slope)


def plain_states(p, x_in):
    """One window, place by place."""
    out = []
    x = [p["emb"][c] + p["pos"][t] for t, c in enumerate(x_in)]
    for t in range(len(x)):
        w = np.array([math.exp((x[t] @ p["q"]) @ (x[u] @ p["k"]) / math.sqrt(lm.DIM)) for u in range(t + 1)])
        z = sum(a * (x[u] @ p["v"]) for u, a in enumerate(w / w.sum()))
        y = x[t] + z @ p["o"]
        out.append(y + np.maximum(y @ p["w1"] + p["b1"], 0) @ p["w2"])
    return out


def log_softmax(x):
    return x - x.max() - math.log(np.exp(x - x.max()).sum())


def plain_score(p, ids, cls, within):
    """log10 of a text's probability: each id once, in the windows that ``windows`` names."""
    total = 0.0
    for _, begin, fresh in zip(*lm.windows(np.array([len(ids)])), strict=True):
        own = ids[begin : begin + lm.WINDOW]
        before = [cls[lm.END_ID] if t + begin == 0 else cls[ids[t + begin - 1]] for t in range(len(own))]
        for t, h in enumerate(plain_states(p, before)):
            if t + begin >= fresh:
                c = cls[own[t]]
                g, m = divmod(int(c), lm.MEMBERS)
                total += log_softmax(h @ p["grp"] + p["gb"])[g] + log_softmax(h @ p["out"][g] + p["b"][g])[m] + within[own[t]]
    return total / math.log(10)


def test_lm_scores_brute(spark, monkeypatch):
    """Whole-text scores against a plain loop over windows, places and weights."""
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 1000, lm.VOCAB)
    cls, within, prior = lm.classes_of(counts)
    for k in range(0, lm.CLASSES, 97):
        assert abs(np.exp(within[cls == k]).sum() - 1) < 1e-6
    flat = lm.fresh(prior) + rng.standard_normal(len(lm.fresh(prior))).astype(np.float32) * 0.1
    texts = ["", "one", "The quick brown fox, é 漢字 " * 3, " ".join(f"w{rng.integers(99)}" for _ in range(90)), "x y " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm, "fitted", lambda train, prior, path, cls: flat)
    monkeypatch.setattr(lm, "classes_of", lambda counts: (cls, within, prior))
    enc = packing.bpe(BPE)
    p = lm.parts(flat.astype(np.float64))
    for r in rows(lm.lm_scores(docs, BPE)):
        words = texts[r["doc_id"]].encode().lower().decode().split()
        ids = [i for w in words for i in enc.encode_ordinary(" " + w)] + [lm.END_ID]
        assert abs(r["score"] - plain_score(p, np.array(ids), cls, within)) < 1e-4 * len(ids)


def test_lm_windows_score_each_id_once():
    for n in (1, 5, 31, 32, 33, 56, 57, 200):
        text, begin, fresh = lm.windows(np.array([n, 0, n]))
        got = Counter(p for t, b, f in zip(text, begin, fresh, strict=True) if t == 0 for p in range(f, min(n, b + lm.WINDOW)))
        assert got == Counter(range(n)) and 1 not in text


def test_lm_base_brute(spark, sf, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 50)  # most words take the join
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, ws in texts.items() if not held[i] for w in ws)
    n = sum(c.values())
    low = math.log10(n + 0.5 * (len(c) + 1))
    found = rows(lm.lm_scores(docs, BPE))
    assert len(found) == len(texts)
    for r in found:
        ws = texts[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(c[w] > 0 for w in ws)
        assert abs(r["base_score"] - sum(math.log10(c[w] + 0.5) - low for w in ws)) < 1e-6 * len(ws)
        assert r["score"] < 0
    odd = rows(lm.lm_scores(odd_docs, BPE))
    want = Counter((r.doc_id, len((r.text or "").encode().split()) + 1) for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in odd) == want and all(r["score"] < 0 and r["base_score"] < 0 for r in odd)
    assert rows(lm.lm_scores(no_docs, BPE)) == []


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)] + [(7, 7)]
    ids = {x for a, b in edges if a != b for x in (a, b)}
    want = reach(ids, [e for e in edges if e[0] != e[1]])
    table = spark.createDataFrame(edges, "u long, v long").repartition(8)
    for part in (100, 100_000):  # several parts that meet in joins, and one
        assert {r["id"]: r["component"] for r in rows(graph.components(table, part_edges=part))} == want
    assert rows(graph.components(table.where("false"))) == []


def test_language_model_reads_all_training_documents(spark, monkeypatch):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("one short text").alias("text"))
    seen = []
    monkeypatch.setattr(lm, "fitted", lambda train, prior, path, cls: seen.append(train.count()) or lm.fresh(prior))
    found = lm.lm_scores(docs, BPE)
    assert seen == [found.where("not held_out").count()]  # one window a text
    assert lm.WINDOW - lm.STRIDE >= 8  # earlier ids before the first scored one of a later window
