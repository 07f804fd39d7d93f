"""Ids of texts that hold the vocabulary's added token, against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataloom.llm import packing

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def test_packed_texts_with_added_tokens(spark):
    tok = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(6)
    bits = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "word", " more", "é漢", " ", "'s", "12", "<|EndOfText|>"]
    texts = ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|>\n", "x" * 5000 + "<|endoftext|>" + " y" * 5000, *("".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(300))]
    assert any(50256 in tok.encode(t, add_special_tokens=False).ids for t in texts)
    want = Counter()
    for k, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 128 or min(len(ids), 128)
        cuts = [0, *range(head, len(ids) + 1, 128)]
        want.update((k, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = packing.pack(docs, RANKS, width=128).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want


def test_added_tokens_of_a_vocabulary(tmp_path):
    assert packing.added_tokens(VOCABULARY) == {"<|endoftext|>": 50256}
    assert packing.with_added("ab", lambda t: [ord(c) for c in t], {}) == [97, 98]
    assert packing.with_added("aXXbX", lambda t: [ord(c) for c in t], {"X": 1, "XX": 2}) == [97, 2, 98, 1]
    odd = tmp_path / "odd.json"
    odd.write_text('{"added_tokens": [{"content": "x", "id": 1, "lstrip": true, "rstrip": false, "single_word": false, "normalized": false}]}')
    with pytest.raises(ValueError):
        packing.added_tokens(str(odd))
