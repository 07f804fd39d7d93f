"""Scores of the places that are asked for alone; words coded together, and the windows of their ids."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from strataloom.llm import lm, packing, textvec


def test_log_probs_of_asked_places():
    """They are those of the whole windows, and other places give 0; also where batches are cut into parts and where few groups occur."""
    rng = np.random.default_rng(5)
    p = lm.parts(lm.fresh(np.zeros(lm.CLASSES)))
    x, y = (rng.integers(0, lm.CLASSES, (lm.NEAR + 3, lm.WINDOW)) for _ in range(2))
    for target in (y, y % lm.MEMBERS):
        for asked in (rng.random(y.shape) < 0.5, np.ones(y.shape, bool), np.zeros(y.shape, bool)):
            got, whole = lm.log_probs(p, x, target, asked), lm.log_probs(p, x, target)
            assert np.allclose(got[asked], whole[asked], atol=1e-5) and not got[~asked].any()
            assert (whole < 0).all()
    one = lm.log_probs(p, x[-1:], y[-1:])
    assert np.allclose(one, lm.log_probs(p, x, y)[-1:], atol=1e-5)


def test_words_coded_together():
    """Ids of words that are coded as one text, in one call, are those of each word alone, also where words hold Unicode's other white space."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = packing.bpe(path)
    plain = ["it's", "'s", "na\u00efve", "\u6f22\u5b57", "\U0001f642\U0001f642", "a1b2", "--", "\ufffd", "x" * 300, "don't've", "#$%", "the", "\u0301"]
    for words in (plain, [*plain, "a\u00a0", "\u00a0b", "\u2003", "c\u3000d", "\x85", "\x1f"], ["\u00a0"], ["one"], []):
        ids, size = lm.coded(path, words)
        assert [r.tolist() for r in np.split(ids, np.cumsum(size)[:-1])] == [enc.encode_ordinary(" " + w) for w in words] or not words
        assert len(size) == len(words) and size.sum() == len(ids)
    calls = []
    lm._vocabularies["counted"] = type("Counted", (), {"encode_ordinary": lambda self, text: calls.append(text) or enc.encode_ordinary(text)})(), lm.vocabulary(path)[1]
    assert lm.coded("counted", plain)[1].sum() and len(calls) == 1
    del lm._vocabularies["counted"]


def test_windows_of_streams():
    """Input and target classes of every window, from the ids of each text alone."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc, cls = packing.bpe(path), np.random.default_rng(2).integers(0, lm.CLASSES, lm.VOCAB)
    texts = [None, "One two\tone", "", "\u00e9\u00a0x \u2003 ", "a b " * 70, "TWO two " * 200]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for coder, lead in ((lm.coder_of(path), 0), (lm.numbered_coder(path, {"one": 1, "two": 2}), 1)):
        ids, first, found, where = lm.streams(*textvec.utf8(batch.column(0)), coder, lead)
        want = [[*(i for w in (t or "").encode().lower().split() for i in enc.encode_ordinary(" " + w.decode())), lm.END_ID] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == want
        if lead:
            assert {found.name(i): n for i, n in enumerate(coder.flat[where].tolist())} == {"one": 1, "two": 2, "\u00e9\u00a0x": 0, "\u2003": 0, "a": 0, "b": 0}
    x, y, inside = lm.cut_windows(batch, lm.coder_of(path), cls)
    cuts = [(t, a) for t in want for a in range(0, len(t), lm.WINDOW)]
    assert len(cuts) == len(x)
    for (t, a), xs, ys, m in zip(cuts, x, y, inside, strict=True):
        n = min(lm.WINDOW, len(t) - a)
        assert m.tolist() == [True] * n + [False] * (lm.WINDOW - n)
        assert xs[:n].tolist() == cls[[lm.END_ID, *t][a : a + n]].tolist() and ys[:n].tolist() == cls[t[a : a + n]].tolist()
