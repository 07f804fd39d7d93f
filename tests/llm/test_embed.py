"""Which cells a vector is shown to: recall on data of few directions in many dimensions, with a dominant mean, and with an exact margin."""

import numpy as np
import pytest

from strataloom.llm import embed


def unit(x):
    return x / np.sqrt((x * x).sum(1))[:, None]


def made(kind, n, dim, inner, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "subspace":
        return unit(rng.standard_normal((n, inner)) @ rng.standard_normal((inner, dim)) / np.sqrt(dim) + 0.01 * rng.standard_normal((n, dim)) / np.sqrt(dim))
    if kind == "copies":
        x = rng.standard_normal((n, dim))
        x[n // 2 :] = x[: n - n // 2] + 0.2 * rng.standard_normal((n - n // 2, dim))
        return unit(x)
    if kind == "mean":
        scale = np.arange(1, dim + 1) ** -0.5
        x = rng.standard_normal((n, dim)) * scale + inner * scale.mean()
        x[n // 2 :] = x[: n - n // 2] + 0.02 * rng.standard_normal((n - n // 2, dim)) * scale
        return unit(x)
    c = rng.standard_normal((200, dim))
    return unit(c[rng.integers(0, 200, n)] + 0.25 * rng.standard_normal((n, dim)))


def lost(x, cells):
    home, shown = cells.shown(x)
    total = missed = 0
    for a in range(0, len(x), 1000):
        p, q = np.nonzero(x[a : a + 1000] @ x.T >= 0.95)
        p += a
        p, q = p[p < q], q[p < q]
        total += len(p)
        missed += int((~shown[p, home[q]] & ~shown[q, home[p]]).sum())
    return missed / max(1, total), shown.sum(1).mean() / len(cells.centroids)


@pytest.mark.parametrize("kind,dim,inner,most", [("subspace", 768, 4, 0.3), ("subspace", 768, 6, 0.3), ("subspace", 768, 8, 0.3), ("subspace", 768, 12, 0.3), ("copies", 64, 0, 0.3), ("copies", 16, 0, 0.3), ("mean", 256, 1, 0.9), ("cells", 64, 0, 0.1)])
def test_recall(kind, dim, inner, most):
    x = made(kind, 6000, dim, inner)
    missed, share = lost(x, embed.Cells(x[:4000], 24, 0.95))
    assert missed <= 0.01 and share <= most


def test_exact_loses_nothing():
    for threshold in (0.95, 0.7):
        x = made("subspace", 3000, 64, 5)
        cells = embed.Cells(x[:1000], 20, threshold, exact=True)
        home, shown = cells.shown(x)
        p, q = np.nonzero(x @ x.T >= threshold)
        assert shown[p, home[q]].all() and shown[q, home[p]].all()


def test_links_in_a_subspace(spark):
    x = made("subspace", 3000, 200, 6)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = (x @ x.T >= 0.95).sum(1) - 1
    for exact in (False, True):
        got = {r["vec_id"]: r["n_links"] for r in embed.near_vectors(table, exact=exact).collect()}
        found = np.array([got[i] for i in range(3000)])
        assert (found <= want).all() and found.sum() >= (1 if exact else 0.99) * want.sum()
