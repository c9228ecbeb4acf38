"""What list probing finds of pairs just above the threshold, for vectors that fill their space and for those that do not."""

import numpy as np
import pytest

from siftwright.llm import embed_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def make(dim, kind, n=6000, m=1500):
    rng = np.random.default_rng(dim)
    plane = rng.normal(size=(8, dim))
    centres = rng.normal(size=(100, dim))[rng.integers(0, 100, n)]
    falling = np.arange(1, dim + 1) ** -0.7
    base, dev = {
        "isotropic": lambda: (rng.normal(size=(n, dim)), rng.normal(size=(m, dim))),
        "clustered": lambda: (centres + 0.7 * rng.normal(size=(n, dim)), rng.normal(size=(m, dim))),
        "low rank": lambda: (rng.normal(size=(n, 8)) @ plane + 0.05 * rng.normal(size=(n, dim)), rng.normal(size=(m, 8)) @ plane),
        "low-rank clusters": lambda: (centres + 0.25 * rng.normal(size=(n, 8)) @ plane, rng.normal(size=(m, 8)) @ plane),
        "falling spectrum": lambda: (rng.normal(size=(n, dim)) * falling, rng.normal(size=(m, dim)) * falling),
    }[kind]()
    x = unit(base)
    a = x[:m]
    dev = unit(dev - (dev * a).sum(1, keepdims=True) * a)
    cos = rng.uniform(0.95, 0.96, (m, 1))
    return x, a, unit(cos * a + np.sqrt(1 - cos**2) * dev)


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "low rank", "low-rank clusters", "falling spectrum"])
@pytest.mark.parametrize("dim", [64, 256, 768])
def test_recall_of_probing(dim, kind):
    x, a, b = make(dim, kind)
    rows = np.vstack([x, b])
    for items in (len(rows), 5_000_000):
        q = embed_dedup.Quantiser(rows[np.random.default_rng(1).permutation(len(rows))[:4000]], items, 0.95)
        own = np.stack([q.nearest(v.astype(np.float32)) for v in (a, b)])
        swap = own[0] > own[1]
        first, lists = np.where(swap[:, None], b, a), np.sort(own, axis=0)
        row, other = q.asks(first.astype(np.float32), lists[0])
        asked = set(zip(row.tolist(), other.tolist()))
        found = [p == q_ or (i, q_) in asked for i, (p, q_) in enumerate(lists.T.tolist())]
        assert np.mean(found) >= 0.98


@pytest.mark.parametrize("dim,kind", [(64, "isotropic"), (64, "low rank"), (256, "falling spectrum")])
def test_links_against_brute_force(spark, dim, kind):
    x, _, b = make(dim, kind, 600, 150)
    rows = np.vstack([x, b])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    near = rows @ rows.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.id: r.n_links for r in embed_dedup.near_vectors(table).collect()}
    want = near.sum(1)
    assert want.sum() >= 300 and sum(got.values()) >= 0.98 * want.sum()
    assert all(got[i] <= want[i] for i in got)
