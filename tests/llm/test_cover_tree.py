"""The cover tree's invariant, and that the dual-tree search prunes where vectors lie in clusters."""

import numpy as np
import pytest

from tessera.llm import embeddings


def clustered(n, clusters, dim=32, wide=0.01):
    r = np.random.default_rng(7)
    centres = r.normal(size=(clusters, dim))
    x = centres[r.integers(0, clusters, n)] + wide * r.normal(size=(n, dim))
    return np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))


@pytest.mark.parametrize("leaf", [1, 64])
@pytest.mark.parametrize("wide", [0.01, 5.0])
def test_radii_halve(leaf, wide):
    x = np.concatenate([clustered(700, 20, wide=wide), np.zeros((5, 32))])
    t = embeddings.CoverTree(x, leaf)
    seen = []
    for node, kids in enumerate(t.children):
        assert (t.rows[node] is None) == bool(kids)
        assert all(t.radius[c] <= t.radius[node] / 2 + 1e-6 for c in kids)
        if not kids:
            seen += t.rows[node].tolist()
            assert np.sqrt(((x[t.rows[node]] - t.centre[node]) ** 2).sum(axis=1)).max() <= t.radius[node] + 1e-9
            assert leaf > 1 or t.radius[node] == 0
    assert sorted(seen) == list(range(len(x)))


def test_search_prunes():
    x, ids = clustered(4000, 50), np.arange(4000)
    q = ids % 50 == 0
    s = embeddings.Search(x[q], ids[q], x, ids, 5)
    s.run()
    assert s.scored.sum() < 0.1 * len(x) * q.sum()
    for i, want in zip(ids[q], s.who, strict=True):
        score = x @ x[i]
        score[i] = -np.inf
        assert want.tolist() == sorted(ids, key=lambda j: (-score[j], j))[:5]


def test_scored_rows_are_told(spark):
    x = clustered(3000, 30)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / 256)], "vec_id long, embedding array<double>")
    got = embeddings.top_k(df).collect()
    n = {r["query_id"]: r["n_scored"] for r in got}
    assert len(n) == 60 and len(got) == 300 and all(k >= 5 for k in n.values()) and sum(n.values()) < 0.1 * 60 * 3000
