"""Large sets of one list: tiles leave only pairs that may link."""

import numpy as np

from tessera.llm import jaccard


def test_tiles_tell_large_sets_apart(spark):
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in [1500] * 30 + [6000] * 30]
    for at in (0, 30):  # a near copy of the first of each size
        sets.append(np.unique(np.r_[sets[at][20:], r.integers(0, 1 << 63, 20, dtype=np.uint64)]))
    fold = lambda s: np.bitwise_xor.reduce(jaccard.parity(s).reshape(-1, jaccard.FOLD), axis=0)
    words = [f"s{i}" for i in range(jaccard.FOLD)]
    short = spark.createDataFrame([(i, len(s), jaccard.own_sketch(s) if hasattr(jaccard, "own_sketch") else None, *map(int, fold(s))) for i, s in enumerate(sets)], "node long, n long, own binary, " + ", ".join(f"{w} long" for w in words))
    n = len(sets)
    lists = spark.createDataFrame([(1, i, i, 0, n, n - 1) for i in range(n)], "key long, node long, c long, main long, size long, outside long")
    assert {tuple(x) for x in jaccard.tiled(lists, short, 80, 100).collect()} == {(0, 60), (30, 61)}


def test_wide_sketches_fold_to_narrow_ones():
    r = np.random.default_rng(6)
    a, b = (np.unique(r.integers(0, 1 << 40, n, dtype=np.uint64)) for n in (1800, 2200))
    narrow, _, wide = jaccard.sketches([jaccard.own_sketch(a), jaccard.own_sketch(b)])
    assert wide.tolist() == [False, True] and all((x.view(np.int64) == jaccard.parity(s)).all() for x, s in zip(narrow, (a, b), strict=True))
    differ = len(np.setxor1d(a, b))
    assert 0 < jaccard.least_apart([jaccard.own_sketch(a)], [jaccard.own_sketch(b)])[0] <= differ
