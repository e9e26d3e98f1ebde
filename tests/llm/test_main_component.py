"""Nodes of a list's main component are dealt once, not once for each list, and no link is lost by it."""

import random

import pytest

from tessera.llm import jaccard


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))

    def changed(words, n):
        out = list(words)
        for i in r.sample(range(0, len(out), 4), n):
            out[i] = word()
        return out

    base, step = [word() for _ in range(200)], [word() for _ in range(200)]
    texts = [base] + [changed(base, 1) for _ in range(60)] + [changed(base, n) for n in (7, 9, 12) for _ in range(20)]
    for _ in range(80):  # a chain: neighbours link, its ends do not
        step = changed(step, 2)
        texts.append(step)
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, " ".join(base))]


def components(rows, num):
    sets = {i: frozenset(zip(w, w[1:], w[2:], strict=False)) for i, t in rows if (w := (t or "").split())}
    name = {i: i for i, _ in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and name[i] != name[j] and 100 * len(a & b) >= num * len(a | b):
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = {x: new if c == old else c for x, c in name.items()}
    return name


@pytest.mark.parametrize("by_lists", [False, True])
def test_main_component_is_dealt_once(spark, monkeypatch, by_lists):
    """by_lists: as where a component has many more nodes than its lists hold of it."""
    if by_lists:
        monkeypatch.setattr(jaccard, "WHOLE", 0, raising=False)
    rows, dealt, tiled = corpus(), [], jaccard.tiled
    monkeypatch.setattr(jaccard, "tiled", lambda lists, *a, **kw: dealt.append(lists) or tiled(lists, *a, **kw))
    got = {x[0]: x[2] for x in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 80, 100).collect()}
    assert got == components(rows, 80)
    inner = [x for t in dealt for x in t.where("c = main").select("node").collect()]
    assert inner if by_lists else 0 < len(inner) == len(set(inner))
