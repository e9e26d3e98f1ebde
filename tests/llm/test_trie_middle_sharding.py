"""The prefix trie, the fill-in-middle transformation and resharding against brute force, with nulls, ties, repeated rows, empty and long texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, middle, sharding, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie ----------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        up = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), up, len(cs), kids[p], sum(kids[q] == 0 for q in below), saved, sha(",".join(map(str, sorted(ends[p]))))))
    return sorted(out, key=str)


def conversations(seed, n, long):
    r = random.Random(seed)
    lines = ["", None, "hello  there", "one\ttwo three", "é\x0bö ü", "x"]
    rows = []
    for c in r.sample(range(1, 70), n) + [20, 40]:
        for t in range(r.choice([0, 1, 2, 3, 5, 8, 9])):
            rows.append((c, r.choice([t, t, t, t, None, 1]), r.choice(["user", "user", "bot", None]), r.choice(lines)))
    rows += [(7, t, "user", lines[t % 3 + 2]) for t in range(long)] + [(27, t, "user", lines[t % 3 + 2]) for t in range(long // 2)]
    rows += [(None, 1, "user", "x"), (None, None, None, None)] + rows[:5]
    return rows


@pytest.mark.parametrize("seed,n,long", [(1, 30, 37), (2, 45, 64)])
def test_trie(spark, seed, n, long, monkeypatch):
    """Also with hot keys at every size and with lists of several pieces."""
    if seed == 2:
        monkeypatch.setattr(trie, "PIECE", 2)
        monkeypatch.setattr(common, "HOT_SHARE", 0.1)
    rows = conversations(seed, n, long)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, depth long").repartition(3)
    got = sorted((tuple(r) for r in trie.trie(df).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_empty_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.trie(spark.createDataFrame([], schema)).collect() == []
    c = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(c, 1, "user", "a b")]  # all of its turns go and its family has none
    assert [tuple(r) for r in trie.trie(spark.createDataFrame(rows, schema)).collect()] == brute_trie(rows) == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


def test_dense_names(spark):
    got = [r["n"] for r in trie.dense(spark.range(100).select(F.col("id").alias("k")).repartition(5), "n").collect()]
    assert sorted(got) == list(range(100))


# --- fill in middle -------------------------------------------------------------------------------------------------------


def brute_middle(doc_id, text):
    text = text or ""
    n, s = len(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, x = text[:lo], text[lo:hi], text[hi:]
    if not text or any(k in text for k in middle.MARKS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    return (doc_id, n, "spm", lo, hi - lo, f"<S>{x}<P>{p}<M>{m}") if h[3] % 100 < 20 else (doc_id, n, "psm", lo, hi - lo, f"<P>{p}<S>{x}<M>{m}")


def test_middle(spark):
    r = random.Random(3)
    odd = ["", "a", "é", "\U0001f926", "<", "<S", ">", "<P", "\x00", "\n", "日本", " ", "M>"]
    rows = [(i, "".join(r.choice(odd) for _ in range(r.randint(0, 30)))) for i in range(1500)]
    rows += [(2000, None), (None, "null id"), (None, "null id"), (5, "again"), (2001, "has <S> in it"), (2002, "日<é" * 700_000), (-3, "x" * 100)] + rows[:3]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, form string, n long").repartition(3)
    out = middle.restore(middle.fill_in_middle(df)).collect()
    assert sorted((tuple(x[:6]) for x in out), key=str) == sorted((brute_middle(*x) for x in rows), key=str)
    texts = Counter(t or "" for _, t in rows)
    assert Counter(x["restored"] for x in out) == texts
    assert {x["form"] for x in out} == set(middle.FORMS)
    assert middle.fill_in_middle(df.limit(0)).collect() == []


def test_middle_word_units():
    texts = ["  two words\tand  more", "", "é", " ", "a b"]
    col = pa.array(texts)
    ((_, _, buf, offs),) = common.text_slices(col)
    n, cut = middle.cut_all(buf, offs, "word")
    assert n.tolist() == [5, 0, 1, 1, 2]  # white space at the head is a unit of its own
    for k in range(6):
        want = []
        for t in texts:
            units = re.findall(r"^\s+|\S+\s*", t)
            want.append(len("".join(units[:k]).encode()))
        assert (cut(np.minimum(k, n)) - offs[:-1]).tolist() == want


# --- resharding -----------------------------------------------------------------------------------------------------------


def test_min_cost_flow():
    r = random.Random(1)
    for _ in range(150):
        m, n = r.randint(1, 4), r.randint(1, 4)
        s, c = [r.randint(0, 3) for _ in range(m)], [r.randint(0, 4) for _ in range(n)]
        c[0] += max(0, sum(s) - sum(c))
        k = [[r.randint(0, 5) for _ in range(n)] for _ in range(m)]
        units = [i for i in range(m) for _ in range(s[i])]

        @lru_cache(None)
        def least(u, room, units=units, k=k):
            if u == len(units):
                return 0
            return min(k[units[u]][j] + least(u + 1, (*room[:j], room[j] - 1, *room[j + 1 :])) for j in range(len(room)) if room[j])

        f = sharding.min_cost_flow(s, c, np.array(k))
        assert f.sum(1).tolist() == s and (f.sum(0) <= c).all() and (f >= 0).all() and (f * np.array(k)).sum() == least(0, tuple(c))
    with pytest.raises(ValueError):
        sharding.min_cost_flow([3], [2], np.zeros((1, 1)))


def test_rooms():
    assert sharding.rooms([10, 10, 10], [0, 25, 0], 5) in ([3, 0, 2], [2, 0, 3])
    for seed in range(50):
        r = random.Random(seed)
        goal = sharding.targets(r.randint(0, 500), [1] * r.randint(1, 9))
        load = [r.randint(0, 90) for _ in goal]
        supply = max(0, sum(goal) - sum(load))
        assert sum(sharding.rooms(goal, load, supply)) == supply


def check_layout(layout, rows, weights, tolerance):
    got = sharding.slots(layout).select("shard", "slot", "size", "row.*").collect()
    assert Counter((x["doc_id"], x["text"]) for x in got) == Counter((x[0], x[1]) for x in rows)
    size = Counter()
    places = defaultdict(list)
    for x in got:
        assert x["size"] == len((x["text"] or "").encode()) + 1
        size[x["shard"]] += x["size"]
        places[x["shard"]].append(x["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    for j, goal in enumerate(sharding.targets(sum(size.values()), weights)):
        assert abs(size[j] - goal) <= tolerance, (j, size, goal)
    files = {(f["shard"], f["round"], f["block"]): (f["rows"], f["bytes"]) for f in layout.files.collect()}
    assert sum(n for n, _ in files.values()) == len(rows) and sum(b for _, b in files.values()) == sum(size.values())
    return size


@pytest.mark.parametrize("large", [8192, 1024])
def test_reshard(spark, large, monkeypatch, tmp_path):
    """A hot shard of repeated rows and null ids; only moved and split files are written; a second round and fewer shards work too."""
    monkeypatch.setattr(sharding, "LARGE", large)
    r = random.Random(4)
    rows = [(i, "x" * r.randint(0, 60), r.choice("abcd")) for i in range(2500)] + [(None, "same row", "hot")] * 1200 + [(1, None, None), (2, "y" * 900, "a")]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, source string, block long, shard string").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    old = sharding.store(df, F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 6, 6, sharding.text_size())
    before = Counter()
    for x in old.rows.select("shard", "size").collect():
        before[x["shard"]] += x["size"]
    total = sum(before.values())
    new = sharding.reshard(old, [1.0] * 8)
    size = check_layout(new, rows, [1.0] * 8, 200)
    fewest = sum(max(0, n - total / 8) for n in before.values())
    assert abs(new.moved - fewest) <= 8 * 1000 and new.moved <= new.written <= total and (large > 1024 or new.written < total)
    same = {tuple(f) for f in old.files.collect()} & {tuple(f) for f in new.files.collect()}
    assert sum(f[5] for f in same) == total - new.written
    again = sharding.reshard(new, [3.0, 1.0, 1.0, 1.0, 2.0])
    check_layout(again, rows, [3.0, 1.0, 1.0, 1.0, 2.0], 1000)
    assert again.moved >= sum(size.values()) - sum(size[j] for j in range(5)) - 1000


def test_reshard_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    size = sharding.text_size()
    empty = sharding.reshard(sharding.store(spark.createDataFrame([], schema), F.lit(0), 2, size), [1.0] * 8)
    assert sharding.slots(empty).collect() == []
    rows = [(i, "z" * (5000 if i == 3 else 5), "s") for i in range(40)]  # one row is larger than any goal
    one = sharding.reshard(sharding.store(spark.createDataFrame(rows, schema), F.lit(None), 1, size), [1.0] * 4)
    got = Counter(x["shard"] for x in sharding.slots(one).collect())
    assert sorted(got.values()) == [1, 13, 13, 13]
    with pytest.raises(ValueError):
        sharding.store(spark.createDataFrame(rows, schema), F.lit(5), 2, size)


def test_cost_of_places(spark):
    """Bytes go where they cost least, not to the next shard."""
    flow = sharding.min_cost_flow([10, 10], [4, 4, 12], np.array([[0, 9, 1], [9, 0, 2]]))
    assert flow.tolist() == [[4, 0, 6], [0, 4, 6]]
    assert list(itertools.chain(sharding.pieces_of(flow))) == [(0, 0, 4, 0), (0, 4, 10, 2), (1, 0, 4, 1), (1, 4, 10, 2)]
