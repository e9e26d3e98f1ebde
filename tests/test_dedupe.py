"""Consolidation and upsert against a replay of the greedy rules row by row; titles alike against all pairs."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedupe

NAMES = ["title", "institution", "application_url", "description_text", "fit_score", "fit_category", "role_type", *dedupe.FLAGS, *dict.fromkeys((*dedupe.FILLED, *dedupe.LISTS))]
TYPES = {"fit_score": "int", **dict.fromkeys(dedupe.FLAGS, "boolean"), **dict.fromkeys(dedupe.LISTS, "array<string>")}
SCHEMA = "ord long, canonical_id string, " + ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in NAMES)


def postings(seed: int, n: int) -> list[dict]:
    r = random.Random(seed)
    bases = ["Assistant Professor of Structural Engineering", "Lecturer in Statistics and Data Science", "Open Rank Faculty in Physics", "Chair"]
    tails = ["", "", "s", " (two posts)", " Organisation: University of X Apply before: 1 May", " at the School of Very Long Names Indeed", " II"]
    out = []
    for i in range(n):
        title = r.choice(bases) + r.choice(tails)
        if r.random() < 0.3:
            at = r.randrange(len(title))
            title = title[:at] + r.choice("xyz") + title[at + 1 :]
        row = {c: r.choice(["", "", None, "a", "b", "c"]) for c in NAMES}
        row |= {c: r.choice([None, [], ["a"], ["b", "a"], ["c", "b"]]) for c in dedupe.LISTS} | {c: r.choice([True, False, None]) for c in dedupe.FLAGS}
        row |= {"ord": i, "title": r.choice([title, title, None, ""]) if r.random() < 0.1 else title, "institution": r.choice(["The Uni of A", "Uni of A", "Uni of B", "Not listed", None])}
        row |= {"canonical_id": f"id{r.randrange(n)}" if r.random() < 0.7 else f"id{i}", "application_url": r.choice(["", "", None, f"https://x.org/{r.randrange(n)}", f"http://www.x.org/{r.randrange(n)}/"])}
        row |= {"fit_score": r.choice([None, 0, 0, 10, 20]), "description_text": r.choice([None, "", "short", "a longer one", "Candidate link extracted from a board", "x" * r.randrange(60)])}
        out.append(row)
    return out


def table(spark, rows, parts=3):
    return spark.createDataFrame([tuple(x[c] for c in ("ord", "canonical_id", *NAMES)) for x in rows], SCHEMA).repartition(parts)


def comparable(rows):
    return sorted((tuple((c, tuple(v) if isinstance(v, list) else v) for c, v in sorted(r.items()) if not c.startswith("_")) for r in rows), key=lambda x: dict(x)["ord"])


def copies(rows):
    return [{k: list(v) if isinstance(v, list) else v for k, v in x.items()} for x in rows]


@pytest.mark.parametrize("seed,n,many", [(1, 60, 300), (2, 150, 300), (2, 150, -1), (3, 25, -1)])
def test_consolidate(spark, seed, n, many, monkeypatch):
    """With pairs compared at once, and with rounds that ask the index first."""
    monkeypatch.setattr(dedupe, "MANY_PAIRS", many)
    rows = postings(seed, n)
    want = dedupe.fold(copies(rows))
    assert 3 < len(want) < n
    got = [r.asDict() for r in dedupe.consolidate(table(spark, rows)).collect()]
    assert comparable(got) == comparable(want)


def test_consolidate_without_replays(spark, monkeypatch):
    """Titles that stay as they are: rounds and aggregates alone give the replay's rows."""
    monkeypatch.setattr(dedupe, "replayed", None)
    rows = postings(4, 150)
    for x in rows:
        x["title"] = (x["title"] or "Readership in Cryptography")[:40].replace("Chair", "Readership in Cryptography")[:40]
    got = [r.asDict() for r in dedupe.consolidate(table(spark, rows)).collect()]
    assert comparable(got) == comparable(dedupe.fold(copies(rows)))


def test_upsert(spark):
    rows = postings(5, 120)
    stored = dedupe.fold(copies(rows[:60]))
    seen, unique = set(), []
    for x in stored:  # a store holds an id once
        if x["canonical_id"] not in seen:
            seen.add(x["canonical_id"])
            unique.append(x)
    want = dedupe.fold([x | {"_stored": True} for x in copies(unique)] + [x | {"_stored": False} for x in copies(rows[60:])], stored=True)
    got = [r.asDict() for r in dedupe.upsert(table(spark, unique), table(spark, rows[60:]), mark="_seen").collect()]
    assert comparable(got) == comparable(want)
    assert {r["ord"]: r["_seen"] for r in got} == {r["ord"]: bool(r.get("_hit")) or not r["_stored"] for r in want}


def test_ids_alone(spark):
    """Without URLs and institutions one grouping merges all; columns may be missing."""
    rows = [x | {"application_url": "", "institution": None} for x in postings(6, 80)]
    got = [r.asDict() for r in dedupe.consolidate(table(spark, rows)).collect()]
    assert comparable(got) == comparable(dedupe.fold(copies(rows)))
    few = ["ord", "canonical_id", "department", "warnings"]
    got = [r.asDict() for r in dedupe.consolidate(table(spark, rows).select(*few)).collect()]
    assert comparable(got) == comparable(dedupe.fold([{c: x[c] for c in few} for x in copies(rows)]))


@pytest.mark.parametrize("many", [300, -1])
def test_duplicates(spark, many, monkeypatch):
    monkeypatch.setattr(dedupe, "MANY_PAIRS", many)
    rows = [x | {"title": (x["title"] or "Readership in Cryptography")[:40].replace("Chair", "Readership in Cryptography")[:40]} for x in postings(7, 100)]
    replay, want = dedupe.Replay(), {}
    for x in copies(rows):
        hit = replay.add(x)
        want[x["ord"]] = None if hit is None else hit["ord"]
    got = dedupe.duplicates(table(spark, rows)).collect()
    assert {r["ord"]: r["leader"] for r in got} == want
    fuzzy = [r for r in got if r["reason"] == "fuzzy_title_institution"]
    assert fuzzy and all(0.9 <= r["score"] <= 1 for r in fuzzy)
    assert dedupe.duplicates(table(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("at,n", [(0.9, 120), (0.95, 60), (0.7, 40)])
def test_titles_alike(spark, at, n):
    """The index loses no pair of at least that ratio, short titles included."""
    r = random.Random(n)
    titles = {"".join(r.choice("ab ") for _ in range(r.randint(1, 14))).strip() for _ in range(n)}
    for x in list(titles):
        cut = r.randrange(len(x) + 1)
        titles |= {x[:cut] + r.choice("abc") + x[cut:], x[:cut] + x[cut + 1 :]}
    titles = sorted(titles - {""})
    classes = spark.createDataFrame([(i, "p", t, "n") for i, t in enumerate(titles)], "class long, place string, core string, name string")
    index = dedupe.title_index(classes, at).join(classes.select("class", "place"), "class")
    got = {(x["a"], x["b"]) for x in dedupe.alike(dedupe.index_pairs(index, index, at), classes, at, 0.9).collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.permutations(enumerate(titles), 2) if SequenceMatcher(None, a, b).ratio() >= at}


def test_one_institution_is_spread(spark):
    """An institution's titles lie in many tasks when they are compared."""
    n = 3000
    r = random.Random(8)
    rows = spark.createDataFrame([(i, str(i), "".join(r.choice("abcdefghij ") for _ in range(30)), "U") for i in range(n)], "ord long, canonical_id string, title string, institution string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        classes = rows.select(F.col("ord").alias("class"), F.lit("u").alias("place"), F.col("title").alias("core"))
        index = dedupe.title_index(classes, 0.9).join(classes.select("class", "place"), "class")
        tasks = index.repartition(4, "place", "gram").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(t["count"] for t in tasks) < 2 * min(t["count"] for t in tasks)
    assert dedupe.duplicates(rows).where("leader IS NULL").count() == n


def test_common_letters():
    r = random.Random(9)
    word = lambda n: "".join(r.choice("ab c1") for _ in range(n))
    a, b = zip(*((word(r.choice([0, 1, 5, 30, 63, 64, 65, 90])), word(r.choice([0, 3, 30, 64, 80]))) for _ in range(200)), strict=True)

    def longest(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y):
                last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j], row[j + 1])
        return row[-1]

    assert dedupe.common_letters(list(a), list(b)).tolist() == [longest(x, y) for x, y in zip(a, b, strict=True)]


def parts(n: int, seed: int = 11, shared: float = 0.0) -> list[dict]:
    """Rows of four institutions with titles that resemble each other, some in many rows; ids are their own but for a share of them."""
    r = random.Random(seed)
    name = lambda: f"Professor of {r.choice(['large', 'small', 'hot', 'blue'])} {r.choice(['ring', 'bolt', 'gear'])} at grade {r.randint(1, 20)}"
    return [{"ord": i, "canonical_id": f"id{r.randrange(n)}" if r.random() < shared else f"own{i}", "title": name(), "institution": f"{r.choice(['', 'The '])}Brand {r.randrange(4)}"} for i in range(n)]


@pytest.mark.parametrize("shared,most,without", [(0.0, 8192, "index_pairs"), (0.3, 8192, None), (0.1, 20, None)])
def test_titles_in_order(spark, shared, most, without, monkeypatch):
    """An institution whose rows titles alone tie is compared in order: no pairs are made. Others go by rounds; both give the replay's leaders."""
    if most != 8192:
        monkeypatch.setattr(dedupe, "LOCAL_CLASSES", most)
    if without:
        monkeypatch.setattr(dedupe, without, None)
    rows = parts(250, shared=shared)
    rows[7] |= {"institution": "Brand alone"}
    replay, want = dedupe.Replay(), {}
    for x in copies(rows):
        hit = replay.add(x)
        want[x["ord"]] = None if hit is None else hit["ord"]
    got = dedupe.duplicates(spark.createDataFrame([tuple(x.values()) for x in rows], "ord long, canonical_id string, title string, institution string").repartition(3)).collect()
    assert {r["ord"]: r["leader"] for r in got} == want
    assert all((r["reason"] is None) == (r["leader"] is None) for r in got)
    by = {x["ord"]: x for x in rows}
    for r in got:
        if r["reason"] == "canonical_id":
            assert by[r["ord"]]["canonical_id"] == by[r["leader"]]["canonical_id"]
        elif r["reason"]:
            assert r["score"] == pytest.approx(min(dedupe.ratio(by[r["ord"]][c], by[r["leader"]][c]) for c in ("title", "institution")))


@pytest.mark.parametrize("near", [2000, 9])
def test_small_homes_are_folded(spark, near, monkeypatch):
    """Institutions that no id or URL ties to others are folded at once, without rounds; larger ones go by rounds and give the same."""
    if near == 2000:
        monkeypatch.setattr(dedupe, "leaders", None)
    else:
        monkeypatch.setattr(dedupe, "NEAR_ROWS", near)
    rows = postings(12, 120)
    for i, x in enumerate(rows):
        x |= {"canonical_id": f"own{i}", "application_url": "", "institution": f"Uni {i % 11 if i % 3 else i}"}
        if i % 10 == 0:
            x |= {"institution": None, "application_url": f"https://u.org/{i % 40}"}
    got = [r.asDict() for r in dedupe.consolidate(table(spark, rows)).collect()]
    assert comparable(got) == comparable(dedupe.fold(copies(rows)))
    stored = dedupe.fold(copies(rows[:60]))
    want = dedupe.fold([x | {"_stored": True} for x in copies(stored)] + [x | {"_stored": False} for x in copies(rows[60:])], stored=True)
    got = [r.asDict() for r in dedupe.upsert(table(spark, stored), table(spark, rows[60:]), mark="_seen").collect()]
    assert comparable(got) == comparable(want)
    assert {r["ord"]: r["_seen"] for r in got} == {r["ord"]: bool(r.get("_hit")) or not r["_stored"] for r in want}
