"""What the driver plans for a join: few tables, and components that go on from those known."""

import random

from tessera.llm import common, jaccard


def test_components_go_on_from_known_ones(spark, monkeypatch):
    r = random.Random(4)
    edges = lambda n: [(r.randrange(300) * 7 - 900, r.randrange(300) * 7 - 900) for _ in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    table = lambda df: {(x.node, x.component) for x in df.collect()}
    one, two = edges(100), edges(80) + [(i * 7 - 900, i * 7 - 893) for i in range(60)]  # a chain takes several rounds
    known = common.components(frame(one), "known")
    assert table(common.components(frame(two), "more", known)) == table(common.components(frame(one + two), "all"))
    written, real = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name, *a, **kw: written.append(name) or real(df, name, *a, **kw))
    assert table(common.components(frame(one[:9]), "again", known)) == table(known) and written == ["again"]
    assert table(common.components(frame([]), "none", known)) == table(known)


def test_join_writes_few_narrow_tables(spark, monkeypatch):
    """Each table is jobs, broadcasts and plans on the driver; a plan of a column for each word of a sketch is large."""
    r = random.Random(12)
    base = [str(r.random()) for _ in range(120)]
    texts = [" ".join(w if r.random() > 0.01 * (i % 3) else "x" for w in base) for i in range(80)]
    written, real = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name, *a, **kw: written.append((name, len(df.columns))) or real(df, name, *a, **kw))
    assert jaccard.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() >= 1
    assert len(written) <= 30 and max(n for _, n in written) <= 10, written
