"""Scoring, dates, places, merging and page parsing on small cases."""

import random

from pyspark.sql import functions as F

from tessera.functions import dates, geo, text, urls
from tessera.operators import dedupe, digest, scoring
from tessera.sources import pages


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_text(spark):
    assert one(spark, text.normalize(F.lit(' "Example  University! "')), text.normalize(F.lit(None).cast("string")))[:2] == ("example university", "")
    a, b = one(spark, text.canonical_id(F.lit("A"), F.lit("B"), F.lit("https://www.x.org/1")), text.canonical_id(F.lit("C"), F.lit("D"), F.lit("http://x.org/1/")))
    assert a == b and len(a) == 24
    assert one(spark, text.title_matches(F.lit("Assistant Professor of Fluid Dynamics"), F.lit("Professor in fluid")))[0]


def test_roles(spark):
    role = lambda t, r="": one(spark, scoring.role_type(F.lit(t), F.lit(""), F.lit(r)))[0]
    assert [role("Lecturer", "uk"), role("Postdoctoral researcher"), role("Open rank faculty"), role("Lecturer", "us"), role("Visiting Assistant Professor")] == ["lecturer_ap_equivalent", "regular_postdoc", "open_rank", "teaching_only", "teaching_only"]


def test_dates_and_places(spark):
    assert one(spark, dates.iso_date(F.lit("2026-08-01T10:00:00Z")), dates.rfc_date(F.lit("Thu, 18 Jun 2026 10:00:00 GMT")), dates.expired(F.lit("bad"), "2026-01-01")) == ("2026-08-01", "2026-06-18", False)
    assert tuple(one(spark, geo.infer(F.lit("Austin, TX")))[0]) == ("United States", "us")
    assert urls.title_from_url("https://x.org/jobs/assistant-professor-electric-mobility-12345.html") == "Assistant Professor Electric Mobility"


def posting(ord_, title, place="University of X", url="", **more):
    row = {"ord": ord_, "canonical_id": f"id{ord_}", "title": title, "institution": place, "application_url": url, "description_text": "", "fit_score": 0, "fit_category": "D", "role_type": "other", "is_priority_institution": False, "is_new_this_run": True}
    return row | {c: "" for c in dedupe.FILLED} | {c: [] for c in dedupe.LISTS} | more


def test_consolidate(spark):
    rows = [posting(1, "Professor in Computational Science", country="UK"), posting(2, "Professor, Computational Science", deadline="2026-01-01", warnings=["w"]), posting(3, "Dean", "Other"), posting(4, "Dean of all", "", url="u"), posting(5, "Dean of all things", "", url="u", description_text="long")]
    schema = "ord long, canonical_id string, title string, institution string, application_url string, description_text string, fit_score int, fit_category string, role_type string, is_priority_institution boolean, is_new_this_run boolean, " + ", ".join(f"{c} string" for c in dedupe.FILLED) + ", " + ", ".join(f"{c} array<string>" for c in dedupe.LISTS if c not in dedupe.FILLED)
    names = [x.split()[0] for x in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    for parts in (1, 3):
        got = {r["ord"]: r for r in dedupe.consolidate(df.repartition(parts)).collect()}
        assert sorted(got) == [1, 3, 4]
        assert (got[1]["deadline"], got[1]["country"], got[1]["warnings"], got[4]["description_text"]) == ("2026-01-01", "UK", ["w"], "long")
    again = {r["ord"]: r for r in dedupe.upsert(df.where("ord in (1, 3)"), df.where("ord in (2, 4)")).collect()}
    assert sorted(again) == [1, 3, 4] and not again[1]["is_new_this_run"] and again[4]["is_new_this_run"]


def test_pages(spark):
    html = '<a href="/jobs/1">Assistant Professor</a><a href="/about">About us</a><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Chair", "url": "/c"}]}</script><script type="application/ld+json">{bad</script>'
    found = pages.links(spark.createDataFrame([(1, "https://x.org/", html), (2, None, None)], "page_id long, url string, html string"))
    assert [(r["kind"], r["url"], r["text"]) for r in found.orderBy("pos").collect()] == [("ld", "https://x.org/c", "Chair"), ("a", "https://x.org/jobs/1", "Assistant Professor"), ("a", "https://x.org/about", "About us")]
    assert [r["title"] for r in pages.candidates(found.where("kind = 'a'")).collect()] == ["Assistant Professor"]


def test_eligible(spark):
    case = lambda c, low, pri, sent: one(spark, digest.eligible(F.lit(c), F.lit(low), F.lit(pri), F.lit(sent)))[0]
    assert [case("A", False, False, False), case("A", False, False, True), case("C", False, True, False), case("C", True, False, False), case("D", False, True, False)] == [True, False, True, True, False]


def test_many_keywords(spark):
    """Many terms by one reading give what a search for each gives: overlaps, terms within terms, spellings alike, odd spellings."""
    r = random.Random(3)
    texts = ["".join(r.choice("ab c") for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, ""]
    terms = sorted({"".join(r.choice("ab c") for _ in range(r.randint(1, 5))) for _ in range(150)}) + ["A-B", "a  b", "", "--", "a/b/c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.normalize(F.col("t")).alias("t"))
    many = df.select("t", scoring.keyword_hits(F.col("t"), terms).alias("got")).collect()
    assert all(x["got"] == [t for t in terms if scoring.plain_key(t) and scoring.plain_key(t) in x["t"]] for x in many)
    few = df.select("t", scoring.keyword_hits(F.col("t"), terms[:40]).alias("got")).collect()
    assert all(x["got"] == [t for t in terms[:40] if scoring.plain_key(t) and scoring.plain_key(t) in x["t"]] for x in few)


def test_targets(spark):
    """The containment join against the rule on every pair; no nested loop."""
    r = random.Random(6)
    words = ["assistant", "professor", "of", "law", "art", "soil", "in", "x1"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n)).title()
    places, links = ["Hill", "Hill University", "The Dale", "", None], ["", None, "https://a.org/j/1", "http://A.org/j/12/", "https://b.org", "nonsense"]
    posts = [(i, say(r.randint(0, 5)), r.choice(places), r.choice(links), r.choice(links)) for i in range(60)]
    wants = [(f"t{i}", say(r.randint(0, 4)), r.choice(places), r.choice(["", "", "https://a.org/j/1", "https://a.org", "https://org"])) for i in range(80)]
    p = spark.createDataFrame(posts, "ord long, title string, institution string, application_url string, source_url string")
    t = spark.createDataFrame(wants, "name string, title string, institution string, url string")
    each = t.select(*(F.col(c).alias(f"t_{c}") for c in t.columns)).crossJoin(p)
    target = urls.canonical_url(F.col("t_url"))
    rule = (target != "") & (urls.canonical_url(F.col("application_url")).contains(target) | urls.canonical_url(F.col("source_url")).contains(target))
    rule |= text.title_matches(F.col("title"), F.col("t_title")) & text.soft_contains(F.col("institution"), F.col("t_institution"))
    want = {x["t_name"]: x["o"] for x in each.where(rule).groupBy("t_name").agg(F.min("ord").alias("o")).collect()}
    out = digest.match_targets(p, t, "ord")
    got = {x["name"]: x["matched_ord"] for x in out.collect()}
    assert 10 < len(want) < 80 and got == {w[0]: want.get(w[0]) for w in wants}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
