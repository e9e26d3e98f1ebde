"""Extraction from prose, feeds, and outputs, on small tables."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import extract
from tessera.operators import outputs
from tessera.sources import feeds

RSS = b"""<rss><channel><item><title>Lecturer &amp; Fellow</title><link>https://a.org/1</link><description>North University (Austin, TX)</description><pubDate>Thu, 18 Jun 2026 09:00:00 GMT</pubDate></item>
<item><title>No link</title></item>
<item><title>Fellow</title><link>https://a.org/2</link><description>&lt;p&gt;Institution: East College&lt;/p&gt;&lt;p&gt;Location: Hong Kong&lt;/p&gt;&lt;p&gt;Type: full&lt;/p&gt;</description></item></channel></rss>"""
ATOM = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Again</title><link href="https://a.org/1"/><updated>2026-07-01T23:30:00-09:00</updated></entry><entry><title>New</title><link href="https://a.org/3"/><updated>2026-07-01T23:30:00-09:00</updated></entry></feed>'


def test_extract(spark):
    cases = [
        ("The School of Engineering at University of Southern California invites all", "School of Engineering", "University of Southern California invites"),
        ("Organisation: Department of Energy Apply no later than: May", "Department of Energy", ""),
        ("Department: Physics; Employer: West  Institute Location: here", "Department of Physics", "West Institute"),
        ("a post at The Ohio Valley University", "", "The Ohio Valley University"),
        ("", "", ""),
        (None, "", ""),
    ]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", extract.unit(F.col("t")), extract.institution(F.col("t"))).orderBy("i").collect()
    want = [(i, c[1], c[2]) for i, c in enumerate(cases)]
    # A name runs over the capitalised words after it; "invites" is not one.
    want[0] = (0, "School of Engineering", "University of Southern California")
    assert [tuple(r) for r in got] == want


def test_enrich(spark):
    rows = [("Chair", "Department of Art seeks one", "", "", "Not listed"), ("Chair", "College of Law; Employer: South", None, "", "Known"), ("Chair", "Department of Art seeks one", "Own", "", "")]
    got = extract.enrich(spark.createDataFrame(rows, "title string, description_text string, department string, school string, institution string")).collect()
    assert [(r.department, r.school, r.institution) for r in got] == [("Department of Art", "", "Not listed"), (None, "College of Law", "Known"), ("Own", "", "")]


def test_feeds(spark):
    schema = "feed_id long, payload binary, name string, institution string, department string, location string, country string, region string"
    plain = (None, None, None, None, None, None)
    bad = [b"<html>", b"<rss/>", b"<rss", b"Request unsuccessful. Incapsula", None]
    df = spark.createDataFrame([(1, RSS, "R", *plain[1:]), (2, ATOM, *plain)] + [(3 + i, b, *plain) for i, b in enumerate(bad)], schema)
    got = [(r.title, r.institution, r.location, r.region, r.date_posted, r.source_name) for r in feeds.postings(df).orderBy("ord").collect()]
    assert got == [
        ("Lecturer & Fellow", "North University", "Austin, TX", "us", "2026-06-18", "R"), ("Fellow", "East College", "Hong Kong", "hong_kong", None, "R"),
        ("New", "Unknown institution", "", "", "2026-07-01", "RSS"),
    ]
    assert feeds.entries(df).where("warning is not null").count() == len(bad)
    assert feeds.postings(df.limit(0)).count() == 0


def postings(spark):
    fields = "ord long, title string, institution string, department string, school string, location string, country string, region string, role_type string, source_name string, source_url string, application_url string, description_text string, deadline string, fit_category string, fit_score int, match_reasons array<string>, warnings array<string>, required_materials array<string>, is_priority_institution boolean, date_first_seen string, date_last_seen string, status string, summary string, application_angle string, canonical_id string"
    def one(i, fit, score, deadline=None, text='a "quoted"\nline', warnings=(), priority=False):  # noqa: E306
        return (i, f"T{i}", "I & J", "", None, None, None, "us", "faculty_fellowship" if i == 1 else "other", "S", "https://s.org", "https://a.org/?x=1&y=2", text, deadline, fit, score, ["r1", "r2", "r3", "r4"], list(warnings), ["cv"], priority, "2026-01-01", "2026-01-02", "active", None, None, f"c{i}")

    return spark.createDataFrame([one(1, "A", 80, "2026-06-05"), one(2, "A", 90, "2026-06-20"), one(3, "C", 40, text="Part-time"), one(4, "C", 41, priority=True), one(5, "D", 1), one(6, "B", 60, warnings=["w"])], fields)


def test_digest(spark, monkeypatch):
    jobs = postings(spark)
    got = {(r.section, r.ord, r["rank"]) for r in outputs.sections(jobs, "2026-06-01", outputs.Layout(n=1)).collect()}
    assert got == {("strong_fit", 2, 1), ("good_fit", 6, 1), ("possible_priority", 4, 1), ("lower_priority", 3, 1), ("fellowships", 1, 1), ("deadlines_14", 1, 0), ("deadlines_7", 1, 0), ("warnings", 6, 0)}
    subject, body = outputs.render(jobs, "2026-06-01")
    assert subject.startswith("5 new") and body.index("- T2 - I & J") < body.index("- T1 - I & J") and "Match: r1; r2; r3\n" in body and "T5" not in body
    html = outputs.as_html(body)
    assert "I &amp; J" in html and '<a href="https://a.org/?x=1&amp;y=2">Open job posting</a>' in html and html.count("<section>") == html.count("</section>")
    mail, sent = outputs.message("a@x", "b@x", subject, body), []
    assert not outputs.send(mail, None) and [p.get_content_type() for p in mail.iter_parts()] == ["text/plain", "text/html"]
    fake = type("Fake", (), {"send_message": lambda self, m: sent.append(m)})()
    assert outputs.send(mail, fake) and sent == [mail]
    monkeypatch.setattr(outputs, "MOST", 3)
    with pytest.raises(ValueError):
        outputs.render(jobs, "2026-06-01")
    assert "None this week." in outputs.render(jobs.limit(0), "2026-06-01")[1]


def test_csv_and_notes(spark, tmp_path):
    jobs = postings(spark)
    outputs.write_csv(jobs.coalesce(1), str(tmp_path / "out"))
    with open(glob.glob(f"{tmp_path}/out/part-*.csv")[0], newline="", encoding="utf-8") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == outputs.COLUMNS and rows[0]["description_text"] == 'a "quoted"\nline' and rows[0]["match_reasons"] == "r1\nr2\nr3\nr4"
    assert (rows[3]["is_priority_institution"], rows[0]["is_priority_institution"], rows[0]["notion_page_id"]) == ("1", "0", "")
    notes = [json.loads(r[0]) for r in jobs.orderBy("ord").select(outputs.note_payload("db")).collect()]
    p = notes[0]["properties"]
    assert notes[0]["parent"] == {"database_id": "db"} and p["Deadline"] == {"date": {"start": "2026-06-05"}} and "Deadline" not in notes[2]["properties"]
    assert p["Country"] == {"select": {"name": "Unknown"}} and p["Required Materials"] == {"multi_select": [{"name": "cv"}]} and p["Fit Score"] == {"number": 80} and len(p) == 18
