"""Boards, stored postings, delivery and a whole run, on small inputs."""

import json
import time
import uuid
from datetime import datetime, timezone

import pytest

from tessera import run as whole_run
from tessera import settings
from tessera.operators import delivery, outputs, store
from tessera.sources import boards, feeds, fetch

LD = '<script type="application/ld+json">{"@type": "JobPosting", "title": "Assistant Professor of Law", "url": "/p/1", "hiringOrganization": "Hill University", "validThrough": "2026-08-01T00:00", "jobLocation": {"address": "Perth, Australia"}}</script>'
SITE = {
    "https://a.org/jobs": f'{LD}<a href="/p/1">Assistant Professor of Law</a><a href="/jobs/70001-lecturer-in-art">Apply</a><a href="/about">About us</a>',
    "https://a.org/jobs/70001-lecturer-in-art": '<script type="application/ld+json">{"@type": "JobPosting", "title": "Lecturer in Art", "url": "https://a.org/x", "hiringOrganization": {"name": "Dale College"}, "description": "The Department of Fine Art seeks a lecturer."}</script>',
    "https://b.org/": "Access denied",
    "https://f.org/rss": "<rss><item><title>Fellow</title><link>https://f.org/1</link><description>Institution: East College</description></item></rss>",
}


def opener_of(site):
    def opener(url, agent, timeout, most):
        if url.endswith("/robots.txt"):
            return b"User-agent: *\nDisallow: /closed"
        if url not in site:
            raise OSError("no route")
        return site[url].encode()

    return opener


def test_boards(spark, tmp_path):
    rows = [(0, "https://a.org/jobs", "A", "", "", "", []), (1, "https://b.org/", "B", "", "", "", []), (2, "https://a.org/closed", "C", "", "", "", []), (3, "https://c.org/", "D", "", "", "", [])]
    df = spark.createDataFrame(rows, "page_id long, url string, name string, institution string, country string, region string, tags array<string>")
    found, warnings = boards.collect(df, delay=0, opener=opener_of(SITE), scratch=str(tmp_path))
    got = {r["title"]: r for r in found.collect()}
    law, art = got["Assistant Professor of Law"], got["Lecturer In Art"]
    assert len(got) == 2 and (law.institution, law.location, law.region, law.deadline, law.application_url) == ("Hill University", "Perth, Australia", "australia", "2026-08-01", "https://a.org/p/1")
    assert (art.institution, art.department, art.description_text) == ("Dale College", "Department of Fine Art", "The Department of Fine Art seeks a lecturer.")
    assert {r["source"]: r["warning"] for r in warnings.collect()}.keys() == {"B", "C", "D"}
    assert boards.postings(df.limit(0).selectExpr("page_id", "url", "cast(null as string) as html")).count() == 0


def test_host_layouts(spark):
    page = '<div class="job-list-item"><a href="/ad/1" class="job-link"><h4>Professor of Soil</h4></a></div><a href="/jobs/9/professor">Professor of Air</a>'
    df = spark.createDataFrame([(1, "https://academicpositions.eu/list", page), (2, "https://other.org/list", page), (3, "https://other.org/null", None)], "page_id long, url string, html string")
    assert [(r.page_id, r.title) for r in boards.postings(df).where("title like '%Air'").collect()] == [(2, "Professor of Air")]


def test_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    row = lambda i, title, url: (i, title, "Hill University", "S", url, url)
    names = "ord long, title string, institution string, source_name string, source_url string, application_url string"
    first = store.save(spark.createDataFrame([row(0, "Chair of Law", "https://a.org/1")], names), folder, "2026-01-01", "2026-01-01T00:00:00+00:00")
    assert [(r.date_first_seen, r.is_new_this_run, r.status) for r in first.collect()] == [("2026-01-01", True, "active")]
    again = store.save(spark.createDataFrame([row(0, "Chair of Law", "https://a.org/1"), row(1, "Reader in Art and Design", "https://a.org/2")], names), folder, "2026-02-02", "2026-02-02T00:00:00+00:00")
    got = {r.title: r for r in again.collect()}
    law, art = got["Chair of Law"], got["Reader in Art and Design"]
    assert (law.date_first_seen, law.date_last_seen, law.is_new_this_run, law.created_at[:10]) == ("2026-01-01", "2026-02-02", False, "2026-01-01")
    assert (art.date_first_seen, art.is_new_this_run, art.ord > law.ord) == ("2026-02-02", True, True)
    flat = store.read_flat(outputs.flat(again))
    assert flat.schema.names == list(outputs.COLUMNS) and sorted(r.title for r in flat.collect()) == sorted(got)


NAMES = "ord long, title string, institution string, source_name string, source_url string, application_url string"


def rows_of(spark, *found):
    return spark.createDataFrame([(i, t, place, "S", url, url) for i, (t, place, url) in enumerate(found)], NAMES)


def test_store_writers(spark, tmp_path, monkeypatch):
    """Two writers of one version: the later fails and tries again; files of a run that died stand in nobody's way; old versions go."""
    folder, day = str(tmp_path / "s"), ("2026-01-01", "2026-01-01T00:00:00+00:00")
    store.merge_in(rows_of(spark, ("Chair of Law", "Hill University", "https://a.org/1")), folder, *day)
    real, tries = store.publish, []

    def late(spark_, folder_, made):
        tries.append(made["version"])
        if len(tries) == 1:  # another writer is faster
            monkeypatch.setattr(store, "publish", real)
            store.merge_in(rows_of(spark, ("Reader in Art", "Dale College", "https://a.org/2")), folder, *day)
        real(spark_, folder_, made)

    monkeypatch.setattr(store, "publish", late)
    with pytest.raises(store.Conflict):
        store.merge_in(rows_of(spark, ("Lecturer in Botany", "Dale College", "https://a.org/3")), folder, *day)
    assert sorted(r.title for r in store.read(spark, folder).collect()) == ["Chair of Law", "Reader in Art"]
    (tmp_path / "s" / "data" / "left-by-a-dead-run").mkdir()
    (tmp_path / "s" / "manifests" / "000000002.json.tmp").write_text("")
    tries.clear()
    monkeypatch.setattr(store, "publish", late)
    store.save(rows_of(spark, ("Lecturer in Botany", "Dale College", "https://a.org/3")), folder, *day)
    assert tries == [2] and store.read(spark, folder).count() == 3
    for i in range(4):
        made = store.merge_in(rows_of(spark, (f"Fellow {i}", "East College", f"https://a.org/f{i}")), folder, *day)
    names = [p.name for p in (tmp_path / "s" / "manifests").iterdir() if p.name.endswith(".json")]
    assert len(names) == store.KEEP and store.read(spark, folder).count() == made["rows_read"] + 1 + 3


def test_store_reads_what_it_reaches(spark, tmp_path):
    """Only buckets of institutions that new rows name are read whole and written; the result is a replay's."""
    folder, day = str(tmp_path / "s"), ("2026-01-01", "2026-01-01T00:00:00+00:00")
    first = [(f"Professor of Subject {i:03d}", f"College Number {i}", f"https://a.org/{i}") for i in range(60)]
    store.merge_in(rows_of(spark, *first), folder, *day)
    made = store.merge_in(rows_of(spark, ("Professor of Subject 007", "College Number 7", "https://b.org/x"), ("Another Post in Chemistry", "College Number 9", "")), folder, "2026-02-02", "2026-02-02T00:00:00+00:00")
    assert made["rows_read"] < 20 and made["rows_written"] < 20
    got = {r.title: r for r in store.read(spark, folder).collect()}
    assert len(got) == 61 and got["Professor of Subject 007"].date_last_seen == "2026-02-02" and got["Professor of Subject 008"].date_last_seen == "2026-01-01"


def test_feed_encodings(spark):
    """Feeds in the encoding that they declare."""
    page = '<?xml version="1.0" encoding="{}"?><rss><item><title>Professeur à Genève</title><link>https://f.org/{}</link></item></rss>'
    site = {f"https://f.org/{e}": page.format(e, e).encode(e) for e in ("ISO-8859-1", "UTF-16", "UTF-8")}
    df = spark.createDataFrame([(i, u, "F", "", "", "", "", "", []) for i, u in enumerate(site)], "feed_id long, url string, name string, institution string, department string, location string, country string, region string, tags array<string>")
    found, warnings = feeds.collect(df, delay=0, opener=lambda url, agent, timeout, most: site[url])
    assert [r.title for r in found.collect()] == ["Professeur à Genève"] * 3 and warnings.count() == 0


def test_cap_of_links(spark):
    """Links that a JSON-LD posting has given already do not count."""
    ld = "".join(f'<script type="application/ld+json">{{"@type": "JobPosting", "title": "Chair {i}", "url": "/p/{i}"}}</script>' for i in range(3))
    page = ld + "".join(f'<a href="/p/{i}">Professor of Matter {i}</a>' for i in range(6))
    df = spark.createDataFrame([(0, "https://a.org/jobs", page)], "page_id long, url string, html string")
    assert sorted(r.application_url[-1] for r in boards.postings(df, most=3).collect()) == list("012345")
    assert sorted(r.application_url[-1] for r in boards.postings(df, most=2).collect()) == list("01234")


def test_details_of_boards_with_one_name(spark):
    rows = [(b * 100_000 + i, b, "Same name", f"https://a.org/{b}/{i}", boards.CANDIDATE) for b in range(2) for i in range(4)]
    df = spark.createDataFrame(rows, "ord long, page_id long, source_name string, application_url string, description_text string")
    assert boards.wanted_details(df, most=3).count() == 6


class Post:
    def __init__(self, host, port, timeout):
        self.did = Post.did = [("open", host, port)]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def starttls(self):
        self.did.append("tls")

    def login(self, user, password):
        self.did.append(("login", user))

    def send_message(self, message):
        self.did.append(message["Subject"])


def test_delivery(monkeypatch):
    with pytest.raises(delivery.MissingSettings, match=f"{delivery.PASSWORD}, {delivery.RECIPIENT}"):
        delivery.credentials({delivery.SENDER: "a@b"})
    who = delivery.credentials({delivery.SENDER: " a@b ", delivery.PASSWORD: "pw x", delivery.RECIPIENT: "c@d"})
    assert "pw x" not in repr(who) and who.sender == "a@b"
    assert delivery.mail(who, "S", "B", "h", 1, connect=Post) == "Sent email to c@d." and Post.did == [("open", "h", 1), "tls", ("login", "a@b"), "S"]
    Post.did = None
    assert "not sent" in delivery.mail(who, "S", "B", dry_run=True, connect=Post) and Post.did is None
    with pytest.raises(RuntimeError):
        delivery.Gateway("https://m.org", "m", "NO_SUCH_KEY")
    monkeypatch.setenv("SOME_KEY", "k")
    tries = []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self):
            return json.dumps({"output": {"x": 1}, "usage": {"input_tokens": 3, "output_tokens": 2, "total_tokens": 5}}).encode()

    def flaky(request, timeout):
        tries.append(request)
        if len(tries) < 2:
            raise TimeoutError
        return Answer()

    client = delivery.Gateway("https://m.org", "m", "SOME_KEY", opener=flaky, sleep=lambda s: None)
    assert client("q") == {"x": 1} and len(tries) == 2 and client.usage["total_tokens"] == 5


@pytest.fixture
def folder(tmp_path):
    files = {
        "settings": "newsletter: {max_jobs_per_section: 5}\nregions: {include: {us: true, uk: true, canada: false}}\noutputs: {csv: {path: out/csv}, markdown_summary: {path: out/run.md}, store: {path: out/store}, notion: {enabled: true}}\nemail: {enabled: true}\nscraping: {delay_between_requests_seconds: 0}",
        "profile": "", "keywords": "high_value: [optimization, machine learning, simulation]\nmedium_value: [teaching]\nnegative: []", "institutions": "other:\n  - Unwatched College\npriority_universities:\n  - name: Northfield University\n    aliases: [NU]",
        "sources": "sources:\n  job_boards: {enabled: true, sources: [{name: A, url: 'https://a.org/jobs'}, {name: Off, enabled: false, url: x}]}\n  official_pages: {enabled: true, pages: []}\n  rss: {enabled: true, feeds: [{name: F, url: 'https://f.org/rss'}, {name: G, url: 'https://g.org/rss'}]}\n  target_positions: {positions: [{name: T, title: Applied Mathematics, institution: Northfield University, url: ''}]}",
    }
    (tmp_path / "config").mkdir()
    for name, body in files.items():
        (tmp_path / "config" / f"{name}.yaml").write_text(body)
    (tmp_path / "config" / settings.TEMPLATE).write_text("# Digest")
    return tmp_path / "config"


def test_run(spark, folder):
    c = settings.load(folder)
    assert c.priority_names() == ["Northfield University", "NU"] and c.get("no.such", 3) == 3 and c.profile == {}
    clock = datetime(2026, 6, 1, tzinfo=timezone.utc)
    got = whole_run.run(spark, c, dry_run=True, clock=clock, environment={})
    rows = {r["title"]: r for r in got.postings.collect()}
    assert len(rows) == 3 and "Email not sent" in got.mail and got.notes == 0
    math = next(r for t, r in rows.items() if "Mathematics" in t)
    assert math["is_priority_institution"] and math["fit_category"] in "AB" and "focus on Applied Mathematics" in math["application_angle"]
    said = (folder.parent / "out" / "run.md").read_text()
    assert "- FOUND: T" in said and "Saved jobs in local outputs: 3" in said and (folder.parent / "out" / "csv").read_text().startswith("canonical_id,title,")
    again = whole_run.run(spark, c, live=True, no_mail=True, clock=clock, opener=opener_of(SITE), environment={"NOTION_DATABASE_ID": "db"})
    titles = {r["title"]: r for r in again.postings.collect()}
    assert len(titles) == 6 and {"Fellow", "Assistant Professor of Law", "Lecturer In Art"} < set(titles) and again.notes == 6 and titles["Fellow"]["notion_page_id"].startswith("mock-notion-")
    assert any("G" in w for w in again.warnings)
    with pytest.raises(SystemExit):
        whole_run.main(["--once", "--dry-run"])


def test_digest_settings(spark, folder):
    """Categories, windows, subject and template come from the configuration; a digest that cannot be made is a warning."""
    text = (folder / "settings.yaml").read_text().replace("newsletter: {max_jobs_per_section: 5}", "newsletter: {max_jobs_per_section: 5, include_categories_main: [A, B, C], include_category_d: true, subject_template: 'New: {num_new}'}\ndeadline_reminders: {reminder_window_days: 400}")
    (folder / "settings.yaml").write_text(text)
    (folder / settings.TEMPLATE).write_text("S: {summary}\nSoon: {deadlines_14}\nUrgent: {deadlines_7}")
    c = settings.load(folder)
    how = outputs.Layout.of(c.get, c.template)
    assert (how.main, how.with_d, how.soon, how.urgent, how.n) == (("A", "B", "C"), True, 400, 0, 5)
    clock = datetime(2026, 6, 1, tzinfo=timezone.utc)
    got = whole_run.run(spark, c, dry_run=True, clock=clock, environment={})
    assert got.subject == "New: 3" and got.body.startswith("S: 3 new") and "Urgent: None this week." in got.body
    (folder / settings.TEMPLATE).write_text("{no_such_part}")
    (folder / "settings.yaml").write_text(text + "\nopenai: {enabled: true}")
    got = whole_run.run(spark, settings.load(folder), clock=clock, environment={}, no_mail=True)
    assert got.body == "" and any("no digest" in w for w in got.warnings) and any("model scoring unavailable" in w for w in got.warnings) and got.postings.count() == 3


def test_hosts_are_fetched_at_once(spark, tmp_path):
    """Pages of one host one after the other, hosts side by side."""

    def opener(url, agent, timeout, most):
        began = time.time()
        time.sleep(1.0)
        (tmp_path / uuid.uuid4().hex).write_text(json.dumps([url.split("/")[2], began, time.time()]))
        return b"x"

    df = spark.createDataFrame([(f"https://h{h}.org/{i}",) for h in range(3) for i in range(2)], "url string")
    out = fetch.fetched(df, delay=0, robots=False, opener=opener)
    assert out.rdd.getNumPartitions() == 3 and out.where("html = 'x'").count() == 6
    spans = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    meet = lambda a, b: a[1] < b[2] and b[1] < a[2]
    pairs = [(a, b) for i, a in enumerate(spans) for b in spans[:i]]
    assert not any(meet(a, b) for a, b in pairs if a[0] == b[0]) and any(meet(a, b) for a, b in pairs if a[0] != b[0])


def test_sources_side_by_side(spark, folder):
    """A source that hangs is a warning; the others' postings stay in order."""
    (folder / "settings.yaml").write_text((folder / "settings.yaml").read_text().replace("scraping: {", "scraping: {source_time_limit_seconds: 25, "))

    plain = opener_of(SITE)

    def opener(url, agent, timeout, most):
        if "a.org" in url:
            time.sleep(60)
        return plain(url, agent, timeout, most)

    found, warnings = whole_run.collect(spark, settings.load(folder), True, opener)
    assert [r.title for r in found.orderBy("ord").collect()] == ["Fellow"]
    assert any("job boards failed: no end after 25 seconds" in w for w in warnings)
