"""Card layouts, page fetching and the run summary, on small tables."""

import io
from urllib.error import HTTPError, URLError

from pyspark.sql import functions as F
from test_outputs import postings

from tessera.operators import outputs
from tessera.sources import cards, fetch

FIRST = """<div class="j-search-result__result x"><a href="/job/1"> Lecturer in <b>Law</b></a><div class="j-search-result__department">Law</div><br/>
<div class="j-search-result__employer">North &amp; Co</div><div>Location: Leeds, England Salary: 1</div></div>
<div class="j-search-result__result"><a href="/other/2">No title</a></div><div class="j-search-result__result"><a href="/job/3">Unclosed</a>"""
SECOND = """<div class="job-list-item"><a href="/ad/1"><h4>Fellow</h4><p>Two  years</p></a><a href="/employer/e">East</a><div class="job-locations">Toronto, Canada</div>
<div class="job-list-item"><a href="/ad/2"><h4>Chair</h4></a><p>outside</p>"""


def test_cards(spark):
    rows = [(1, "https://www.jobs.ac.uk/search", FIRST), (2, "https://academicpositions.com/jobs", SECOND), (3, "https://x.org/", FIRST), (4, None, SECOND), (5, "https://www.jobs.ac.uk/search", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.title, r.institution, r.department, r.location, r.country, r.region, r.application_url, r.description_text) for r in cards.postings(df).orderBy("ord").collect()]
    assert got == [
        ("Lecturer in Law", "North & Co", "Law", "Leeds, England", "United Kingdom", "uk", "https://www.jobs.ac.uk/job/1", "Job card extracted from jobs.ac.uk. Department: Law."),
        ("Fellow", "East", "", "Toronto, Canada", "Canada", "canada", "https://academicpositions.com/ad/1", "Two years"),
        ("Chair", "Institution not provided", "", "", "", "", "https://academicpositions.com/ad/2", "Job card extracted from Academic Positions."),
    ]
    assert cards.postings(df.limit(0)).count() == 0


def network():
    """Stands for the network; local, so that it is sent to the workers whole."""

    def opener(url, agent, timeout, most):
        if url.endswith("/robots.txt"):
            if "closed" in url:
                raise HTTPError(url, 403, "no", None, io.BytesIO())
            if "none" in url:
                raise HTTPError(url, 404, "no", None, io.BytesIO())
            return b"User-agent: *\nDisallow: /private"
        if "broken" in url:
            raise URLError("gone")
        return b"x" * 20 if "large" in url else "päge".encode()

    return opener


def test_fetch(spark):
    asked = ["https://a.org/1", "https://a.org/private/1", "https://closed.org/1", "https://none.org/1", "https://none.org/broken", "https://a.org/large", "ftp://a.org/1", None]
    df = spark.createDataFrame([(u, i) for i, u in enumerate(asked)], "url string, n int")
    got = {r.n: (r.html, r.warning) for r in fetch.fetched(df, delay=0, opener=network(), most=10).collect()}
    assert got[0] == got[3] == ("päge", None)
    assert got[1] == got[2] == (None, "forbidden by robots.txt") and "gone" in got[4][1] and got[5][1] == "larger than 10 bytes" and got[6] == got[7] == (None, "not a web address")
    assert fetch.fetched(df.limit(0), opener=network()).count() == 0


def test_run_summary(spark):
    jobs = postings(spark)
    targets = spark.createDataFrame([("one", "T2", "I & J", ""), ("two", "Nothing", "Nowhere", "https://z.org/")], "name string, title string, institution string, url string")
    out = outputs.run_summary(jobs, jobs.where(F.col("ord") < 3), targets, ["w1"], "2026-06-01", "2026-06-01T00:00:00+00:00")
    assert "- Current run jobs: 6\n- Saved jobs in local outputs: 2\n- Email-eligible jobs: 5\n- Source warnings: 1\n" in out
    assert "- FOUND: one\n  Target: T2 - I & J\n  URL: \n  Matched: T2 - I & J\n" in out and "- MISSING: two\n" in out and "## Source Warnings\n\n- w1\n" in out
    empty = outputs.run_summary(jobs.limit(0), jobs, targets.limit(0), [], "2026-06-01", "now")
    assert empty.count("None.") == 2 and "No target positions configured." in empty
