"""Postings from the card layouts of two job boards.

A page is read once into runs of text, each with the elements it stands in; a layout says which element is a card and which elements of it
are fields, so that a further board is a further entry of LAYOUTS.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geo, text, urls

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass(eq=False)
class Element:
    tag: str
    classes: frozenset[str]
    href: str
    closed: bool = False


@dataclass
class Layout:
    """Tests of elements: what is a card, what links to its posting, what are its fields."""

    card: Callable[[Element], bool]
    link: Callable[[Element], bool]
    fields: dict[str, Callable[[Element], bool]]
    #: Fields that count only inside the link.
    in_link: frozenset[str] = frozenset()
    #: Whether a card inside a card is one of its own, and an unclosed one counts.
    innermost: bool = False
    name: str = ""


def block(name: str) -> Callable[[Element], bool]:
    return lambda e: e.tag == "div" and name in e.classes


#: Hosts and their layouts: class names and link prefixes are fixed values.
LAYOUTS: dict[str, Layout] = {
    "jobs.ac.uk": Layout(
        block("j-search-result__result"), lambda e: e.tag == "a" and e.href.startswith("/job/"),
        {"title": lambda e: e.tag == "a" and e.href.startswith("/job/"), "institution": block("j-search-result__employer"), "department": block("j-search-result__department")}, name="jobs.ac.uk",
    ),
    "academicpositions.": Layout(
        block("job-list-item"), lambda e: e.tag == "a" and "/ad/" in e.href,
        {"title": lambda e: e.tag == "h4", "description": lambda e: e.tag == "p", "institution": lambda e: e.tag == "a" and "/employer/" in e.href, "location": block("job-locations")},
        frozenset(("title", "description")), innermost=True, name="Academic Positions",
    ),
}


def layout_of(url: str | None) -> Layout | None:
    host = urlparse(url or "").netloc.lower()
    return LAYOUTS["jobs.ac.uk"] if host.endswith("jobs.ac.uk") else LAYOUTS["academicpositions."] if "academicpositions." in host else None


@dataclass
class Card:
    href: str = ""
    words: list[str] = field(default_factory=list)
    fields: dict[str, list[str]] = field(default_factory=dict)


class Runs(HTMLParser):
    """The page's cards under a layout, in page order."""

    def __init__(self, layout: Layout) -> None:
        super().__init__(convert_charrefs=True)
        self.layout, self.open, self.cards = layout, [], {}

    def owner(self) -> int | None:
        """Place of the card on the stack of open elements."""
        places = [i for i, e in enumerate(self.open) if self.layout.card(e)]
        return None if not places else places[-1] if self.layout.innermost else places[0]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        e = Element(tag, frozenset(a.get("class", "").split()), a.get("href", ""))
        if tag not in VOID:
            self.open.append(e)
            at = self.owner()
            if at is not None and self.layout.link(e):
                self.cards.setdefault(self.open[at], Card()).href = e.href

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                for e in self.open[i:]:
                    e.closed = True
                del self.open[i:]
                return

    def handle_data(self, data):
        at = self.owner()
        if at is None:
            return
        card, inner = self.cards.setdefault(self.open[at], Card()), self.open[at + 1 :]
        card.words.append(data)
        linked = any(map(self.layout.link, inner))
        for e in reversed(inner):
            name = next((n for n, is_it in self.layout.fields.items() if is_it(e) and (linked or n not in self.layout.in_link)), None)
            if name:
                card.fields.setdefault(name, []).append(data)
                return

    def found(self) -> list[Card]:
        return [c for e, c in self.cards.items() if e.closed or self.layout.innermost]


def cards(pages: DataFrame) -> DataFrame:
    """page_id, page_url, pos, board, url, words, title, institution, department, location, description of every card of `pages` (page_id, url, html).
    Pages of other hosts, null pages and null URLs have none; repeated pages give their cards again."""
    names = ("title", "institution", "department", "location", "description")

    def run(batches):
        for pdf in batches:
            out = []
            for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                if not (layout := layout_of(url)):
                    continue
                p = Runs(layout)
                p.feed(html or "")
                p.close()
                for n, c in enumerate(p.found()):
                    out.append((pid, url, n, layout.name, urljoin(url, c.href), " ".join(c.words), *(" ".join(c.fields.get(f, [])) for f in names)))
            yield pd.DataFrame(out, columns=["page_id", "page_url", "pos", "board", "url", "words", *names])

    kinds = "page_id long, page_url string, pos long, board string, url string, words string, " + ", ".join(f"{c} string" for c in names)
    out = pages.select("page_id", "url", "html").mapInPandas(run, kinds)
    return out.withColumns({c: text.clean_text(F.col(c)) for c in ("words", *names)})


def postings(pages: DataFrame) -> DataFrame:
    """The cards with a title and a web address as postings with their ids: place, institution and description filled as the board has them."""
    labelled = F.regexp_extract("words", r"(?i)\bLocation:\s*(.+?)(?=\s+Salary:|\s+Date Placed:|\s+Closes\b|$)", 1)
    first = F.col("board") == "jobs.ac.uk"
    unit = F.when(F.col("department") != "", F.concat(F.lit(" Department: "), "department", F.lit("."))).otherwise("")
    described = F.when(first, F.concat(F.lit("Job card extracted from jobs.ac.uk."), unit)).otherwise(F.when(F.col("description") != "", F.col("description")).otherwise("Job card extracted from Academic Positions."))
    found = cards(pages).where((F.col("title") != "") & urls.is_http(F.col("url"))).withColumn("location", F.when(first, text.clean_text(labelled)).otherwise(F.col("location")))
    place = geo.first_of([(F.lower("location").contains(term), geo.place(c, r)) for term, c, r in geo.BOARD_COUNTRIES], geo.place("", ""))
    out = found.select(
        (F.col("page_id") * 100_000 + F.col("pos")).alias("ord"), "title", F.when(F.col("institution") != "", F.col("institution")).otherwise("Institution not provided").alias("institution"), "department", "location",
        place.alias("place"), F.col("url").alias("application_url"), F.col("url").alias("source_url"), F.col("board").alias("source_name"), described.alias("description_text"),
    )
    out = out.withColumns({"country": F.col("place.country"), "region": F.col("place.region"), "school": F.lit("")}).drop("place")
    return out.withColumn("canonical_id", text.canonical_id(F.col("title"), F.col("institution"), F.col("application_url")))
