"""Postings from RSS and Atom feeds. XML is parsed in Arrow batches on the executors; fields, dates and places are column expressions.

A feed that cannot be read gives one row with its warning and no entries, so one bad feed never fails the others. Null payloads count as
empty ones and give a warning. A URL counts once over all feeds, the first by feed and place.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, geo, text
from tessera.operators import dedupe
from tessera.sources import fetch, pages

#: Marks of refused requests, tags that break lines, and labels of fields. Fixed values.
BLOCKED = ("incapsula", "request unsuccessful", "pardon our interruption")
BREAKS = frozenset(("br", "div", "li", "p", "tr"))
LABELS = "Institution|Location|Category|Posted|Type|Salary"
ENTRY = "feed_id long, pos int, title string, link string, description string, published string, warning string"


class Prose(HTMLParser):
    """The text of markup, with line breaks at block tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.found.append("\n")

    def handle_endtag(self, tag):
        if tag in BREAKS and tag != "br":
            self.found.append("\n")

    def handle_data(self, data):
        self.found.append(data)


def html_to_text(markup: str | None) -> str:
    """Lines of text without markup, white space squeezed, blank lines left out."""
    p = Prose()
    p.feed(markup or "")
    p.close()
    lines = (" ".join(line.split()) for line in "".join(p.found).splitlines())
    return "\n".join(filter(None, lines))


def read_entries(payload: bytes) -> list[tuple[str, str, str, str]]:
    """title, link, description and date text of a feed's entries, in order; ValueError with the reason where it is none."""
    start = payload[:2000].decode("utf-8", "ignore").lower()
    if any(mark in start for mark in BLOCKED):
        raise ValueError("the host blocked the automated request")
    if payload.lstrip()[:14].lower().startswith((b"<html", b"<!doctype html")):
        raise ValueError("expected RSS/Atom XML but received HTML; the source may have blocked the request")
    try:
        root = ET.fromstring(payload)
    except ET.ParseError as e:
        raise ValueError(f"not well-formed XML: {e}") from e
    name = lambda node: node.tag.rpartition("}")[2]
    out, entries = [], 0
    for node in root.iter():
        if name(node) not in ("item", "entry"):
            continue
        entries += 1
        first: dict[str, str] = {}
        link = ""
        for child in node:
            words = "".join(child.itertext()).strip()
            first.setdefault(name(child), words)
            if name(child) == "link":
                link = link or (child.get("href") or "").strip() or words
        any_of = lambda *names: next((first[n] for n in names if first.get(n)), "")  # noqa: E731, B023
        if first.get("title") and link:
            out.append((html_to_text(first["title"]), link, html_to_text(any_of("description", "summary", "content")), any_of("pubDate", "published", "updated")))
    if not entries:
        raise ValueError("response contained no RSS or Atom entries")
    return out


def entries(feeds: DataFrame) -> DataFrame:
    """feed_id, pos, title, link, description, published and warning of feeds (feed_id, payload binary); warning is null for entries."""

    def run(batches):
        for pdf in batches:
            rows: list[tuple] = []
            for feed, payload in zip(pdf["feed_id"], pdf["payload"], strict=True):
                try:
                    rows += [(feed, i, *entry, None) for i, entry in enumerate(read_entries(bytes(payload or b"")))]
                except ValueError as e:
                    rows.append((feed, -1, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])

    return feeds.select("feed_id", "payload").mapInPandas(run, ENTRY)


def labelled(description: Column, label: str) -> Column:
    """The value after a line's label, up to the next labelled line or the end."""
    return text.clean_text(F.regexp_extract(description, rf"(?ius)(?:^|\n){label}\s*:\s*(.+?)(?=\n(?:{LABELS})\s*:|$)", 1))


def postings(feeds: DataFrame) -> DataFrame:
    """Feeds (feed_id, payload, name, institution, department, location, country, region) as postings with an order."""
    found = entries(feeds).where("warning is null")
    setting = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(""))
    known = feeds.select("feed_id", *(F.col(c) for c in ("name", "institution", "department", "location", "country", "region"))).alias("f")
    some = lambda *cs: F.coalesce(*(F.when(c != "", c) for c in cs), F.lit(""))
    d = F.col("description")
    whole = F.regexp_extract(F.trim(d), r"^(.+)\s+\(([^()]*)\)$", 1), F.regexp_extract(F.trim(d), r"^(.+)\s+\(([^()]*)\)$", 2)
    place = some(labelled(d, "Location"), F.trim(whole[1]), setting("location"))
    out = found.join(known, "feed_id").select(
        (F.col("feed_id") * 100_000 + F.col("pos")).alias("ord"), "title", some(labelled(d, "Institution"), F.trim(whole[0]), setting("institution"), F.lit("Unknown institution")).alias("institution"),
        setting("department").alias("department"), F.lit("").alias("school"), place.alias("location"), some(setting("country"), geo.infer(place)["country"]).alias("country"), some(setting("region"), geo.infer(place)["region"]).alias("region"),
        some(setting("name"), F.lit("RSS")).alias("source_name"), F.col("link").alias("source_url"), F.col("link").alias("application_url"), d.alias("description_text"), dates.rfc_date(F.col("published")).alias("date_posted"),
    )
    out = pages.keep_first(out, "application_url", "ord")
    return out.withColumn("canonical_id", text.canonical_id(F.col("title"), F.col("institution"), F.col("application_url")))


#: Bytes of a feed at most.
FEED_BYTES = 5_000_000


def collect(feeds: DataFrame, agent: str = "tessera", timeout: float = 30, delay: float = 2, opener: fetch.Opener = fetch.read_url) -> tuple[DataFrame, DataFrame]:
    """Feeds (feed_id, url and their settings) as postings, each URL once over all feeds, and warnings (source, warning). Feeds are fetched once and
    written to the shared folder."""
    given = fetch.fetched(feeds, agent, timeout, delay, False, opener, FEED_BYTES, raw_bytes=True).withColumnRenamed("html", "payload")
    given = dedupe.written(given, dedupe.shared_dir(feeds.sparkSession), "feeds")
    here = given.where("warning is null")
    unread = entries(here).where("warning is not null").join(here.select("feed_id", "name"), "feed_id").select(F.col("name").alias("source"), "warning")
    return postings(here), given.where("warning is not null").select(F.col("name").alias("source"), "warning").union(unread)
