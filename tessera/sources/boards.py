"""Job boards: pages to postings by JSON-LD, card layouts and candidate links; detail pages for postings that only a link is known of.

Pages (page_id, url, html) may have columns name, institution, country, region and tags, the settings of their board. Of a page come its cards,
where its host has a layout, then its JSON-LD postings, then its candidate links, each URL once a page; a host of the second layout gives no links.
A blocked page, a null page and a page without any of these give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dates, extract, geo, text, urls
from tessera.operators import dedupe
from tessera.sources import cards, fetch
from tessera.sources import pages as page_source

SETTINGS = {"name": "string", "institution": "string", "country": "string", "region": "string", "tags": "array<string>"}
#: Begins the description of a posting that only a link is known of. Fixed value.
CANDIDATE = "Candidate link extracted from"
#: Candidate links of a page, and detail pages of a board, at most.
MOST_LINKS, MOST_DETAILS = 150, 25
COLUMNS = ("title", "institution", "department", "school", "location", "country", "region", "source_name", "source_url", "application_url", "description_text", "deadline", "date_posted")


def with_settings(pages: DataFrame) -> DataFrame:
    return pages.withColumns({c: F.lit(None).cast(kind) for c, kind in SETTINGS.items() if c not in pages.columns})


def or_else(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in cols), F.lit(""))


def place_of(node: Column) -> Column:
    """The first place that a node's jobLocation names: an address text, or its locality, region and country, comma-joined."""
    raw = F.get_json_object(node, "$.jobLocation")
    each = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))

    def one(x: Column) -> Column:
        address = F.coalesce(F.get_json_object(x, "$.address"), x)
        parts = F.array(*(F.when(F.get_json_object(address, f"$.address{p}") != "", text.clean_text(F.get_json_object(address, f"$.address{p}"))) for p in ("Locality", "Region", "Country")))
        return F.when(x.startswith("{"), F.when(address.startswith("{"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", ")).otherwise(text.clean_text(address)))

    return F.coalesce(F.get(F.filter(F.transform(F.filter(each, lambda x: x.isNotNull()), one), lambda p: p != ""), F.lit(0)), F.lit(""))


def structured(found: DataFrame) -> DataFrame:
    """The JSON-LD rows of links() as postings: rows without a title or a web address are none."""
    node = F.col("json")
    employer = F.get_json_object(node, "$.hiringOrganization")
    name = text.clean_text(F.when(employer.startswith("{"), F.get_json_object(node, "$.hiringOrganization.name")).otherwise(employer))
    rows = found.where((F.col("kind") == "ld") & (F.col("text") != "") & urls.is_http(F.col("url"))).withColumn("location", place_of(node))
    return rows.withColumns({
        "title": text.clean_text(F.col("text")), "employer": F.coalesce(name, F.lit("")), "described": text.strip_html(F.get_json_object(node, "$.description")), "department": F.lit(""),
        "date_posted": dates.iso_date(F.get_json_object(node, "$.datePosted")), "deadline": dates.iso_date(F.get_json_object(node, "$.validThrough")),
    })


def postings(pages: DataFrame, most: int = MOST_LINKS, role_pattern: str = page_source.ROLE_TERMS) -> DataFrame:
    """Every posting of every page with its order `ord` (page and place) and the settings of its board."""
    pages = with_settings(pages).where(F.coalesce(~page_source.blocked(F.col("html")), F.lit(False)))
    found = page_source.links(pages)
    host = F.lower(urls.part(F.col("page_url"), 2))
    carded = cards.postings(pages.select("page_id", "url", "html")).withColumns({"page_id": F.floor(F.col("ord") / 100_000), "pos": F.col("ord") % 100_000, "rank": F.lit(0)})
    carded = carded.withColumns({"employer": F.when(F.col("institution") == "Institution not provided", "").otherwise(F.col("institution")), "described": F.col("description_text"), "date_posted": F.lit(None).cast("string"), "deadline": F.lit(None).cast("string"), "url": F.col("application_url")})
    noded = structured(found)
    taken = carded.select("page_id", "url").union(noded.select("page_id", "url"))
    linked = page_source.candidates(found.where((F.col("kind") == "a") & ~host.contains("academicpositions.")), role_pattern, most, taken).select(*found.columns, "title")
    linked = linked.withColumns({"employer": F.lit(""), "department": F.lit(""), "location": F.lit(""), "described": F.lit(None).cast("string"), "date_posted": F.lit(None).cast("string"), "deadline": F.lit(None).cast("string")})
    shape = ("page_id", "pos", "rank", "url", "title", "employer", "department", "location", "described", "date_posted", "deadline")
    every = carded.select(*shape).union(noded.withColumn("rank", F.lit(1)).select(*shape)).union(linked.withColumn("rank", F.lit(2)).select(*shape))
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("rank", "pos"))).where("_n = 1")
    joined = first.join(pages.select("page_id", *(F.col(c).alias(f"_{c}") for c in SETTINGS)), "page_id")
    place = geo.of_source(F.col("_country"), F.col("_region"), F.col("location"), F.col("_tags"))
    named = or_else(F.col("_name"), F.lit("Job board"))
    by_link = F.concat(F.lit(CANDIDATE + " "), named, F.lit(". Open the source page for the full job description."))
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("rank", "pos"))
    out = joined.select(
        "page_id", (F.col("page_id") * 100_000 + order - 1).alias("ord"), "title", or_else(F.col("employer"), F.col("_institution"), F.lit("Institution not provided")).alias("institution"), "department", F.lit("").alias("school"), "location",
        place["country"].alias("country"), place["region"].alias("region"), named.alias("source_name"), F.col("url").alias("source_url"), F.col("url").alias("application_url"), F.coalesce("described", by_link).alias("description_text"), "deadline", "date_posted",
    )
    return out.withColumn("canonical_id", text.canonical_id(F.col("title"), F.col("institution"), F.col("application_url")))


def needs_details() -> Column:
    return F.col("description_text").startswith(CANDIDATE)


def wanted_details(found: DataFrame, board: str = "page_id", most: int = MOST_DETAILS) -> DataFrame:
    """The first `most` postings of each board that need their detail page, as pages to fetch."""
    first = F.row_number().over(Window.partitionBy(board).orderBy("ord"))
    return found.where(needs_details()).withColumn("_n", first).where(F.col("_n") <= most).select("ord", F.col("application_url").alias("url"))


def enriched(found: DataFrame, details: DataFrame) -> DataFrame:
    """found with what their detail pages (ord, html) say: the first JSON-LD posting is merged into the row, by the rules of consolidation; where
    there is none, the page's text is the description if it is longer. Rows without a detail page stay."""
    pages = found.join(details.select("ord", "html"), "ord").select(F.col("ord").alias("page_id"), F.col("application_url").alias("url"), "html", F.col("source_name").alias("name"), "institution", "country", "region")
    nodes = structured(page_source.links(pages)).withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("_n = 1")
    said = nodes.select(F.col("page_id").alias("ord"), F.struct("title", "employer", "location", "described", "date_posted", "deadline").alias("_d"))
    seen = pages.select(F.col("page_id").alias("ord"), text.strip_html(F.col("html")).alias("_text"))
    joined = found.join(seen, "ord", "left").join(said, "ord", "left")
    new = F.col("_d.title")
    shorter = new.isNotNull() & F.lower("title").contains(F.lower(new)) & (F.length(new) + 15 < F.length("title"))
    missing = text.missing_institution(F.col("institution")) & (F.coalesce("_d.employer", F.lit("")) != "")
    place = geo.of_source(F.lit(""), F.lit(""), F.col("_d.location"), F.array().cast("array<string>"))
    described = F.when(F.col("_d").isNotNull(), F.col("_d.described")).otherwise(F.when(F.length("_text") > F.length("description_text"), F.col("_text")).otherwise(F.col("description_text")))
    filled = {"location": or_else(F.col("location"), F.col("_d.location")), "country": or_else(F.col("country"), place["country"]), "region": or_else(F.col("region"), place["region"])}
    filled |= {c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_d.{c}")) for c in ("deadline", "date_posted")}
    filled |= {"title": F.when(shorter, new).otherwise(F.col("title")), "institution": F.when(missing, F.col("_d.employer")).otherwise(F.col("institution")), "description_text": described}
    hit = F.col("_text").isNotNull()
    out = joined.withColumns(filled)
    rich = extract.enrich(out.where(hit))
    return rich.select(*found.columns).unionByName(out.where(~hit).select(*found.columns))


def collect(boards: DataFrame, agent: str = "tessera", timeout: float = 30, delay: float = 2, robots: bool = True, most: int = MOST_LINKS, details: int = MOST_DETAILS, opener: fetch.Opener = fetch.read_url, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Boards (page_id, url and their settings) as postings, each URL once over all boards, and warnings (source, warning). Pages are fetched once:
    what was fetched is written to `scratch`, or to the shared folder."""
    spark = boards.sparkSession
    scratch = scratch or dedupe.shared_dir(spark)
    boards = with_settings(boards)
    page = dedupe.written(fetch.fetched(boards, agent, timeout, delay, robots, opener), scratch, "boards")
    stopped = F.when(page_source.blocked(F.col("html")), "the site blocked the automated HTML request")
    warnings = page.select(F.col("name").alias("source"), F.coalesce("warning", stopped).alias("warning")).where("warning is not null")
    found = page_source.keep_first(postings(page.where("html is not null"), most), "application_url", "ord")
    found = dedupe.written(found, scratch, "board-postings")
    if details <= 0:
        return found, warnings
    detail = dedupe.written(fetch.fetched(wanted_details(found, most=details), agent, timeout, delay, robots, opener), scratch, "details")
    failed = detail.where("warning is not null").join(found.select("ord", "source_name"), "ord").groupBy("source_name").count()
    warnings = warnings.union(failed.select("source_name", F.concat(F.lit("could not enrich "), "count", F.lit(" detail page(s)"))))
    return enriched(found, detail.where("html is not null")), warnings
