"""The queries of the engine over the driver's tables, and the SQL that checks them. AS_OF is the day of the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dates, extract, geo, text, urls
from tessera.operators import dedupe, digest, outputs, scoring, store
from tessera.sources import boards as board_source
from tessera.sources import feeds as feed_source
from tessera.sources import pages as page_source

AS_OF = "1997-06-01"
KEYWORDS = {"high_value": ["the", "and on", "tion"], "medium_value": ["que", "der", "los"], "negative": ["token", "licence", "http"]}
TARGETS = [("steel", "", "STEEL", "Brand"), ("brass part", "", "part BRASS", "Brand#1"), ("none", "", "zzz", "nowhere"), ("address", "https://A.org/part/77/", "zzz", ""), ("any post", "", "Full Professor", "brand#2")]


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def duck_normal(c: str) -> str:
    out = f"lower(coalesce({c}, ''))"
    for a, b in text.FOLDS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return rf"trim(regexp_replace(regexp_replace({out}, 'https?://(www\.)?', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def duck_clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '{text.SPACE_RE2}', ' ', 'g'))"


def duck_any(c: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{x}')" for x in terms) + ")"


def duck_part(c: str, group: int) -> str:
    return rf"regexp_extract(coalesce({c}, ''), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', {group})"


def duck_hits(c: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{x}') AS INT)" for x in terms) + ")"


DUCK_CATEGORY = "CASE WHEN {0} >= 75 THEN 'A' WHEN {0} >= 55 THEN 'B' WHEN {0} >= 35 THEN 'C' ELSE 'D' END"


def normalize_text(spark, d):
    return t(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


def canonical_id(spark, d):
    return t(spark, d, "pages").select("page_id", text.canonical_id(F.lit("Page"), F.lit("Site"), F.col("url")).alias("canonical_id"))


def url_keep_first(spark, d):
    p = t(spark, d, "pages").select("page_id", urls.part(F.col("url"), 2).alias("host"))
    return page_source.keep_first(p, "host", "page_id")


def strip_html(spark, d):
    return t(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("stripped"))


def clean_text(spark, d):
    return t(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


def url_keys(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", urls.canonical_url(u).alias("canonical_url"), urls.is_http(u).alias("is_http"), urls.is_detail(u).alias("is_detail"))


def role_type(spark, d):
    region = F.element_at(F.array(F.lit("us"), F.lit("uk"), F.lit("eu"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    roles = F.array(*map(F.lit, ("Assistant Professor", "Lecturer", "Postdoctoral Fellow faculty", "Associate Professor", "Open Rank", "Presidential Fellow", "Visiting Assistant Professor", "Clerk")))
    return t(spark, d, "documents").select("doc_id", scoring.role_type(F.element_at(roles, (F.col("doc_id") % 8 + 1).cast("int")), F.col("text"), region).alias("role_type"))


_T = duck_normal("CASE doc_id % 8 WHEN 0 THEN 'Assistant Professor' WHEN 1 THEN 'Lecturer' WHEN 2 THEN 'Postdoctoral Fellow faculty' WHEN 3 THEN 'Associate Professor' WHEN 4 THEN 'Open Rank' WHEN 5 THEN 'Presidential Fellow' WHEN 6 THEN 'Visiting Assistant Professor' ELSE 'Clerk' END || ' ' || coalesce(text, '')")
_ROLE_SQL = f"""
    WITH x AS (SELECT doc_id, {_T} AS t, CASE doc_id % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'uk' WHEN 2 THEN 'eu' ELSE '' END AS r FROM documents)
    SELECT doc_id, CASE WHEN {duck_any("t", scoring.POSTDOC)} AND contains(t, 'fellow') AND {duck_any("t", ("prestigious", "faculty", "tenure"))} THEN 'prestigious_postdoc_fellowship'
        WHEN {duck_any("t", scoring.POSTDOC)} THEN 'regular_postdoc' WHEN {duck_any("t", scoring.TEACHING)} THEN 'teaching_only'
        WHEN {duck_any("t", scoring.LECTURER)} AND r IN ('us', 'usa', 'canada') THEN 'teaching_only'
        WHEN {duck_any("t", scoring.AP)} THEN CASE WHEN contains(t, 'tenure') THEN 'tenure_track_assistant_professor' ELSE 'assistant_professor' END
        WHEN {duck_any("t", scoring.LECTURER)} AND r IN ('uk', 'eu', 'europe') THEN 'lecturer_ap_equivalent'
        WHEN {duck_any("t", scoring.FELLOWSHIP)} THEN 'faculty_fellowship' WHEN {duck_any("t", scoring.OPEN_RANK)} THEN 'open_rank'
        WHEN {duck_any("t", scoring.ASSOCIATE)} AND r IN ('eu', 'europe', 'sweden', 'netherlands', 'nordics') THEN 'associate_professor_eu_tt_equivalent'
        ELSE 'other' END AS role_type FROM x"""


def as_postings(spark, d) -> DataFrame:
    """Documents in the shape of postings."""
    doc = t(spark, d, "documents")
    empty = {c: F.lit("") for c in ("department", "school", "location", "country")}
    return doc.select("doc_id", F.lit("Assistant Professor").alias("title"), F.col("source").alias("institution"), F.element_at(F.array(F.lit("us"), F.lit("mars")), (F.col("doc_id") % 2 + 1).cast("int")).alias("region"), F.col("text").alias("description_text"), F.lit("feed").alias("source_name"), F.lit("1997-01-31").alias("deadline")).withColumns(empty)


def keyword_score(spark, d):
    out = scoring.score(as_postings(spark, d), KEYWORDS, AS_OF, ["src0", "src1"])
    return out.select("doc_id", "role_type", F.round("rule_score", 9).alias("rule_score"), "fit_score", "fit_category", "is_priority_institution", F.size("match_reasons").alias("n_reasons"), F.size("warnings").alias("n_warnings"))


def keyword_hits(spark, d):
    # A generator is a wall to Catalyst: the text is normalized once for all lists.
    n, docs = F.col("n"), t(spark, d, "documents").select("doc_id", F.explode(F.array(text.normalize(F.col("text")))).alias("n"))
    return docs.select("doc_id", *(F.array_join(scoring.keyword_hits(n, v), "|").alias(k) for k, v in KEYWORDS.items()))


def fit_category(spark, d):
    points = (F.col("n_chars") % 101).cast("int")
    return t(spark, d, "documents").select("doc_id", points.alias("fit_score"), scoring.category(points).alias("fit_category"))


def region_lookup(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name", scoring.region_allowed(F.col("r_name"), ("asia", "middle_east")).alias("allowed"))


def priority_institution(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", scoring.priority(F.col("s_name"), [f"supplier 00000000{i}" for i in range(1, 9)]).alias("is_priority"))


def deadline_window(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t(spark, d, "orders").select("o_orderkey", dates.due_within(day, AS_OF, 30).alias("due_soon"), dates.expired(day, AS_OF).alias("expired"), dates.iso_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))


def rfc_dates(spark, d):
    return t(spark, d, "orders").select("o_orderkey", dates.rfc_date(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss")).alias("day"))


def section_topk(spark, d):
    return digest.top_of_sections(t(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey"), "o_orderpriority", "o_totalprice", "o_orderkey", 20)


def eligibility(spark, d):
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    c = scoring.category((F.col("n_chars") % 101).cast("int"))
    ok = digest.eligible(c, text.normalize(F.col("text")).contains("part time"), F.col("quality") == 1, F.col("toxic") == 1)
    return j.select("doc_id", c.alias("fit_category"), ok.alias("eligible"))


def target_match(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 97 == 5, "Professor").otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("title"), F.col("p_brand").alias("institution"), F.concat(F.lit("http://a.org/part/"), "p_partkey").alias("application_url"), F.lit("").alias("source_url"))
    targets = spark.createDataFrame(TARGETS, "name string, url string, title string, institution string")
    return digest.match_targets(p, targets, "ord")


def event_postings(spark, d, *fields):
    """Every event as a posting of its user, in the order of time, with the given fields."""
    order = F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    given = {
        "department": F.when(F.col("value") > 50, F.col("event_type")).otherwise(""), "fit_score": F.col("value"), "is_priority_institution": F.col("value") > 90, "school": F.lit(""),
        "match_reasons": F.array("event_type"), "required_materials": F.array(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), "warnings": F.array(F.col("event_id").cast("string")),
    }
    return t(spark, d, "events").select(order.alias("ord"), F.col("user_id").cast("string").alias("canonical_id"), *(given[c].alias(c) for c in fields))


def merge_first_nonempty(spark, d):
    e = dedupe.consolidate(event_postings(spark, d, "department", "fit_score", "is_priority_institution"))
    return e.select(F.col("canonical_id").cast("long").alias("user_id"), F.nullif("department", F.lit("")).alias("first_type"), F.col("fit_score").alias("best_value"), F.col("is_priority_institution").alias("any_high"))


def merge_list_union(spark, d):
    return dedupe.consolidate(event_postings(spark, d, "match_reasons")).select(F.col("canonical_id").cast("long").alias("user_id"), F.array_join("match_reasons", "|").alias("types"))


def exact_consolidate(spark, d):
    n = t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.sha2(text.normalize(F.col("text")), 256).alias("canonical_id"), F.array(F.col("doc_id").cast("string")).alias("warnings"))
    return dedupe.consolidate(n).select(F.col("ord").alias("leader"), F.size("warnings").cast("long").alias("members"))


def upsert_exact(spark, d):
    e = event_postings(spark, d, "school", "fit_score", "required_materials", "warnings")
    old = dedupe.consolidate(e.where("ord < '19960101'").withColumn("school", F.lit("stored")))
    out = dedupe.upsert(old, e.where("ord >= '19960101'"))
    return out.select(F.col("canonical_id").cast("long").alias("user_id"), F.array_max("required_materials").cast("timestamp_ntz").alias("last_seen"), F.size("warnings").cast("long").alias("n"), F.col("fit_score").alias("best"), (F.col("school") == "").alias("is_new"))


def order_postings(spark, d):
    """Every order as a posting. Odd customers are institutions and priorities titles; even ones have no institution and a URL for each priority."""
    odd, key = F.col("o_custkey") % 2 == 1, F.col("o_orderkey")
    return t(spark, d, "orders").select(
        key.alias("ord"), key.cast("string").alias("canonical_id"), F.concat(F.lit("Post "), F.col("o_orderpriority")).alias("title"),
        F.when(odd, F.concat(F.when(key % 2 == 0, "The ").otherwise(""), F.lit("Customer University Number "), F.col("o_custkey"))).otherwise("Not listed").alias("institution"),
        F.when(odd, "").otherwise(F.concat(F.when(key % 2 == 0, "https://www.a.org/").otherwise("http://a.org/"), F.col("o_custkey"), F.lit("/"), F.lower("o_orderpriority"))).alias("application_url"),
        F.repeat(F.lit("x"), (key % 41).cast("int")).alias("description_text"), F.when(key % 3 == 0, F.col("o_orderstatus")).otherwise("").alias("department"),
        (key % 101).cast("int").alias("fit_score"), F.concat(F.lit("T"), key).alias("role_type"), F.array(F.col("o_orderstatus"), F.concat(F.lit("m"), key % 5)).alias("match_reasons"),
    )


def consolidate_keys(spark, d):
    out = dedupe.consolidate(order_postings(spark, d))
    return out.select(F.col("ord").alias("leader"), "institution", F.length("description_text").cast("long").alias("longest"), "department", "fit_score", "role_type", F.array_join("match_reasons", "|").alias("reasons"))


def upsert_keys(spark, d):
    p = order_postings(spark, d).withColumn("school", F.lit(""))
    old = dedupe.consolidate(p.where("ord % 4 = 0")).withColumn("school", F.lit("stored"))
    out = dedupe.upsert(old, p.where("ord % 4 <> 0"), mark="seen")
    return out.select(F.col("ord").alias("leader"), F.col("school") == "stored", "seen", "fit_score").toDF("leader", "stored", "seen", "fit_score")


def fuzzy_duplicates(spark, d):
    """Which earlier posting each part is a duplicate of: the brand is the institution, the name and size the title."""
    p = t(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("canonical_id"), F.concat_ws(" ", F.lit("Professor of"), "p_name", F.lit("at grade"), "p_size").alias("title"), F.col("p_brand").alias("institution"))
    return dedupe.duplicates(p).select("ord", "leader", "reason", F.round("score", 9).alias("score"))


def llm_score_formula(spark, d):
    x = [(F.col(c) % 6).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    s = scoring.model_score(x[0], x[1], x[2], x[3], (F.col("l_quantity").cast("long") % 6))
    return t(spark, d, "lineitem").groupBy(scoring.category(s).alias("category")).agg(F.count("*").alias("n"), F.sum(s).alias("total"))


def run_totals(spark, d):
    j = as_postings(spark, d)
    return j.groupBy("institution").agg(F.count("*").alias("postings"), F.count_if(F.col("region") == "us").alias("in_us"), F.max(F.length("description_text")).alias("longest"))


def geo_source(spark, d):
    n = t(spark, d, "nation")
    g = geo.of_source(F.lit(""), F.lit(""), F.col("n_name"), F.array(F.lit("Europe")))
    return n.select("n_nationkey", g["country"].alias("country"), g["region"].alias("region"))


def geo_infer(spark, d):
    g = geo.infer(F.concat(F.col("c_name"), F.lit(", "), F.element_at(F.array(*map(F.lit, ("Austin TX", "Leeds, England", "Oslo Norway", "Paris"))), (F.col("c_custkey") % 4 + 1).cast("int"))))
    return t(spark, d, "customer").select("c_custkey", g["country"].alias("country"), g["region"].alias("region"))


def csv_record(spark, d):
    p = t(spark, d, "documents").select(F.col("doc_id").alias("canonical_id"), F.array("source", "lang").alias("match_reasons"), (F.col("n_chars") > 1000).alias("is_new_this_run"))
    return outputs.flat(p).select(F.col("canonical_id").cast("long").alias("doc_id"), F.col("match_reasons").alias("lists"), F.col("is_new_this_run").cast("int").alias("flag"))


def read_back(spark, d):
    p = t(spark, d, "documents").select(F.col("doc_id").alias("canonical_id"), F.array("source", "lang").alias("match_reasons"), (F.col("n_chars") > 1000).alias("is_new_this_run"))
    return store.read_flat(outputs.flat(p)).select(F.col("canonical_id").cast("long").alias("doc_id"), F.element_at("match_reasons", 1).alias("source"), F.size("match_reasons").alias("n"), F.col("is_new_this_run").alias("flag"))


def title_from_url(spark, d):
    url = F.concat(F.lit("https://a.org/job/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("_"), F.col("p_partkey") + 10_000, F.lit(".html?x=1"))
    title = F.pandas_udf(lambda s: s.map(urls.title_from_url), "string")
    return t(spark, d, "part").select("p_partkey", title(url).alias("title"))


def html_to_text(spark, d):
    lines = F.pandas_udf(lambda s: s.map(feed_source.html_to_text), "string")
    return t(spark, d, "supplier").select("s_suppkey", lines(F.concat(F.lit("<p>A &amp;  "), "s_name", F.lit("</p><div> b<br>"), F.col("s_nationkey"), F.lit("</div>"))).alias("lines"))


def supplier_pages(spark, d):
    """A page of every supplier: a JSON-LD posting, a link that names a role, the same link again, and links that name none."""
    name, key = F.col("s_name"), F.col("s_suppkey").cast("string")
    node = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": ["JobPosting"], "title": "Chair of '), name, F.lit('", "url": "/ld/'), key, F.lit('", "hiringOrganization": {"name": "University '), F.col("s_nationkey"), F.lit('"}, "jobLocation": [{"address": {"addressLocality": "Leeds", "addressCountry": "England"}}], "description": "<b>Work</b> on '), key, F.lit('", "datePosted": "2026-05-0'), F.col("s_nationkey") % 9 + 1, F.lit('T08:00:00", "validThrough": "2026-08-01"}, {"@type": "Place"}]}</script>'))
    link = F.concat(F.lit('<a href="/jobs/'), key, F.lit('/x"> Assistant  Professor of '), name, F.lit("</a>"))
    html = F.concat(F.lit("<html>"), node, F.lit('<a href="/about">About us</a><a href="/jobs/search">Professor search</a>'), link, link, F.lit('<a href="mailto:x">Professor</a></html>'))
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("https://b.org/"), key).alias("url"), html.alias("html"))


def role_links(spark, d):
    return page_source.candidates(page_source.links(supplier_pages(spark, d))).select("page_id", "url", "title")


def structured_postings(spark, d):
    found = board_source.postings(supplier_pages(spark, d))
    return found.select("page_id", "title", "institution", "location", "country", "region", "application_url", "description_text", "date_posted", "deadline", "source_name")


def summaries(spark, d):
    p = t(spark, d, "supplier").select(F.concat(F.lit("Tenure-Track Assistant Professor of "), "s_name", F.lit(" Organisation: x")).alias("title"), F.lit("I").alias("institution"), F.lit("").alias("department"), F.lit("S").alias("school"), F.lit("feed").alias("source_name"), "s_suppkey")
    return scoring.with_prose(p).select("s_suppkey", "summary", "application_angle", scoring.title_focus(F.col("title")).alias("focus"))


def anchor_links(spark, d):
    return page_source.links(t(spark, d, "pages")).drop("json")


def candidate_links(spark, d):
    return page_source.candidates(page_source.links(t(spark, d, "pages")), r"^\w").select("page_id", "pos", "url", "title")


def posting_pipeline(spark, d):
    p = page_source.postings(t(spark, d, "pages"), ".")  # the driver's pages name no roles
    s = scoring.score(p, KEYWORDS, AS_OF)
    return digest.top_of_sections(s.select("ord", "title", "canonical_id", "application_url", "role_type", "fit_score", "fit_category"), "fit_category", "fit_score", "ord", 20)


def consolidate(spark, d):
    p = t(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("Order of "), F.col("o_orderpriority"), F.lit(" "), F.date_format("o_orderdate", "yyyyMM")).alias("title"), F.concat(F.lit("Customer "), F.col("o_custkey")).alias("institution"), F.lit("").alias("application_url"), F.col("o_orderstatus").alias("description_text"), F.lit(0).alias("fit_score"), F.lit("D").alias("fit_category"), F.lit("other").alias("role_type"), *(F.lit("").alias(c) for c in dedupe.FILLED), *(F.array().cast("array<string>").alias(c) for c in dedupe.LISTS), F.lit(False).alias("is_priority_institution"), F.lit(True).alias("is_new_this_run"))
    p = p.withColumn("canonical_id", text.canonical_id(F.col("title"), F.col("institution"), F.col("application_url")))
    return dedupe.consolidate(p).select("ord", "canonical_id", "title", "description_text")


def extract_units(spark, d):
    prose = F.concat(F.lit("Department: "), "source", F.lit("; Employer: West "), "lang", F.lit(" Location: here. "), F.coalesce("text", F.lit("")))
    return t(spark, d, "documents").select("doc_id", extract.unit(prose).alias("unit"), extract.institution(prose).alias("institution"))


def feed_postings(spark, d):
    item = F.concat(F.lit("<rss><item><title>Fellow "), "doc_id", F.lit("</title><link>https://a.org/"), "doc_id", F.lit("</link><description>Institution: "), F.coalesce("source", F.lit("")), F.lit("</description></item></rss>"))
    none = {c: F.lit("") for c in ("name", "institution", "department", "location", "country", "region")}
    feeds = t(spark, d, "documents").select(F.col("doc_id").alias("feed_id"), F.encode(item, "UTF-8").alias("payload")).withColumns(none)
    return feed_source.postings(feeds).select("ord", "title", "institution", "application_url", "canonical_id")


QUERIES = {f.__name__: f for f in (
    normalize_text, canonical_id, url_keep_first, strip_html, clean_text, url_keys, role_type, keyword_score, keyword_hits, fit_category, region_lookup, priority_institution, deadline_window, rfc_dates, section_topk, eligibility, target_match,
    merge_first_nonempty, merge_list_union, exact_consolidate, upsert_exact, consolidate_keys, upsert_keys, fuzzy_duplicates, llm_score_formula, run_totals, geo_source, geo_infer, csv_record, anchor_links, candidate_links, posting_pipeline, consolidate,
    extract_units, feed_postings, read_back, title_from_url, html_to_text, role_links, structured_postings, summaries,
)}

_N = duck_normal("text")
_BODY = duck_normal("'Assistant Professor ' || source || '     ' || CASE WHEN doc_id % 2 = 0 THEN 'us' ELSE 'mars' END || ' ' || coalesce(text, '') || ' feed'")
_CAT = DUCK_CATEGORY.format("CAST(n_chars % 101 AS INT)")
_SCORE = "7 * (l_orderkey % 6) + 5 * (l_partkey % 6) + 3 * (l_suppkey % 6) + 3 * (l_linenumber % 6) + 2 * (CAST(l_quantity AS BIGINT) % 6)"
_ORDERS = "p AS (SELECT *, (o_custkey, o_orderpriority) AS g, CASE WHEN o_custkey % 2 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'The ' ELSE '' END || 'Customer University Number ' || o_custkey ELSE 'Not listed' END AS place FROM orders)"
_PATH = duck_part("url", 3)
_QUERY = duck_part("url", 4)
_NAME = "lower(n_name)"

ORACLES = {
    "normalize_text": f"SELECT doc_id, {_N} AS normalized FROM documents",
    "canonical_id": f"""WITH x AS (SELECT page_id, {duck_normal("url")} AS u FROM pages)
        SELECT page_id, substr(sha256(CASE WHEN u <> '' AND NOT contains(u, 'configure me') THEN 'url:' || u ELSE 'title-inst:page::site' END), 1, 24) AS canonical_id FROM x""",
    "url_keep_first": f"SELECT page_id, host FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM (SELECT page_id, {duck_part('url', 2)} AS host FROM pages)) WHERE n = 1",
    "strip_html": f"SELECT page_id, {duck_clean("regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')")} AS stripped FROM pages",
    "clean_text": f"SELECT doc_id, {duck_clean("coalesce(text, '')")} AS cleaned FROM documents",
    "url_keys": f"""SELECT page_id, CASE WHEN {duck_part("trim(url)", 2)} = '' THEN '' ELSE lower({duck_part("trim(url)", 2)}) || lower(regexp_replace({duck_part("trim(url)", 3)}, '/+$', '')) END AS canonical_url,
        lower({duck_part("url", 1)}) IN ('http', 'https') AND {duck_part("url", 2)} <> '' AS is_http,
        regexp_matches({_PATH} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END, '(?i){urls.DETAIL_PATH}') OR regexp_matches(lower({_QUERY}), '{"|".join(urls.DETAIL_KEYS)}') AS is_detail FROM pages""",
    "role_type": _ROLE_SQL,
    "keyword_score": f"""
        WITH x AS (SELECT doc_id, source, doc_id % 2 = 0 AS us, {_BODY} AS t, {duck_normal("'Assistant Professor ' || coalesce(text, '')")} AS rt FROM documents),
        h AS (SELECT *, {duck_hits("t", KEYWORDS["high_value"])} AS hi, {duck_hits("t", KEYWORDS["medium_value"])} AS me, {duck_hits("t", KEYWORDS["negative"])} AS ne, contains(t, 'tenure') AS te, contains(t, 'part time') AS pt, source IN ('src0', 'src1') AS pr,
              CASE WHEN {duck_any("rt", scoring.POSTDOC)} AND contains(rt, 'fellow') AND {duck_any("rt", ("prestigious", "faculty", "tenure"))} THEN 'prestigious_postdoc_fellowship' WHEN {duck_any("rt", scoring.POSTDOC)} THEN 'regular_postdoc' WHEN {duck_any("rt", scoring.TEACHING)} THEN 'teaching_only'
              WHEN {duck_any("rt", scoring.LECTURER)} AND doc_id % 2 = 0 THEN 'teaching_only' WHEN contains(rt, 'tenure') THEN 'tenure_track_assistant_professor' ELSE 'assistant_professor' END AS role_type FROM x),
        w AS (SELECT *, CAST(CASE role_type WHEN 'prestigious_postdoc_fellowship' THEN 0.18 WHEN 'regular_postdoc' THEN -0.25 WHEN 'teaching_only' THEN -0.25 ELSE 0.3 END AS DOUBLE) AS wt FROM h),
        s AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, wt + CASE WHEN hi > 0 THEN least(0.35::DOUBLE, 0.06::DOUBLE * hi) ELSE 0 END + CASE WHEN me > 0 THEN least(0.18::DOUBLE, 0.035::DOUBLE * me) ELSE 0 END + CASE WHEN te THEN 0.06::DOUBLE ELSE 0 END
              + CASE WHEN pr THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN us THEN 0.08::DOUBLE ELSE -0.25::DOUBLE END - CASE WHEN ne > 0 THEN least(0.35::DOUBLE, 0.1::DOUBLE * ne) ELSE 0 END - CASE WHEN pt THEN 0.25::DOUBLE ELSE 0 END - 0.3::DOUBLE)) AS rs FROM w),
        p AS (SELECT *, CASE WHEN pt THEN least(54, CAST(round_even(rs * 100, 0) AS INT)) ELSE CAST(round_even(rs * 100, 0) AS INT) END AS fit_score FROM s)
        SELECT doc_id, role_type, round(rs, 9) AS rule_score, fit_score, {DUCK_CATEGORY.format("fit_score")} AS fit_category, pr AS is_priority_institution,
          CAST((wt >= 0)::INT + (hi > 0)::INT + (me > 0)::INT + te::INT + pr::INT + us::INT AS INT) AS n_reasons, CAST((wt < 0)::INT + (NOT us)::INT + (ne > 0)::INT + pt::INT + 1 AS INT) AS n_warnings FROM p""",
    "keyword_hits": f"SELECT doc_id, {', '.join(f"array_to_string(list_filter([{', '.join(f"CASE WHEN contains(t, '{x}') THEN '{x}' END" for x in v)}], lambda y: y IS NOT NULL), '|') AS {k}" for k, v in KEYWORDS.items())} FROM (SELECT doc_id, {_N} AS t FROM documents)",
    "fit_category": f"SELECT doc_id, CAST(n_chars % 101 AS INT) AS fit_score, {_CAT} AS fit_category FROM documents",
    "region_lookup": f"SELECT n_nationkey, r_name, replace({duck_normal('r_name')}, ' ', '_') IN ('asia', 'middle_east') AS allowed FROM nation JOIN region ON n_regionkey = r_regionkey",
    "priority_institution": f"SELECT s_suppkey, {duck_normal('s_name')} IN ({', '.join(f"'supplier 00000000{i}'" for i in range(1, 9))}) AS is_priority FROM supplier",
    "deadline_window": f"SELECT o_orderkey, date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE)) BETWEEN 0 AND 30 AS due_soon, CAST(o_orderdate AS DATE) < DATE '{AS_OF}' AS expired, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "rfc_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "section_topk": "SELECT * FROM (SELECT o_orderpriority, o_totalprice, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) WHERE rank <= 20",
    "eligibility": f"""SELECT doc_id, fit_category, coalesce(CASE WHEN pt AND fit_category = 'C' THEN true WHEN fit_category IN ('A', 'B') THEN true WHEN fit_category = 'C' AND quality = 1 THEN true ELSE false END AND NOT toxic = 1, false) AS eligible
        FROM (SELECT doc_id, {_CAT} AS fit_category, contains({_N}, 'part time') AS pt, quality, toxic FROM documents JOIN labels USING (doc_id))""",
    "target_match": """WITH q AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 97 = 5 THEN 'Professor' ELSE p_name || ' ' || p_type END AS title, p_brand FROM part),
        p AS (SELECT ord, title, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS b, 'a.org/part/' || ord AS u FROM q),
        g AS (SELECT * FROM (VALUES ('steel', ['steel'], 'brand', 'steel', ''), ('brass part', ['part', 'brass'], 'brand 1', '', ''), ('none', ['zzz'], 'nowhere', '', ''), ('address', ['zzz'], '', '', 'a.org/part/77'), ('any post', [], 'brand 2', 'full professor', '')) v(name, terms, inst, said, url)),
        m AS (SELECT g.name, arg_min(p.title, p.ord) AS matched_title, min(p.ord) AS matched_ord FROM g JOIN p ON g.url <> '' AND contains(p.u, g.url)
              OR g.inst <> '' AND p.b <> '' AND (contains(p.b, g.inst) OR contains(g.inst, p.b)) AND CASE WHEN len(g.terms) > 0 THEN list_has_all(string_split(p.n, ' '), g.terms) ELSE p.n <> '' AND (contains(p.n, g.said) OR contains(g.said, p.n)) END GROUP BY g.name)
        SELECT g.name, matched_title, matched_ord, matched_ord IS NOT NULL AS found FROM g LEFT JOIN m USING (name)""",
    "merge_first_nonempty": "SELECT user_id, arg_min(event_type, {'t': ts, 'e': event_id}) FILTER (value > 50) AS first_type, max(value) AS best_value, bool_or(value > 90) AS any_high FROM events GROUP BY user_id",
    "merge_list_union": "WITH f AS (SELECT user_id, event_type, min({'t': ts, 'e': event_id}) AS seen FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, '|' ORDER BY seen) AS types FROM f GROUP BY user_id",
    "exact_consolidate": f"SELECT min(doc_id) AS leader, count(*) AS members FROM (SELECT doc_id, {_N} AS k FROM documents) GROUP BY k",
    "upsert_exact": "SELECT user_id, max(ts) AS last_seen, count(*) AS n, max(value) AS best, min(ts) FILTER (ts < TIMESTAMP '1996-01-01') IS NULL AS is_new FROM events GROUP BY user_id",
    "consolidate_keys": f"""WITH {_ORDERS}, f AS (SELECT g, v, min((o_orderkey, i)) AS nth FROM (SELECT g, o_orderkey, unnest([o_orderstatus, 'm' || o_orderkey % 5]) AS v, unnest([1, 2]) AS i FROM p) GROUP BY g, v),
        l AS (SELECT g, string_agg(v, '|' ORDER BY nth) AS reasons FROM f GROUP BY g)
        SELECT min(o_orderkey) AS leader, arg_min(place, o_orderkey) AS institution, max(o_orderkey % 41) AS longest, coalesce(arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 = 0), '') AS department, CAST(max(o_orderkey % 101) AS INT) AS fit_score,
               'T' || arg_min(o_orderkey, (-(o_orderkey % 101), o_orderkey)) AS role_type, any_value(l.reasons) AS reasons FROM p JOIN l USING (g) GROUP BY g""",
    "upsert_keys": f"""WITH {_ORDERS}
        SELECT coalesce(min(o_orderkey) FILTER (o_orderkey % 4 = 0), min(o_orderkey)) AS leader, count(*) FILTER (o_orderkey % 4 = 0) > 0 AS stored, count(*) FILTER (o_orderkey % 4 <> 0) > 0 AS seen, CAST(max(o_orderkey % 101) AS INT) AS fit_score FROM p GROUP BY g""",
    "llm_score_formula": f"SELECT {DUCK_CATEGORY.format(f'({_SCORE})')} AS category, count(*) AS n, CAST(sum({_SCORE}) AS BIGINT) AS total FROM lineitem GROUP BY 1",
    "run_totals": "SELECT source AS institution, count(*) AS postings, count(*) FILTER (doc_id % 2 = 0) AS in_us, CAST(max(length(text)) AS INT) AS longest FROM documents GROUP BY source",
    "geo_source": f"SELECT n_nationkey, CASE {' '.join(f"WHEN contains({_NAME}, '{m}') THEN '{c}'" for m, c, _ in geo.BOARD_COUNTRIES)} ELSE '' END AS country, CASE {' '.join(f"WHEN contains({_NAME}, '{m}') THEN '{r}'" for m, _, r in geo.BOARD_COUNTRIES)} ELSE 'eu' END AS region FROM nation",
    "geo_infer": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'United States' WHEN 1 THEN 'United Kingdom' WHEN 2 THEN 'Norway' ELSE '' END AS country, CASE c_custkey % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'uk' WHEN 2 THEN 'nordics' ELSE '' END AS region FROM customer",
    "csv_record": "SELECT doc_id, source || chr(10) || lang AS lists, CAST(n_chars > 1000 AS INT) AS flag FROM documents",
    "read_back": "SELECT doc_id, source, CAST(2 AS INT) AS n, n_chars > 1000 AS flag FROM documents",
    "title_from_url": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part",
    "html_to_text": "SELECT s_suppkey, 'A & ' || s_name || chr(10) || 'b' || chr(10) || s_nationkey AS lines FROM supplier",
    "role_links": "SELECT s_suppkey AS page_id, 'https://b.org/jobs/' || s_suppkey || '/x' AS url, 'Assistant Professor of ' || s_name AS title FROM supplier",
    "structured_postings": """SELECT s_suppkey AS page_id, 'Chair of ' || s_name AS title, 'University ' || s_nationkey AS institution, 'Leeds, England' AS location, 'United Kingdom' AS country, 'uk' AS region, 'https://b.org/ld/' || s_suppkey AS application_url,
          'Work on ' || s_suppkey AS description_text, '2026-05-0' || (s_nationkey % 9 + 1) AS date_posted, '2026-08-01' AS deadline, 'Job board' AS source_name FROM supplier
        UNION ALL SELECT s_suppkey, 'Assistant Professor of ' || s_name, 'Institution not provided', '', '', '', 'https://b.org/jobs/' || s_suppkey || '/x',
          'Candidate link extracted from Job board. Open the source page for the full job description.', NULL, NULL, 'Job board' FROM supplier""",
    "summaries": """SELECT s_suppkey, 'Tenure-Track Assistant Professor of ' || s_name || ' Organisation: x at I, sourced from feed.' AS summary,
        'Connect your strongest relevant research evidence to the advertised focus on ' || s_name || ', and name one credible collaboration or teaching contribution in S.' AS application_angle, s_name AS focus FROM supplier""",
    "extract_units": """SELECT doc_id, CASE WHEN source IS NULL OR lang IS NULL THEN '' ELSE 'Department of ' || source END AS unit,
        CASE WHEN source IS NULL OR lang IS NULL THEN '' ELSE 'West ' || lang END AS institution FROM documents""",
    "feed_postings": """SELECT doc_id * 100000 AS ord, 'Fellow ' || doc_id AS title, coalesce(source, 'Unknown institution') AS institution, 'https://a.org/' || doc_id AS application_url,
        substr(sha256('url:a org ' || doc_id), 1, 24) AS canonical_id FROM documents""",
}
