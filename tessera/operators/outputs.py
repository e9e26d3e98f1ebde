"""Outputs: CSV, the Markdown digest, its e-mail, and pages of a notes database.

Only what a reader sees reaches the driver: a bounded number of items and counts. CSV and payloads are written by the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from email.message import EmailMessage
from html import escape
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions import dates, text
from tessera.operators import digest

#: Columns of the CSV, in their order. Fixed values.
COLUMNS = (
    "canonical_id title institution department school location country region role_type source_name source_url application_url description_text deadline date_posted date_first_seen "
    "date_last_seen fit_category fit_score summary match_reasons application_angle required_materials warnings is_priority_institution is_new_this_run has_been_emailed status notion_page_id raw_html_path created_at updated_at"
).split()
LISTS = ("match_reasons", "required_materials", "warnings")
FLAGS = ("is_priority_institution", "is_new_this_run", "has_been_emailed")
#: Items of a rendered digest at most.
MOST = 10_000
#: The digest's layout. Fixed values.
HEADINGS = [
    ("summary", "Summary"), ("strong_fit", "Strong-fit new postings"), ("good_fit", "Good-fit new postings"), ("possible_priority", "Possible matches from priority institutions"), ("lower_priority", "Lower-priority matches"),
    ("fellowships", "Prestigious fellowships"), ("deadlines_14", "Deadlines within 14 days"), ("deadlines_7", "Urgent deadlines within 7 days"), ("warnings", "Warnings and caveats"), ("sync_summary", "CSV/Notion update summary"),
]


@dataclass(frozen=True)
class Layout:
    """How a digest is made: which categories enter, items of a ranked section, days of the deadline sections, subject and template.

    The subject knows {num_new} and {num_strong}; the template the keys of HEADINGS.
    """

    main: tuple[str, ...] = ("A", "B")
    c_if_priority: bool = True
    with_d: bool = False
    n: int = 20
    soon: int = 14
    urgent: int = 7
    subject: str = "{num_new} new postings, {num_strong} strong fits"
    template: str = "# Weekly digest\n\n" + "\n\n".join(f"## {title}\n{{{key}}}" for key, title in HEADINGS) + "\n"

    @classmethod
    def of(cls, get: Callable[[str, object], object], template: str) -> "Layout":
        """The layout that settings give, `get` by dotted path; deadline sections without a setting hold today's alone."""
        own = cls()
        return cls(
            tuple(get("newsletter.include_categories_main", own.main)), bool(get("newsletter.include_category_c_if_priority_institution", True)), bool(get("newsletter.include_category_d", False)),
            int(get("newsletter.max_jobs_per_section", own.n)), int(get("deadline_reminders.reminder_window_days", 0)), int(get("deadline_reminders.urgent_window_days", 0)),
            str(get("newsletter.subject_template", own.subject)), template or own.template,
        )


def flat_columns(postings: DataFrame) -> list[Column]:
    def one(c: str) -> Column:
        if c not in postings.columns:
            return F.lit("")
        value = F.array_join(c, "\n") if c in LISTS else F.col(c).cast("int") if c in FLAGS else F.col(c)
        return F.coalesce(value.cast("string"), F.lit(""))

    return [one(c) for c in COLUMNS]


def flat(postings: DataFrame) -> DataFrame:
    """The CSV's columns: lists as lines, flags as 0 and 1, missing columns and nulls empty."""
    return postings.select(*(value.alias(c) for c, value in zip(COLUMNS, flat_columns(postings), strict=True)))


def write_one_csv(postings: DataFrame, path: str, order: str = "ord") -> int:
    """One CSV file in order, with its header, and its rows: pieces made by the executors, in ranges of the order, are joined as they are."""
    spark = postings.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    flat(postings.orderBy(order)).write.option("header", False).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    folder, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    out = fs.create(target, True)
    out.write(bytearray((",".join(COLUMNS) + "\n").encode()))
    for found in sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
        piece = fs.open(found)
        hadoop.io.IOUtils.copyBytes(piece, out, 1 << 16, False)
        piece.close()
    out.close()
    fs.delete(folder, True)
    return postings.count()


def write_csv(postings: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, one for each partition, quotes doubled; line breaks inside quotes stay."""
    flat(postings).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def lower_priority() -> Column:
    """Whether a posting is part-time, by its searchable text."""
    fields = ("title", "institution", "department", "school", "location", "country", "region", "description_text")
    return text.normalize(text.searchable(*map(F.col, fields))).contains("part time")


def eligible(postings: DataFrame, how: Layout = Layout()) -> Column:
    """Whether a posting enters the digest; without a flag nothing has been sent yet."""
    emailed = F.coalesce("has_been_emailed", F.lit(False)) if "has_been_emailed" in postings.columns else F.lit(False)
    return digest.eligible(F.col("fit_category"), lower_priority(), F.col("is_priority_institution"), emailed, how.main, how.c_if_priority, how.with_d)


def sections(postings: DataFrame, as_of: str, how: Layout = Layout()) -> DataFrame:
    """A row for each section an eligible posting belongs to: `section`, `rank` and the posting. Ranked sections hold their best; the
    deadline and warning sections hold all, in input order."""
    lower = lower_priority()
    fit, regular = F.col("fit_category"), ~lower
    able = postings.where(eligible(postings, how))
    belongs = {
        "lower_priority": lower, "strong_fit": regular & (fit == "A"), "good_fit": regular & (fit == "B"), "possible_priority": regular & (fit == "C") & F.col("is_priority_institution"),
        "fellowships": F.col("role_type").contains("fellowship"), "deadlines_14": dates.due_within(F.col("deadline"), as_of, how.soon), "deadlines_7": dates.due_within(F.col("deadline"), as_of, how.urgent), "warnings": F.size("warnings") > 0,
    }
    listed = able.withColumn("section", F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in belongs.items())), lambda x: x.isNotNull())))
    unranked = F.col("section").isin("deadlines_14", "deadlines_7", "warnings")
    top = digest.top_of_sections(listed.where(~unranked), "section", "fit_score", "ord", how.n)
    return top.unionByName(listed.where(unranked).withColumn("rank", F.lit(0)))


def card(r: Row, compact: bool = False) -> str:
    """A posting as lines of the digest."""
    get = lambda c, default="": (r[c] if c in r.__fields__ else None) or default
    unit = " / ".join(x for x in (get("department"), get("school")) if x) or "not listed"
    role = f"{r['role_type']}; fit {r['fit_category']} ({r['fit_score']}/100)"
    if compact:
        fields = [("Department/school", unit), ("Role", role), ("Link", get("application_url"))]
    else:
        fields = [
            ("Department/school", unit), ("Location", f"{get('location', 'not listed')} ({get('country') or get('region', 'unknown')})"), ("Role", role), ("Deadline", get("deadline", "not listed")),
            ("Link", get("application_url")), ("Summary", get("summary", "No summary yet.")), ("Match", "; ".join(get("match_reasons", [])[:3]) or "No detailed reasons yet."),
            ("Application angle", get("application_angle", "To draft.")), ("Warnings", "; ".join(get("warnings", [])[:2]) or "None noted."), ("Source", get("source_url")), ("First seen", get("date_first_seen")),
        ]
    return "\n".join([f"- {r['title']} - {r['institution']}", *(f"  {k}: {v}" for k, v in fields)])


def render(postings: DataFrame, as_of: str, how: Layout = Layout()) -> tuple[str, str]:
    """The digest's subject and Markdown body. The unranked sections hold every match, however many; a digest of more than MOST items is
    refused with a ValueError, as it is no message and does not belong on the driver: write sections() as a table instead."""
    shown = sections(postings, as_of, how)
    if shown.limit(MOST + 1).count() > MOST:
        raise ValueError(f"the digest has more than {MOST} items")
    able = postings.where(eligible(postings, how)).count()
    by: dict[str, list[Row]] = {}
    for r in shown.orderBy("section", "rank", "ord").toLocalIterator():
        by.setdefault(r["section"], []).append(r)
    strong, good = len(by.get("strong_fit", [])), len(by.get("good_fit", []))
    parts = {"summary": f"{able} new email-eligible postings. {strong} strong fits and {good} good fits.", "sync_summary": f"Prepared {postings.count()} job records; {able} are email-eligible."}
    for key, _ in HEADINGS:
        rows = by.get(key, [])
        if key == "warnings":
            parts[key] = "\n".join(f"- {r['title']} - {r['institution']}: {'; '.join(r['warnings'])}" for r in rows) or "No warnings for included jobs."
        elif key not in parts:
            parts[key] = "\n\n".join(card(r, key == "lower_priority") for r in rows) or "None this week."
    return how.subject.format(num_new=able, num_strong=strong), how.template.format(**parts)


def as_html(body: str) -> str:
    """The digest's Markdown as HTML: headings, a section for each item with its labelled lines, and links for Link and Source."""
    out, inside = [], False
    for line in body.splitlines():
        words = line.strip()
        item = line.startswith("  ") and inside and words
        if inside and not item:
            out.append("</section>")
            inside = False
        if item:
            label, colon, value = words.partition(":")
            value = value.strip()
            if label in ("Link", "Source") and value.startswith(("http://", "https://")):
                value = f'<a href="{escape(value, quote=True)}">{"Open job posting" if label == "Link" else "View source"}</a>'
            else:
                value = escape(value)
            out.append(f"<p><strong>{escape(label)}:</strong> {value}</p>" if colon else f"<p>{escape(words)}</p>")
        elif line.startswith("- "):
            out.append(f"<section><h3>{escape(line[2:].rstrip())}</h3>")
            inside = True
        elif line.startswith(("# ", "## ")):
            level = line.index(" ")
            out.append(f"<h{level}>{escape(line[level + 1 :].rstrip())}</h{level}>")
        elif words:
            out.append(f"<p>{escape(words)}</p>")
    return "<!doctype html><html><body>" + "".join(out) + ("</section>" if inside else "") + "</body></html>"


def message(sender: str, recipient: str, subject: str, body: str) -> EmailMessage:
    out = EmailMessage()
    out["From"], out["To"], out["Subject"] = sender, recipient, subject
    out.set_content(body)
    out.add_alternative(as_html(body), subtype="html")
    return out


class Transport(Protocol):
    def send_message(self, message: EmailMessage) -> object: ...


def send(mail: EmailMessage, transport: Transport | None) -> bool:
    """Hand a message to a transport such as a signed-in smtplib.SMTP; without one nothing is sent (a dry run)."""
    if transport is None:
        return False
    transport.send_message(mail)
    return True


def note_payload(database_id: str) -> Column:
    """The JSON of a posting's page in a notes database. Deadline is left out where there is none."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    prose = lambda c: F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("text"))).alias("rich_text"))
    choice = lambda c: F.struct(F.struct(F.when(some(c) == "", "Unknown").otherwise(F.col(c)).alias("name")).alias("select"))
    day = lambda c: F.struct(F.struct(F.col(c).alias("start")).alias("date"))
    fields = {
        "Title": F.struct(F.array(F.struct(F.struct(some("title").alias("content")).alias("text"))).alias("title")), "Institution": prose(some("institution")), "Department": prose(some("department")), "Country": choice("country"), "Region": choice("region"),
        "Role Type": choice("role_type"), "Fit Category": choice("fit_category"), "Fit Score": F.struct(F.col("fit_score").alias("number")), "URL": F.struct(F.col("application_url").alias("url")), "Source": prose(some("source_name")),
        "Date First Seen": day("date_first_seen"), "Date Last Seen": day("date_last_seen"), "Status": choice("status"), "Application Angle": prose(some("application_angle")), "Summary": prose(some("summary")),
        "Required Materials": F.struct(F.transform("required_materials", lambda m: F.struct(m.alias("name"))).alias("multi_select")), "Warnings": prose(F.array_join("warnings", "; ")),
        "Deadline": F.when(some("deadline") != "", day("deadline")),
    }
    return F.to_json(F.struct(F.struct(F.lit(database_id).alias("database_id")).alias("parent"), F.struct(*(v.alias(k) for k, v in fields.items())).alias("properties")))


def run_summary(run: DataFrame, saved: DataFrame, targets: DataFrame, warnings: list[str], as_of: str, generated: str, how: Layout = Layout()) -> str:
    """The Markdown summary of a run: totals, target positions, the eligible postings in input order, source warnings and the digest's body.
    Like the digest, it is refused with a ValueError beyond MOST eligible postings."""
    able = run.where(eligible(run, how))
    if able.limit(MOST + 1).count() > MOST:
        raise ValueError(f"the summary has more than {MOST} postings")
    listed = able.orderBy("ord").collect()
    _, body = render(run, as_of, how)
    totals = [("Current run jobs", run.count()), ("Saved jobs in local outputs", saved.count()), ("Email-eligible jobs", len(listed)), ("Source warnings", len(warnings))]
    asked = targets.select("name", "title", "institution", "url").collect()
    found = {r["name"]: r["matched_ord"] for r in digest.match_targets(run, targets, "ord").collect()} if asked else {}
    hits = {r["ord"]: r for r in run.where(F.col("ord").isin([x for x in found.values() if x is not None])).collect()} if any(x is not None for x in found.values()) else {}
    checks = []
    for t in asked:
        hit = hits.get(found.get(t["name"]))
        checks += [f"- {'FOUND' if hit else 'MISSING'}: {t['name']}", f"  Target: {t['title']} - {t['institution']}", f"  URL: {t['url']}"]
        if hit:
            checks += [f"  Matched: {hit['title']} - {hit['institution']}", f"  Source: {hit['source_name']}", f"  Fit: {hit['fit_category']} ({hit['fit_score']}/100)", f"  Link: {hit['application_url']}"]
    items = [x for r in listed for x in (f"- {r['fit_category']} ({r['fit_score']}/100): {r['title']} - {r['institution']}", f"  Link: {r['application_url']}")]
    parts = {
        "Run Totals": [f"- {k}: {v}" for k, v in totals], "Target Position Checks": checks or ["No target positions configured."], "Email-Eligible Jobs": items or ["None."],
        "Source Warnings": [f"- {w}" for w in warnings] or ["None."], "Newsletter Body": [body.strip()],
    }
    return "\n".join(["# Local Summary", "", f"Generated: {generated}", *(x for k, v in parts.items() for x in ("", f"## {k}", "", *v)), ""])
