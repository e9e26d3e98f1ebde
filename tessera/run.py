"""A whole run: collect, prepare, score, save, digest, summary and mail. `python -m tessera.run --help`."""

from __future__ import annotations

import argparse
import logging
import os
import smtplib
import sys
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import settings as config
from tessera.functions import extract
from tessera.operators import dedupe, delivery, model_scoring, outputs, scoring, store
from tessera.sources import boards, demo, feeds, fetch

LOG = logging.getLogger("tessera")
#: What sources are expected to give; a source without a column has nulls there.
COLLECTED = ("ord", "canonical_id", *boards.COLUMNS)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Postings of several sources after one another: each source's order stays, behind that of the sources before it."""
    shaped = [p.select(F.lit(i).alias("_source"), *(F.col(c) if c in p.columns else F.lit(None).cast("long" if c == "ord" else "string").alias(c) for c in COLLECTED)) for i, p in enumerate(parts)]
    out = shaped[0]
    for p in shaped[1:]:
        out = out.unionByName(p)
    return out


def in_order(postings: DataFrame) -> DataFrame:
    """postings of union_all() with one order: a source's rows follow all of the sources before it."""
    tops = postings.groupBy("_source").agg((F.max("ord") + 1).alias("n")).collect()
    before, at = {}, 0
    for r in sorted(tops, key=lambda r: r["_source"]):
        before[r["_source"]] = at
        at += r["n"]
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv)) if before else None
    return postings.withColumn("ord", F.col("ord") + (F.element_at(offset, F.col("_source")) if before else 0)).drop("_source")


def as_table(spark: SparkSession, rows: list[dict], key: str) -> DataFrame:
    """Configured boards or feeds as rows, the disabled ones left out."""
    kept = [r for r in rows if r.get("enabled", True)]
    text_ = lambda r, c: str(r.get(c) or "").strip()
    data = [(i, text_(r, "url"), text_(r, "name"), text_(r, "institution"), text_(r, "department"), text_(r, "location"), text_(r, "country"), text_(r, "region"), [str(t) for t in r.get("tags") or []]) for i, r in enumerate(kept)]
    return spark.createDataFrame(data, f"{key} long, url string, name string, institution string, department string, location string, country string, region string, tags array<string>")


def collect(spark: SparkSession, c: config.Settings, live: bool, opener: fetch.Opener = fetch.read_url) -> tuple[DataFrame, list[str]]:
    """Postings of every source that is enabled, in one order, and warnings. A source that fails is a warning. Without live sources, the demo rows."""
    s = lambda name, other: c.get(f"scraping.{name}", other)
    how = {"agent": str(s("user_agent", "tessera")), "timeout": float(s("request_timeout_seconds", 30)), "delay": float(s("delay_between_requests_seconds", 2)), "opener": opener}
    folder, limit = dedupe.shared_dir(spark), float(s("source_time_limit_seconds", 3600))
    jobs: list[tuple[str, Callable[[], tuple[DataFrame, list]]]] = []
    warnings: list[str] = []

    def add(kind: str, make) -> None:
        jobs.append((kind, make))

    def gather(kind: str, make) -> tuple[DataFrame, list]:
        spark.sparkContext.setJobGroup(f"tessera {kind}", kind, interruptOnCancel=True)
        found, told = make()
        return dedupe.written(found, folder, kind.replace(" ", "-")), told

    def some(told: DataFrame) -> list:
        """Warnings as a reader can take them; if there are more, that is said."""
        first = [(r[0], r[1]) for r in told.limit(outputs.MOST + 1).collect()]
        return first if len(first) <= outputs.MOST else [*first[: outputs.MOST], ("further warnings", str(told.count() - outputs.MOST))]

    def boards_() -> tuple[DataFrame, list]:
        rows, told = boards.collect(as_table(spark, c.source("job_boards").get("sources") or [], "page_id"), robots=bool(s("respect_robots_txt", True)), details=int(s("max_detail_pages_per_source", boards.MOST_DETAILS)), **how)
        return rows, some(told)

    def feeds_() -> tuple[DataFrame, list]:
        rows, told = feeds.collect(as_table(spark, c.source("rss").get("feeds") or [], "feed_id"), **how | {"agent": str(c.source("rss").get("user_agent") or how["agent"])})
        return rows, some(told)

    if live and c.source("job_boards").get("enabled", False):
        add("job boards", boards_)
    official = c.source("official_pages")
    if official.get("enabled", False) and not live:
        add("official pages", lambda: (demo.postings(spark), []))
    elif official.get("enabled", False) and official.get("pages"):
        warnings.append("official pages: live pages are not fetched; using none of them")
    if live and c.source("rss").get("enabled", False):
        add("feeds", feeds_)
    parts = []
    # Sources are read side by side; their order is that of the list. One that fails or outlasts its time is a warning and stops no other.
    pool = ThreadPoolExecutor(max(1, len(jobs)))
    begun, running = time.monotonic(), [(kind, pool.submit(gather, kind, make)) for kind, make in jobs]
    for kind, job in running:
        try:
            rows, told = job.result(max(0.0, begun + limit - time.monotonic()))
            parts.append(rows)
            warnings.extend(f"{r[0]}: {r[1]}" for r in told)
        except TimeoutError:
            spark.sparkContext.cancelJobGroup(f"tessera {kind}")
            warnings.append(f"Source {kind} failed: no end after {limit:g} seconds")
        except Exception as e:  # whatever a source raises costs its own postings alone
            warnings.append(f"Source {kind} failed: {e}")
    pool.shutdown(wait=False, cancel_futures=True)
    if not parts:
        parts = [demo.postings(spark).limit(0)]
    return in_order(union_all(parts)), warnings


def prepare(postings: DataFrame, title_at: float = 0.9, institution_at: float = 0.9, today: str = "", now: str = "") -> DataFrame:
    """Units and institutions filled from prose, then near-equal postings merged."""
    return dedupe.consolidate(store.whole(extract.enrich(postings), today, now), title_at=title_at, institution_at=institution_at)


def score(postings: DataFrame, c: config.Settings, as_of: str, client: model_scoring.Client | None = None) -> DataFrame:
    """Rule scores with summary and angle, and a model's scores where a client is given; answers are written before they are used, so none is asked for twice."""
    included = tuple(k for k, on in (c.get("regions.include") or {}).items() if on)
    out = scoring.with_prose(scoring.score(postings, c.keywords, as_of, c.priority_names(), c.get("scoring"), included))
    roles = tuple(scoring.DEFAULTS["role_weights"])
    kept = c.get("openai.answers_path")
    out = model_scoring.rescore(out, client, c.profile, roles, float(c.get("openai.min_rule_score_for_llm", 0.35)), str(c.place(kept)) if kept else None)
    return dedupe.written(out, dedupe.shared_dir(postings.sparkSession), "scored")


def client_of(c: config.Settings) -> tuple[model_scoring.Client | None, list[str]]:
    """The model's client that the settings name, or why there is none; rule scores stand then."""
    try:
        return delivery.Gateway(str(c.get("openai.url") or ""), str(c.get("openai.model") or ""), str(c.get("openai.api_key_env_var") or "OPENAI_API_KEY")), []
    except (RuntimeError, ValueError) as e:
        return None, [f"model scoring unavailable; using rule scores: {e}"]


@dataclass
class Result:
    postings: DataFrame
    warnings: list[str]
    subject: str
    body: str
    mail: str
    summary_path: str
    notes: int
    totals: dict[str, int]


def run(spark: SparkSession, c: config.Settings, dry_run: bool = False, live: bool = False, no_mail: bool = False, client: model_scoring.Client | None = None, opener: fetch.Opener = fetch.read_url, environment: dict | None = None, clock: datetime | None = None) -> Result:
    clock = clock or datetime.now(timezone.utc)
    today, now = clock.date().isoformat(), clock.replace(microsecond=0).isoformat()
    at = float(c.get("deduplication.fuzzy_title_threshold", 0.9)), float(c.get("deduplication.fuzzy_institution_threshold", 0.9))
    found, warnings = collect(spark, c, live, opener)
    if client is None and not dry_run and c.get("openai.enabled", False):
        client, told = client_of(c)
        warnings += told
    scored = score(prepare(found, *at, today, now), c, today, None if dry_run else client)
    saved = scored.drop("model_problem", "model_tokens", "rule_score")
    if c.get("outputs.sqlite.enabled", True):
        saved = store.save(scored, str(c.place(c.get("outputs.store.path", "data/postings"))), today, now, *at)
    saved = dedupe.written(saved, dedupe.shared_dir(spark), "saved")
    notes = 0
    base = os.environ if environment is None else environment
    if not dry_run and c.get("outputs.notion.enabled", False):
        if database := base.get(str(c.get("outputs.notion.database_id_env_var", "NOTION_DATABASE_ID")), ""):
            saved = dedupe.written(delivery.sync_notes(saved, database), dedupe.shared_dir(spark), "noted")
            notes = saved.count()
    if c.get("outputs.csv.enabled", True):
        outputs.write_one_csv(saved, str(c.place(c.get("outputs.csv.path", "data/postings.csv"))))
    how = outputs.Layout.of(c.get, c.template)
    try:
        subject, body = outputs.render(saved, today, how)
    except (ValueError, KeyError, IndexError) as e:  # too long for a message, or a template with unknown fields: the run goes on without
        subject, body = "", ""
        warnings.append(f"no digest: {e}")
    path = ""
    if c.get("outputs.markdown_summary.enabled", True):
        asked = c.source("target_positions")
        rows = [tuple(str(p.get(k) or "") for k in ("name", "url", "title", "institution")) for p in (asked.get("positions") or [] if asked.get("enabled", True) else [])]
        targets = spark.createDataFrame(rows, "name string, url string, title string, institution string")
        path = c.place(c.get("outputs.markdown_summary.path", "data/latest_run_summary.md"))
        path.parent.mkdir(parents=True, exist_ok=True)
        try:
            path.write_text(outputs.run_summary(scored, saved, targets, warnings, today, now, how), "utf-8")
        except (ValueError, KeyError, IndexError) as e:
            warnings.append(f"no summary: {e}")
    sent = "Email disabled by --no-email." if no_mail else "Email disabled."
    if not body:
        sent = "Email not sent. There is no digest."
    elif not no_mail and c.get("email.enabled", False):
        try:
            sent = delivery.mail(delivery.credentials(base), subject, body, str(c.get("email.smtp_host", "smtp.gmail.com")), int(c.get("email.smtp_port", 587)), bool(c.get("email.use_tls", True)), dry_run)
        except delivery.MissingSettings as e:
            sent = f"Email not sent. {e}"
    totals = {"collected": found.count(), "scored": scored.count(), "saved": saved.count(), "warnings": len(warnings), "model_tokens": scored.agg(F.sum("model_tokens")).first()[0] or 0}
    LOG.info("run complete: %s, email=%s", totals, sent)
    for w in warnings:
        LOG.warning(w)
    return Result(saved, warnings, subject, body, sent, str(path), notes, totals)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Collect, score and report postings.")
    p.add_argument("--config-dir", default="config")
    mode = p.add_mutually_exclusive_group(required=True)
    mode.add_argument("--dry-run", action="store_true", help="no effects outside the local outputs")
    mode.add_argument("--once", action="store_true", help="one run over the live sources")
    mode.add_argument("--test-email", action="store_true", help="send one message that shows the layout")
    mode.add_argument("--test-llm", action="store_true", help="score one built-in posting by a client without a model")
    p.add_argument("--no-email", action="store_true")
    p.add_argument("--live-sources", action="store_true")
    p.add_argument("--log-level", default="INFO")
    a = p.parse_args(argv)
    if a.test_email and a.no_email:
        p.error("--test-email cannot be combined with --no-email")
    logging.basicConfig(level=a.log_level.upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    c = config.load(a.config_dir)
    if a.test_email:
        try:
            print(delivery.sample_mail(delivery.credentials(), host=str(c.get("email.smtp_host", "smtp.gmail.com")), port=int(c.get("email.smtp_port", 587)), tls=bool(c.get("email.use_tls", True))))
        except delivery.MissingSettings as e:
            print(f"ERROR: {e}", file=sys.stderr)
            return 2
        except (OSError, smtplib.SMTPException) as e:
            print(f"ERROR: mail test failed: {e}", file=sys.stderr)
            return 1
        return 0
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if a.test_llm:
        one = score(prepare(demo.postings(spark).limit(1)), c, datetime.now(timezone.utc).date().isoformat()).first().asDict()
        print(delivery.model_check(delivery.echo, one, c.profile, tuple(scoring.DEFAULTS["role_weights"])))
        return 0
    run(spark, c, a.dry_run, a.live_sources or a.once, a.no_email)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
