"""What leaves the engine: mail by SMTP, a model's client over HTTP, pages of a notes database. Credentials come from the environment by name and are never shown."""

from __future__ import annotations

import json
import os
import smtplib
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import model_scoring, outputs

#: Names of the environment's mail settings. Fixed values.
SENDER, PASSWORD, RECIPIENT = "GMAIL_SENDER_EMAIL", "GMAIL_APP_PASSWORD", "NEWSLETTER_RECIPIENT_EMAIL"


class MissingSettings(ValueError):
    """Names what the environment lacks."""

    def __init__(self, names: list[str]) -> None:
        self.names = tuple(names)
        super().__init__("Missing required email environment variables: " + ", ".join(names))


@dataclass(frozen=True)
class Credentials:
    sender: str
    recipient: str
    password: str = field(repr=False)


def credentials(environment: Mapping[str, str] | None = None) -> Credentials:
    found = os.environ if environment is None else environment
    if missing := [n for n in (SENDER, PASSWORD, RECIPIENT) if not found.get(n, "").strip()]:
        raise MissingSettings(missing)
    return Credentials(found[SENDER].strip(), found[RECIPIENT].strip(), found[PASSWORD])


def mail(who: Credentials, subject: str, body: str, host: str = "smtp.gmail.com", port: int = 587, tls: bool = True, dry_run: bool = False, connect: Callable = smtplib.SMTP) -> str:
    """Send a digest and say what was done. A dry run opens no connection."""
    if dry_run:
        return "Dry run: email was not sent."
    with connect(host, port, timeout=30) as smtp:
        if tls:
            smtp.starttls()
        smtp.login(who.sender, who.password)
        outputs.send(outputs.message(who.sender, who.recipient, subject, body), smtp)
    return f"Sent email to {who.recipient}."


def sample_mail(who: Credentials, **how) -> str:
    """Send a message that shows the layout of a digest."""
    item = ["- Sample posting (test only) - Example University", "  Location: Example City", "  Role: assistant professor; fit A (90/100)", "  Link: https://example.com/jobs/sample"]
    return mail(who, "Mail settings test", "\n".join(["# Mail settings test", "", "Mail is configured correctly.", "", "## Formatting preview", *item]), **how)


class Gateway:
    """A model's client: posts a request to an HTTP endpoint that answers with JSON, tries again after a failure of the network or the server, and adds up the tokens used.

    It is a model_scoring.Client, and picklable, so it runs on the executors; `usage` counts what its own process used.
    """

    def __init__(self, url: str, model: str, key_name: str, timeout: float = 60, retries: int = 2, opener: Callable = urlopen, sleep: Callable = time.sleep) -> None:
        if not url.startswith(("http://", "https://")):
            raise ValueError("the model's address is not set")
        if not os.environ.get(key_name, "").strip():
            raise RuntimeError(f"{key_name} is not set")
        self.url, self.model, self.key_name, self.timeout, self.retries, self.opener, self.sleep = url, model, key_name, timeout, retries, opener, sleep
        self.usage = {"input_tokens": 0, "output_tokens": 0, "total_tokens": 0}

    def __call__(self, request: str) -> dict:
        body = json.dumps({"model": self.model, "input": request}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ[self.key_name]}"}
        for left in range(self.retries, -1, -1):
            try:
                with self.opener(Request(self.url, data=body, headers=head), timeout=self.timeout) as response:
                    answer = json.loads(response.read())
                break
            except (HTTPError, URLError, TimeoutError) as e:
                if not left or isinstance(e, HTTPError) and e.code < 500 and e.code != 429:
                    raise
                self.sleep(2.0 ** (self.retries - left))
        for k in self.usage:
            self.usage[k] += int((answer.get("usage") or {}).get(k, 0))
        found = answer.get("output")
        if not isinstance(found, dict):
            raise ValueError("the model gave no assessment")
        return found


def echo(request: str) -> dict:
    """A client without a model: an assessment that repeats the rules' own result."""
    asked = json.loads(request)
    rules, job = asked["rule_prescreen"], asked["job"]
    points = int(rules["score"])
    return {
        "fit_category": next(c for c, least in model_scoring.CATEGORIES if points >= least), "fit_score": points, "role_type": rules["role_type"], "match_reasons": rules["reasons"][:3] or ["Rule-based prescreen matched the profile."],
        "summary": f"{job['title']} at {job['institution']} appears relevant based on rule scoring.", "application_angle": "", "required_materials": [], "warnings": rules["warnings"], "deadline": job["deadline"], "confidence": 0.7,
    }


def model_check(client: model_scoring.Client, scored: dict, profile: dict, roles: tuple[str, ...]) -> str:
    """Ask a client about one scored posting, and show its checked answer and the tokens used."""
    got = model_scoring.checked(client(model_scoring.request_of(scored, profile)), roles)
    used = getattr(client, "usage", {})
    lines = [f"Fit: {got['fit_category']} ({got['fit_score']}/100)", f"Role: {got['role_type']}", f"Summary: {got['summary']}", f"Evidence: {'; '.join(got['match_reasons'])}", f"Warnings: {'; '.join(got['warnings']) or 'none'}"]
    return "\n".join([*lines, f"Tokens: {used.get('input_tokens', 0)} input, {used.get('output_tokens', 0)} output, {used.get('total_tokens', 0)} total"])


def sync_notes(postings: DataFrame, database_id: str, put: Callable[[str, str], str] | None = None) -> DataFrame:
    """postings with notion_page_id, as `put` (canonical id, JSON of the page) gives it on the executors; without one, made-up ids and no effect."""
    put_ = put or (lambda key, payload: f"mock-notion-{key}")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(notion_page_id=[put_(k, p) for k, p in zip(pdf["canonical_id"], pdf["payload"], strict=True)]).drop(columns="payload")

    pages = postings.select("canonical_id", outputs.note_payload(database_id).alias("payload")).mapInPandas(run, "canonical_id string, notion_page_id string")
    return postings.drop("notion_page_id").join(pages.groupBy("canonical_id").agg(F.first("notion_page_id").alias("notion_page_id")), "canonical_id", "left").select(*postings.columns)
