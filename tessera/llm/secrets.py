"""Secret scans with multipart credential linking.

Base spans are taken by three rules on the whole text (`assign`, `access`, `hex`) and always stay. Parts of three roles are then gathered:
identifiers (access ids; account names), secrets (assigned values, long hex; mixed tokens) and endpoints (URLs with a scheme). The parts
after the semicolons, and endpoints, are weak: alone they are reported never. Parts are intervals; an interval join links two of
complementary roles (identifier and secret, secret and endpoint) in one scope: at most SCOPE code points apart, no blank line between, not
overlapping. A weak part with such a link is reported under `token`, `account` or `endpoint`.

A document is scanned by the task that reads it, so no row is shuffled; a sorted sweep joins its parts, so a document of very many parts
takes time in proportion to parts and links in scope. Null text is empty: counts 0, base_sha256 that of the empty string, spans empty.
Repeated rows are rows of their own; extra columns do not take part; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common

SCOPE = 200
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "account", "endpoint")
#: Role of each kind; complementary roles link.
ROLE = {"assign": "secret", "hex": "secret", "token": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
LINKS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
_ACCOUNT = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
_ENDPOINT = re.compile(r"""(?a:\b)(?:https?|ftp|s3|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""")
_BLANK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three base rules; leftmost and non-overlapping per kind, failing matches dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def weak_parts(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if any(c.isdigit() for c in t) and any(c.isupper() for c in t) and any(c.islower() for c in t):
            out.append((m.start(), m.end(), 3))
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 4) for m in _ACCOUNT.finditer(text)]
    if "://" in text:
        out += [(m.start(), m.end(), 5) for m in _ENDPOINT.finditer(text)]
    return out


def linked(text: str, base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], scope: int = SCOPE) -> tuple[list[tuple[int, int, int]], int]:
    """The weak parts that an interval join links with a complementary part, and the number of links."""
    parts = sorted({*base, *weak})
    starts = [p[0] for p in parts]
    blanks = [m.start() for m in _BLANK.finditer(text)] if len(parts) > 1 else []
    found, links = set(), 0
    for i, (s, e, k) in enumerate(parts):  # each pair once: the later part starts within scope of the earlier one's end
        for j in range(i + 1, bisect.bisect_right(starts, e + scope)):
            s2, e2, k2 = parts[j]
            if s2 < e or ROLE[KINDS[k2]] not in LINKS[ROLE[KINDS[k]]]:
                continue
            if bisect.bisect_left(blanks, s2) > bisect.bisect_left(blanks, e):
                continue
            links += 1
            found |= {p for p in ((s, e, k), (s2, e2, k2)) if p[2] > 2}
    return sorted(found, key=lambda x: (x[0], x[2])), links


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans and the number of links of a text."""
    base = base_spans(text)
    weak = weak_parts(text)
    more, links = linked(text, base, weak) if weak and len(base) + len(weak) > 1 else ([], 0)
    return base, sorted({*base, *more}, key=lambda x: (x[0], x[2], x[1])), links


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_links of every document."""
    common.tune(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, spans, links = scan_text(text or "")
                n = [sum(k == i for _, _, k in base) for i in range(3)]
                rows.append((*n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), links))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_links"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_links long")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span replaced by the mark; overlapping spans become one mark. All rows and columns stay."""
    common.tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                if text:
                    done, parts = 0, []
                    for s, e, _ in scan_text(text)[1]:
                        if e > done:
                            if s >= done:
                                parts += [text[done:s], mark]
                            done = e
                    text = "".join([*parts, text[done:]])
                out.append(text)
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole text."""
    return scan(common.table(spark, sf_dir, "documents"))
