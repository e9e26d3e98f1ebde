"""Live pages: fetched on the executors, host by host, under robots rules, a delay and a size limit.

The rows of one host are in one partition, so that its rules are read once and its delay holds; a host is a site to be polite to, so its pages are
meant to come one after the other. There are as many partitions as hosts, a number that Spark does not lower, and hosts that fall into one
partition are fetched by threads of their own: no host waits for another. Failures become warnings and stop no other page.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.error import HTTPError
from urllib.parse import urljoin, urlparse
from urllib.request import Request, urlopen
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import urls

#: Bytes of a page and of a host's rules at most.
PAGE_BYTES, RULES_BYTES = 8_000_000, 500_000
#: Partitions at most, for any number of hosts, and hosts that a partition fetches at once.
MOST_PARTS, THREADS = 2000, 16
Opener = Callable[[str, str, float, int], bytes]


def read_url(url: str, agent: str, timeout: float, most: int) -> bytes:
    """Up to `most` + 1 bytes of a web address."""
    with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as response:
        return response.read(most + 1)


class Rules:
    """The robots rules of the hosts met so far. Hosts that refuse to show them (401, 403) are closed; with no rules to be had, open."""

    def __init__(self, agent: str, timeout: float, opener: Opener) -> None:
        self.agent, self.timeout, self.opener, self.known = agent, min(timeout, 10), opener, {}

    def allow(self, url: str) -> bool:
        origin = "{0.scheme}://{0.netloc}".format(urlparse(url))
        if origin not in self.known:
            rules = RobotFileParser()
            try:
                rules.parse(self.opener(urljoin(origin, "/robots.txt"), self.agent, self.timeout, RULES_BYTES)[:RULES_BYTES].decode("utf-8", "replace").splitlines())
            except HTTPError as e:
                rules.disallow_all, rules.allow_all = e.code in (401, 403), e.code not in (401, 403)
            except OSError:
                rules.allow_all = True
            self.known[origin] = rules
        return self.known[origin].can_fetch(self.agent, url)


def fetched(wanted: DataFrame, agent: str = "tessera", timeout: float = 30, delay: float = 2, robots: bool = True, opener: Opener = read_url, most: int = PAGE_BYTES, raw_bytes: bool = False) -> DataFrame:
    """The rows of `wanted` (url) with html and warning; one of these is null. raw_bytes: html holds the bytes as they came, not UTF-8 text. Rows that are no web address, forbidden, too large or failing have a warning."""

    def one(url: str, rules: Rules, last: dict[str, float]) -> tuple[str | bytes | None, str | None]:
        """What a page gives: its content, or a warning."""
        if not (isinstance(url, str) and urlparse(url).scheme in ("http", "https") and urlparse(url).netloc):
            return None, "not a web address"
        if robots and not rules.allow(url):
            return None, "forbidden by robots.txt"
        host = urlparse(url).netloc
        if host in last:
            time.sleep(max(0.0, last[host] + delay - time.monotonic()))
        try:
            raw = opener(url, agent, timeout, most)
            if len(raw) > most:
                return None, f"larger than {most} bytes"
            return (raw if raw_bytes else raw.decode("utf-8", "replace")), None
        except (OSError, ValueError) as e:
            return None, f"{type(e).__name__}: {e}"
        finally:
            last[host] = time.monotonic()

    def run(batches):
        rules, last = Rules(agent, timeout, opener), {}
        with ThreadPoolExecutor(THREADS) as pool:
            for pdf in batches:
                hosts: dict[str, list[int]] = {}
                for i, url in enumerate(pdf["url"]):
                    hosts.setdefault(urlparse(url).netloc if isinstance(url, str) else "", []).append(i)
                got: list = [None] * len(pdf)

                def each(places: list[int], urls_=pdf["url"].tolist(), got=got) -> None:
                    for i in places:
                        got[i] = one(urls_[i], rules, last)

                list(pool.map(each, hosts.values()))
                yield pdf.assign(**{c: pd.Series([g[n] for g in got], index=pdf.index, dtype=object) for n, c in enumerate(("html", "warning"))})

    kept = wanted.drop("html", "warning")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    host = F.coalesce(urls.part(F.col("url"), 2), F.lit(""))
    parts = max(1, min(MOST_PARTS, kept.select(host.alias("host")).distinct().count()))
    return kept.repartition(parts, host).mapInPandas(run, f"{kinds}, html {'binary' if raw_bytes else 'string'}, warning string")
