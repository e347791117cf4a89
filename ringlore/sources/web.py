"""Fetching pages: a Python data source over a table of targets, polite to each domain."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalized_domain

AGENT, TIMEOUT, ATTEMPTS, DELAY = "ringlore/1.0", 10.0, 3, 2.0
PAGE = "url string, final_url string, http_status int, content_type string, body string, etag string, last_modified string, not_modified boolean, fetched_at timestamp, error string"


def fetch(url: str, etag: str | None = None, last_modified: str | None = None, agent: str = AGENT, timeout: float = TIMEOUT, attempts: int = ATTEMPTS, pause: float = 1.0) -> dict:
    """One page, conditionally if validators are given; transport errors are tried again after 1, 2, ... pauses."""
    headers = {"User-Agent": agent} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": last_modified} if last_modified else {})
    row = dict.fromkeys((c.split()[0] for c in PAGE.split(", "))) | {"url": url, "not_modified": False}
    for n in range(attempts):
        row["fetched_at"] = datetime.now(timezone.utc).replace(tzinfo=None)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                body, info, status, final = r.read(), r.headers, r.status, r.url
        except urllib.error.HTTPError as e:
            body, info, status, final = e.read(), e.headers, e.code, e.url
        except (urllib.error.URLError, TimeoutError, ConnectionError, ValueError) as e:
            row["error"] = str(e)
            if n + 1 < attempts:
                time.sleep(pause * (n + 1))
            continue
        if status == 304:  # unchanged: the validators that we have stay good
            return row | {"http_status": 304, "final_url": final, "body": "", "not_modified": True, "etag": etag, "last_modified": last_modified, "error": None}
        charset = info.get_content_charset() or "utf-8"
        return row | {"http_status": status, "final_url": final, "content_type": info.get("Content-Type"), "body": body.decode(charset, "replace"), "etag": info.get("ETag"), "last_modified": info.get("Last-Modified"), "error": None}
    return row


def fetch_pages(targets: DataFrame, delay: float = DELAY, partitions: int = 64) -> DataFrame:
    """The pages of ``targets`` (url, etag, last_modified).  A domain's targets share a partition and wait for one another."""
    rows = targets.withColumn("domain", normalized_domain(F.col("url"))).repartition(partitions, "domain").sortWithinPartitions("domain", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                wait = last.get(r.domain, -delay) + delay - time.monotonic() if r.domain in last else 0
                if wait > 0:
                    time.sleep(wait)
                out.append(fetch(r.url, r.etag or None, r.last_modified or None))
                last[r.domain] = time.monotonic()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGE.split(", ")])

    return rows.mapInPandas(run, PAGE)
