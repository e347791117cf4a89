"""What every source of pages offers, whatever it reads: a table of addresses, of pages, of what they say."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_candidates, page_title
from . import sitemaps, web


class Collector(Protocol):
    """A way to collect a kind of source; all four steps take a table and give one."""

    def discover_urls(self, sites: DataFrame) -> DataFrame: ...

    def fetch(self, targets: DataFrame) -> DataFrame: ...

    def parse(self, pages: DataFrame) -> DataFrame: ...

    def extract_metadata(self, pages: DataFrame) -> DataFrame: ...


class HttpCollector:
    """Pages over HTTP; ``get`` fetches a table of targets (url, etag, last_modified)."""

    def __init__(self, get: Callable[[DataFrame], DataFrame] = web.fetch_pages) -> None:
        self.get = get

    def discover_urls(self, sites: DataFrame) -> DataFrame:
        """(base_url, url) out of the sitemaps of ``sites`` (base_url, robots), fetched round by round."""
        front = sitemaps.starting_points(sites)
        pages = None
        for _ in range(sitemaps.DEPTH + 1):
            asked = front.select(F.col("sitemap").alias("url"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified")).distinct()
            got = self.get(asked).select("url", F.encode("body", "UTF-8").alias("body"))
            pages = got if pages is None else pages.unionByName(got)
            nested = got.select("url", F.explode(sitemaps.parsed(F.col("body"))["nested"]).alias("next"))
            front = front.join(nested.withColumnRenamed("url", "sitemap"), "sitemap").select("base_url", F.col("next").alias("sitemap")).distinct()
        return sitemaps.resolve(sitemaps.starting_points(sites), pages.dropDuplicates(["url"]))

    def fetch(self, targets: DataFrame) -> DataFrame:
        return self.get(targets)

    def parse(self, pages: DataFrame) -> DataFrame:
        """The candidates of fetched pages (url, body)."""
        return html_candidates(pages.select("url", F.col("body").alias("raw_content")), "raw_content").drop("raw_content")

    def extract_metadata(self, pages: DataFrame) -> DataFrame:
        return pages.select("url", page_title(F.col("body")).alias("title"), "content_type", "http_status")


class DirectoryCollector(HttpCollector):
    """Business directories: nothing of their own so far."""


class OfficialCollector(HttpCollector):
    """Official sites: nothing of their own so far."""


COLLECTORS: dict[str, type[HttpCollector]] = {"http": HttpCollector, "directory": DirectoryCollector, "official": OfficialCollector}


def collector(kind: str) -> HttpCollector:
    if kind not in COLLECTORS:
        raise ValueError(f"no such collector: {kind}")
    return COLLECTORS[kind]()
