"""Sitemaps and robots rules: parsing errors are values, resolution is a bounded loop of joins."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import SITEMAP_PATHS

DEPTH = 3
_PACKED, _LOCAL = b"\x1f\x8b", re.compile(r"^\{.*\}")
PARSED = "struct<urls:array<string>,nested:array<string>,error:string>"


#: The roots that are read, and which list their addresses belong to.
_LISTS = {"urlset": "urls", "sitemapindex": "nested"}


def parse_sitemap(body: bytes | None) -> dict:
    """The addresses of a sitemap, or the sitemaps of an index, packed or not, read event by event; a fault is a value."""
    out: dict = {"urls": [], "nested": [], "error": None}
    if body is None:
        return out | {"error": "missing"}
    stream = io.BytesIO(body)
    into: list[str] | None = None
    try:
        for event, node in ElementTree.iterparse(gzip.open(stream) if body.startswith(_PACKED) else stream, events=("start", "end")):
            name = _LOCAL.sub("", node.tag)
            if into is None:
                if name not in _LISTS:
                    return out | {"error": f"a sitemap cannot begin with <{name}>"}
                into = out[_LISTS[name]]
            elif event == "end":
                if name == "loc" and (said := (node.text or "").strip()):
                    into.append(said)
                node.clear()
    except (ElementTree.ParseError, OSError, EOFError, zlib.error) as fault:
        return {"urls": [], "nested": [], "error": f"unreadable: {fault}"}
    return out


def parsed(body: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for bodies in batches:
            yield pd.DataFrame([parse_sitemap(b) for b in bodies], columns=["urls", "nested", "error"])

    return F.pandas_udf(run, PARSED)(body)


def robots_sitemaps(robots: Column) -> Column:
    """The sitemaps that a robots file names, in order."""
    return F.regexp_extract_all(robots, F.lit(r"(?im)^sitemap:\s*(\S+)"), F.lit(1))


def starting_points(sites: DataFrame) -> DataFrame:
    """(base_url, sitemap) of sites (base_url, robots): the named sitemaps, or else the usual paths."""
    named = robots_sitemaps(F.coalesce("robots", F.lit("")))
    usual = F.array(*[F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit(p)) for p in SITEMAP_PATHS])
    return sites.select("base_url", F.explode(F.array_distinct(F.when(F.size(named) > 0, named).otherwise(usual))).alias("sitemap"))


def resolve(start: DataFrame, pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(base_url, sitemap, url, error, place): every address reached from ``start`` over fetched ``pages`` (url, body), once a site.

    Each round joins the sitemaps found so far with the fetched pages; a sitemap is read once for each site.  ``place``
    orders a site's addresses as they were met: by round, by sitemap, by line; an address met again keeps its first place.
    """
    fetched = pages.select(F.col("url").alias("sitemap"), parsed(F.col("body")).alias("p"))
    seen = front = start.select("base_url", "sitemap").distinct()
    out = None
    for k in range(depth + 1):
        read = front.join(fetched, "sitemap", "left")
        rows = read.select("base_url", "sitemap", F.posexplode_outer("p.urls").alias("line", "url"), F.coalesce("p.error", F.when(F.col("p").isNull(), F.lit("missing"))).alias("error"))
        rows = rows.where("url IS NOT NULL OR error IS NOT NULL").withColumn("place", F.struct(F.lit(k).alias("round"), "sitemap", F.coalesce("line", F.lit(-1)).alias("line"))).drop("line")
        out = rows if out is None else out.unionByName(rows)
        front = read.select("base_url", F.explode("p.nested").alias("sitemap")).distinct().join(seen, ["base_url", "sitemap"], "left_anti")
        seen = seen.unionByName(front)
    first = out.where("url IS NOT NULL").groupBy("base_url", "url").agg(F.min_by("sitemap", "place").alias("sitemap"), F.min("place").alias("place"))
    faults = out.where("error IS NOT NULL").select("base_url", F.lit(None).cast("string").alias("url"), "sitemap", "error", "place")
    return first.withColumn("error", F.lit(None).cast("string")).unionByName(faults.select("base_url", "url", "sitemap", "place", "error"))


def allowed(status: int | None, body: str | None, agent: str, url: str) -> bool:
    """Whether a robots answer lets ``agent`` fetch ``url``: refusals and network errors forbid all, other errors nothing."""
    if status is None or status in (401, 403):
        return False
    if status >= 400:
        return True
    rules = RobotFileParser()
    rules.parse((body or "").splitlines())
    return rules.can_fetch(agent, url)


def with_permission(targets: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``targets`` (domain, url, ...) with ``allowed``, by the robots answers (domain, status, body) of their domains."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for status, body, url in batches:
            yield pd.Series([allowed(None if pd.isna(s) else int(s), b, agent, u) for s, b, u in zip(status, body, url)], dtype=bool)

    rows = targets.join(robots.select("domain", F.col("status").alias("_status"), F.col("body").alias("_body")), "domain", "left")
    return rows.withColumn("allowed", F.pandas_udf(run, "boolean")("_status", "_body", "url")).drop("_status", "_body")
