"""Whole jobs put together from the operators: crawling targets, discovering a domain, taking in a dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import changed_documents
from ..sources import files, sitemaps, web
from . import ingest, writes


def crawled(targets: DataFrame, stored: DataFrame, at: Column, fetch: Callable[[DataFrame], DataFrame] = web.fetch_pages) -> dict[str, DataFrame]:
    """What crawling ``targets`` (id, source_id, url, etag, last_modified) writes beside the ``stored`` documents.

    An unchanged page only updates its target; a page whose hash is that of the target's latest document is not put in
    again; a new one is a document, from which numbers are extracted.  ``fetch`` is evaluated once.
    """
    pages = fetch(targets.select("url", "etag", "last_modified")).persist()
    met = targets.select(F.col("id").alias("crawl_target_id"), "source_id", "url").join(pages, "url")
    good = F.col("error").isNull() & (F.col("not_modified") | (F.col("http_status") < 400))
    hashed = met.withColumn("content_hash", F.when(F.col("error").isNull() & ~F.col("not_modified"), F.sha2("body", 256)))
    results = hashed.select(F.col("crawl_target_id").alias("id"), F.when(good, "SUCCESS").otherwise("FAILED").alias("crawl_status"), "http_status", "content_hash", "etag", "last_modified")
    read = ingest.documents_of(hashed.where("content_hash IS NOT NULL AND http_status < 400")).drop("content_hash")
    fresh = hashed.where("content_hash IS NOT NULL AND http_status < 400").select("crawl_target_id", "source_id", "url", "content_hash")
    fresh = changed_documents(stored.select("crawl_target_id", "content_hash", F.struct("created_at", "id").alias("_at")), fresh, "crawl_target_id", "content_hash", "_at")
    documents = fresh.join(read, "url").withColumn("id", F.sha2(F.concat_ws("|", "crawl_target_id", "content_hash", at.cast("string")), 256)).withColumn("created_at", at)
    found = ingest.page_observations(documents.select(F.col("id").alias("raw_document_id"), "raw_content")).drop("raw_content").withColumn("discovered_at", at)
    return {"results": results, "raw_documents": documents, "phone_observations": found}


def discovered(domains: DataFrame, robots: DataFrame, pages: DataFrame, at: Column, most: int = 500) -> dict[str, DataFrame]:
    """What the discovery of ``domains`` (base_url, name) writes: sources at MEDIUM, queued targets, and a row for the ledger.

    ``robots`` (base_url, robots) are the answers of the domains, ``pages`` (url, body) their fetched sitemaps.
    """
    sites = domains.select("base_url").distinct().join(robots, "base_url", "left")
    found = sitemaps.resolve(sitemaps.starting_points(sites), pages)
    report = ingest.discovery(found, most)
    read = found.groupBy("base_url").agg(F.count_distinct(F.when(F.col("url").isNotNull(), F.col("sitemap"))).alias("sitemaps_found"), F.concat_ws("; ", F.array_sort(F.collect_set("error"))).alias("error_message"))
    met = sites.select("base_url", F.col("robots").isNotNull().alias("robots_found")).join(read, "base_url", "left")
    sources = domains.select("name", "base_url", F.lit("OFFICIAL_WEBSITE").alias("source_type"), F.lit("MEDIUM").alias("trust_level"), F.lit(None).cast("string").alias("crawl_policy"))
    return {"data_sources": sources, "queued": ingest.queued_urls(found, most), "report": report, "domain_discoveries": writes.discovery_runs(report, met, at)}


def ingested(spark: SparkSession, path: str, ledger: DataFrame) -> dict:
    """Takes in a bulk file, unless its checksum ended in SUCCESS before.

    The outcome's status is ALREADY_INGESTED, FAILED (no column of numbers) or SUCCESS; then ``observations`` holds what was found.
    """
    content = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("checksum"), F.element_at(F.split("path", "/"), -1).alias("name"))
    entry = writes.registered_datasets(ledger, content).head()  # one file
    out = {"checksum": entry["checksum"], "dataset_id": entry["dataset_id"], "rows": 0, "status": "ALREADY_INGESTED", "observations": None}
    if not entry["to_run"]:
        return out
    rows = files.read_dataset(spark, path)
    try:
        observations = ingest.dataset_observations(rows, entry["checksum"])
    except ValueError:
        return out | {"status": "FAILED"}
    return out | {"status": "SUCCESS", "rows": rows.count(), "observations": observations}
