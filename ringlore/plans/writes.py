"""What a batch of input does to a stored table: old table and batch in, new table out.

Every function is pure, so a batch that is replayed gives the same table again wherever the rule allows it; the tables that
only grow get the rows to append.  ``at`` is the moment of the write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phone import normalized
from ..functions.urls import normalized_url
from ..operators.merge import insert_new, merge
from ..operators.top import greatest_per
from ..rules import SPAM_CATEGORIES

#: How a source begins that nobody configured, by who brings it in.
STARTING_TRUST = {"config": None, "discovery": "MEDIUM", "dataset": "MEDIUM", "user": "HIGH"}


# -- targets and sources ------------------------------------------------------------------------------------------


def upserted_targets(stored: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """Targets after a batch of found pages (source_id, url, priority): one row for each normalized address.

    What is stored first stays but for the moment of its update; of a new address met twice the least url is put in.
    """
    batch = greatest_per(found.withColumn("normalized_url", normalized_url(F.col("url"))), ["normalized_url"], [F.col("url"), F.col("source_id"), F.col("priority").desc()])
    batch = batch.withColumns({"crawl_status": F.lit("PENDING"), "updated_at": at})
    return merge(stored, batch, ["normalized_url"], {"url": "first", "source_id": "first", "priority": "first", "crawl_status": "first", "updated_at": "last"})


def targets_after_results(stored: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Targets after their pages were fetched: ``results`` (id, crawl_status, http_status, content_hash, etag, last_modified), one a target.

    Status and hash are overwritten even by nothing, as by an unchanged page; validators stay unless new ones came.
    """
    fields = ("crawl_status", "http_status", "content_hash", "etag", "last_modified")
    new = results.select("id", *[F.col(c).alias(f"_n_{c}") for c in fields], F.lit(True).alias("_got"))
    rows = stored.join(new, "id", "left").withColumn("_got", F.coalesce("_got", F.lit(False)))
    kept = {c: F.when(F.col("_got"), F.coalesce(F.col(f"_n_{c}"), F.col(c)) if c in ("etag", "last_modified") else F.col(f"_n_{c}")).otherwise(F.col(c)) for c in fields}
    times = {c: F.when(F.col("_got"), at).otherwise(F.col(c)) for c in ("last_crawled_at", "updated_at")}
    tries = F.col("attempt_count") + F.col("_got").cast("int")
    return rows.withColumns(kept | times | {"attempt_count": tries}).select(*stored.columns)


def upserted_sources(stored: DataFrame, batch: DataFrame, by: str, at: Column) -> DataFrame:
    """Sources by name after a batch (name, base_url, source_type, trust_level, crawl_policy).

    A configuration sets address, trust and policy of what is there; what a discovery, a dataset or a user brings in is only
    put in, at the trust that it starts with.
    """
    if by not in STARTING_TRUST:
        raise ValueError(f"no such way in: {by}")
    if STARTING_TRUST[by]:
        batch = batch.withColumn("trust_level", F.lit(STARTING_TRUST[by]))
    rule = "overwrite" if by == "config" else "first"
    batch = greatest_per(batch, ["name"], [F.col("base_url")]).withColumn("updated_at", at)
    renewed = "first" if by == "user" else "last"  # a user's source is only looked up
    return merge(stored, batch, ["name"], {"base_url": rule, "source_type": "first", "trust_level": rule, "crawl_policy": rule, "updated_at": renewed})


# -- ledgers ------------------------------------------------------------------------------------------------------


def registered_datasets(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """(checksum, ...): incoming files as the ledger knows them, those not known yet as PENDING; one row a checksum.

    Only what ended in SUCCESS is skipped, so ``to_run`` holds for a file that failed or never ended.
    """
    known = greatest_per(ledger, ["checksum"], [F.col("status") == "SUCCESS", F.col("id")]).select("checksum", F.col("id").alias("known_id"), F.col("status").alias("known_status"))
    files = greatest_per(incoming.select("checksum", "name"), ["checksum"], [F.col("name")])
    out = files.join(known, "checksum", "left")
    status = F.coalesce("known_status", F.lit("PENDING"))
    return out.select("checksum", "name", F.col("known_id").alias("dataset_id"), status.alias("status"), (status != "SUCCESS").alias("to_run"))


def datasets_after_run(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger after runs (id, processed_rows, status)."""
    new = outcomes.select("id", F.col("processed_rows").alias("_rows"), F.col("status").alias("_status"))
    rows = ledger.join(new, "id", "left")
    return rows.withColumns({"processed_rows": F.coalesce("_rows", "processed_rows"), "status": F.coalesce("_status", "status")}).select(*ledger.columns)


def discovery_runs(report: DataFrame, robots: DataFrame, at: Column) -> DataFrame:
    """Rows for the ledger of discoveries out of a report (base_url, counts, status) and what was met (base_url, robots_found, sitemaps_found, error_message)."""
    domain = F.regexp_extract(F.regexp_replace("base_url", "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "^([^/?#]*)", 1)
    out = report.join(robots, "base_url", "left").withColumn("domain", F.lower(domain))
    return out.select(
        "domain", F.coalesce("robots_found", F.lit(False)).alias("robots_found"), F.coalesce("sitemaps_found", F.lit(0)).cast("bigint").alias("sitemaps_found"),
        "urls_discovered", "urls_high_priority", F.col("urls_queued").cast("bigint").alias("urls_queued"), "status", "error_message", at.alias("finished_at"),
    )


# -- reports, calls and numbers -----------------------------------------------------------------------------------


def submitted_reports(batch: DataFrame, at: Column) -> DataFrame:
    """Spam reports to append: those on a usable number, under SPAM where no category is said."""
    n = normalized(F.col("phone_raw"))
    rows = batch.withColumn("phone_normalized", n["normalized"]).where("phone_normalized IS NOT NULL")
    return rows.select("id", "phone_raw", "phone_normalized", F.coalesce("category", F.lit("SPAM")).alias("category"), "note", "reporter_ref", at.alias("reported_at"))


def imported_calls(batch: DataFrame, call_date: Column, notes: Column, at: Column) -> DataFrame:
    """Call-log rows to append: all of a batch, one call where no count above none is said; an entry's own note stands before the batch's."""
    count = F.when(F.col("call_count") > 0, F.col("call_count")).otherwise(1)
    return batch.select("id", "phone_raw", normalized(F.col("phone_raw"))["normalized"].alias("phone_normalized"), call_date.alias("call_date"), count.alias("call_count"), F.coalesce("notes", notes).alias("notes"), at.alias("imported_at"))


def call_batch_errors(call_date: str, entries: int, category: str | None = None, enabled: object = None) -> list[str]:
    """What is wrong with a request: its date, its emptiness, its category, its switch."""
    import re

    checks = {
        "date": re.fullmatch(r"\d{4}-\d{2}-\d{2}", call_date or "") is not None, "entries": entries > 0,
        "category": category is None or category in SPAM_CATEGORIES, "enabled": enabled is None or isinstance(enabled, bool),
    }
    return [name for name, good in checks.items() if not good]


def valid_reports(batch: DataFrame) -> DataFrame:
    """Reports whose number is there and whose category, if said, is one of the closed list."""
    return batch.where((F.trim(F.coalesce("phone_raw", F.lit(""))) != "") & (F.col("category").isNull() | F.col("category").isin(*SPAM_CATEGORIES)))


def suppressed(stored: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """Suppressed numbers after a batch (phone_raw, reason): the reason is overwritten, the moment of the first stays."""
    rows = batch.withColumn("phone_normalized", normalized(F.col("phone_raw"))["normalized"]).where("phone_normalized IS NOT NULL")
    rows = greatest_per(rows, ["phone_normalized"], [F.col("reason").desc_nulls_last()]).withColumn("created_at", at)
    return merge(stored, rows, ["phone_normalized"], {"reason": "overwrite", "created_at": "first"})


def unsuppressed(stored: DataFrame, batch: DataFrame) -> DataFrame:
    gone = batch.select(normalized(F.col("phone_raw"))["normalized"].alias("phone_normalized"))
    return stored.join(gone, "phone_normalized", "left_anti")


def suppressions_newest_first(stored: DataFrame) -> DataFrame:
    return stored.orderBy(F.col("created_at").desc(), "phone_normalized")


def suppression_status(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (phone_raw) with its number and whether that is suppressed."""
    rows = asked.select("phone_raw", normalized(F.col("phone_raw"))["normalized"].alias("phone_normalized"))
    marks = stored.select("phone_normalized", F.lit(True).alias("suppressed"))
    return rows.join(marks, "phone_normalized", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def set_settings(stored: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """Settings (key, value as JSON) after a batch."""
    return merge(stored, batch.withColumn("updated_at", at), ["key"], {"value": "overwrite", "updated_at": "overwrite"})


def settings_or_default(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """The value of every asked key (key, default), its default where nothing is stored."""
    return defaults.join(stored.select("key", "value", F.lit(True).alias("_set")), "key", "left").select("key", F.when(F.col("_set"), F.col("value")).otherwise(F.col("default")).alias("value"))


def appended_metrics(stored: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Host metrics after a batch; a snapshot that is delivered again is put in once."""
    return stored.unionByName(insert_new(stored, snapshots, ["event_id"]).select(*stored.columns))


# -- text reports -------------------------------------------------------------------------------------------------


def text_report(row: DataFrame, title: str) -> DataFrame:
    """A row of figures as lines of text, ``name: value`` in the order of its columns, under a title."""
    shown = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in row.columns]
    return row.select(F.posexplode(F.array(F.lit(title), *shown)).alias("line_no", "line"))
