"""From files, pages and confirmed entries to documents, observations, numbers and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import with_once
from ..functions.identity import name_key
from ..functions.phone import confirmed_national_number, normalized
from ..functions.text import html_candidates, page_title
from ..functions.urls import phone_columns, url_score
from ..operators.merge import insert_new, merge
from ..rules import USER_CONFIRMED

ROW_CONFIDENCE, CONFIRMED = 0.85, 95


def dataset_documents(rows: DataFrame, dataset: str) -> DataFrame:
    """The rows of a dataset and, for each, its document: its content as JSON and a hash that equal rows do not share.

    Equal rows are counted and numbered, so a hash does not depend on how the file was read, and a row that stands a million
    times costs one row of the shuffle.
    """
    held = rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count("*").alias("_n"))
    held = held.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).drop("_n")
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    held = held.withColumn("raw_content", body)
    return held.withColumn("content_hash", F.sha2(F.concat_ws(":", F.lit(dataset), F.col("_copy").cast("string"), "raw_content"), 256))


def dataset_observations(rows: DataFrame, dataset: str) -> DataFrame:
    """One observation for each phone cell that is not empty; the other cells are its context, the row its document.

    A null cell gives no observation.
    """
    columns = phone_columns(rows.sparkSession, rows.columns)
    if not columns:
        raise ValueError("no phone column is named")
    others = [c for c in rows.columns if c not in columns]
    context = F.concat_ws(", ", *[F.when(F.col(f"`{c}`") != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in others]) if others else F.lit("")
    cells = F.array(*[F.trim(F.col(f"`{c}`").cast("string")) for c in columns])
    out = dataset_documents(rows, dataset).select("content_hash", "raw_content", context.alias("context_text"), F.explode(cells).alias("phone_raw")).where("phone_raw <> ''")
    out = with_once(out, "_n", normalized(F.col("phone_raw")))
    return out.select(
        "content_hash", "raw_content", "phone_raw", F.col("_n.normalized").alias("phone_normalized"), F.col("_n.type").alias("phone_type"), "context_text",
        F.lit("").alias("context_before"), F.col("context_text").alias("context_after"), F.lit("DATASET_ROW").alias("extraction_method"), F.lit(ROW_CONFIDENCE).cast("decimal(5,4)").alias("confidence"),
    )


def new_datasets(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """Datasets (checksum, ...) that have not been ingested with success."""
    return insert_new(ledger.where("status = 'SUCCESS'"), incoming, ["checksum"])


def page_observations(pages: DataFrame, html: str = "raw_content") -> DataFrame:
    """Every candidate of every page with its normalized number."""
    n = normalized(F.col("phone_raw"))
    return html_candidates(pages, html).withColumn("phone_normalized", n["normalized"]).withColumn("phone_type", n["type"])


def unextracted(documents: DataFrame, observations: DataFrame) -> DataFrame:
    """Documents from which nothing was extracted yet: extraction runs at most once for each."""
    return documents.join(observations.select(F.col("raw_document_id").alias("id")), "id", "left_anti")


def merged_numbers(stored: DataFrame, observations: DataFrame) -> DataFrame:
    """Stored numbers after a batch of observations: sightings add up, the first time stays, the latest type wins.

    Of types seen at one moment the greatest wins, so a batch gives one result however its rows stand.
    """
    batch = observations.where("phone_normalized IS NOT NULL").groupBy(F.col("phone_normalized").alias("phone_e164")).agg(
        F.count("*").alias("observation_count"), F.min("discovered_at").alias("first_seen_at"), F.max("discovered_at").alias("last_seen_at"),
        F.max_by("phone_type", F.struct("discovered_at", "phone_type")).alias("phone_type"),
    )
    return merge(stored, batch, ["phone_e164"], {"observation_count": "sum", "first_seen_at": "min", "last_seen_at": "max", "phone_type": "last"})


def merged_claims(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored claims after a run of the rules: a category is kept unless a new one is found, names never change."""
    return merge(stored, batch, list(CLAIM), {"display_name": "first", "identity_type": "first", "status": "first", "first_seen_at": "first", "category": "last", "evidence_count": "overwrite", "confidence": "overwrite", "last_seen_at": "overwrite"})


#: What is unique among claims.
CLAIM = ("phone_normalized", "name_key", "claim_source")


def linked_evidence(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Links of claims to observations after a batch; a link that is there already is ignored, none is ever taken away."""
    keys = [*CLAIM, "phone_observation_id"]
    return stored.select(*keys).unionByName(insert_new(stored, batch, keys).select(*keys))


def recounted(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claims`` with ``evidence_count`` counted anew from the links."""
    n = evidence.groupBy(*CLAIM).agg(F.count("*").alias("evidence_count"))
    return claims.drop("evidence_count").join(n, list(CLAIM), "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))


def confirmed(entries: DataFrame, at: Column) -> dict[str, DataFrame]:
    """What a batch of user-confirmed entries (entry_no, phone_raw, display_name, identity_type, category, note_source) writes.

    Every usable entry is a document and an observation of its own, numbered within the batch, so a batch that is replayed at
    the same moment writes the same rows.  Entries for one claim come in their order: the first names it, the last sets its category.
    """
    rows = with_once(entries, "_n", normalized(F.col("phone_raw"))).withColumn("phone_normalized", F.col("_n.normalized")).withColumn("phone_type", F.col("_n.type")).where("phone_normalized IS NOT NULL")
    said = F.concat(F.lit("phone="), "phone_raw", F.lit(" display_name="), "display_name", F.lit(" note_source="), F.coalesce("note_source", F.lit("unknown")))
    rows = rows.withColumns({"raw_content": said, "at": at, "name_key": name_key(F.col("display_name")), "claim_source": F.lit(USER_CONFIRMED)})
    rows = rows.withColumn("phone_observation_id", F.sha2(F.concat_ws("|", F.col("at").cast("string"), F.col("entry_no").cast("string"), "raw_content"), 256))
    documents = rows.select(
        "phone_observation_id", F.concat(F.lit("manual://user-confirmed/"), "phone_normalized", F.lit("/"), F.unix_millis(F.col("at").cast("timestamp")).cast("string")).alias("url"),
        F.lit("text/plain").alias("content_type"), F.lit(200).alias("http_status"), F.sha2("raw_content", 256).alias("content_hash"), "raw_content", F.col("at").alias("fetched_at"),
    )
    observed = rows.select(
        "phone_observation_id", "phone_raw", "phone_normalized", "phone_type", F.col("display_name").alias("context_text"), F.lit("user_confirmed_manual").alias("extraction_method"),
        F.lit(1).cast("decimal(5,4)").alias("confidence"), F.lit(0).alias("position_start"), F.length("phone_raw").alias("position_end"), F.col("at").alias("discovered_at"),
    )
    claim = rows.groupBy(*CLAIM).agg(
        F.min_by("display_name", "entry_no").alias("display_name"), F.min_by(F.coalesce("identity_type", F.lit("UNKNOWN")), "entry_no").alias("identity_type"), F.max_by("category", "entry_no").alias("category"),
        F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"),
    )
    claim = claim.withColumn("confidence", F.lit(float(CONFIRMED))).withColumn("status", F.lit("CONFIRMED"))
    return {"raw_documents": documents, "phone_observations": observed, "phone_identities": claim, "phone_identity_evidence": rows.select(*CLAIM, "phone_observation_id")}


def numbers_after_confirmation(stored: DataFrame, known: DataFrame, observed: DataFrame) -> DataFrame:
    """Stored numbers after confirmed observations, those ``known`` already not counted again: the type of a stored number stays."""
    new = observed.join(known.select("phone_observation_id"), "phone_observation_id", "left_anti")
    batch = new.groupBy(F.col("phone_normalized").alias("phone_e164")).agg(
        F.count("*").alias("observation_count"), F.min("discovered_at").alias("first_seen_at"), F.max("discovered_at").alias("last_seen_at"), F.first("phone_type").alias("phone_type")
    ).withColumn("national_number", confirmed_national_number(F.col("phone_e164")))
    return merge(stored, batch, ["phone_e164"], {"observation_count": "sum", "first_seen_at": "first", "last_seen_at": "last", "phone_type": "first", "national_number": "first"})


def identities_after_confirmation(stored: DataFrame, batch: dict[str, DataFrame], evidence: DataFrame) -> DataFrame:
    """Stored confirmed claims after a batch: the category is overwritten even by none, evidence is counted from the links."""
    merged = merge(stored, batch["phone_identities"], list(CLAIM), {"display_name": "first", "identity_type": "first", "status": "first", "confidence": "first", "first_seen_at": "first", "category": "overwrite", "last_seen_at": "overwrite"})
    return recounted(merged, evidence)


def scored(found: DataFrame) -> DataFrame:
    """(base_url, url, score, place) of each address that was found, once a site; ``place`` is null where none is known."""
    place = F.min("place") if "place" in found.columns else F.lit(None).cast("int")
    return found.where("url IS NOT NULL").groupBy("base_url", "url").agg(place.alias("place")).withColumn("score", url_score(F.col("url")))


def queued_urls(found: DataFrame, most: int = 500) -> DataFrame:
    """The addresses of each site that are queued: the best first, as they were met among equals, and no more than ``most``."""
    order = [F.col("score").desc(), F.col("place"), F.col("url")]
    ranked = scored(found).where("score >= 1").withColumn("rank", F.row_number().over(Window.partitionBy("base_url").orderBy(*order)))
    return ranked.where(F.col("rank") <= most).select("base_url", "url", F.col("score").alias("priority"), "rank")


def discovery(found: DataFrame, queued: int = 500) -> DataFrame:
    """A discovery report for each site of ``found`` (base_url, url, error): counts, and how it ended."""
    rows = scored(found)
    wrong = found.where("error IS NOT NULL").groupBy("base_url").agg(F.count("*").alias("errors"))
    good = rows.groupBy("base_url").agg(F.count("*").alias("urls_discovered"), F.count_if(F.col("score") >= 80).alias("urls_high_priority"), F.least(F.count_if(F.col("score") >= 1), F.lit(queued)).alias("urls_queued"))
    out = good.join(wrong, "base_url", "full_outer").na.fill(0)
    return out.withColumn("status", F.when(F.col("errors") == 0, "SUCCESS").when(F.col("urls_discovered") > 0, "PARTIAL").otherwise("FAILED"))


def documents_of(pages: DataFrame) -> DataFrame:
    """Fetched pages as raw documents."""
    kept = pages.where("NOT not_modified AND error IS NULL")
    return kept.select("url", "final_url", page_title(F.col("body")).alias("title"), "content_type", "http_status", F.sha2("body", 256).alias("content_hash"), F.col("body").alias("raw_content"), "fetched_at")
