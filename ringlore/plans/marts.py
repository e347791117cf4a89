"""The composite queries over the data model.  ``as_of`` stands for the present; every tie has an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as idf
from ..functions.binding import with_once
from ..functions.display import load_band, used_percent
from ..functions.phone import digits_only, normalized
from ..operators.merge import merge
from ..operators.top import greatest_per, top
from ..rules import ACTIVE_STATUSES, FREQUENCY_DAYS, HORIZON_HOURS, JOB_STATUSES, OFFICIAL_TYPES, RULES, WINDOW_HOURS

AS_OF = "2025-07-01 00:00:00"
AS_OF_JOBS = "1999-01-01 00:00:00"
AS_OF_METRICS = "2024-01-20 00:00:00"


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def before(at: Column, interval: str) -> Column:
    return at - F.expr(f"INTERVAL {interval}")


# -- observations and numbers -------------------------------------------------------------------------------------


def evidence_rows(observations: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Observations with a number, and the source behind each.  No side is marked for broadcast: statistics decide by size."""
    docs = documents.select(F.col("id").alias("raw_document_id"), "source_id")
    srcs = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_type", "trust_level")
    rows = observations.where("phone_normalized IS NOT NULL").select("id", "raw_document_id", "phone_normalized", "context_text", "context_before", "context_after", "discovered_at")
    return rows.join(docs, "raw_document_id").join(srcs, "source_id")


def number_rollup(observations: DataFrame) -> DataFrame:
    """Canonical numbers as the aggregate of their sightings; the type is that of the latest one."""
    kind = normalized(F.col("phone_raw"))["type"]
    rows = observations.where("phone_normalized IS NOT NULL").withColumn("kind", kind)
    return rows.groupBy(F.col("phone_normalized").alias("phone_e164")).agg(
        F.count("*").alias("observation_count"), F.min("discovered_at").alias("first_seen_at"), F.max("discovered_at").alias("last_seen_at"),
        F.max_by("kind", F.struct("discovered_at", "id")).alias("phone_type"),
    )


def identities_after_run(numbers: DataFrame, identities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stored identities after a run of the rules: each claim is put in, or renews the stored row of its number, name and rule.

    A category stays unless a new one is found; names, type, status and first sighting never change.
    """
    stored = numbers.select(F.col("id").alias("phone_number_id"), F.col("phone_e164").alias("phone_normalized")).join(identities, "phone_number_id")
    stored = stored.withColumn("name_key", F.col("normalized_name")).withColumn("confidence", F.col("confidence").cast("double")).withColumn("evidence_count", F.col("evidence_count").cast("bigint"))
    found = claims(evidence, numbers).withColumns({"claim_source": F.lit(RULES), "status": F.lit("CANDIDATE"), "confidence": F.col("score").cast("double")})
    return merge(stored, found, ["phone_normalized", "name_key", "claim_source"], {
        "display_name": "first", "identity_type": "first", "status": "first", "first_seen_at": "first", "category": "last",
        "confidence": "last", "evidence_count": "last", "last_seen_at": "last",
    })


def trusted_identities(numbers: DataFrame, identities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Identities of mobile and landline numbers that aren't rejected and whose own evidence stands in a trusted source.

    A sighting is evidence of the claim that the rules make of it, so another identity of the same number gains nothing by it.
    """
    callable_ = numbers.where(F.col("phone_type").isin("MOBILE", "LANDLINE")).select(F.col("phone_e164").alias("phone_normalized"))
    proof = guesses(evidence.where("trust_level = 'HIGH' AND NOT source_name LIKE 'Fixture%'")).select("phone_normalized", "name_key", F.lit(RULES).alias("claim_source"))
    rows = identities_after_run(numbers, identities, evidence).where("status <> 'REJECTED'")
    return rows.join(callable_, "phone_normalized", "left_semi").join(proof, ["phone_normalized", "name_key", "claim_source"], "left_semi")


def production_numbers(numbers: DataFrame, identities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Numbers with a trusted identity."""
    trusted = trusted_identities(numbers, identities, evidence).select(F.col("phone_normalized").alias("phone_e164"))
    return numbers.join(trusted, "phone_e164", "left_semi")


# -- claims -------------------------------------------------------------------------------------------------------


def guesses(evidence: DataFrame) -> DataFrame:
    """For each sighting the identity that its context suggests."""
    company = idf.company_name(F.col("context_before"), F.col("context_after"))
    hotline = idf.is_hotline(F.col("context_text"))
    out = with_once(evidence, "_g", F.struct(company.alias("company"), hotline.alias("hotline"))).select(*evidence.columns, "_g.company", "_g.hotline")
    named = F.when(F.col("company").isNotNull(), F.col("company")).when(F.col("hotline"), F.concat("source_name", F.lit(" Hotline"))).otherwise(F.concat(F.lit("Unknown ("), "source_name", F.lit(")")))
    kind = F.when(F.col("company").isNotNull(), "BUSINESS").when(F.col("hotline"), "HOTLINE").otherwise("UNKNOWN")
    return (
        out.withColumn("display_name", named).withColumn("identity_type", kind).withColumn("name_key", idf.name_key(F.col("display_name")))
        .withColumn("category", idf.category(F.col("context_text"))).withColumn("says_company", idf.names_company(F.col("context_text")))
        .withColumn("high", F.col("trust_level") == "HIGH").withColumn("official", F.col("source_type").isin(*OFFICIAL_TYPES))
    )


def claims(evidence: DataFrame, numbers: DataFrame) -> DataFrame:
    """One claim for each number and name, with its score.  Partial aggregation carries hot numbers; nothing is gathered."""
    known = numbers.select(F.col("phone_e164").alias("phone_normalized"))
    order = F.struct("discovered_at", "id")
    return (
        guesses(evidence).join(known, "phone_normalized", "left_semi").groupBy("phone_normalized", "name_key")
        .agg(
            F.min_by("display_name", order).alias("display_name"), F.min_by("identity_type", order).alias("identity_type"), F.min_by("category", order).alias("category"),
            F.count("*").alias("evidence_count"), F.bool_or("high").alias("high"), F.bool_or("hotline").alias("hotline"), F.bool_or("says_company").alias("company"),
            F.bool_or("official").alias("official"), F.min("discovered_at").alias("first_seen_at"), F.max("discovered_at").alias("last_seen_at"),
        )
        .withColumn("score", idf.score(F.col("high"), F.col("evidence_count"), F.col("hotline"), F.col("company"), F.col("official")))
        .drop("high", "hotline", "company", "official")
    )


def claim_evidence(evidence: DataFrame, numbers: DataFrame) -> DataFrame:
    """The sightings behind each claim."""
    known = numbers.select(F.col("phone_e164").alias("phone_normalized"))
    return guesses(evidence).join(known, "phone_normalized", "left_semi").select("phone_normalized", "name_key", F.col("id").alias("phone_observation_id")).distinct()


def best_identities(numbers: DataFrame, identities: DataFrame) -> DataFrame:
    """The strongest identity of each number that isn't rejected."""
    rows = numbers.select(F.col("id").alias("phone_number_id"), "phone_e164", "phone_type").join(identities.where("status <> 'REJECTED'").withColumnRenamed("id", "identity_id"), "phone_number_id")
    rank = F.when(F.col("status") == "CONFIRMED", 0).otherwise(1)
    order = [F.col("confidence").desc(), rank.asc(), F.col("evidence_count").desc(), F.col("normalized_name"), F.col("identity_id")]
    return greatest_per(rows, ["phone_e164"], order)


# -- spam ---------------------------------------------------------------------------------------------------------


def spam_flags(reports: DataFrame) -> DataFrame:
    """Reports, distinct reporters, risk and most reported category of every reported number; the reports are read once.

    Reports are counted by number, category and reporter first, so a number with very many of them is spread over its reporters.
    """
    rows = reports.where("phone_normalized IS NOT NULL").groupBy("phone_normalized", "category", F.coalesce("reporter_ref", "id").alias("reporter")).agg(F.count("*").alias("n"))
    once = rows.groupBy("phone_normalized", "reporter").agg(F.collect_list(F.struct("category", "n")).alias("c"))  # a reporter's categories are few
    parts = once.select("phone_normalized", F.posexplode("c").alias("k", "c")).select("phone_normalized", "c.category", "c.n", (F.col("k") == 0).cast("int").alias("first"))
    by = parts.groupBy("phone_normalized", "category").agg(F.sum("n").alias("n"), F.sum("first").alias("reporters"))
    out = by.groupBy("phone_normalized").agg(F.sum("n").alias("report_count"), F.sum("reporters").alias("reporter_count"), F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("top_category"))
    return out.withColumn("risk", idf.spam_risk(F.col("reporter_count")))


def spam_breakdown(reports: DataFrame) -> DataFrame:
    return reports.where("phone_normalized IS NOT NULL").groupBy("phone_normalized", "category").agg(F.count("*").alias("report_count"))


def call_directory(numbers: DataFrame, identities: DataFrame, evidence: DataFrame, reports: DataFrame, suppressed: DataFrame) -> DataFrame:
    """The caller directory: the label of every number with a trusted identity or a report that isn't suppressed."""
    strongest = [F.col("confidence").desc(), F.when(F.col("status") == "CONFIRMED", 0).otherwise(1), F.col("evidence_count").desc(), F.col("name_key")]
    best = greatest_per(trusted_identities(numbers, identities, evidence), ["phone_normalized"], strongest)
    best = best.select("phone_normalized", idf.unwrapped_label(F.col("display_name")).alias("name"))
    kind = normalized(F.col("phone_normalized"))["type"]
    flags = spam_flags(reports).where(kind.isin("MOBILE", "LANDLINE"))
    both = best.join(flags, "phone_normalized", "full_outer").join(suppressed.select("phone_normalized"), "phone_normalized", "left_anti")
    word = F.when(F.col("top_category") == "SCAM", "LỪA ĐẢO").otherwise("SPAM")
    warning = F.concat(F.lit("⚠️ Nghi ngờ "), word, F.lit(" ("), F.col("reporter_count").cast("string"), F.lit(" báo cáo)"))
    label = (
        F.when(F.col("reporter_count").isNull(), F.col("name")).when(F.col("name").isNull() | (F.col("reporter_count") >= 10), warning).otherwise(F.concat(F.lit("⚠️ "), F.col("name")))
    )
    return both.select(F.regexp_replace("phone_normalized", r"^\+", "").alias("digits"), label.alias("label"))


def in_number_order(entries: DataFrame) -> DataFrame:
    """Directory entries or blocked numbers in ascending numeric order, as a device takes them."""
    return entries.orderBy(F.col("digits").cast("decimal(20,0)"))


def export_payload(directory: DataFrame, blocked: DataFrame) -> DataFrame:
    """What a device fetches, row by row in the order it takes them: entries to label, numbers to block, and how many entries."""
    n = directory.agg(F.count("*").alias("count"))
    rows = directory.select(F.lit("entries").alias("part"), "digits", "label").unionByName(blocked.select(F.lit("blocked_digits").alias("part"), "digits", F.lit(None).cast("string").alias("label")))
    return rows.join(F.broadcast(n)).orderBy("part", F.col("digits").cast("decimal(20,0)"))  # one row of a count


def by_label(directory: DataFrame) -> DataFrame:
    return directory.orderBy("label", F.col("digits").cast("decimal(20,0)"))


def blocked_digits(reports: DataFrame, suppressed: DataFrame, enabled: bool = True, least: int = 10) -> DataFrame:
    kind = normalized(F.col("phone_normalized"))["type"]
    rows = spam_flags(reports).where((F.col("reporter_count") >= least) & (F.col("top_category") == "SCAM") & kind.isin("MOBILE", "LANDLINE") & F.lit(enabled))
    return rows.join(suppressed.select("phone_normalized"), "phone_normalized", "left_anti").select(F.regexp_replace("phone_normalized", r"^\+", "").alias("digits"))


# -- call log -----------------------------------------------------------------------------------------------------


def call_summary(calls: DataFrame, numbers: DataFrame, identities: DataFrame, since: str, until: str) -> DataFrame:
    """Calls of a period by number, each with the number's best identity."""
    rows = calls.where(F.col("call_date").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    per = rows.groupBy(F.coalesce("phone_normalized", "phone_raw").alias("phone"), "phone_normalized").agg(
        F.max_by("phone_raw", F.struct("imported_at", "id")).alias("phone_raw"), F.sum("call_count").alias("total_calls"), F.count_distinct("call_date").alias("days"),
        F.min("call_date").alias("first_call"), F.max("call_date").alias("last_call"),
    )
    best = best_identities(numbers, identities).select(F.col("phone_e164").alias("phone_normalized"), F.col("display_name").alias("identity_name"), F.col("category").alias("identity_category"))
    return per.join(best, "phone_normalized", "left")


def unknown_numbers(calls: DataFrame, numbers: DataFrame, identities: DataFrame, as_of: str) -> DataFrame:
    """Called numbers without an identity, rejected ones not counted, most urgent first; an unusable number has none."""
    claimed = identities.where("status <> 'REJECTED'").select("phone_number_id")
    known = numbers.select(F.col("id").alias("phone_number_id"), F.col("phone_e164").alias("phone_normalized")).join(claimed, "phone_number_id", "left_semi")
    rows = calls.join(known.select("phone_normalized"), "phone_normalized", "left_anti")
    per = rows.groupBy(F.coalesce("phone_normalized", "phone_raw").alias("phone"), "phone_normalized").agg(
        F.max_by("phone_raw", F.struct("imported_at", "id")).alias("phone_raw"), F.sum("call_count").alias("total_calls"), F.count_distinct("call_date").alias("days"), F.max("call_date").alias("last_call")
    )
    since = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.col("last_call")))
    points = F.least(F.col("total_calls") * 5, F.lit(50)) + F.greatest(F.lit(0), 30 - since) + F.least(F.col("days") * 3, F.lit(20))
    return per.withColumn("priority", F.least(F.lit(100), points).cast("int")).orderBy(F.col("priority").desc(), F.col("total_calls").desc(), "phone")


# -- statistics ---------------------------------------------------------------------------------------------------


def source_performance(sources: DataFrame, documents: DataFrame, observations: DataFrame) -> DataFrame:
    """Every source with its pages, sightings and numbers; counted before the join, so nothing fans out."""
    docs = documents.groupBy("source_id").agg(F.count("*").alias("documents"), F.count_distinct("content_hash").alias("distinct_contents"))
    seen = observations.join(documents.select(F.col("id").alias("raw_document_id"), "source_id"), "raw_document_id").groupBy("source_id").agg(
        F.count("*").alias("observations"), F.count("phone_normalized").alias("normalized"), F.count_distinct("phone_normalized").alias("numbers")
    )
    out = sources.select(F.col("id").alias("source_id"), "name").join(docs, "source_id", "left").join(seen, "source_id", "left").na.fill(0)
    return out.withColumn("yield_per_page", F.when(F.col("documents") == 0, 0.0).otherwise(F.col("observations") / F.col("documents")))


def data_quality(observations: DataFrame, numbers: DataFrame, identities: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of counts and ratios; one pass over each table."""
    a = observations.agg(F.count("*").alias("observations"), F.count_if(F.col("phone_normalized").isNull()).alias("invalid_observations"))
    b = numbers.agg(F.count("*").alias("numbers"), F.count_if(F.col("phone_type") != "UNKNOWN").alias("typed_numbers"), F.count_if(F.col("observation_count") > 3).alias("numbers_often_seen"))
    c = identities.agg(F.count("*").alias("identities"), F.count_if(F.col("status") == "CONFIRMED").alias("confirmed_identities"), F.count_distinct("phone_number_id").alias("identified_numbers"))
    d = documents.agg(F.count("*").alias("documents"), F.count_distinct("content_hash").alias("distinct_contents"))
    out = a.crossJoin(b).crossJoin(c).crossJoin(d)  # four single rows
    ratio = F.when(F.col("documents") == 0, 0.0).otherwise(1 - F.col("distinct_contents") / F.col("documents"))
    return out.withColumn("duplicate_ratio", ratio).withColumn("invalid_ratio", F.when(F.col("observations") == 0, 0.0).otherwise(F.col("invalid_observations") / F.col("observations")))


def top_sources(evidence: DataFrame, n: int = 5) -> DataFrame:
    return top(evidence.groupBy("source_name").agg(F.count("*").alias("observations")), [F.col("observations").desc(), F.col("source_name")], n)


def growth_horizons(numbers: DataFrame, as_of: str, observed_since: str) -> DataFrame:
    """How many numbers there are, and how many came within each horizon and since the observation began; one scan."""
    at = moment(as_of)
    recent = [F.count_if(F.col("first_seen_at") > before(at, f"'{h}' HOUR")).alias(f"last_{h}h") for h in HORIZON_HOURS]
    return numbers.agg(F.count("*").alias("total"), *recent, F.count_if(F.col("first_seen_at") > moment(observed_since)).alias("since_observation"))


def growth_hourly(numbers: DataFrame, as_of: str, hours: int) -> DataFrame:
    rows = numbers.where(F.col("first_seen_at") > before(moment(as_of), f"'{hours}' HOUR"))
    return rows.groupBy(F.date_trunc("hour", "first_seen_at").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("new_numbers"))


# -- jobs and metrics ---------------------------------------------------------------------------------------------


def ended(jobs: DataFrame, status: str, as_of: str, hours: int) -> Column:
    """How many jobs ended in ``status`` within so many hours."""
    return F.count_if((F.col("status") == status) & (F.col("finished_at") > before(moment(as_of), f"'{hours}' HOUR")))


def job_histogram(jobs: DataFrame, as_of: str) -> DataFrame:
    """Jobs by status, the active ones, how those of the last day ended, and when one last began."""
    return jobs.agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in JOB_STATUSES], F.count_if(F.col("status").isin(*ACTIVE_STATUSES)).alias("active"),
        ended(jobs, "SUCCESS", as_of, 24).alias("completed_24h"), ended(jobs, "FAILED", as_of, 24).alias("failed_24h"), F.max("started_at").alias("last_started_at"),
    )


def jobs_summary(jobs: DataFrame, as_of: str) -> DataFrame:
    """Totals by status, what ended lately, and how long the successes of the last day took on average, to a tenth."""
    recent = (F.col("status") == "SUCCESS") & (F.col("finished_at") > before(moment(as_of), "'24' HOUR"))
    took = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")) / 1e6
    states = {"pending": "PENDING", "running": "RUNNING", "completed": "SUCCESS", "failed": "FAILED"}
    return jobs.agg(
        *[F.count_if(F.col("status") == s).alias(n) for n, s in states.items()], *[ended(jobs, "SUCCESS", as_of, h).alias(f"completed_{h}h") for h in (1, 6, 24)],
        *[ended(jobs, "FAILED", as_of, h).alias(f"failed_{h}h") for h in (1, 24)], F.round(F.coalesce(F.avg(F.when(recent, took)), F.lit(0.0)), 1).alias("average_seconds"),
    )


def queue_health(jobs: DataFrame, as_of: str) -> DataFrame:
    """What waits, since when, what runs and failed, and the state of the queue by its length and the age of its oldest job."""
    waits = F.col("status") == "PENDING"
    out = jobs.agg(F.count_if(waits).alias("pending"), F.count_if(F.col("status") == "RUNNING").alias("running"), F.min(F.when(waits, F.col("scheduled_at"))).alias("oldest"), ended(jobs, "FAILED", as_of, 24).alias("failed_24h"))
    out = out.withColumn("oldest_age_seconds", F.timestamp_diff("SECOND", F.col("oldest"), moment(as_of))).drop("oldest")
    minutes = F.coalesce(F.col("oldest_age_seconds") / 60, F.lit(0.0))
    state = F.when((F.col("pending") >= 30) | (minutes >= 180), "CRITICAL").when((F.col("pending") >= 10) | (minutes >= 60), "WARNING").otherwise("HEALTHY")
    return out.withColumn("health", state)


def due_targets(targets: DataFrame, as_of: str, n: int) -> DataFrame:
    due = targets.where((F.col("status") == "active") & (F.col("next_crawl_at") <= moment(as_of)))
    return top(due.select("id", "source_id", "priority", "next_crawl_at"), [F.col("priority").desc(), F.col("next_crawl_at"), F.col("id")], n)


def due_sources(sources: DataFrame, as_of: str) -> DataFrame:
    """Active sources on a schedule whose time has come."""
    return sources.where(F.col("is_active") & (F.col("crawl_frequency") != "MANUAL") & (F.col("next_scheduled_at") <= moment(as_of)))


def next_schedule(sources: DataFrame, as_of: str) -> DataFrame:
    """When each due source is due again, counted from now: what was long overdue does not stay so."""
    days = F.lit(7)
    for word, n in FREQUENCY_DAYS.items():
        days = F.when(F.col("crawl_frequency") == word, n).otherwise(days)
    return due_sources(sources, as_of).select("id", days.alias("days"), F.timestamp_add("DAY", days, moment(as_of)).alias("next_scheduled_at"))


def latest_metric(metrics: DataFrame) -> DataFrame:
    row = F.max_by(F.struct(*metrics.columns), F.struct("recorded_at", "event_id"))
    return metrics.agg(row.alias("r")).select("r.*")


def metric_history(metrics: DataFrame, as_of: str, window: str) -> DataFrame:
    """The snapshots of the last 6, 24 or 72 hours, any other window counting as 24, oldest first, with the share of memory in use."""
    at, hours = moment(as_of), WINDOW_HOURS.get(window, 24)
    rows = metrics.where((F.col("recorded_at") > before(at, f"'{hours}' HOUR")) & (F.col("recorded_at") <= at))
    used = used_percent(F.col("memory_total_bytes"), F.col("memory_available_bytes"))
    return rows.select("event_id", "recorded_at", "cpu_percent", load_band(F.col("cpu_percent")).alias("band"), used.alias("memory_used_percent")).orderBy("recorded_at", "event_id")


def search_numbers(numbers: DataFrame, query: str, n: int = 20) -> DataFrame:
    wanted = digits_only(F.lit(query))
    return top(numbers.where(F.col("national_number").contains(wanted)).select("phone_e164", "national_number", "phone_type"), [F.col("phone_e164")], n)


def lookup(asked: DataFrame, numbers: DataFrame, identities: DataFrame, evidence: DataFrame, reports: DataFrame) -> DataFrame:
    """What is known of each number asked for (raw_input): its reading, statistics, identities and reports.

    There are three shapes: what is no number has nothing; a number never stored has its reports alone; a stored one has all,
    its identities of whatever status by confidence.  A number's identities are few, being unique by name and rule.
    """
    n = normalized(F.col("raw_input"))
    rows = with_once(asked.select("raw_input").distinct(), "_n", n).select("raw_input", "_n.normalized", F.col("_n.type").alias("read_type"), "_n.valid")
    seen = evidence.groupBy(F.col("phone_normalized").alias("normalized")).agg(F.count_distinct("source_id").alias("source_count"))
    order = F.struct(-F.col("confidence").cast("double"), "normalized_name", "id")
    said = F.struct(order.alias("o"), F.col("display_name").alias("name"), F.col("identity_type").alias("type"), "category", F.col("confidence").cast("double").alias("confidence"), "evidence_count", "status")
    named = identities.groupBy("phone_number_id").agg(F.transform(F.array_sort(F.collect_list(said)), lambda x: x.dropFields("o")).alias("identities"))
    stored = numbers.select(F.col("id").alias("phone_number_id"), F.col("phone_e164").alias("normalized"), "phone_type", "observation_count", "first_seen_at", "last_seen_at")
    stored = stored.join(named, "phone_number_id", "left").join(seen, "normalized", "left").withColumn("stored", F.lit(True)).drop("phone_number_id")
    flags = spam_flags(reports).select(F.col("phone_normalized").alias("normalized"), "report_count", "reporter_count", "risk", "top_category")
    out = rows.join(stored, "normalized", "left").join(flags, "normalized", "left")
    out = out.withColumn("type", F.coalesce("phone_type", "read_type")).withColumn("identities", F.coalesce("identities", F.array().cast(stored.schema["identities"].dataType)))
    out = out.withColumn("shape", F.when(F.col("normalized").isNull(), "INVALID").when(F.col("stored"), "SEEN").otherwise("NEVER_SEEN"))
    out = out.na.fill(0, ["observation_count", "source_count", "report_count", "reporter_count"]).na.fill({"risk": "NONE"})
    return out.select("raw_input", "normalized", "type", "valid", "shape", "observation_count", "source_count", "first_seen_at", "last_seen_at", "identities", "report_count", "reporter_count", "risk", "top_category")


JOB_FIELDS = ("id", "job_type", "source_id", "source_name", "crawl_target_id", "priority", "status", "attempt_count", "max_attempts", "scheduled_at", "started_at", "finished_at", "error_message", "created_at")


def _with_source(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    return jobs.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")


def job_list(jobs: DataFrame, sources: DataFrame, n: int = 50, status: str | None = None, job_type: str | None = None) -> DataFrame:
    """The newest jobs, filtered as asked, each with its source's name."""
    for column, wanted in (("status", status), ("job_type", job_type)):
        if wanted is not None:
            jobs = jobs.where(F.col(column) == wanted)
    newest = [F.col("created_at").desc(), F.col("id")]
    return _with_source(top(jobs, newest, n), sources).select(*JOB_FIELDS).orderBy(*newest)


def job_by_id(jobs: DataFrame, sources: DataFrame, wanted: str) -> DataFrame:
    return _with_source(jobs.where(F.col("id") == wanted), sources).select(*JOB_FIELDS)


def running_jobs(jobs: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """Running jobs, the longest first, and for how many whole seconds; unknown where the start is."""
    rows = _with_source(jobs.where("status = 'RUNNING'"), sources)
    return rows.select("id", "job_type", "source_name", "started_at", F.timestamp_diff("SECOND", F.col("started_at"), moment(as_of)).alias("duration_seconds"), "attempt_count", "max_attempts").orderBy(F.col("started_at").asc_nulls_last(), "id")


def observation_window(start: DataFrame, as_of: str, hours: int) -> DataFrame:
    """How much of an observation period has passed; nothing if it has not begun."""
    passed = F.greatest(F.lit(0), F.coalesce(F.timestamp_diff("SECOND", F.col("started_at"), moment(as_of)), F.lit(0)))
    goal = F.lit(hours * 3600)
    return start.select(passed.alias("elapsed_seconds"), goal.alias("target_seconds"), F.greatest(F.lit(0), goal - passed).alias("remaining_seconds"))


def call_import(calls: DataFrame, numbers: DataFrame, identities: DataFrame) -> DataFrame:
    """What importing a call log finds out about each entry."""
    best = best_identities(numbers, identities).select(F.col("phone_e164").alias("phone_normalized"), F.col("display_name").alias("identity_name"), F.lit(True).alias("known"))
    n = normalized(F.col("phone_raw"))
    rows = calls.select("id", "phone_raw", n["normalized"].alias("phone_normalized"), n["valid"].alias("valid"), F.when(F.col("call_count") > 0, F.col("call_count")).otherwise(1).alias("call_count"))
    return rows.join(best, "phone_normalized", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def import_counts(results: DataFrame) -> DataFrame:
    """How the entries of an import fared."""
    return results.agg(F.count("*").alias("entries"), F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("unknown"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("skipped"))


def spam_summaries(reports: DataFrame) -> DataFrame:
    """Every reported number's flags and its breakdown as a map of category to reports: the totals are joined to the categories."""
    by = spam_breakdown(reports).where("category IS NOT NULL")
    parts = by.groupBy("phone_normalized").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "report_count")))).alias("breakdown"))  # at most one entry a category
    return spam_flags(reports).join(parts, "phone_normalized", "left")


def spam_of_one(reports: DataFrame, number: str) -> DataFrame:
    """The categories reported for one number, each beside that number's totals (one row)."""
    rows = reports.where(F.col("phone_normalized") == number)
    totals = rows.agg(F.count("*").alias("report_count"), F.count_distinct(F.coalesce("reporter_ref", "id")).alias("reporter_count"))
    return rows.groupBy("category").agg(F.count("*").alias("reports")).crossJoin(totals)


def acquisition_stats(sources: DataFrame, targets: DataFrame, jobs: DataFrame, discoveries: DataFrame, documents: DataFrame, observations: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row on crawling, discovery, yield and quality; one pass over each table."""
    crawl = F.col("job_type").isin("CRAWL_URL", "CRAWL_SOURCE", "RECRAWL")
    took = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")) / 1e3
    counters = ("sitemaps_found", "urls_discovered", "urls_high_priority", "urls_queued")
    rows = [
        sources.agg(F.count("*").alias("total_sources"), F.count_if("is_active").alias("active_sources")),
        targets.agg(F.count("*").alias("total_crawl_targets"), F.count_if(F.col("crawl_status") == "PENDING").alias("pending_targets")),
        jobs.agg(
            F.count_if(crawl & (F.col("status") == "SUCCESS")).alias("successful_crawls"), F.count_if(crawl & (F.col("status") == "FAILED")).alias("failed_crawls"),
            F.round(F.coalesce(F.avg(took), F.lit(0.0))).cast("bigint").alias("average_crawl_duration_ms"),
        ),
        discoveries.agg(F.count_distinct("domain").alias("domains_discovered"), *[F.coalesce(F.sum(c), F.lit(0)).alias("sitemaps_discovered" if c == "sitemaps_found" else c) for c in counters]),
        documents.agg(F.count("*").alias("raw_documents"), F.count_distinct("content_hash").alias("contents")),
        observations.agg(F.count("*").alias("phone_observations"), F.count("phone_normalized").alias("usable")),
        numbers.agg(F.count("*").alias("unique_phone_numbers")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)  # single rows

    def share(part: Column, whole: str, digits: int) -> Column:
        return F.round(F.when(F.col(whole) > 0, part / F.col(whole)).otherwise(0.0), digits)

    out = out.withColumn("phones_per_document", share(F.col("phone_observations"), "raw_documents", 2))
    out = out.withColumn("duplicate_content_ratio", share(F.col("raw_documents") - F.col("contents"), "raw_documents", 4))
    out = out.withColumn("invalid_phone_ratio", share(F.col("phone_observations") - F.col("usable"), "phone_observations", 4))
    return out.withColumn("normalization_success_rate", share(F.col("usable"), "phone_observations", 4)).drop("contents", "usable")


def monitoring_summary(observation: DataFrame, growth: DataFrame, jobs: DataFrame, queue: DataFrame, system: DataFrame) -> DataFrame:
    """The five reports as one row of structs, ``system`` null where nothing was measured yet."""
    out = None
    for name, part in (("observation", observation), ("data", growth), ("jobs", jobs), ("queue", queue), ("system", system)):
        row = part.agg(F.first(F.struct(*part.columns)).alias(name))  # each part is at most one row
        out = row if out is None else out.crossJoin(row)
    return out
