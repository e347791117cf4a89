"""Queries over the job queue, its monitoring, and what batches write to stored tables; each with the SQL to hold it against.

Jobs, metrics and datasets are those of adapters.py.  A write is shown as the table after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import display
from ..rules import JOB_STATUSES
from ..session import table
from . import adapters, catalog, ingest, marts, pipelines, queue, writes
from .catalog import _query, _t, ladder_sql

_AT = f"TIMESTAMP '{adapters.NOW_JOBS}'"
_JOBS = f"jobs AS ({adapters.JOBS_SQL})"
_METRICS = f"metrics AS ({adapters.METRICS_SQL})"
_SUP = f"sup AS ({adapters.SUPPRESSED_SQL})"
_DATASETS = f"ledger AS ({adapters.DATASETS_SQL})"
_WRITTEN = "2025-07-01 00:00:00"
_AT_WRITE = f"TIMESTAMP '{_WRITTEN}'"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.crawl_jobs(table(spark, sf_dir, "crawl_targets"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.system_metrics(table(spark, sf_dir, "events"))


def _late(status: str, hours: int) -> str:
    return f"count(*) FILTER (WHERE status = '{status}' AND finished_at > {_AT} - INTERVAL '{hours}' HOUR)"


# -- monitoring ---------------------------------------------------------------------------------------------------

_HISTOGRAM = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in JOB_STATUSES)


@_query("job_status_histogram", f"WITH {_JOBS} SELECT {_HISTOGRAM}, count(*) FILTER (WHERE status IN ('PENDING', 'RUNNING', 'RETRY')) AS active, {_late('SUCCESS', 24)} AS completed_24h, {_late('FAILED', 24)} AS failed_24h, max(started_at) AS last_started_at FROM jobs")
def job_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.job_histogram(_jobs(spark, sf_dir), adapters.NOW_JOBS)


_SUMMARY = (
    "count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'RUNNING') AS running, count(*) FILTER (WHERE status = 'SUCCESS') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed, "
    + ", ".join(f"{_late('SUCCESS', h)} AS completed_{h}h" for h in (1, 6, 24)) + f", {_late('FAILED', 1)} AS failed_1h, {_late('FAILED', 24)} AS failed_24h, "
    + f"round(coalesce(avg(epoch(finished_at) - epoch(started_at)) FILTER (WHERE status = 'SUCCESS' AND finished_at > {_AT} - INTERVAL '24' HOUR), 0), 1) AS average_seconds"
)


@_query("jobs_summary", f"WITH {_JOBS} SELECT {_SUMMARY} FROM jobs")
def jobs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.jobs_summary(_jobs(spark, sf_dir), adapters.NOW_JOBS)


_HEALTH = f"""q AS (SELECT count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'RUNNING') AS running, {_late('FAILED', 24)} AS failed_24h,
  CAST(floor(epoch({_AT}) - epoch(min(scheduled_at) FILTER (WHERE status = 'PENDING'))) AS BIGINT) AS oldest_age_seconds FROM jobs),
health AS (SELECT *, CASE WHEN pending >= 30 OR coalesce(oldest_age_seconds, 0) >= 180 * 60 THEN 'CRITICAL' WHEN pending >= 10 OR coalesce(oldest_age_seconds, 0) >= 60 * 60 THEN 'WARNING' ELSE 'HEALTHY' END AS health FROM q)"""


@_query("queue_health", f"WITH {_JOBS}, {_HEALTH} SELECT * FROM health")
def queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.queue_health(_jobs(spark, sf_dir), adapters.NOW_JOBS)


_NAMED = "SELECT j.*, s.name AS source_name FROM jobs j LEFT JOIN data_sources s ON s.id = j.source_id"
_FIELDS = ", ".join(marts.JOB_FIELDS)


@_query("job_list", f"WITH {_JOBS}, n AS ({_NAMED}) SELECT {_FIELDS} FROM n WHERE status = 'FAILED' AND job_type = 'CRAWL_URL' ORDER BY created_at DESC, id LIMIT 50")
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.job_list(_jobs(spark, sf_dir), table(spark, sf_dir, "data_sources"), 50, status="FAILED", job_type="CRAWL_URL")


@_query("job_by_id", f"WITH {_JOBS}, n AS ({_NAMED}) SELECT {_FIELDS} FROM n WHERE id = (SELECT min(id) FROM jobs)")
def job_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    return marts.job_by_id(jobs, table(spark, sf_dir, "data_sources"), jobs.agg(F.min("id")).head()[0])


@_query("running_jobs", f"WITH {_JOBS}, n AS ({_NAMED}) SELECT id, job_type, source_name, started_at, CAST(floor(epoch({_AT}) - epoch(started_at)) AS BIGINT) AS duration_seconds, attempt_count, max_attempts FROM n WHERE status = 'RUNNING'")
def running_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.running_jobs(_jobs(spark, sf_dir), table(spark, sf_dir, "data_sources"), adapters.NOW_JOBS)


@_query(
    "running_jobs_shown",
    f"""WITH {_JOBS}, r AS (SELECT id, CAST(floor(epoch({_AT}) - epoch(started_at)) AS BIGINT) AS s FROM jobs WHERE status = 'RUNNING')
SELECT id, CASE WHEN s IS NULL THEN '—' WHEN s >= 3600 THEN format('{{}}h {{}}m', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN format('{{}}m {{}}s', s // 60, s % 60) ELSE format('{{}}s', s) END AS duration FROM r WHERE s IS NULL OR s >= 0""",
)
def running_jobs_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs of the past as a page shows them."""
    return running_jobs(spark, sf_dir).where("duration_seconds IS NULL OR duration_seconds >= 0").select("id", display.duration(F.col("duration_seconds")).alias("duration"))


@_query("system_metrics_latest", f"WITH {_METRICS} SELECT * FROM metrics ORDER BY recorded_at DESC, event_id DESC LIMIT 1")
def system_metrics_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.latest_metric(_metrics(spark, sf_dir))


_BANDS = "CASE WHEN cpu_percent >= 80 THEN 'danger' WHEN cpu_percent >= 50 THEN 'warn' ELSE 'good' END AS band, CAST(round((memory_total_bytes - memory_available_bytes) / memory_total_bytes * 100) AS INTEGER) AS memory_used_percent"


def _window(name: str, asked: str, hours: int) -> None:
    at = f"TIMESTAMP '{adapters.NOW_METRICS}'"

    @_query(name, f"WITH {_METRICS} SELECT event_id, recorded_at, cpu_percent, {_BANDS} FROM metrics WHERE recorded_at > {at} - INTERVAL '{hours}' HOUR AND recorded_at <= {at}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return marts.metric_history(_metrics(spark, sf_dir), adapters.NOW_METRICS, asked)


_window("system_metrics_window", "any", 24)
_window("system_metrics_window_6h", "6h", 6)
_window("system_metrics_window_72h", "72h", 72)


@_query(
    "figures_shown",
    f"""WITH {_METRICS} SELECT event_id, format('{{:.1f}} GB', round(memory_available_bytes / 1024.0 / 1024 / 1024, 1)) AS available, i.id AS identity_id,
CASE WHEN confidence >= 60 THEN 'good' WHEN confidence >= 30 THEN 'warn' ELSE 'danger' END AS band FROM (SELECT * FROM metrics ORDER BY recorded_at DESC, event_id DESC LIMIT 1), phone_identities i""",
)
def figures_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free memory of the latest snapshot beside the band of each identity's confidence."""
    one = marts.latest_metric(_metrics(spark, sf_dir)).select("event_id", display.gigabytes(F.col("memory_available_bytes")).alias("available"))
    return table(spark, sf_dir, "phone_identities").select(F.col("id").alias("identity_id"), display.confidence_band(F.col("confidence")).alias("band")).join(F.broadcast(one))  # one row


_SINCE = catalog._SINCE


def _flat(structs: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    return structs.select(*[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p, columns in parts.items() for c in columns])


@_query(
    "monitoring_summary",
    f"""WITH {catalog._PRODUCTION}, {_JOBS}, {_HEALTH}, {_METRICS}, d AS (SELECT {catalog._GROWTH} FROM prod), s AS (SELECT {_SUMMARY} FROM jobs), m AS (SELECT * FROM metrics ORDER BY recorded_at DESC, event_id DESC LIMIT 1)
SELECT CAST(epoch(TIMESTAMP '{marts.AS_OF}') - epoch(TIMESTAMP '{_SINCE}') AS BIGINT) AS observation_elapsed_seconds, CAST(greatest(0, 259200 - (epoch(TIMESTAMP '{marts.AS_OF}') - epoch(TIMESTAMP '{_SINCE}'))) AS BIGINT) AS observation_remaining_seconds,
  d.total AS data_total, d.last_24h AS data_last_24h, d.since_observation AS data_since_observation, s.pending AS jobs_pending, s.completed_24h AS jobs_completed_24h, s.average_seconds AS jobs_average_seconds,
  health.health AS queue_health, health.oldest_age_seconds AS queue_oldest_age_seconds, m.cpu_percent AS system_cpu_percent, m.load_1 AS system_load_1 FROM d, s, health, m""",
)
def monitoring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    begun = spark.range(1).select(marts.moment(_SINCE).alias("started_at"))
    whole = marts.monitoring_summary(
        marts.observation_window(begun, marts.AS_OF, 72), catalog.data_growth_horizons(spark, sf_dir), jobs_summary(spark, sf_dir), queue_health(spark, sf_dir), system_metrics_latest(spark, sf_dir)
    )
    return _flat(whole, {"observation": ["elapsed_seconds", "remaining_seconds"], "data": ["total", "last_24h", "since_observation"], "jobs": ["pending", "completed_24h", "average_seconds"], "queue": ["health", "oldest_age_seconds"], "system": ["cpu_percent", "load_1"]})


_RUNS = f"""{catalog._REPORT}, met AS (SELECT base_url, count(*) AS sitemaps_found FROM (SELECT DISTINCT base_url, source_id FROM crawl_targets t JOIN data_sources s ON s.id = t.source_id) GROUP BY 1),
runs AS (SELECT lower(regexp_extract(regexp_replace(r.base_url, '^[a-z]+://', ''), '^[^/?#]*')) AS domain, s.robots_checked AS robots_found, met.sitemaps_found, urls_discovered, urls_high_priority, CAST(urls_queued AS BIGINT) AS urls_queued, status,
  CASE WHEN errors > 0 THEN errors || ' faults' END AS error_message, {_AT_WRITE} AS finished_at FROM report r JOIN met USING (base_url) JOIN (SELECT base_url, bool_or(robots_checked) AS robots_checked FROM data_sources GROUP BY 1) s USING (base_url))"""


@_query("discovery_runs", f"WITH {_RUNS} SELECT * FROM runs")
def discovery_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, sources = _t(spark, sf_dir, "crawl_targets", "data_sources")
    report = catalog.discovery_report(spark, sf_dir)
    met = targets.join(sources.select(F.col("id").alias("source_id"), "base_url"), "source_id").groupBy("base_url").agg(F.count_distinct("source_id").alias("sitemaps_found"))
    met = met.join(sources.groupBy("base_url").agg(F.bool_or("robots_checked").alias("robots_found")), "base_url")
    met = met.join(report.select("base_url", F.when(F.col("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit(" faults"))).alias("error_message")), "base_url")
    return writes.discovery_runs(report, met, marts.moment(_WRITTEN))


_ACQUIRED = f"""WITH {_JOBS}, {_RUNS},
a AS (SELECT count(*) AS total_sources, count(*) FILTER (WHERE is_active) AS active_sources FROM data_sources), b AS (SELECT count(*) AS total_crawl_targets, count(*) FILTER (WHERE crawl_status = 'PENDING') AS pending_targets FROM crawl_targets),
c AS (SELECT count(*) FILTER (WHERE job_type IN ('CRAWL_URL', 'CRAWL_SOURCE', 'RECRAWL') AND status = 'SUCCESS') AS successful_crawls, count(*) FILTER (WHERE job_type IN ('CRAWL_URL', 'CRAWL_SOURCE', 'RECRAWL') AND status = 'FAILED') AS failed_crawls,
  CAST(round(coalesce(avg((epoch(finished_at) - epoch(started_at)) * 1000), 0)) AS BIGINT) AS average_crawl_duration_ms FROM jobs),
d AS (SELECT count(DISTINCT domain) AS domains_discovered, CAST(sum(sitemaps_found) AS BIGINT) AS sitemaps_discovered, CAST(sum(urls_discovered) AS BIGINT) AS urls_discovered, CAST(sum(urls_high_priority) AS BIGINT) AS urls_high_priority, CAST(sum(urls_queued) AS BIGINT) AS urls_queued FROM runs),
e AS (SELECT count(*) AS raw_documents, count(DISTINCT content_hash) AS contents FROM raw_documents), f2 AS (SELECT count(*) AS phone_observations, count(phone_normalized) AS usable FROM phone_observations), g2 AS (SELECT count(*) AS unique_phone_numbers FROM phone_numbers)
SELECT a.*, b.*, c.*, d.*, raw_documents, phone_observations, unique_phone_numbers, round(phone_observations / raw_documents, 2) AS phones_per_document, round(1 - contents / raw_documents, 4) AS duplicate_content_ratio,
  round((phone_observations - usable) / phone_observations, 4) AS invalid_phone_ratio, round(usable / phone_observations, 4) AS normalization_success_rate FROM a, b, c, d, e, f2, g2"""


@_query("acquisition_stats", _ACQUIRED)
def acquisition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, targets, documents, observations, numbers = _t(spark, sf_dir, "data_sources", "crawl_targets", "raw_documents", "phone_observations", "phone_numbers")
    return marts.acquisition_stats(sources, targets, _jobs(spark, sf_dir), discovery_runs(spark, sf_dir), documents, observations, numbers)


@_query("stats_report", f"WITH s AS ({catalog.SQL['data_quality']}) SELECT * FROM (SELECT 0 AS line_no, 'Data quality' AS line FROM s UNION ALL SELECT 1, 'observations: ' || observations FROM s UNION ALL SELECT 2, 'numbers: ' || numbers FROM s UNION ALL SELECT 3, 'identities: ' || identities FROM s UNION ALL SELECT 4, 'documents: ' || documents FROM s)")
def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.text_report(catalog.data_quality(spark, sf_dir).select("observations", "numbers", "identities", "documents"), "Data quality")


# -- queue --------------------------------------------------------------------------------------------------------

_ACTIVE = "status IN ('PENDING', 'RUNNING', 'RETRY')"


@_query("queue_claim_order", f"WITH {_JOBS} SELECT id, priority, 'RUNNING' AS status, {_AT} AS started_at, {_AT} AS locked_at, 'w1' AS locked_by FROM jobs WHERE status IN ('PENDING', 'RETRY') AND scheduled_at <= {_AT} ORDER BY priority DESC, scheduled_at, id LIMIT 20")
def queue_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claimed(_jobs(spark, sf_dir), adapters.NOW_JOBS, 20, "w1").select("id", "priority", "status", "started_at", "locked_at", "locked_by")


@_query("queue_complete", f"WITH {_JOBS} SELECT id, 'SUCCESS' AS status, {_AT} AS finished_at, NULL::TIMESTAMP AS locked_at, NULL::VARCHAR AS locked_by FROM jobs WHERE status = 'RUNNING'")
def queue_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    return queue.completed(jobs, jobs.where("status = 'RUNNING'"), adapters.NOW_JOBS).select("id", "status", "finished_at", "locked_at", "locked_by")


@_query(
    "queue_fail_transition",
    f"""WITH {_JOBS} SELECT id, attempt_count + 1 AS attempt_count, CASE WHEN attempt_count + 1 >= max_attempts THEN 'FAILED' ELSE 'RETRY' END AS status, 'boom' AS error_message,
CASE WHEN attempt_count + 1 >= max_attempts THEN scheduled_at ELSE {_AT} + to_seconds(CAST(30 * power(2, attempt_count) AS INTEGER)) END AS scheduled_at, CASE WHEN attempt_count + 1 >= max_attempts THEN {_AT} END AS finished_at FROM jobs WHERE status = 'RUNNING'""",
)
def queue_fail_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    errors = jobs.where("status = 'RUNNING'").select("id", F.lit("boom").alias("error"))
    return queue.failed(jobs, errors, adapters.NOW_JOBS).select("id", "attempt_count", "status", "error_message", "scheduled_at", "finished_at")


@_query("queue_stale_recovery", f"WITH {_JOBS} SELECT id, 'RETRY' AS status, attempt_count, 'recovered from stale RUNNING lock' AS error_message FROM jobs WHERE status = 'RUNNING' AND locked_at < {_AT} - INTERVAL '30' MINUTE")
def queue_stale_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.recovered(_jobs(spark, sf_dir), adapters.NOW_JOBS).select("id", "status", "attempt_count", "error_message")


_WANTED = """wanted AS (SELECT concat('n', id) AS id, 'CRAWL_URL' AS job_type, source_id, id AS crawl_target_id FROM crawl_targets UNION ALL SELECT concat('m', id), 'DISCOVER_SITEMAP', id, NULL FROM data_sources
UNION ALL SELECT concat('z', id), 'CRAWL_URL', source_id, id FROM crawl_targets)"""


@_query(
    "active_job_dedupe",
    f"""WITH {_JOBS}, {_WANTED},
h AS (SELECT DISTINCT ON (crawl_target_id) crawl_target_id, id FROM jobs WHERE {_ACTIVE} AND crawl_target_id IS NOT NULL ORDER BY crawl_target_id, created_at, id),
g AS (SELECT DISTINCT ON (source_id, job_type) source_id, job_type, id FROM jobs WHERE {_ACTIVE} AND crawl_target_id IS NULL ORDER BY source_id, job_type, created_at, id),
p AS (SELECT w.id, coalesce(h.id, g.id, min(w.id) OVER (PARTITION BY w.crawl_target_id, CASE WHEN w.crawl_target_id IS NULL THEN w.source_id END, CASE WHEN w.crawl_target_id IS NULL THEN w.job_type END)) AS job_id
  FROM wanted w LEFT JOIN h ON h.crawl_target_id = w.crawl_target_id LEFT JOIN g ON w.crawl_target_id IS NULL AND g.source_id = w.source_id AND g.job_type = w.job_type)
SELECT id, job_id, id = job_id AS created FROM p""",
)
def active_job_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, sources = _t(spark, sf_dir, "crawl_targets", "data_sources")
    crawl = targets.select(F.concat(F.lit("n"), "id").alias("id"), F.lit("CRAWL_URL").alias("job_type"), "source_id", F.col("id").alias("crawl_target_id"))
    again = crawl.withColumn("id", F.concat(F.lit("z"), "crawl_target_id"))
    find = sources.select(F.concat(F.lit("m"), "id").alias("id"), F.lit("DISCOVER_SITEMAP").alias("job_type"), F.col("id").alias("source_id"), F.lit(None).cast("string").alias("crawl_target_id"))
    return queue.created_jobs(_jobs(spark, sf_dir), crawl.unionByName(again).unionByName(find))


@_query("enqueue_discovery", f"SELECT 'DISCOVER_DOMAIN' AS job_type, 150 AS priority, '{{\"domain\":\"' || base_url || '\",\"source_name\":\"' || name || '\"}}' AS metadata, 'PENDING' AS status, 0 AS attempt_count, {_AT} AS scheduled_at FROM data_sources")
def enqueue_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = table(spark, sf_dir, "data_sources").select(F.col("base_url").alias("domain"), F.col("name").alias("source_name"))
    return queue.domain_discoveries(domains, marts.moment(adapters.NOW_JOBS))


@_query("schedule_due_targets", f"SELECT id, source_id, priority, next_crawl_at FROM crawl_targets WHERE status = 'active' AND next_crawl_at <= TIMESTAMP '{marts.AS_OF}' ORDER BY priority DESC, next_crawl_at, id LIMIT 100")
def schedule_due_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.due_targets(table(spark, sf_dir, "crawl_targets"), marts.AS_OF, 100)


def _pass_sql(active: str, at: str) -> str:
    return f"""due AS (SELECT id, source_id, priority, next_crawl_at FROM crawl_targets WHERE status = 'active' AND next_crawl_at <= {at} ORDER BY priority DESC, next_crawl_at, id LIMIT 100),
free AS (SELECT 0 AS turn, row_number() OVER (ORDER BY priority DESC, next_crawl_at, id) AS n, 'CRAWL_URL' AS job_type, source_id, id AS crawl_target_id FROM due WHERE id NOT IN (SELECT crawl_target_id FROM {active} WHERE crawl_target_id IS NOT NULL)),
find AS (SELECT 1 AS turn, row_number() OVER (ORDER BY id) AS n, 'DISCOVER_SITEMAP' AS job_type, id AS source_id, NULL AS crawl_target_id FROM data_sources WHERE is_active AND crawl_frequency <> 'MANUAL' AND next_scheduled_at <= {at}
  AND id NOT IN (SELECT source_id FROM {active} WHERE job_type = 'DISCOVER_SITEMAP')),
placed AS (SELECT CAST(row_number() OVER (ORDER BY turn, n) AS INTEGER) AS place, * FROM (SELECT * FROM free UNION ALL SELECT * FROM find)),
pass AS (SELECT place, job_type, source_id, crawl_target_id FROM placed WHERE place <= greatest(0, least(10, 5 - (SELECT count(*) FROM {active}))))"""


@_query("scheduler_pass", f"WITH {_JOBS}, few AS (SELECT * FROM jobs WHERE {_ACTIVE} ORDER BY id LIMIT 2), {_pass_sql('few', _AT)} SELECT * FROM pass")
def scheduler_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass beside two active jobs: three more may be put in."""
    few = _jobs(spark, sf_dir).where("status IN ('PENDING', 'RUNNING', 'RETRY')").orderBy("id").limit(2)
    return queue.scheduled(few, *_t(spark, sf_dir, "crawl_targets", "data_sources"), adapters.NOW_JOBS)


@_query("scheduler_pass_full", f"WITH {_JOBS}, act AS (SELECT * FROM jobs WHERE {_ACTIVE}), {_pass_sql('act', _AT)} SELECT * FROM pass")
def scheduler_pass_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass beside the whole queue, which is full: nothing is put in."""
    return queue.scheduled(_jobs(spark, sf_dir), *_t(spark, sf_dir, "crawl_targets", "data_sources"), adapters.NOW_JOBS)


@_query("scheduler_discoveries", f"WITH none AS (SELECT * FROM ({adapters.JOBS_SQL}) WHERE false), {_pass_sql('none', _AT).replace('FROM crawl_targets WHERE', 'FROM crawl_targets WHERE false AND')} SELECT id, d AS days, {_AT} + to_days(d) AS next_scheduled_at FROM (SELECT *, CASE crawl_frequency WHEN 'DAILY' THEN 1 WHEN 'WEEKLY' THEN 7 WHEN 'MONTHLY' THEN 30 ELSE 7 END AS d FROM data_sources) WHERE id IN (SELECT source_id FROM pass)")
def scheduler_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without due targets the budget goes to sources, and only those that are put in advance."""
    targets, sources = _t(spark, sf_dir, "crawl_targets", "data_sources")
    put_in = queue.scheduled(_jobs(spark, sf_dir).where("false"), targets.where("false"), sources, adapters.NOW_JOBS)
    return queue.sources_after(sources, put_in, adapters.NOW_JOBS)


@_query("source_next_schedule", f"SELECT id, d AS days, {_AT} + to_days(d) AS next_scheduled_at FROM (SELECT *, CASE crawl_frequency WHEN 'DAILY' THEN 1 WHEN 'WEEKLY' THEN 7 WHEN 'MONTHLY' THEN 30 ELSE 7 END AS d FROM data_sources) WHERE is_active AND crawl_frequency <> 'MANUAL' AND next_scheduled_at <= {_AT}")
def source_next_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.next_schedule(table(spark, sf_dir, "data_sources"), adapters.NOW_JOBS)


_STEP = f"""taken AS (SELECT * FROM jobs WHERE status IN ('PENDING', 'RETRY') AND scheduled_at <= {_AT} ORDER BY priority DESC, scheduled_at, id LIMIT 30),
bad AS (SELECT *, CASE WHEN job_type = 'CRAWL_URL' THEN NULL WHEN job_type = 'RECRAWL' THEN 'gone' ELSE 'no handler for ' || job_type END AS error FROM taken),
stepped AS (SELECT id, CASE WHEN error IS NULL THEN 'SUCCESS' WHEN attempt_count + 1 >= max_attempts THEN 'FAILED' ELSE 'RETRY' END AS status, attempt_count + (error IS NOT NULL)::INT AS attempt_count, CASE WHEN error IS NULL THEN error_message ELSE error END AS error_message FROM bad)"""


@_query("worker_step", f"WITH {_JOBS}, {_STEP} SELECT * FROM stepped UNION ALL SELECT id, status, attempt_count, error_message FROM jobs WHERE id NOT IN (SELECT id FROM taken)")
def worker_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after a worker took thirty jobs: one type is done, one fails, the others have no handler."""
    worker = queue.Worker(
        {"CRAWL_URL": lambda jobs: jobs.select("id", F.lit(None).cast("string").alias("error")), "RECRAWL": lambda jobs: jobs.select("id", F.lit("gone").alias("error"))}
    )
    return worker.step(_jobs(spark, sf_dir), adapters.NOW_JOBS, 30, "w1").select("id", "status", "attempt_count", "error_message")


# -- writes -------------------------------------------------------------------------------------------------------


@_query(
    "number_upsert",
    f"""WITH {ladder_sql('phone_raw', 'phone_observations')}, bt AS (SELECT phone_normalized AS phone_e164, count(*) AS n, min(discovered_at) AS lo, max(discovered_at) AS hi, arg_max(type, (discovered_at, type)) AS phone_type
  FROM phone_observations JOIN ladder ON raw IS NOT DISTINCT FROM phone_raw WHERE phone_normalized IS NOT NULL AND discovered_at >= TIMESTAMP '2025-06-01' GROUP BY 1)
SELECT coalesce(o.phone_e164, bt.phone_e164) AS phone_e164, CAST(coalesce(observation_count, 0) + coalesce(n, 0) AS BIGINT) AS observation_count, least(first_seen_at, lo) AS first_seen_at, greatest(last_seen_at, hi) AS last_seen_at, coalesce(bt.phone_type, o.phone_type) AS phone_type
FROM phone_numbers o FULL OUTER JOIN bt ON bt.phone_e164 = o.phone_e164""",
)
def number_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored numbers after a month of sightings."""
    numbers, observations = _t(spark, sf_dir, "phone_numbers", "phone_observations")
    batch = observations.where(F.col("discovered_at") >= marts.moment("2025-06-01 00:00:00")).withColumn("phone_type", catalog.phone.normalized(F.col("phone_raw"))["type"])
    return ingest.merged_numbers(numbers.withColumn("observation_count", F.col("observation_count").cast("bigint")), batch)


_URL = """regexp_replace(trim(url), '[?#].*$', '') AS bare"""


@_query(
    "target_upsert",
    f"""WITH f AS (SELECT source_id, url, CAST(10 AS INTEGER) AS priority, {_URL} FROM raw_documents WHERE url IS NOT NULL), h AS (SELECT *, regexp_extract(bare, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/]*)', 1) AS host FROM f),
p AS (SELECT *, host || CASE WHEN regexp_replace(substr(bare, length(host) + 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(substr(bare, length(host) + 1), '/+$', '') END AS normalized_url FROM h),
b AS (SELECT DISTINCT ON (normalized_url) * FROM p ORDER BY normalized_url, url, source_id, priority DESC)
SELECT coalesce(t.normalized_url, b.normalized_url) AS normalized_url, coalesce(t.url, b.url) AS url, coalesce(t.source_id, b.source_id) AS source_id, coalesce(t.priority, b.priority) AS priority, coalesce(t.crawl_status, 'PENDING') AS crawl_status,
  CASE WHEN b.normalized_url IS NOT NULL THEN {_AT_WRITE} ELSE t.updated_at END AS updated_at FROM (SELECT DISTINCT ON (normalized_url) * FROM crawl_targets ORDER BY normalized_url, id) t FULL OUTER JOIN b ON b.normalized_url = t.normalized_url""",
)
def target_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets after all addresses of the stored pages were found again."""
    targets, documents = _t(spark, sf_dir, "crawl_targets", "raw_documents")
    stored = catalog.marts.greatest_per(targets, ["normalized_url"], [F.col("id")])
    found = documents.where("url IS NOT NULL").select("source_id", "url", F.lit(10).alias("priority"))
    return writes.upserted_targets(stored, found, marts.moment(_WRITTEN))


@_query(
    "target_results",
    f"""WITH r AS (SELECT id, http_status, CASE WHEN http_status = 200 THEN 'SUCCESS' ELSE 'FAILED' END AS crawl_status, NULL::VARCHAR AS content_hash, NULL::VARCHAR AS etag, 'now' AS last_modified FROM crawl_targets WHERE http_status IS NOT NULL)
SELECT t.id, CASE WHEN r.id IS NULL THEN t.crawl_status ELSE r.crawl_status END AS crawl_status, CASE WHEN r.id IS NULL THEN t.content_hash ELSE r.content_hash END AS content_hash, coalesce(r.etag, t.etag) AS etag, coalesce(r.last_modified, t.last_modified) AS last_modified,
  t.attempt_count + (r.id IS NOT NULL)::INT AS attempt_count, CASE WHEN r.id IS NULL THEN t.last_crawled_at ELSE {_AT_WRITE} END AS last_crawled_at FROM crawl_targets t LEFT JOIN r ON r.id = t.id""",
)
def target_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets after a round in which every page that was ever met is unchanged: hashes go, validators stay."""
    targets = table(spark, sf_dir, "crawl_targets")
    none = F.lit(None).cast("string")
    results = targets.where("http_status IS NOT NULL").select("id", F.when(F.col("http_status") == 200, "SUCCESS").otherwise("FAILED").alias("crawl_status"), "http_status", none.alias("content_hash"), none.alias("etag"), F.lit("now").alias("last_modified"))
    out = writes.targets_after_results(targets, results, marts.moment(_WRITTEN))
    return out.select("id", "crawl_status", "content_hash", "etag", "last_modified", "attempt_count", "last_crawled_at")


def _sources_sql(trust: str, set_all: bool) -> str:
    base, level, policy = ("n.base_url", "n.trust_level", "n.crawl_policy") if set_all else ("o.base_url", "o.trust_level", "o.crawl_policy")
    return f"""WITH n AS (SELECT name, base_url || '/new' AS base_url, source_type, {trust} AS trust_level, '{{}}' AS crawl_policy FROM data_sources WHERE source_type = 'NEWS' UNION ALL SELECT 'Another', 'https://another.example', 'NEWS', {trust}, NULL)
SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN n.base_url WHEN n.name IS NULL THEN o.base_url ELSE {base} END AS base_url, CASE WHEN o.name IS NULL THEN n.trust_level WHEN n.name IS NULL THEN o.trust_level ELSE {level} END AS trust_level,
  CASE WHEN o.name IS NULL THEN n.crawl_policy WHEN n.name IS NULL THEN o.crawl_policy ELSE {policy} END AS crawl_policy FROM data_sources o FULL OUTER JOIN n ON n.name = o.name"""


def _source_upsert(name: str, by: str, trust: str, set_all: bool) -> None:
    @_query(name, _sources_sql(trust, set_all))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = table(spark, sf_dir, "data_sources")
        batch = stored.where("source_type = 'NEWS'").select("name", F.concat("base_url", F.lit("/new")).alias("base_url"), "source_type", F.lit("LOW").alias("trust_level"), F.lit("{}").alias("crawl_policy"))
        other = spark.createDataFrame([("Another", "https://another.example", "NEWS", "LOW", None)], "name string, base_url string, source_type string, trust_level string, crawl_policy string")
        return writes.upserted_sources(stored, batch.unionByName(other), by, marts.moment(_WRITTEN)).select("name", "base_url", "trust_level", "crawl_policy")


_source_upsert("source_upsert_config", "config", "'LOW'", True)
_source_upsert("source_upsert_discovery", "discovery", "'MEDIUM'", False)
_source_upsert("source_upsert_user", "user", "'HIGH'", False)


@_query(
    "dataset_ledger",
    f"""WITH {_DATASETS}, inc AS (SELECT coalesce(content_hash, id) AS checksum, min(url) AS name FROM crawl_targets GROUP BY 1), k AS (SELECT DISTINCT ON (checksum) * FROM ledger ORDER BY checksum, status = 'SUCCESS', id)
SELECT inc.checksum, inc.name, k.id AS dataset_id, coalesce(k.status, 'PENDING') AS status, coalesce(k.status, 'PENDING') <> 'SUCCESS' AS to_run FROM inc LEFT JOIN k ON k.checksum = inc.checksum""",
)
def dataset_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "crawl_targets")
    return writes.registered_datasets(adapters.datasets(targets), targets.select(F.coalesce("content_hash", "id").alias("checksum"), F.col("url").alias("name")))


@_query("dataset_progress", f"WITH {_DATASETS} SELECT id, CASE WHEN status = 'PENDING' THEN 99 ELSE processed_rows END AS processed_rows, CASE WHEN status = 'PENDING' THEN 'SUCCESS' ELSE status END AS status FROM ledger")
def dataset_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = adapters.datasets(table(spark, sf_dir, "crawl_targets"))
    done = ledger.where("status = 'PENDING'").select("id", F.lit(99).cast("bigint").alias("processed_rows"), F.lit("SUCCESS").alias("status"))
    return writes.datasets_after_run(ledger, done).select("id", "processed_rows", "status")


@_query(
    "spam_report_insert",
    f"WITH {ladder_sql('phone_raw', 'personal_call_logs')} SELECT c.id, c.phone_raw, normalized AS phone_normalized, CASE WHEN call_count > 3 THEN 'SCAM' ELSE 'SPAM' END AS category, notes AS note, NULL::VARCHAR AS reporter_ref, {_AT_WRITE} AS reported_at FROM personal_call_logs c JOIN ladder ON raw = c.phone_raw WHERE normalized IS NOT NULL",
)
def spam_report_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "personal_call_logs")
    batch = calls.select("id", "phone_raw", F.when(F.col("call_count") > 3, "SCAM").alias("category"), F.col("notes").alias("note"), F.lit(None).cast("string").alias("reporter_ref"))
    return writes.submitted_reports(writes.valid_reports(batch), marts.moment(_WRITTEN))


@_query(
    "call_log_insert",
    f"WITH {ladder_sql('phone_raw', 'spam_reports')} SELECT s.id, s.phone_raw, normalized AS phone_normalized, DATE '2025-07-01' AS call_date, CASE WHEN length(category) > 4 THEN length(category) - 4 ELSE 1 END AS call_count, coalesce(note, 'batch') AS notes, {_AT_WRITE} AS imported_at FROM spam_reports s JOIN ladder ON raw IS NOT DISTINCT FROM s.phone_raw",
)
def call_log_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "spam_reports").select("id", "phone_raw", (F.length("category") - 4).alias("call_count"), F.col("note").alias("notes"))
    return writes.imported_calls(batch, F.lit("2025-07-01").cast("date"), F.lit("batch"), marts.moment(_WRITTEN))


@_query(
    "suppression_upsert",
    f"""WITH {_SUP}, {ladder_sql('phone_raw', 'personal_call_logs')}, bt AS (SELECT normalized AS phone_normalized, max(notes) AS reason FROM personal_call_logs c JOIN ladder ON raw = c.phone_raw WHERE normalized IS NOT NULL GROUP BY 1)
SELECT coalesce(s.phone_normalized, bt.phone_normalized) AS phone_normalized, CASE WHEN bt.phone_normalized IS NULL THEN s.reason ELSE bt.reason END AS reason, coalesce(s.created_at, {_AT_WRITE}) AS created_at FROM sup s FULL OUTER JOIN bt ON bt.phone_normalized = s.phone_normalized""",
)
def suppression_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers, calls = _t(spark, sf_dir, "phone_numbers", "personal_call_logs")
    return writes.suppressed(adapters.label_suppressions(numbers), calls.select("phone_raw", F.col("notes").alias("reason")), marts.moment(_WRITTEN))


@_query("suppression_delete", f"WITH {_SUP}, {ladder_sql('phone_raw', 'phone_observations')} SELECT phone_normalized, reason FROM sup WHERE phone_normalized NOT IN (SELECT normalized FROM ladder WHERE normalized IS NOT NULL)")
def suppression_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers, observations = _t(spark, sf_dir, "phone_numbers", "phone_observations")
    return writes.unsuppressed(adapters.label_suppressions(numbers), observations.select("phone_raw")).select("phone_normalized", "reason")


@_query("suppression_status", f"WITH {_SUP}, {ladder_sql('phone_raw', 'personal_call_logs')} SELECT DISTINCT phone_raw, normalized AS phone_normalized, coalesce(normalized IN (SELECT phone_normalized FROM sup), false) AS suppressed FROM personal_call_logs JOIN ladder ON raw IS NOT DISTINCT FROM phone_raw")
def suppression_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers, calls = _t(spark, sf_dir, "phone_numbers", "personal_call_logs")
    return writes.suppression_status(adapters.label_suppressions(numbers), calls.select("phone_raw").distinct())


@_query(
    "settings_after_change",
    "SELECT name AS key, CASE WHEN source_type = 'NEWS' THEN 'true' WHEN is_active THEN 'false' ELSE '\"none\"' END AS value FROM data_sources",
)
def settings_after_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of which the active sources' are stored, the newspapers' are changed, and the others' have their default."""
    sources = table(spark, sf_dir, "data_sources")
    at = marts.moment(_WRITTEN)
    stored = sources.where("is_active").select(F.col("name").alias("key"), F.lit("false").alias("value"), at.alias("updated_at"))
    new = writes.set_settings(stored, sources.where("source_type = 'NEWS'").select(F.col("name").alias("key"), F.lit("true").alias("value")), at)
    return writes.settings_or_default(new, sources.select(F.col("name").alias("key"), F.lit('"none"').alias("default")))


@_query("metrics_append", f"WITH {_METRICS} SELECT * FROM metrics")
def metrics_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the snapshots stored, then all delivered: each is there once."""
    metrics = _metrics(spark, sf_dir)
    return writes.appended_metrics(metrics.where(F.col("recorded_at") < marts.moment("2024-01-15 00:00:00")), metrics)


@_query("evidence_upsert", f"WITH {catalog._GUESS} SELECT DISTINCT phone_normalized, name_key, 'rule_based_aggregation_v1' AS claim_source, id AS phone_observation_id FROM guess WHERE phone_normalized IN (SELECT phone_e164 FROM phone_numbers)")
def evidence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages before 2025 stored, then those of all pages found again."""
    numbers = table(spark, sf_dir, "phone_numbers")
    seen = catalog._evidence(spark, sf_dir)
    rule = F.lit("rule_based_aggregation_v1").alias("claim_source")
    old = marts.claim_evidence(seen.where(F.col("discovered_at") < marts.moment("2025-01-01 00:00:00")), numbers).select("*", rule)
    return ingest.linked_evidence(old, marts.claim_evidence(seen, numbers).select("*", rule))


_ENTRIES = "entries AS (SELECT row_number() OVER (PARTITION BY phone_normalized ORDER BY reported_at, id) AS entry_no, id, phone_raw, 'Người gọi ' || category AS display_name, CASE WHEN reporter_ref IS NULL THEN NULL ELSE category END AS category FROM spam_reports)"


@_query(
    "user_confirmed_identities",
    f"""WITH {_ENTRIES}, {ladder_sql('phone_raw', 'spam_reports')}, c AS (SELECT normalized AS phone_normalized, lower(display_name) AS name_key, arg_min(display_name, id) AS display_name, arg_max_null(entries.category, id) AS category, count(*) AS evidence_count
  FROM entries JOIN ladder ON raw IS NOT DISTINCT FROM entries.phone_raw WHERE normalized IS NOT NULL GROUP BY 1, 2)
SELECT *, 'user_confirmed_v1' AS claim_source, 'UNKNOWN' AS identity_type, 'CONFIRMED' AS status, 95.0::DOUBLE AS confidence FROM c""",
)
def user_confirmed_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports taken as confirmed entries, in two deliveries that overlap, the second replaying the first whole."""
    batch = _confirmed_batch(spark, sf_dir)
    first = {k: v.where(F.col("phone_normalized").endswith("5")) for k, v in batch.items() if k != "raw_documents"}
    links = ingest.linked_evidence(first["phone_identity_evidence"], batch["phone_identity_evidence"])
    stored = ingest.recounted(first["phone_identities"], first["phone_identity_evidence"])
    return ingest.identities_after_confirmation(stored, batch, links).select("phone_normalized", "name_key", "display_name", "category", "evidence_count", "claim_source", "identity_type", "status", "confidence")


def _confirmed_batch(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    reports = table(spark, sf_dir, "spam_reports")
    named = F.concat(F.lit("Người gọi "), "category")
    entries = reports.select(F.col("id").alias("entry_no"), "phone_raw", named.alias("display_name"), F.lit(None).cast("string").alias("identity_type"), F.when(F.col("reporter_ref").isNotNull(), F.col("category")).alias("category"), F.lit("app").alias("note_source"))
    return ingest.confirmed(entries, marts.moment(_WRITTEN))


@_query(
    "user_confirmed_numbers",
    f"""WITH {ladder_sql('phone_raw', 'spam_reports')}, bt AS (SELECT normalized AS phone_e164, count(*) AS n, any_value(type) AS phone_type FROM spam_reports s JOIN ladder ON raw IS NOT DISTINCT FROM s.phone_raw WHERE normalized IS NOT NULL GROUP BY 1)
SELECT coalesce(o.phone_e164, bt.phone_e164) AS phone_e164, CAST(coalesce(observation_count, 0) + coalesce(n, 0) AS BIGINT) AS observation_count, coalesce(o.phone_type, bt.phone_type) AS phone_type, coalesce(national_number, regexp_replace(bt.phone_e164, '^\\+84', '0')) AS national_number,
  coalesce(first_seen_at, {_AT_WRITE}) AS first_seen_at, CASE WHEN bt.phone_e164 IS NULL THEN last_seen_at ELSE {_AT_WRITE} END AS last_seen_at FROM phone_numbers o FULL OUTER JOIN bt ON bt.phone_e164 = o.phone_e164""",
)
def user_confirmed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "phone_numbers").withColumn("observation_count", F.col("observation_count").cast("bigint"))
    observed = _confirmed_batch(spark, sf_dir)["phone_observations"]
    return ingest.numbers_after_confirmation(numbers, observed.select("phone_observation_id").where("false"), observed)


@_query(
    "user_confirmed_documents",
    f"""WITH {ladder_sql('phone_raw', 'spam_reports')} SELECT sha256(c) AS content_hash, c AS raw_content, url FROM (SELECT 'phone=' || phone_raw || ' display_name=Người gọi ' || category || ' note_source=app' AS c, 'manual://user-confirmed/' || normalized || '/' || CAST(epoch_ms({_AT_WRITE}) AS VARCHAR) AS url
FROM spam_reports s JOIN ladder ON raw IS NOT DISTINCT FROM s.phone_raw WHERE normalized IS NOT NULL)""",
)
def user_confirmed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confirmed_batch(spark, sf_dir)["raw_documents"].select("content_hash", "raw_content", "url")


@_query("confirmed_national_number", "SELECT phone_e164, regexp_replace(phone_e164, '^\\+84', '0') AS national FROM phone_numbers")
def confirmed_national_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "phone_numbers").select("phone_e164", catalog.phone.confirmed_national_number(F.col("phone_e164")).alias("national"))


# -- collection ---------------------------------------------------------------------------------------------------

_LINK = "'(?i)href=[\"'']tel:([^\"'']+)[\"'']'"
_TITLE, _DESCRIBED = "'(?is)<title[^>]*>(.*?)</title>'", "'(?i)<meta[^>]*name=[\"'']description[\"''][^>]*content=[\"'']([^\"'']*)[\"'']'"


@_query(
    "html_candidate_order",
    f"""WITH m AS (SELECT id, 0 AS k, regexp_extract_all(raw_content, {_LINK}, 1) AS found FROM raw_documents UNION ALL SELECT id, 1, regexp_extract_all({catalog._visible_sql('raw_content')}, '{catalog.PHONE_PATTERN}', 0) FROM raw_documents
UNION ALL SELECT id, 2, regexp_extract_all(trim(regexp_extract(raw_content, {_TITLE}, 1)), '{catalog.PHONE_PATTERN}', 0) FROM raw_documents UNION ALL SELECT id, 3, regexp_extract_all(regexp_extract(raw_content, {_DESCRIBED}, 1), '{catalog.PHONE_PATTERN}', 0) FROM raw_documents),
e AS (SELECT id, k, unnest(found) AS phone_raw, generate_subscripts(found, 1) AS n FROM m) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k, n) AS INTEGER) AS place, phone_raw FROM e""",
)
def html_candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every page in their order: links, text, title, description."""
    found = catalog.text.html_candidates(table(spark, sf_dir, "raw_documents").select("id", "raw_content"), "raw_content")
    place = F.row_number().over(Window.partitionBy("id").orderBy("method_rank", "ordinal"))
    return found.select("id", place.alias("place"), "phone_raw")


@_query("sitemap_resolution", "SELECT DISTINCT s.base_url, trim(t.url) AS url FROM crawl_targets t JOIN data_sources s ON s.id = t.source_id")
def sitemap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target found again out of sitemaps that are written of them: an index for each site, sixteen sitemaps below it, half of them packed."""
    targets, sources = _t(spark, sf_dir, "crawl_targets", "data_sources")
    rows = targets.join(sources.select(F.col("id").alias("source_id"), "base_url"), "source_id").withColumn("part", F.substring("id", 1, 1))
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    maps = rows.groupBy("base_url", "part").agg(F.array_join(F.collect_list(loc), "").alias("urls"))
    address = F.concat("base_url", F.lit("/map-"), "part", F.lit(".xml"))
    leaves = maps.select(address.alias("url"), F.encode(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "urls", F.lit("</urlset>")), "UTF-8").alias("body"))
    index = maps.groupBy("base_url").agg(F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), address, F.lit("</loc></sitemap>"))), "").alias("maps"))
    roots = index.select(F.concat("base_url", F.lit("/sitemap.xml")).alias("url"), F.encode(F.concat(F.lit("<sitemapindex>"), "maps", F.lit("</sitemapindex>")), "UTF-8").alias("body"))
    start = index.select("base_url", F.concat("base_url", F.lit("/sitemap.xml")).alias("sitemap"))
    return catalog.sitemaps.resolve(start, leaves.unionByName(roots)).where("url IS NOT NULL").select("base_url", "url")


_STATUS = "CASE source_type WHEN 'NEWS' THEN 403 WHEN 'OTHER' THEN 503 WHEN 'GOVERNMENT' THEN NULL ELSE 200 END"


@_query(
    "robots_permissions",
    f"""WITH r AS (SELECT id AS source_id, {_STATUS} AS status FROM data_sources)
SELECT t.id, CASE WHEN r.status IS NULL OR r.status = 403 THEN false WHEN r.status = 503 THEN true ELSE NOT starts_with(regexp_replace(t.url, '^[a-z]+://[^/]*', ''), '/contact') END AS allowed FROM crawl_targets t JOIN r USING (source_id)""",
)
def robots_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which targets may be fetched by answers made for each source: refusals, failures, silence, and rules."""
    targets, sources = _t(spark, sf_dir, "crawl_targets", "data_sources")
    answers = sources.select(F.col("id").alias("domain"), F.expr(_STATUS).cast("int").alias("status"), F.lit("User-agent: *\nDisallow: /contact\n").alias("body"))
    asked = targets.select("id", F.col("source_id").alias("domain"), "url")
    return catalog.sitemaps.with_permission(asked, answers, "ringlore").select("id", "allowed")


@_query("header_identifiers", "SELECT name, trim(regexp_replace(lower(strip_accents(replace(replace(name, 'đ', 'd'), 'Đ', 'D'))), '[^a-z0-9]+', '_', 'g'), '_') AS identifier FROM data_sources")
def header_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "data_sources").select("name", catalog.urls.identifier(F.col("name")).alias("identifier"))


_FETCHED = "f AS (SELECT DISTINCT ON (url) url, raw_content, http_status FROM raw_documents WHERE url IS NOT NULL AND raw_content IS NOT NULL ORDER BY url, created_at DESC, id)"


@_query(
    "crawl_step",
    f"""WITH {_FETCHED}, l AS (SELECT crawl_target_id, arg_max(content_hash, (created_at, id)) AS h FROM raw_documents WHERE crawl_target_id IS NOT NULL AND created_at < TIMESTAMP '2025-01-01' GROUP BY 1)
SELECT t.id AS crawl_target_id, sha256(raw_content) AS content_hash, trim(regexp_extract(raw_content, {_TITLE}, 1)) AS title FROM crawl_targets t JOIN f ON f.url = t.url LEFT JOIN l ON l.crawl_target_id = t.id
WHERE f.http_status < 400 AND sha256(raw_content) IS DISTINCT FROM l.h""",
)
def crawl_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that crawling all targets puts in beside those stored before 2025, their latest pages standing for the network."""
    targets, documents = _t(spark, sf_dir, "crawl_targets", "raw_documents")
    latest = catalog.marts.greatest_per(documents.where("url IS NOT NULL AND raw_content IS NOT NULL"), ["url"], [F.col("created_at").desc(), F.col("id")])
    pages = latest.select("url", F.col("url").alias("final_url"), "http_status", "content_type", F.col("raw_content").alias("body"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(False).alias("not_modified"), "fetched_at", F.lit(None).cast("string").alias("error"))
    stored = documents.where(F.col("created_at") < marts.moment("2025-01-01 00:00:00"))
    out = pipelines.crawled(targets, stored, marts.moment(_WRITTEN), lambda asked: pages.join(asked.select("url").distinct(), "url", "left_semi"))
    return out["raw_documents"].select("crawl_target_id", "content_hash", "title")
