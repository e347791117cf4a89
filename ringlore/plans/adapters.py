"""Tables of the data model that the test data lacks, derived from tables that it has by rules that any SQL engine can run.

Jobs and datasets come from crawl_targets (their ids' digits decide), host metrics from events, suppressed numbers from
phone_numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The present of the derived jobs and metrics.
NOW_JOBS, NOW_METRICS = "2024-07-01 00:00:00", "2024-01-20 00:00:00"


def _digit(k: int) -> str:
    return f"(instr('0123456789abcdef', substr(id, {k}, 1)) - 1)"


JOBS_SQL = f"""
SELECT concat('j', id) AS id,
       CASE WHEN a < 6 THEN 'CRAWL_URL' WHEN a < 9 THEN 'RECRAWL' WHEN a < 11 THEN 'CRAWL_SOURCE' WHEN a < 14 THEN 'DISCOVER_SITEMAP' ELSE 'INGEST_DATASET' END AS job_type,
       source_id, CASE WHEN a < 9 THEN id END AS crawl_target_id,
       CAST(100 + 10 * c AS INT) AS priority, status, CAST(c % 5 AS INT) AS attempt_count, 5 AS max_attempts, scheduled_at,
       CASE WHEN status IN ('SUCCESS', 'FAILED') OR status = 'RUNNING' AND c > 0 THEN scheduled_at + INTERVAL '60' SECOND END AS started_at,
       CASE WHEN status IN ('SUCCESS', 'FAILED') THEN scheduled_at + (61 + c) * INTERVAL '1' SECOND END AS finished_at,
       CASE WHEN status = 'RUNNING' THEN scheduled_at + INTERVAL '60' SECOND END AS locked_at,
       CASE WHEN status = 'RUNNING' THEN concat('worker:', CAST(c AS VARCHAR(9))) END AS locked_by,
       CASE WHEN status = 'FAILED' THEN 'timeout' END AS error_message, scheduled_at - INTERVAL '5' MINUTE AS created_at
FROM (SELECT id, source_id, a, c,
             CASE WHEN b < 2 THEN 'PENDING' WHEN b < 4 THEN 'RUNNING' WHEN b < 5 THEN 'RETRY' WHEN b < 13 THEN 'SUCCESS' WHEN b < 15 THEN 'FAILED' ELSE 'CANCELLED' END AS status,
             TIMESTAMP '{NOW_JOBS}' + INTERVAL '1' HOUR - (16 * d + e) * INTERVAL '6' MINUTE AS scheduled_at
      FROM (SELECT id, source_id, {_digit(1)} AS a, {_digit(2)} AS b, {_digit(3)} AS c, {_digit(4)} AS d, {_digit(5)} AS e FROM crawl_targets))
"""

METRICS_SQL = """
SELECT event_id, ts AS recorded_at, CAST(value AS DOUBLE) AS cpu_percent, CAST(event_id % 400 AS DOUBLE) / 100 AS load_1,
       CAST(user_id AS BIGINT) * 1048576 AS memory_available_bytes, CAST(8589934592 AS BIGINT) AS memory_total_bytes
FROM events
"""

SUPPRESSED_SQL = f"SELECT phone_e164 AS phone_normalized, phone_type AS reason, created_at FROM phone_numbers WHERE {_digit(1)} = 7"

DATASETS_SQL = f"""
SELECT concat('d', id) AS id, source_id, url AS name, coalesce(content_hash, id) AS checksum, CASE WHEN {_digit(6)} < 10 THEN 'SUCCESS' WHEN {_digit(6)} < 13 THEN 'FAILED' ELSE 'PENDING' END AS status,
       CAST({_digit(7)} AS BIGINT) AS processed_rows
FROM crawl_targets WHERE content_hash IS NOT NULL
"""


def _run(sql: str, source: DataFrame, name: str) -> DataFrame:
    return source.sparkSession.sql(sql.replace(f"FROM {name}", "FROM {source}").replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("VARCHAR(9)", "STRING"), source=source)


def crawl_jobs(targets: DataFrame) -> DataFrame:
    return _run(JOBS_SQL, targets, "crawl_targets")


def system_metrics(events: DataFrame) -> DataFrame:
    return _run(METRICS_SQL, events, "events")


def label_suppressions(numbers: DataFrame) -> DataFrame:
    return _run(SUPPRESSED_SQL, numbers, "phone_numbers")


def datasets(targets: DataFrame) -> DataFrame:
    return _run(DATASETS_SQL, targets, "crawl_targets")
