"""Scenarios of the composite queries."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ringlore.functions import display
from ringlore.plans import marts, queue
from ringlore.rules import RULES

A, B, C, LAND = "+84912345678", "+84987654321", "+84901112223", "+842838229999"


def _reports(spark, rows):
    return spark.createDataFrame([(f"r{i}", *r) for i, r in enumerate(rows)], "id string, phone_normalized string, category string, reporter_ref string")


def test_spam_escalation(spark):
    got = {r["phone_normalized"]: r for r in marts.spam_flags(_reports(spark, [(A, "SCAM", "a"), (A, "SCAM", "a"), (A, "SPAM", "b"), (A, "SCAM", "c"), (B, "SPAM", None), (B, "SPAM", None), (None, "SPAM", "x")])).collect()}
    assert set(got) == {A, B}
    assert (got[A]["report_count"], got[A]["reporter_count"], got[A]["risk"], got[A]["top_category"]) == (4, 3, "MEDIUM", "SCAM")
    assert got[B]["reporter_count"] == 2  # nameless reporters count one by one
    tie = marts.spam_flags(_reports(spark, [(A, "SPAM", "a"), (A, "OTHER", "b")])).head()
    assert tie["top_category"] == "OTHER"
    assert marts.spam_flags(_reports(spark, [(A, "SCAM", str(i)) for i in range(10)])).head()["risk"] == "HIGH"


def test_blocking(spark):
    rows = [(A, "SCAM", str(i)) for i in range(10)] + [(B, "TELEMARKETING", str(i)) for i in range(10)] + [(C, "SCAM", str(i)) for i in range(10)]
    suppressed = spark.createDataFrame([(C,)], "phone_normalized string")
    assert [r["digits"] for r in marts.blocked_digits(_reports(spark, rows), suppressed).collect()] == [A[1:]]
    assert marts.blocked_digits(_reports(spark, rows), suppressed, enabled=False).count() == 0


IDENTITY = "id string, phone_number_id string, display_name string, normalized_name string, claim_source string, identity_type string, category string, confidence decimal(5,2), evidence_count int, status string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
SEEN = "id string, phone_normalized string, context_text string, context_before string, context_after string, discovered_at timestamp_ntz, source_id string, source_name string, source_type string, trust_level string"
T = dt.datetime(2025, 1, 1)


def _identity(i, number, name, status="CANDIDATE", confidence=40, by=RULES, category=None):
    return (i, number, name, name.lower(), by, "BUSINESS", category, D(confidence), 1, status, T, T)


def _sighting(i, number, company, source, trust, kind="OTHER"):
    return (i, number, f"{company} {number}", company, "", T, source, source, kind, trust)


def _world(spark):
    numbers = spark.createDataFrame([("n1", A, "MOBILE"), ("n2", B, "MOBILE"), ("n3", LAND, "LANDLINE"), ("n4", "19001234", "HOTLINE_1900")], "id string, phone_e164 string, phone_type string")
    identities = spark.createDataFrame(
        [_identity("i1", "n1", "Công ty Sao"), _identity("i2", "n1", "Công ty Trăng", "CONFIRMED", 99, "caller_label_v1"), _identity("i4", "n3", "Công ty Mây", "REJECTED", 99)], IDENTITY
    )
    evidence = spark.createDataFrame(
        [_sighting("o1", A, "Công ty Sao", "Sở X", "HIGH", "GOVERNMENT"), _sighting("o2", B, "", "Báo X", "HIGH"), _sighting("o3", LAND, "Công ty Mây", "Báo X", "HIGH"), _sighting("o4", "19001234", "Công ty Nắng", "Báo X", "HIGH"),
         _sighting("o5", A, "Công ty Gió", "Blog", "MEDIUM"), _sighting("o6", A, "Công ty Gió", "Blog", "MEDIUM"), _sighting("o7", A, "Công ty Gió", "Blog", "MEDIUM"), _sighting("o8", A, "Công ty Gió", "Blog", "MEDIUM"),
         _sighting("o9", A, "Công ty Gió", "Blog", "MEDIUM"), _sighting("p1", A, "Công ty Gió", "Blog", "MEDIUM")], SEEN,
    )
    return numbers, identities, evidence


def test_directory_tiers(spark):
    numbers, identities, evidence = _world(spark)
    reports = _reports(spark, [(B, "SCAM", "a"), *[(C, "SCAM", str(i)) for i in range(12)], ("1234", "SPAM", "z")])
    none = spark.createDataFrame([], "phone_normalized string")
    rows = marts.in_number_order(marts.call_directory(numbers, identities, evidence, reports, none)).collect()
    # the claim of six sightings in a source of medium trust is stronger, but only the trusted source's own claim is shown
    assert {r["digits"]: r["label"] for r in rows} == {A[1:]: "Công ty Sao", B[1:]: "⚠️ Báo X", C[1:]: "⚠️ Nghi ngờ LỪA ĐẢO (12 báo cáo)"}
    assert [int(r["digits"]) for r in rows] == sorted(int(r["digits"]) for r in rows)
    out = spark.createDataFrame([(A,)], "phone_normalized string")
    assert A[1:] not in {r["digits"] for r in marts.call_directory(numbers, identities, evidence, reports, out).collect()}
    assert {r["phone_e164"] for r in marts.production_numbers(numbers, identities, evidence).collect()} == {A, B}
    fixture = evidence.withColumn("source_name", F.lit("Fixture one"))
    assert marts.production_numbers(numbers, identities, fixture).count() == 0


def test_identities_after_a_run(spark):
    numbers, identities, evidence = _world(spark)
    got = {(r["phone_normalized"], r["name_key"], r["claim_source"]): r for r in marts.identities_after_run(numbers, identities.withColumn("category", F.lit("BANK")), evidence).collect()}
    sao = got[A, "công ty sao", RULES]
    assert sao["category"] == "BANK" and sao["evidence_count"] == 1 and sao["confidence"] == 65.0 and sao["first_seen_at"] == T
    assert got[LAND, "công ty mây", RULES]["status"] == "REJECTED" and got[A, "công ty trăng", "caller_label_v1"]["confidence"] == 99.0
    assert got[A, "công ty gió", RULES]["status"] == "CANDIDATE"


def test_unknown_numbers(spark):
    numbers, identities, _ = _world(spark)
    day = dt.date(2025, 6, 30)
    rows = [("c1", A, A, 1, day, T), ("c2", None, "abc", 2, day, T), ("c3", C, "0901112223", 20, dt.date(2025, 1, 1), T), ("c4", C, "090 111 2223", 1, dt.date(2025, 1, 1), T + dt.timedelta(days=1)), ("c5", LAND, LAND, 1, day, T)]
    calls = spark.createDataFrame(rows, "id string, phone_normalized string, phone_raw string, call_count int, call_date date, imported_at timestamp_ntz")
    got = marts.unknown_numbers(calls, numbers, identities, "2025-07-01").collect()
    # the landline's only identity was rejected: nobody knows it
    assert {r["phone"]: r["priority"] for r in got} == {"abc": 10 + 29 + 3, C: 50 + 0 + 3, LAND: 5 + 29 + 3}
    assert [r["phone"] for r in got] == [C, "abc", LAND] and got[0]["phone_raw"] == "090 111 2223"


def test_lookup_shapes(spark):
    numbers, identities, evidence = _world(spark)
    numbers = numbers.withColumns({"observation_count": F.lit(7), "first_seen_at": F.lit(T), "last_seen_at": F.lit(T)})
    asked = spark.createDataFrame([("0912 345 678",), ("0901112223",), ("xyz",), (None,)], "raw_input string")
    got = {r["raw_input"]: r for r in marts.lookup(asked, numbers, identities, evidence, _reports(spark, [(C, "SCAM", "a")])).collect()}
    assert [got[x]["shape"] for x in ("0912 345 678", "0901112223", "xyz", None)] == ["SEEN", "NEVER_SEEN", "INVALID", "INVALID"]
    assert [(i["name"], i["status"]) for i in got["0912 345 678"]["identities"]] == [("Công ty Trăng", "CONFIRMED"), ("Công ty Sao", "CANDIDATE")]
    assert got["0912 345 678"]["source_count"] == 2 and got["0912 345 678"]["observation_count"] == 7 and got["0912 345 678"]["risk"] == "NONE"
    assert got["0901112223"]["risk"] == "MEDIUM" and got["0901112223"]["identities"] == [] and got["xyz"]["normalized"] is None


def test_growth_counts_production_numbers_only(spark):
    numbers, identities, evidence = _world(spark)
    numbers = numbers.withColumn("first_seen_at", F.lit(dt.datetime(2025, 6, 30, 23, 30)))
    real = marts.production_numbers(numbers, identities, evidence)
    assert [(r["hour"], r["new_numbers"]) for r in marts.growth_hourly(real, marts.AS_OF, 24).collect()] == [(dt.datetime(2025, 6, 30, 23), 2)]
    row = marts.growth_horizons(real, marts.AS_OF, "2025-06-30 23:45:00").head()
    assert (row["total"], row["last_1h"], row["since_observation"]) == (2, 2, 0)


JOB = "id string, job_type string, source_id string, crawl_target_id string, status string, priority int, attempt_count int, scheduled_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, locked_at timestamp_ntz, locked_by string, error_message string, max_attempts int, created_at timestamp_ntz"
NOON = dt.datetime(2025, 1, 1, 12)
AT = "2025-01-01 12:00:00"


def _job(i, status, priority=10, tries=0, at=NOON, started=None, locked=None, target=None, source="s1", kind="CRAWL_URL"):
    return (i, kind, source, target, status, priority, tries, at, started, None, locked, None, None, 5, at)


def test_queue(spark):
    h = dt.timedelta(hours=1)
    rows = [_job("1", "PENDING"), _job("2", "PENDING", 200), _job("3", "RETRY", 200, 2, NOON - h), _job("4", "RUNNING", 5, 1, started=NOON, locked=NOON - 2 * h), _job("5", "RUNNING", 5, 4, started=NOON - 3 * h, locked=NOON), _job("6", "PENDING", 900, 0, NOON + 24 * h)]
    jobs = spark.createDataFrame(rows, JOB)
    assert [r["id"] for r in queue.claimed(jobs, AT, 5, "w").collect()] == ["3", "2", "1"]
    errors = spark.createDataFrame([("4", "x"), ("5", "y")], "id string, error string")
    got = {r["id"]: r for r in queue.failed(jobs, errors, AT).collect()}
    assert (got["4"]["status"], got["4"]["scheduled_at"], got["4"]["finished_at"]) == ("RETRY", NOON + dt.timedelta(seconds=60), None)
    assert (got["5"]["status"], got["5"]["finished_at"], got["5"]["error_message"]) == ("FAILED", NOON, "y")
    stale = queue.recovered(jobs, AT).collect()
    assert [(r["id"], r["attempt_count"]) for r in stale] == [("4", 1)]  # by its lock, not by its start
    done = queue.after(jobs, queue.completed(jobs, jobs.where("id = '5'"), AT))
    assert {r["id"]: r["status"] for r in done.collect()}["5"] == "SUCCESS" and done.count() == 6


def test_slots(spark):
    jobs = spark.createDataFrame([_job("a", "RUNNING", target="t1"), _job("b", "SUCCESS", target="t2"), _job("c", "PENDING", kind="DISCOVER_SITEMAP")], JOB)
    wanted = spark.createDataFrame([("w1", "CRAWL_URL", "s1", "t1"), ("w2", "CRAWL_URL", "s1", "t2"), ("w3", "CRAWL_URL", "s1", "t2"), ("w4", "DISCOVER_SITEMAP", "s1", None), ("w5", "DISCOVER_SITEMAP", "s2", None), ("w6", "DISCOVER_DOMAIN", None, None), ("w7", "DISCOVER_DOMAIN", None, None)], "id string, job_type string, source_id string, crawl_target_id string")
    got = {r["id"]: (r["job_id"], r["created"]) for r in queue.created_jobs(jobs, wanted).collect()}
    assert got == {"w1": ("a", False), "w2": ("w2", True), "w3": ("w2", False), "w4": ("c", False), "w5": ("w5", True), "w6": ("w6", True), "w7": ("w7", True)}


def test_scheduler_pass(spark):
    targets = spark.createDataFrame([(f"t{i}", "s1", "active", 10 - i, NOON - dt.timedelta(days=1)) for i in range(4)] + [("t9", "s1", "disabled", 99, NOON), ("t8", "s1", "active", 99, NOON + dt.timedelta(days=1))], "id string, source_id string, status string, priority int, next_crawl_at timestamp_ntz")
    sources = spark.createDataFrame(
        [("s1", True, "WEEKLY", NOON), ("s2", True, "DAILY", NOON), ("s3", True, "MANUAL", NOON), ("s4", False, "DAILY", NOON), ("s5", True, "DAILY", NOON + dt.timedelta(1)), ("s6", True, "DAILY", None)],
        "id string, is_active boolean, crawl_frequency string, next_scheduled_at timestamp_ntz",
    )
    busy = spark.createDataFrame([_job("a", "RUNNING", target="t0")], JOB)
    got = [(r["place"], r["job_type"], r["crawl_target_id"] or r["source_id"]) for r in queue.scheduled(busy, targets, sources, AT).orderBy("place").collect()]
    assert got == [(1, "CRAWL_URL", "t1"), (2, "CRAWL_URL", "t2"), (3, "CRAWL_URL", "t3"), (4, "DISCOVER_SITEMAP", "s1")]
    after = queue.sources_after(sources, queue.scheduled(busy, targets, sources, AT), AT).collect()
    assert [(r["id"], r["next_scheduled_at"]) for r in after] == [("s1", NOON + dt.timedelta(days=7))]  # s2 stays due
    full = spark.createDataFrame([_job(str(i), "PENDING", target=f"x{i}") for i in range(5)], JOB)
    assert queue.scheduled(full, targets, sources, AT).count() == 0
    finding = spark.createDataFrame([_job("a", "RUNNING", kind="DISCOVER_SITEMAP")], JOB)
    assert {r["source_id"] for r in queue.scheduled(finding, targets.where("false"), sources, AT).collect()} == {"s2"}
    assert queue.scheduled(busy.limit(0), targets.limit(0), sources.limit(0), AT).count() == 0


def test_worker(spark):
    jobs = spark.createDataFrame([_job("1", "PENDING"), _job("2", "PENDING", kind="RECRAWL"), _job("3", "PENDING", kind="NORMALIZE"), _job("4", "SUCCESS")], JOB)

    def breaks(df):
        raise RuntimeError("down")

    worker = queue.Worker({"CRAWL_URL": lambda df: df.select("id", F.lit(None).cast("string").alias("error")), "RECRAWL": breaks})
    got = {r["id"]: (r["status"], r["error_message"]) for r in worker.step(jobs, AT, 10, "w").collect()}
    assert got == {"1": ("SUCCESS", None), "2": ("RETRY", "down"), "3": ("RETRY", "no handler for NORMALIZE"), "4": ("SUCCESS", None)}
    worker.stop()
    assert worker.outcomes(jobs).count() == 0


def test_running_jobs_without_a_start(spark):
    jobs = spark.createDataFrame([_job("1", "RUNNING", started=NOON - dt.timedelta(seconds=90, milliseconds=500)), _job("2", "RUNNING", source="gone")], JOB)
    sources = spark.createDataFrame([("s1", "Báo X")], "id string, name string")
    got = marts.running_jobs(jobs, sources, AT).collect()
    assert [(r["id"], r["source_name"], r["duration_seconds"]) for r in got] == [("1", "Báo X", 90), ("2", None, None)]


def test_display(spark):
    df = spark.createDataFrame([(3725, 1610612736, 100, 25), (125, None, 0, 0), (7, 0, 3, 1), (None, 1, None, None)], "s long, b long, total long, free long")
    got = [tuple(r) for r in df.select(display.duration(F.col("s")), display.gigabytes(F.col("b")), display.used_percent(F.col("total"), F.col("free"))).collect()]
    assert got == [("1h 2m", "1.5 GB", 75), ("2m 5s", "—", 0), ("7s", "0.0 GB", 67), ("—", "0.0 GB", 0)]


def test_queue_health(spark):
    for pending, minutes, want in ((2, 2, "HEALTHY"), (15, 1, "WARNING"), (1, 61, "WARNING"), (31, 1, "CRITICAL"), (1, 181, "CRITICAL"), (0, 0, "HEALTHY")):
        at = dt.datetime(2025, 1, 1, 12)
        jobs = spark.createDataFrame([("PENDING", at - dt.timedelta(minutes=minutes), None)] * pending, "status string, scheduled_at timestamp_ntz, finished_at timestamp_ntz")
        assert marts.queue_health(jobs, "2025-01-01 12:00:00").head()["health"] == want


def test_empty_tables(spark):
    numbers, identities, evidence = (d.limit(0) for d in _world(spark))
    reports = _reports(spark, [(A, "SPAM", "a")]).limit(0)
    none = spark.createDataFrame([], "phone_normalized string")
    assert marts.call_directory(numbers, identities, evidence, reports, none).count() == 0 and marts.spam_flags(reports).count() == 0
    assert marts.growth_horizons(numbers.withColumn("first_seen_at", F.lit(None).cast("timestamp_ntz")), marts.AS_OF, marts.AS_OF).head()["total"] == 0
