"""Merging, ingestion, confirmed entries, streams, and queries against their SQL twins."""

import datetime as dt
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from ringlore.operators.merge import changed_documents, insert_new, merge
from ringlore.plans import catalog, catalog_jobs, ingest, marts, pipelines, writes  # noqa: F401
from ringlore.session import table
from ringlore.streaming import continuous


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, "a", "x", 1, 5), (2, "b", None, 2, 6)], "k int, first string, last string, n int, low int")
    new = spark.createDataFrame([(2, "z", "y", 10, 1), (3, "c", None, 1, 9)], "k int, first string, last string, n int, low int")
    got = _rows(merge(old, new, ["k"], {"first": "first", "last": "last", "n": "sum", "low": "min"}))
    assert got == [(1, "a", "x", 1, 5), (2, "b", "y", 12, 1), (3, "c", None, 1, 9)]
    over = _rows(merge(old, new.withColumn("last", F.lit(None).cast("string")), ["k"], {"last": "overwrite", "low": "max"}))
    assert over == [(1, "x", 5), (2, None, 6), (3, None, 9)]
    with pytest.raises(ValueError):
        merge(old, new, ["k"], {"n": "median"})
    assert _rows(insert_new(old, new, ["k"]).select("k")) == [(3,)]


def test_changed_documents(spark):
    stored = spark.createDataFrame([("t1", "h1", 1), ("t1", "h2", 2), (None, "h9", 1)], "t string, h string, at int")
    incoming = spark.createDataFrame([("t1", "h2", 3), ("t1", "h1", 4), ("t2", "h5", 3), (None, "h9", 3)], "t string, h string, at int")
    assert _rows(changed_documents(stored, incoming, "t", "h", "at")) == [("t1", "h1", 4), ("t2", "h5", 3), (None, "h9", 3)] or len(_rows(changed_documents(stored, incoming, "t", "h", "at"))) == 3


def test_confirmed_twice(spark):
    entry = "entry_no int, phone_raw string, display_name string, identity_type string, category string, note_source string"
    one = ingest.confirmed(spark.createDataFrame([(1, "0912 345 678", "Anh  Nam", "PERSON", "OTHER", "app"), (2, "bad", "x", "PERSON", None, None)], entry), F.lit("2025-01-01").cast("timestamp_ntz"))
    two = ingest.confirmed(spark.createDataFrame([(1, "+84912345678", "anh nam", "PERSON", "BANK", None), (2, "+84912345678", "ANH NAM", None, None, None)], entry), F.lit("2025-02-01").cast("timestamp_ntz"))
    assert one["phone_observations"].count() == 1 and one["raw_documents"].head()["raw_content"] == "phone=0912 345 678 display_name=Anh  Nam note_source=app"
    stored = ingest.recounted(one["phone_identities"], one["phone_identity_evidence"])
    links = ingest.linked_evidence(one["phone_identity_evidence"], two["phone_identity_evidence"])
    row = ingest.identities_after_confirmation(stored, two, links).collect()
    assert len(row) == 1 and row[0]["evidence_count"] == 3 and row[0]["category"] is None and row[0]["display_name"] == "Anh  Nam" and row[0]["status"] == "CONFIRMED"
    again = ingest.linked_evidence(links, two["phone_identity_evidence"])  # the same batch once more
    assert ingest.identities_after_confirmation(stored, two, again).head()["evidence_count"] == 3
    numbers = spark.createDataFrame([("+84912345678", 5, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), "UNKNOWN", "x")], "phone_e164 string, observation_count bigint, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, phone_type string, national_number string")
    got = ingest.numbers_after_confirmation(numbers, one["phone_observations"].select("phone_observation_id"), two["phone_observations"].unionByName(one["phone_observations"])).head()
    assert (got["observation_count"], got["phone_type"], got["last_seen_at"]) == (7, "UNKNOWN", dt.datetime(2025, 2, 1))


def test_equal_rows_are_documents_of_their_own(spark):
    rows = spark.createDataFrame([("0912345678", "a"), ("0912345678", "a"), (" 0912345678 ", None), (None, "a")], "phone string, note string")
    got = ingest.dataset_observations(rows, "d").collect()
    assert len(got) == 3 and len({r["content_hash"] for r in got}) == 3 and {r["phone_raw"] for r in got} == {"0912345678"}
    again = ingest.dataset_observations(rows.repartition(3), "d").collect()
    assert {r["content_hash"] for r in got} == {r["content_hash"] for r in again}


def test_ties_of_a_batch_have_an_order(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [("+84912345678", t, kind) for kind in ("MOBILE", "UNKNOWN", "LANDLINE")]
    schema = "phone_normalized string, discovered_at timestamp_ntz, phone_type string"
    none = spark.createDataFrame([], "phone_e164 string, observation_count bigint, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, phone_type string")
    got = {ingest.merged_numbers(none, spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(3)).head()["phone_type"] for k in range(3)}
    assert got == {"UNKNOWN"}


def _page(url, body, status=200, same=False, error=None):
    return (url, url, status, "text/html", body, '"e"' if same else None, None, same, dt.datetime(2025, 1, 1), error)


def test_crawled(spark):
    from ringlore.sources import web

    new, old = "<p>Gọi 0912 345 678</p>", "<p>Gọi 0987 654 321</p>"
    fetched = spark.createDataFrame([_page("u1", new), _page("u2", old), _page("u3", "", 304, True), _page("u4", "gone", 404), _page("u5", None, None, error="timed out")], web.PAGE.replace("fetched_at timestamp", "fetched_at timestamp_ntz"))
    targets = spark.createDataFrame([(f"t{i}", "s", f"u{i}", None, None) for i in range(1, 6)], "id string, source_id string, url string, etag string, last_modified string")
    stored = spark.createDataFrame([("d1", "t2", dt.datetime(2024, 1, 1))], "id string, crawl_target_id string, created_at timestamp_ntz").withColumn("content_hash", F.sha2(F.lit(old), 256))
    out = pipelines.crawled(targets, stored, F.lit("2025-01-02").cast("timestamp_ntz"), lambda t: t.select("url").join(fetched, "url"))
    assert [r["crawl_target_id"] for r in out["raw_documents"].collect()] == ["t1"]
    assert {r["phone_normalized"] for r in out["phone_observations"].collect()} == {"+84912345678"}
    got = {r["id"]: (r["crawl_status"], r["content_hash"] is None, r["etag"]) for r in out["results"].collect()}
    assert got == {"t1": ("SUCCESS", False, None), "t2": ("SUCCESS", False, None), "t3": ("SUCCESS", True, '"e"'), "t4": ("FAILED", False, None), "t5": ("FAILED", True, None)}
    table_ = targets.withColumns({"crawl_status": F.lit("PENDING"), "http_status": F.lit(None).cast("int"), "content_hash": F.lit("h"), "attempt_count": F.lit(1), "last_crawled_at": F.lit(None).cast("timestamp_ntz"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    after = {r["id"]: r for r in writes.targets_after_results(table_.withColumn("etag", F.lit("old")), out["results"], F.lit("2025-01-02").cast("timestamp_ntz")).collect()}
    assert after["t3"]["content_hash"] is None and after["t3"]["etag"] == '"e"' and after["t1"]["etag"] == "old" and after["t1"]["attempt_count"] == 2


def test_discovered(spark):
    domains = spark.createDataFrame([("https://a.vn", "A"), ("https://b.vn", "B")], "base_url string, name string")
    robots = spark.createDataFrame([("https://a.vn", "Sitemap: https://a.vn/m.xml")], "base_url string, robots string")
    urls = "".join(f"<url><loc>https://a.vn/{x}</loc></url>" for x in ("blog", "lien-he", "about", "cart", "blog"))
    pages = spark.createDataFrame([("https://a.vn/m.xml", bytearray(f"<urlset>{urls}</urlset>".encode()))], "url string, body binary")
    out = pipelines.discovered(domains, robots, pages, F.lit("2025-01-02").cast("timestamp_ntz"), most=2)
    assert [(r["url"], r["priority"]) for r in out["queued"].orderBy("rank").collect()] == [("https://a.vn/lien-he", 100), ("https://a.vn/about", 40)]
    runs = {r["domain"]: r for r in out["domain_discoveries"].collect()}
    assert (runs["a.vn"]["status"], runs["a.vn"]["robots_found"], runs["a.vn"]["sitemaps_found"], runs["a.vn"]["urls_discovered"], runs["a.vn"]["urls_queued"]) == ("SUCCESS", True, 1, 4, 2)
    assert (runs["b.vn"]["status"], runs["b.vn"]["robots_found"], runs["b.vn"]["error_message"]) == ("FAILED", False, "missing")
    assert {r["trust_level"] for r in out["data_sources"].collect()} == {"MEDIUM"}


def test_ingested(spark, tmp_path):
    ledger = spark.createDataFrame([], "id string, checksum string, status string")
    (tmp_path / "a.csv").write_text("phone,name\n0912345678,x\n0912345678,x\n")
    got = pipelines.ingested(spark, str(tmp_path / "a.csv"), ledger)
    assert (got["status"], got["rows"], got["observations"].count()) == ("SUCCESS", 2, 2)
    known = spark.createDataFrame([("d1", got["checksum"], "SUCCESS")], "id string, checksum string, status string")
    assert pipelines.ingested(spark, str(tmp_path / "a.csv"), known)["status"] == "ALREADY_INGESTED"
    again = pipelines.ingested(spark, str(tmp_path / "a.csv"), known.withColumn("status", F.lit("FAILED")))
    assert (again["status"], again["dataset_id"]) == ("SUCCESS", "d1")
    (tmp_path / "b.csv").write_text("name\nx\n")
    assert pipelines.ingested(spark, str(tmp_path / "b.csv"), ledger)["status"] == "FAILED"


def test_validation():
    assert writes.call_batch_errors("2025-01-31", 1) == [] and writes.call_batch_errors("31/1/2025", 0, "NOISE", "yes") == ["date", "entries", "category", "enabled"]


def test_page_pipeline(spark):
    pages = spark.createDataFrame([("d1", '<p>Gọi 0912 345 678</p><a href="tel:0912345678">x</a>')], "id string, raw_content string")
    got = ingest.page_observations(pages).collect()
    assert len(got) == 2 and {r["phone_normalized"] for r in got} == {"+84912345678"} and {r["phone_type"] for r in got} == {"MOBILE"}
    seen = spark.createDataFrame([("d1",)], "raw_document_id string")
    assert ingest.unextracted(pages, seen).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(f"09123456{i % 7:02d}", t0 + dt.timedelta(minutes=11 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "phone_raw string, discovered_at timestamp_ntz")
    for k in range(3):
        df.where(F.col("phone_raw").endswith(str(k)) | (F.lit(k) == 2) & ~F.col("phone_raw").rlike("[01]$")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = continuous.normalized_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")))
    store = continuous.NumberStore(spark, str(tmp_path / "store"))
    last = []

    def write(batch, n):
        store.write(batch, n)
        last.append(n)

    continuous.drain(stream, write, str(tmp_path / "cp")).awaitTermination(120)
    batch = continuous.normalized_stream(df).withColumn("id", F.monotonically_increasing_id())
    assert last and _rows(store.read(last[-1]).select("phone_e164", "observation_count", "first_seen_at", "last_seen_at")) == _rows(marts.number_rollup(batch).select("phone_e164", "observation_count", "first_seen_at", "last_seen_at"))
    hours = continuous.hourly_counts(continuous.normalized_stream(df), "discovered_at")
    assert sum(r["observations"] for r in hours.collect()) == 60


def test_claims_do_not_depend_on_order(spark, sf_dir):
    parts = [table(spark, sf_dir, n) for n in ("phone_observations", "raw_documents", "data_sources")]
    numbers = table(spark, sf_dir, "phone_numbers")
    one = marts.claims(marts.evidence_rows(*[p.repartition(1) for p in parts]), numbers)
    other = marts.claims(marts.evidence_rows(*[p.repartition(8) for p in parts]), numbers)
    assert _rows(one) == _rows(other)
    reports = table(spark, sf_dir, "spam_reports")
    assert _rows(marts.spam_flags(reports.repartition(1))) == _rows(marts.spam_flags(reports.repartition(8)))


def _plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "events", "documents", "data_sources", "crawl_targets", "raw_documents", "phone_observations", "phone_numbers", "phone_identities", "personal_call_logs", "spam_reports"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == columns
    at = [list(rel.columns).index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry_without_subpackage(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "ringlore.llm.queries", None)  # whatever keeps it from being imported
    assert set(entry.queries()) == set(catalog.QUERIES)


def test_number_store_rewrites_touched_parts_only(spark, tmp_path):
    store = continuous.NumberStore(spark, str(tmp_path), buckets=4)
    t = dt.datetime(2025, 1, 1)
    batches = [[f"+8491000000{i}" for i in range(8)], ["+84910000001"], ["+84910000001", "+84910000002"]]
    frames = [spark.createDataFrame([(p, "MOBILE", t) for p in b], "phone_normalized string, phone_type string, discovered_at timestamp_ntz") for b in batches]
    for k, df in enumerate(frames):
        store.write(df, k)
    store.write(frames[2], 2)  # once more, as after a failure
    assert {r["phone_e164"]: r["observation_count"] for r in store.read(2).collect()} == {f"+8491000000{i}": 3 if i == 1 else 2 if i == 2 else 1 for i in range(8)}
    parts = store._parts(1)
    assert sum(v == 1 for v in parts.values()) == 1 and store.read(-1).count() == 0
    rewritten = next(b for b, v in parts.items() if v == 1)
    assert not (tmp_path / "data" / "0" / f"bucket={rewritten}").exists()


def test_stopping_between_batches(spark, tmp_path):
    spark.range(3).withColumn("phone_raw", F.lit("0912345678")).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long, phone_raw string").parquet(str(tmp_path / "in"))
    got = []
    query = continuous.keep_running(rows, lambda df, n: got.append(df.count()), str(tmp_path / "cp"), "1 second")
    query.processAllAvailable()
    continuous.stop_between_batches(query, 30)
    assert got[0] == 3 and not query.isActive
