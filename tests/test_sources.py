"""Files, sitemaps, robots rules, host metrics and fetching from a server of our own."""

import gzip
import http.server
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from ringlore.functions import urls
from ringlore.plans import ingest
from ringlore.sources import collectors, files, procfs, sitemaps, web

URLSET = b'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.vn/lien-he </loc></url><url><loc>https://a.vn/blog</loc></url></urlset>'
INDEX = b"<sitemapindex><sitemap><loc>https://a.vn/s1.xml</loc></sitemap><sitemap><loc>https://a.vn/index.xml</loc></sitemap></sitemapindex>"


def _xlsx(path, rows):
    cells = "".join("<row r='%d'>%s</row>" % (i, "".join(f"<c r='{chr(65 + j)}{i}' t='inlineStr'><is><t>{v}</t></is></c>" for j, v in enumerate(r) if v)) for i, r in enumerate(rows, 1))
    main = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main} xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'><sheets><sheet name='a' sheetId='1' r:id='rId1'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='rId1' Target='worksheets/sheet1.xml'/></Relationships>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")


ROWS = [["company_name", "phone", "address"], ["Sao Mai", "0912 345 678", "Hà Nội"], ["Gió Mùa", "", "Huế"], ["Trăng", "19001234", ""]]


@pytest.mark.parametrize("kind", ["csv", "CSV", "json", "xlsx"])
def test_datasets(spark, tmp_path, kind):
    path = tmp_path / f"data.{kind}"
    if kind.lower() == "csv":
        path.write_bytes(b"\xef\xbb\xbf" + "\n".join(",".join(r) for r in ROWS).encode())
    elif kind == "json":
        path.write_text(json.dumps([dict(zip(ROWS[0], r)) for r in ROWS[1:]]))
    else:
        _xlsx(path, ROWS)
    df = files.read_dataset(spark, str(path))
    assert df.columns == ROWS[0] and df.count() == 3
    got = {r["phone_raw"]: r for r in ingest.dataset_observations(df, "d1").collect()}
    assert set(got) == {"0912 345 678", "19001234"} and got["0912 345 678"]["context_text"] == "company_name: Sao Mai, address: Hà Nội"


def test_bad_files(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_dataset(spark, str(tmp_path / "x.txt"))
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        files.read_json(spark, str(tmp_path / "e.json"))
    with pytest.raises(ValueError):
        ingest.dataset_observations(spark.createDataFrame([("a",)], "name string"), "d")
    (tmp_path / "s.json").write_text('{"sources": [{"name": "x", "base_url": "${ROOT}/x"}]}')
    assert files.load_sources(str(tmp_path / "s.json"), ROOT="http://h")[0]["base_url"] == "http://h/x"


def test_sitemaps(spark):
    assert sitemaps.parse_sitemap(URLSET)["urls"] == ["https://a.vn/lien-he", "https://a.vn/blog"]
    assert sitemaps.parse_sitemap(gzip.compress(URLSET))["urls"] == sitemaps.parse_sitemap(URLSET)["urls"]
    assert sitemaps.parse_sitemap(b"<oops")["error"].startswith("unreadable") and "<feed>" in sitemaps.parse_sitemap(b"<feed/>")["error"]
    assert sitemaps.parse_sitemap(b"<urlset><url><loc>a</loc></url>") == {"urls": [], "nested": [], "error": sitemaps.parse_sitemap(b"<urlset><url><loc>a</loc></url>")["error"]} and sitemaps.parse_sitemap(gzip.compress(URLSET)[:30])["error"]
    assert sitemaps.parse_sitemap(b"<urlset/>") == {"urls": [], "nested": [], "error": None}
    sites = spark.createDataFrame([("https://a.vn", "User-agent: *\nSitemap: https://a.vn/index.xml\n"), ("https://b.vn/", None)], "base_url string, robots string")
    start = sitemaps.starting_points(sites)
    assert start.where("base_url = 'https://a.vn'").count() == 1 and start.where("base_url = 'https://b.vn/'").count() == 4
    pages = spark.createDataFrame([("https://a.vn/index.xml", bytearray(INDEX)), ("https://a.vn/s1.xml", bytearray(URLSET))], "url string, body binary")
    found = sitemaps.resolve(start.where("base_url = 'https://a.vn'"), pages)
    assert {r["url"] for r in found.where("url IS NOT NULL").collect()} == {"https://a.vn/lien-he", "https://a.vn/blog"}
    report = ingest.discovery(found).head()
    assert (report["status"], report["urls_discovered"], report["urls_high_priority"]) == ("SUCCESS", 2, 1)
    assert ingest.discovery(sitemaps.resolve(start.where("base_url = 'https://b.vn/'"), pages)).head()["status"] == "FAILED"


def test_addresses_keep_the_order_in_which_they_were_met(spark):
    first = b"<urlset><url><loc>https://a.vn/z</loc></url><url><loc>https://a.vn/b</loc></url><url><loc>https://a.vn/z</loc></url></urlset>"
    start = spark.createDataFrame([("https://a.vn", "m1"), ("https://a.vn", "m2")], "base_url string, sitemap string")
    pages = spark.createDataFrame([("m1", bytearray(first)), ("m2", bytearray(b"<urlset><url><loc>https://a.vn/a</loc></url><url><loc>https://a.vn/b</loc></url></urlset>"))], "url string, body binary")
    assert [r["url"].rpartition("/")[2] for r in sitemaps.resolve(start, pages).orderBy("place").collect()] == ["z", "b", "a"]
    queued = ingest.queued_urls(sitemaps.resolve(start, pages)).orderBy("rank").collect()
    assert [r["url"].rpartition("/")[2] for r in queued] == ["z", "b", "a"]  # equal scores: as they were met


def test_headers(spark):
    heads = ["Số điện thoại", "Tên", " SDT ", "HOTLINE", "Điện-thoại", "phone number", "ĐTDĐ", "địa chỉ"]
    assert urls.phone_columns(spark, heads) == ["Số điện thoại", " SDT ", "HOTLINE", "Điện-thoại", "phone number"]
    got = spark.createDataFrame([("Số ĐIỆN thoại (di động)",), ("__Ưu tiên%1",), ("",)], "h string").select(urls.identifier(F.col("h"))).collect()
    assert [r[0] for r in got] == ["so_dien_thoai_di_dong", "uu_tien_1", ""]


def test_collectors(spark):
    site = {"https://a.vn/index.xml": INDEX.decode(), "https://a.vn/s1.xml": URLSET.decode(), "https://a.vn/lien-he": "<title>Liên hệ</title><p>Gọi 0912 345 678</p>"}
    shelf = spark.createDataFrame([(u, b, "text/html", 200) for u, b in site.items()], "url string, body string, content_type string, http_status int")
    http = collectors.HttpCollector(lambda targets: targets.select("url").join(shelf, "url"))
    sites = spark.createDataFrame([("https://a.vn", "Sitemap: https://a.vn/index.xml")], "base_url string, robots string")
    found = http.discover_urls(sites).where("url IS NOT NULL")
    assert {r["url"] for r in found.collect()} == {"https://a.vn/lien-he", "https://a.vn/blog"}
    pages = http.fetch(found.select("url"))
    assert [r["phone_raw"] for r in http.parse(pages).collect()] == ["0912 345 678"] and http.extract_metadata(pages).head()["title"] == "Liên hệ"
    assert isinstance(collectors.collector("official"), collectors.HttpCollector)
    with pytest.raises(ValueError):
        collectors.collector("ftp")


def test_robots(spark):
    rules = "User-agent: *\nDisallow: /private\n"
    assert sitemaps.allowed(200, rules, "bot", "https://a.vn/x") and not sitemaps.allowed(200, rules, "bot", "https://a.vn/private/x")
    assert not sitemaps.allowed(403, None, "bot", "https://a.vn/") and sitemaps.allowed(503, None, "bot", "https://a.vn/") and not sitemaps.allowed(None, None, "bot", "https://a.vn/")
    t = spark.createDataFrame([("a.vn", "https://a.vn/private/1"), ("c.vn", "https://c.vn/")], "domain string, url string")
    r = spark.createDataFrame([("a.vn", 200, rules)], "domain string, status int, body string")
    assert {x["domain"]: x["allowed"] for x in sitemaps.with_permission(t, r, "bot").collect()} == {"a.vn": False, "c.vn": False}


def test_host_metrics(spark):
    rows = [("h", 1, "cpu  100 0 100 800 0 0\n"), ("h", 2, "cpu  150 0 150 1042 0 0\n"), ("h", 3, "cpu  150 0 150 1042 0 0\n")]
    df = spark.createDataFrame(rows, "host string, recorded_at int, stat string").select("host", "recorded_at", procfs.cpu_times(F.col("stat")).alias("c")).select("host", "recorded_at", "c.*")
    assert [r["cpu_percent"] for r in procfs.cpu_percent_between(df).orderBy("recorded_at").collect()] == [None, 29.24, 0.0]
    m = spark.createDataFrame([("MemTotal:  100 kB\nMemFree: 20 kB\nMemAvailable: 60 kB\n", "0.5 1.25 2.0 1/2 3"), ("MemTotal: 100 kB\nMemFree: 20 kB\n", "0 0 0")], "m string, l string")
    got = m.select(procfs.memory(F.col("m")).alias("m"), procfs.load_averages(F.col("l")).alias("l")).collect()
    assert procfs.disk(spark).head()["disk_total_bytes"] > 0
    assert [(r["m"]["total_bytes"], r["m"]["available_bytes"]) for r in got] == [(102400, 61440), (102400, 20480)] and got[0]["l"]["load_5"] == 1.25


class _Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.headers.get("If-None-Match") == '"v1"':
            self.send_response(304)
            self.end_headers()
            return
        body = b"<title>Xin ch\xc3\xa0o</title><p>0912345678</p>"
        self.send_response(404 if self.path == "/gone" else 200)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.send_header("ETag", '"v1"')
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_fetching(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        targets = spark.createDataFrame([(f"{base}/a", None, None), (f"{base}/gone", None, None), (f"{base}/b", '"v1"', None)], "url string, etag string, last_modified string")
        got = {r["url"].rpartition("/")[2]: r for r in web.fetch_pages(targets, delay=0.0, partitions=2).collect()}
    finally:
        server.shutdown()
    assert got["a"]["http_status"] == 200 and "Xin chào" in got["a"]["body"] and got["gone"]["http_status"] == 404 and got["b"]["not_modified"] and got["b"]["etag"] == '"v1"'
    assert web.fetch("http://127.0.0.1:1/", attempts=2, pause=0.0)["error"]
