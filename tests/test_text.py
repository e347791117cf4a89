"""Candidates, visible text, identity rules and addresses."""

import re

import pytest
from pyspark.sql import functions as F

from ringlore.functions import identity, text, urls
from ringlore.rules import PHONE_PATTERN


def _found(spark, body):
    return text.candidates(spark.createDataFrame([(1, body)], "id int, body string"), "body").orderBy("ordinal").collect()


def test_places_are_those_of_a_plain_scan(spark):
    body = "Gọi 0912.345.678 hoặc 1900 1234\nSố thẻ 1234091234567890, fax 024\n38561234 hết 👍 +84 912 345 678"
    got = [(r["position_start"], r["position_end"], r["phone_raw"]) for r in _found(spark, body)]
    assert got == [(m.start(), m.end(), m[0]) for m in re.finditer(PHONE_PATTERN, body)] and len(got) >= 4


def test_context_stops_at_the_paragraph(spark):
    r = _found(spark, "dòng trước\nLiên hệ 0912 345 678 để đặt\ndòng sau")[0]
    assert (r["context_before"], r["context_after"], r["context_text"]) == ("Liên hệ", "để đặt", "Liên hệ 0912 345 678 để đặt")
    assert float(r["confidence"]) == 0.9
    assert float(_found(spark, "so 0912345678")[0]["confidence"]) == 0.5


def test_nothing_in_texts_without_numbers(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "không có số")], "id int, body string")
    assert text.candidates(df, "body").count() == 0


def test_html(spark):
    html = '<html><head><title>Hotline 1900 1234</title><meta name="description" content="gọi 0912345678"><script>var x = "0987654321";</script></head><body><li>Máy 024 3856 1234</li><li>Khác</li><a href="tel:0901234567">gọi</a></body></html>'
    rows = text.html_candidates(spark.createDataFrame([(1, html)], "id int, html string"), "html").collect()
    by = {(r["extraction_method"], r["phone_raw"]) for r in rows}
    assert ("TEL_HREF", "0901234567") in by and ("REGEX_TITLE", "1900 1234") in by and ("REGEX_META_DESCRIPTION", "0912345678") in by and ("REGEX_TEXT", "024 3856 1234") in by
    assert not any("0987654321" in p for _, p in by)
    body = next(r for r in rows if r["extraction_method"] == "REGEX_TEXT" and r["phone_raw"] == "024 3856 1234")
    assert "Khác" not in body["context_text"]


def test_identity_rules(spark):
    df = spark.createDataFrame(
        [("Liên hệ Công ty TNHH Sao Mai - hotline", "nay", "TỔNG ĐÀI ngân hàng"), ("", "", "lừa đảo chuyển tiền"), (None, None, None)], "b string, a string, c string"
    )
    got = df.select(identity.company_name(F.col("b"), F.col("a")).alias("n"), identity.category(F.col("c")).alias("k"), identity.is_hotline(F.col("c")).alias("h")).collect()
    assert [tuple(r) for r in got] == [("Công ty TNHH Sao Mai - hotline nay", "BANK", True), (None, "SCAM", False), (None, None, False)]
    labels = spark.createDataFrame([("Unknown (Báo A)",), ("Ngân hàng B",)], "n string").select(identity.unwrapped_label(F.col("n"))).collect()
    assert [r[0] for r in labels] == ["Báo A", "Ngân hàng B"]
    risks = spark.createDataFrame([(0,), (1,), (9,), (10,)], "n int").select(identity.spam_risk(F.col("n"))).collect()
    assert [r[0] for r in risks] == ["NONE", "MEDIUM", "MEDIUM", "HIGH"]
    top = spark.range(1).select(identity.score(F.lit(True), F.lit(1), F.lit(True), F.lit(True), F.lit(True)).alias("s"), identity.score(F.lit(True), F.lit(9), F.lit(True), F.lit(True), F.lit(True)).alias("t")).head()
    assert (top["s"], top["t"]) == (80, 100)


def test_addresses(spark):
    rows = [("https://a.vn/lien-he/?x=1#y", 100, "https://a.vn/lien-he"), ("https://a.vn/CONTACT", 100, "https://a.vn/CONTACT"), ("https://a.vn/hotline", 95, "https://a.vn/hotline"), ("https://a.vn/chi-nhanh/1", 80, "https://a.vn/chi-nhanh/1"),
            ("https://a.vn/gioi-thieu", 40, "https://a.vn/gioi-thieu"), ("https://a.vn/x", 10, "https://a.vn/x"), ("https://a.vn/wp-admin/login", 0, "https://a.vn/wp-admin/login"), ("https://a.vn", 10, "https://a.vn/")]
    got = spark.createDataFrame([(r[0],) for r in rows], "u string").select("u", urls.url_score(F.col("u")), urls.normalized_url(F.col("u")))
    assert [tuple(r) for r in got.collect()] == rows
    d = spark.createDataFrame([("https://WWW.A.vn/x",), ("a.vn/y",)], "u string").select(urls.normalized_domain(F.col("u"))).collect()
    assert [r[0] for r in d] == ["www.a.vn", "a.vn"]


def test_columns(spark):
    rows = spark.createDataFrame([(x,) for x in ("Điện thoại", "SĐT", "Số điện thoại")], "h string").select(urls.identifier(F.col("h")))
    assert [r[0] for r in rows.collect()] == ["dien_thoai", "sdt", "so_dien_thoai"]
    assert urls.phone_columns(spark, ["company_name", "phone", "address"]) == ["phone"] and urls.phone_columns(spark, ["Mobile", "HOTLINE", "x"]) == ["Mobile", "HOTLINE"] and urls.phone_columns(spark, ["name"]) == []


def test_text_by_nodes(spark):
    html = "<p>Gọi <b>0912 345</b> 678</p><!-- 0900000000 --><script>var a='0911111111';</script><ul><li>Hotline 1900&nbsp;1234</li>\n\n<li>A &eacute; B</li></ul><style>p{}</style>0987654321"
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "trần 0912345678")], "id int, raw string")
    got = {r["id"]: r["t"] for r in df.select("id", text.node_text(F.col("raw")).alias("t")).collect()}
    assert got == {1: "Gọi \n0912 345\n 678\nHotline 1900\u00a01234\nA é B\n0987654321", 2: None, 3: "", 4: "trần 0912345678"}
    found = {m: {r["phone_raw"] for r in text.html_candidates(df, "raw", m).where("id = 1").collect()} for m in ("block", "node")}
    assert "0987654321" in found["node"] & found["block"]
    with pytest.raises(ValueError):
        text.html_candidates(df, "raw", "tree")
