"""Truth tables of the number functions."""

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ringlore.functions import phone
from ringlore.rules import MOBILE_PREFIXES

M = "+84912345678"
TRUTH = [
    *[(r, M, "MOBILE", True) for r in ("0912345678", "0912 345 678", "0912.345.678", "0912-345-678", "+84 912 345 678", M, "84912345678", "(+84) 912345678", "  0912345678  ")],
    *[(f"{p}1234567", f"+84{p[1:]}1234567", "MOBILE", True) for p in MOBILE_PREFIXES],
    ("024 3856 1234", "+842438561234", "LANDLINE", True), ("028.3822.9999", "+842838229999", "LANDLINE", True), ("0203 123 4567", "+842031234567", "LANDLINE", True),
    ("1900 1234", "19001234", "HOTLINE_1900", True), ("1900636563", "1900636563", "HOTLINE_1900", True), ("1800 5678", "18005678", "HOTLINE_1800", True), ("+1900123456", "1900123456", "HOTLINE_1900", True),
    ("1068", "1068", "SHORT_CODE", True), ("191", "191", "SHORT_CODE", True), ("1900xxxx", "1900", "SHORT_CODE", True), ("841234", "841234", "SHORT_CODE", True),
    ("0612345678", "+84612345678", "UNKNOWN", False), ("", None, "UNKNOWN", False), (None, None, "UNKNOWN", False), ("12", None, "UNKNOWN", False), ("84", None, "UNKNOWN", False), ("091234567890123", None, "UNKNOWN", False),
    ("0912-ABC-678", None, "UNKNOWN", False), ("not a phone", None, "UNKNOWN", False), ("1900123", None, "UNKNOWN", False), ("8412345678", None, "UNKNOWN", False), ("+84+912345678", None, "UNKNOWN", False),
]
REASONS = {"": "empty_input", "1900123": "no_recognizable_national_prefix", "+84+912345678": "malformed", "0912-ABC-678": "invalid_length", "0612345678": "unrecognized_prefix"}


def test_ladder(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TRUTH)], "i int, raw string")
    got = df.select("i", phone.normalized(F.col("raw")).alias("n")).select("i", "n.*").orderBy("i").collect()
    assert [(r["raw"], r["normalized"], r["type"], r["valid"]) for r in got] == TRUTH
    assert {r["raw"]: r["reason"] for r in got if r["raw"] in REASONS} == REASONS
    sure = {r["type"]: r["normalization_confidence"] for r in got if r["valid"]}
    assert sure["MOBILE"] == 0.95 and sure["SHORT_CODE"] == 0.5 and sure["HOTLINE_1800"] == 0.9
    assert {r["raw"]: r["normalization_confidence"] for r in got}["024 3856 1234"] == 0.85


@settings(max_examples=4, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123456789+84 .-()xo", max_size=16), min_size=1, max_size=60))
def test_normalizing_twice_changes_nothing(spark, raws):
    df = spark.createDataFrame([(r,) for r in raws] + [("0912 345 678",)], "raw string").select(phone.normalized(F.col("raw")).alias("n")).where("n.type IN ('MOBILE', 'LANDLINE')")
    once = [(r[0],) for r in df.select("n.normalized").collect()]
    again = spark.createDataFrame(once, "normalized string").select("normalized", phone.normalized(F.col("normalized")).alias("m"))
    assert again.where("NOT m.valid OR m.normalized <> normalized").count() == 0


@pytest.mark.parametrize(("line", "number", "count"), [("0912 345 678 x3", "0912 345 678", 3), ("0912345678, 4", "0912345678", 4), ("0912345678 * 2 mẹ", "0912345678", 2), ("0912345678", "0912345678", 1), ("hello", None, None), ("", None, None)])
def test_line(spark, line, number, count):
    r = spark.createDataFrame([(line,)], "line string").select(phone.parsed_line(F.col("line")).alias("p")).head()["p"]
    assert (r and (r["phone_raw"], r["call_count"])) == (number and (number, count))


def test_national_number(spark):
    df = spark.createDataFrame([(M, "MOBILE"), ("19001234", "HOTLINE_1900"), ("+84612345678", "UNKNOWN")], "e string, t string")
    assert [r[0] for r in df.select(phone.national_number(F.col("e"), F.col("t"))).collect()] == ["0912345678", "19001234", "+84612345678"]
