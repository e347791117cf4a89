"""Telephone numbers as native column expressions: normalization, classification and parsing of free lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import MAIN_AREAS, MOBILE_PREFIXES
from .binding import let


def kept_characters(raw: Column) -> Column:
    """Digits and plus signs alone."""
    return F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "[^0-9+]", "")


def national_form(kept: Column) -> Column:
    """The form with a leading zero, or null if no national prefix is there."""
    return (
        F.when(kept.startswith("+84"), F.concat(F.lit("0"), F.substring(kept, 4, 99)))
        .when(kept.startswith("84") & (F.length(kept) >= 11), F.concat(F.lit("0"), F.substring(kept, 3, 99)))
        .when(kept.startswith("0"), kept)
    )


def _outcome(kept: Column, bare: Column, national: Column) -> Column:
    """Which rung of the ladder a number ends on; the first that holds."""
    size = F.length(national)
    return (
        F.when(kept == "", "empty_input")
        .when(bare.rlike("^1900[0-9]{4,7}$"), "HOTLINE_1900")
        .when(bare.rlike("^1800[0-9]{4,7}$"), "HOTLINE_1800")
        .when(national.isNull() & bare.rlike("^[0-9]{3,6}$"), "SHORT_CODE")
        .when(national.isNull(), "no_recognizable_national_prefix")
        .when(~national.rlike("^[0-9]+$"), "malformed")
        .when((size == 10) & F.substring(national, 1, 3).isin(*MOBILE_PREFIXES), "MOBILE")
        .when((size == 11) & (F.substring(national, 2, 1) == "2"), "LANDLINE")
        .when(size.isin(10, 11), "unrecognized_prefix")
        .otherwise("invalid_length")
    )


def _result(raw: Column, kept: Column) -> Column:
    parts = F.struct(F.when(kept.startswith("+"), F.substring(kept, 2, 99)).otherwise(kept).alias("bare"), national_form(kept).alias("national"))
    return let(parts, lambda p: let(_outcome(kept, p["bare"], p["national"]), lambda end: _record(raw, p["bare"], p["national"], end)))


def _record(raw: Column, bare: Column, national: Column, end: Column) -> Column:
    whole = end.isin("MOBILE", "LANDLINE", "unrecognized_prefix")
    short = end.isin("HOTLINE_1900", "HOTLINE_1800", "SHORT_CODE")
    known = end.isin("MOBILE", "LANDLINE") | short
    sure = (
        F.when(end == "MOBILE", 0.95).when(end.startswith("HOTLINE"), 0.9).when(end == "SHORT_CODE", 0.5)
        .when(end == "LANDLINE", F.when(F.substring(national, 2, 2).isin(*MAIN_AREAS), 0.85).otherwise(0.75))
        .when(end == "unrecognized_prefix", 0.3).when(end == "empty_input", 0.0).otherwise(0.1)
    )
    return F.struct(
        raw.alias("raw"),
        F.when(whole, F.concat(F.lit("+84"), F.substring(national, 2, 99))).when(short, bare).alias("normalized"),
        F.lit("VN").alias("country"),
        F.when(known, end).otherwise("UNKNOWN").alias("type"),
        known.alias("valid"),
        sure.alias("normalization_confidence"),
        F.when(~known, end).alias("reason"),
    )


def normalized(raw: Column) -> Column:
    """struct<raw, normalized, country, type, valid, normalization_confidence, reason> of a number as written."""
    return let(kept_characters(raw), lambda kept: _result(raw, kept))


def national_number(e164: Column, kind: Column) -> Column:
    """The national number of a stored number: mobiles and landlines with a zero, anything else as it is."""
    return F.when(kind.isin("MOBILE", "LANDLINE"), F.regexp_replace(e164, r"^\+84", "0")).otherwise(e164)


def confirmed_national_number(e164: Column) -> Column:
    """As a user's confirmation writes it: a zero for the country's code, whatever the type."""
    return F.regexp_replace(e164, r"^\+84", "0")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


LINE = r"^([+0-9][0-9 \t.\-]*[0-9])\s*(?:[,xX*\-]\s*([0-9]+))?\s*.*$"


def parsed_line(line: Column) -> Column:
    """struct<phone_raw, call_count> of a free line such as ``0912 345 678 x3``; null if it holds no number."""
    text = F.trim(line)
    phone = F.regexp_extract(text, LINE, 1)
    count = F.regexp_extract(text, LINE, 2)
    return F.when(text.rlike(LINE), F.struct(phone.alias("phone_raw"), F.coalesce(F.nullif(count, F.lit("")).cast("int"), F.lit(1)).alias("call_count")))
