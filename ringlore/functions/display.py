"""Figures as they are shown, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(seconds: Column) -> Column:
    """``2h 5m``, ``5m 7s`` or ``7s``; a dash for none."""
    s = F.floor(seconds).cast("bigint")
    h, m, rest = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string")
    text = F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(s >= 60, F.concat(m, F.lit("m "), rest, F.lit("s"))).otherwise(F.concat(rest, F.lit("s")))
    return F.coalesce(text, F.lit("—"))


def gigabytes(size: Column) -> Column:
    return F.coalesce(F.concat(F.round(size / 2**30, 1).cast("decimal(20,1)").cast("string"), F.lit(" GB")), F.lit("—"))


def used_percent(total: Column, available: Column) -> Column:
    """The whole percent in use; 0 of nothing."""
    return F.coalesce(F.when(total > 0, F.round((total - available) / total * 100)).cast("int"), F.lit(0))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 60, "good").when(confidence >= 30, "warn").otherwise("danger")


def load_band(percent: Column) -> Column:
    return F.when(percent >= 80, "danger").when(percent >= 50, "warn").otherwise("good")
