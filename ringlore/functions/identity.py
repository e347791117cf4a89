"""Identity rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import CATEGORY_RULES, COMPANY_FLAGS, COMPANY_PATTERN, CONNECTOR_PATTERN, HOTLINE_KEYWORDS
from .binding import let
from .text import holds_any


def category(context: Column) -> Column:
    """The first category one of whose keywords stands in the context, whatever its case."""
    return let(F.lower(context), lambda low: F.coalesce(*[F.when(holds_any(low, words), name) for name, words in CATEGORY_RULES]))


def company_name(before: Column, after: Column) -> Column:
    """The organization named beside the number, without a connector at its end; null if none is."""
    found = F.trim(F.regexp_extract(F.concat(F.coalesce(before, F.lit("")), F.lit(" "), F.coalesce(after, F.lit(""))), "(?iu)" + COMPANY_PATTERN, 0))

    def trimmed(said: Column) -> Column:
        cut = F.trim(F.regexp_replace(said, "(?iu)" + CONNECTOR_PATTERN, ""))
        return F.nullif(F.coalesce(F.nullif(cut, F.lit("")), said), F.lit(""))

    return let(found, trimmed)


def is_hotline(context: Column) -> Column:
    return F.coalesce(let(F.lower(context), lambda low: holds_any(low, HOTLINE_KEYWORDS)), F.lit(False))


def names_company(context: Column) -> Column:
    return F.coalesce(let(F.lower(context), lambda low: holds_any(low, COMPANY_FLAGS)), F.lit(False))


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(name)), r"\s+", " ")


def score(high: Column, seen: Column, hotline: Column, company: Column, official: Column) -> Column:
    points = high.cast("int") * 20 + seen * 10 + hotline.cast("int") * 15 + company.cast("int") * 15 + official.cast("int") * 20
    return F.least(F.lit(100), points).cast("int")


def unwrapped_label(name: Column) -> Column:
    """``Unknown (X)`` reads as X."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^Unknown \((.+)\)$", 1), F.lit("")), name)


def spam_risk(reporters: Column) -> Column:
    return F.when(reporters >= 10, "HIGH").when(reporters >= 1, "MEDIUM").otherwise("NONE")
