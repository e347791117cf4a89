"""Addresses of pages as native column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..rules import PHONE_COLUMNS, URL_DEFAULT, URL_DENY, URL_RULES


def normalized_url(url: Column) -> Column:
    """Scheme, host and path; no trailing slash, parameters, query or fragment."""
    bare = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    host = F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*)", 1)
    path = F.regexp_replace(F.substring(bare, F.length(host) + 1, F.lit(100_000)), r"/+$", "")
    return F.concat(host, F.when(path == "", "/").otherwise(path))


def normalized_domain(url: Column) -> Column:
    """The host in lower case; a missing scheme counts as https."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", ""), r"^([^/?#]*)", 1))


def url_score(url: Column) -> Column:
    """Relevance of an address: denied ones 0, else the first rule that holds."""
    low = F.lower(url)
    chain = F.when(low.rlike("|".join(re.escape(x) for x in URL_DENY)), 0)
    for points, words in URL_RULES:
        chain = chain.when(low.rlike("|".join(re.escape(x) for x in words)), points)
    return chain.otherwise(URL_DEFAULT)


#: Letters with the marks of Vietnamese and of its neighbours, and the plain letters under them.
_MARKED = {c: base for c in map(chr, range(0xC0, 0x1F00)) if (base := unicodedata.normalize("NFKD", c)[0]) != c and base.isascii() and base.isalpha()} | {"đ": "d", "Đ": "D"}


def identifier(header: Column) -> Column:
    """A header as an identifier: plain letters in lower case and digits, whatever stands between them as one underscore."""
    plain = F.translate(header, "".join(_MARKED), "".join(_MARKED.values()))
    bare = F.regexp_replace(plain, "[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^0-9a-z]+", "_"), F.lit("_"))


def phone_columns(spark: SparkSession, headers: list[str]) -> list[str]:
    """The headers that name telephone numbers, in their order."""
    asked = spark.createDataFrame([(n, h) for n, h in enumerate(headers)], "n int, header string")
    known = asked.where(identifier(F.col("header")).isin([x.strip("_") for x in PHONE_COLUMNS]))
    return [r["header"] for r in known.orderBy("n").collect()]  # the header of a file
