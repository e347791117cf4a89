"""Giving an intermediate value a name, so that it is computed once a row.

The optimizer copies an expression into every place that uses it; with regular expressions several levels deep that costs
more than anything else in a plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` and the column ``name``, computed once a row; filters and projections that follow read it as it is."""
    return df.select("*", F.explode(F.array(value)).alias(name))
