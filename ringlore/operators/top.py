"""Greatest and latest row of a group, and reproducible limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greatest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``; Spark prunes within partitions before it shuffles."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
