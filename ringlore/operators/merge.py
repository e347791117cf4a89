"""Merging a batch of rows into a stored table, column by column, without a MERGE statement.

``old FULL OUTER JOIN new ON keys``; each other column follows its own rule.  A key must be unique on either side; nulls in
keys never match.  Both sides hash on the keys once, so a hot key costs one row a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rule(rule: str, old: Column, new: Column, matched: Column) -> Column:
    if rule == "first":
        return F.coalesce(old, new)
    if rule == "last":
        return F.coalesce(new, old)
    if rule == "overwrite":
        return F.when(matched, new).otherwise(old)
    if rule == "sum":
        return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
    if rule == "min":
        return F.least(old, new)
    if rule == "max":
        return F.greatest(old, new)
    raise ValueError(f"no such rule: {rule}")


def merge(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """The table after the batch: keys and the ruled columns.

    first: the stored value stays; last: a new value wins unless null; overwrite: a new value wins even if null;
    sum, min, max: of both.
    """
    a = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in rules], F.lit(True).alias("_in_old"))
    b = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rules], F.lit(True).alias("_in_new"))
    both = a.join(b, keys, "full_outer")
    matched = F.coalesce("_in_new", F.lit(False))
    return both.select(*keys, *[_rule(r, F.col(f"_o_{c}"), F.col(f"_n_{c}"), matched).alias(c) for c, r in rules.items()])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose keys are not stored yet, one for each key."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def changed_documents(latest: DataFrame, incoming: DataFrame, key: str, content_hash: str, at: str) -> DataFrame:
    """Incoming rows whose hash differs from that of the key's latest stored row, or whose key is new."""
    last = latest.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(content_hash, at).alias("_last"))
    return incoming.join(last, key, "left").where(~F.col(content_hash).eqNullSafe(F.col("_last"))).drop("_last")
