"""Problem 2: best representative of each duplicate group.

Method: consistent bundles.  Fields that depend on one another travel together: the claim (status, source, confidence), the
label (names, type, category) and the sightings (first, last, evidence).  For each group the survivor is put together from
whole bundles by branch and bound, maximising trust under the functional dependencies of the data, with as few records
behind it as the best trust allows.

A group is first reduced, by partial aggregation alone, to the records of each combination of status, source, type, category
and name that a best choice can need, and its distinct confidences; no group is ever gathered record by record, so a group
with a third of all rows costs little more than another, unless its combinations are as many.  Groups of one record have no duplicates and give no row.

Defined results: a null criterion counts as worst; rows without a key or an identifier take no part; equal rows count as
separate records of equal merit; ties go to the least identifier; extra columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_udf

from .textforms import skeleton_column

STATUS_RANK = {"CONFIRMED": 3, "CANDIDATE": 2, "REJECTED": 1}
TRUST_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


@dataclass(frozen=True)
class Bundle:
    """Fields chosen as a whole; ``criteria`` are the ranks that make one record's bundle better than another's."""

    name: str
    fields: tuple[str, ...]
    criteria: tuple[str, ...]


#: The bundles of phone_identities, in the order in which the search decides them.
BUNDLES = (
    Bundle("claim", ("status", "claim_source", "confidence"), ("c_status", "c_trust", "c_confidence")),
    Bundle("label", ("display_name", "normalized_name", "identity_type", "category"), ("c_category",)),
    Bundle("sighting", ("first_seen_at", "last_seen_at", "evidence_count"), ("c_seen",)),
)
#: determinants -> dependent: the surviving fields must not contradict a record that has the same determinants.
DEPENDENCIES = ((("claim_source", "normalized_name"), "identity_type"), (("claim_source", "normalized_name"), "category"))
#: What the dependencies and all ranks but those of confidence and sighting depend on.
COMBINATION = ("status", "claim_source", "identity_type", "category", "normalized_name")
CRITERIA = ("c_status", "c_trust", "c_confidence", "c_seen", "c_category")


def _ranked(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for word, rank in ranks.items():
        out = F.when(value == word, rank).otherwise(out)
    return out


def with_criteria(df: DataFrame, trust: DataFrame) -> DataFrame:
    """``df`` with its five criteria as numbers, larger being better and null counted as worst."""
    level = trust.groupBy("claim_source").agg(F.max(_ranked(F.col("trust_level"), TRUST_RANK)).alias("c_trust"))
    return (
        df.join(level, "claim_source", "left")
        .withColumn("c_trust", F.coalesce("c_trust", F.lit(0)))
        .withColumn("c_status", _ranked(F.col("status"), STATUS_RANK))
        .withColumn("c_confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(-1.0)))
        .withColumn("c_seen", F.coalesce(F.unix_micros(F.col("last_seen_at").cast("timestamp")), F.lit(-(2**62))))
        .withColumn("c_category", F.col("category").isNotNull().cast("int"))
    )


def name_key(name: Column) -> Column:
    """What a name reads as: letter case, kinds and runs of blanks and look-alike characters set aside; words stay apart."""
    return F.trim(F.regexp_replace(skeleton_column(name), r"\s+", " "))


def choose(records: list[dict], bundles: Sequence[Bundle] = BUNDLES, dependencies: Sequence[tuple[tuple[str, ...], str]] = DEPENDENCIES, levels: dict[str, Sequence] | None = None) -> list[int]:
    """For each bundle the index of the record it comes from: branch and bound over whole bundles.

    A bundle's trust is the sum of its criteria, each as the share of the group's distinct values that it reaches; ``levels``
    has these values where ``records`` is only a part of the group that does not show them all.  The
    bound of a partial choice is its trust plus the best trust of every bundle still open.  Among choices of equal trust the
    one with the fewest records wins, then the one with the least record.
    """
    ranks = {}
    for c in {c for b in bundles for c in b.criteria}:
        values = sorted((levels or {}).get(c) or {r[c] for r in records})
        ranks[c] = {v: (i + 1) / len(values) for i, v in enumerate(values)}
    trust = [[sum(ranks[c][r[c]] for c in b.criteria) for r in records] for b in bundles]
    order = [sorted(range(len(records)), key=lambda i, t=t: (-t[i], records[i]["id"])) for t in trust]
    best_rest = [0.0] * (len(bundles) + 1)
    for k in range(len(bundles) - 1, -1, -1):
        best_rest[k] = best_rest[k + 1] + max(trust[k])
    known: dict[tuple, set] = {}
    for left, right in dependencies:
        for r in records:
            known.setdefault((left, right, *(r[f] for f in left)), set()).add(r[right])
    where = {f: k for k, b in enumerate(bundles) for f in b.fields}
    best: list = [-1.0, 0, (), None]

    def holds(chosen: list[int]) -> bool:
        for left, right in dependencies:
            ends = [where[f] for f in (*left, right)]
            if max(ends) < len(chosen):
                values = known.get((left, right, *(records[chosen[where[f]]][f] for f in left)))
                if values and records[chosen[where[right]]][right] not in values:
                    return False
        return True

    def search(chosen: list[int], total: float) -> None:
        k = len(chosen)
        if total + best_rest[k] < best[0] - 1e-9:
            return
        if k == len(bundles):
            behind = len(set(chosen))
            ids = tuple(records[i]["id"] for i in chosen)
            if total > best[0] + 1e-9 or behind < best[1] or behind == best[1] and ids < best[2]:
                best[:] = [total, behind, ids, list(chosen)]
            return
        first = [i for i in dict.fromkeys(chosen) if trust[k][i] >= trust[k][order[k][0]] - 1e-9]
        for i in [*first, *(i for i in order[k] if i not in first)]:
            if total + trust[k][i] + best_rest[k + 1] < best[0] - 1e-9:
                if i not in first:
                    break  # the order is by trust: no later record can do better
                continue
            chosen.append(i)
            if holds(chosen):
                search(chosen, total + trust[k][i])
            chosen.pop()

    search([], 0.0)
    return best[3]


def _choose_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for groups, confidences in batches:
        out = []
        for group, values in zip(groups, confidences):
            records = sorted((dict(r) for r in group), key=lambda r: r["id"])
            out.append([records[i]["id"] for i in choose(records, levels={"c_confidence": list(values)})])
        yield pd.DataFrame(out, columns=[b.name for b in BUNDLES])


def survivors(df: DataFrame, keys: dict[str, Column], record: str, trust: DataFrame) -> DataFrame:
    """One row a group of two or more records: its keys, ``members``, the record behind each bundle (``claim_id``,
    ``label_id``, ``sighting_id``), ``survivor_id`` (the claim's record), the surviving fields, and ``undisputed``: whether
    that record alone is at least as good as every other on every criterion.
    """
    fields = [f for b in BUNDLES for f in b.fields]
    rows = with_criteria(df.select(F.col(record).alias("id"), *[k.alias(n) for n, k in keys.items()], *fields), trust)
    rows = rows.where(F.col("id").isNotNull())
    for n in keys:
        rows = rows.where(F.col(n).isNotNull())
    whole = F.struct("id", *fields, *CRITERIA)
    # A best choice has its claim from a record of the greatest confidence of its combination, its sighting from one of the
    # latest of all, its label from any record; where one record gives two or three of them, it is the least that can.
    orders = ((-F.col("c_confidence"), -F.col("c_seen"), F.col("id")), (-F.col("c_confidence"), F.col("id")), (-F.col("c_seen"), F.col("id")), (F.col("id"),))
    first = rows.groupBy(*keys, *COMBINATION).agg(
        F.count("*").alias("members"), F.collect_set("c_confidence").alias("confidences"), *[F.min_by(whole, F.struct(*o)).alias(f"r{k}") for k, o in enumerate(orders)]
    )
    groups = first.groupBy(*keys).agg(
        F.sum("members").alias("members"), F.array_distinct(F.flatten(F.collect_set("confidences"))).alias("confidences"),
        F.array_distinct(F.flatten(F.collect_list(F.array(*[f"r{k}" for k in range(len(orders))])))).alias("records"),
    ).where("members > 1")
    # Of the records that are greatest in the order of the criteria one, if any, is at least as good as all others on each.
    met = rows.groupBy(*keys, *CRITERIA).agg(F.count("*").alias("n"), F.min("id").alias("top_id"))
    top = met.groupBy(*keys).agg(F.max(F.struct(*CRITERIA, "n", "top_id")).alias("top"), *[F.max(c).alias(f"m_{c}") for c in CRITERIA])
    alone = F.col("top.n") == 1
    for c in CRITERIA:
        alone = alone & (F.col(f"top.{c}") == F.col(f"m_{c}"))
    top = top.select(*keys, F.col("top.top_id").alias("top_id"), alone.alias("alone"))
    picked = groups.withColumn("pick", python_udf(_choose_batches, "struct<claim:string,label:string,sighting:string>")("records", "confidences"))

    def picked_for(bundle: str) -> Column:
        return F.element_at(F.filter("records", lambda r: r["id"] == F.col(f"pick.{bundle}")), 1)

    at = {b.name: picked_for(b.name) for b in BUNDLES}
    out = picked.select(
        *keys, "members", F.col("pick.claim").alias("survivor_id"), *[F.col(f"pick.{b.name}").alias(f"{b.name}_id") for b in BUNDLES],
        *[at[b.name][f].alias(f) for b in BUNDLES for f in b.fields],
    )
    return out.join(top, list(keys)).withColumn("undisputed", F.col("alone") & (F.col("top_id") == F.col("survivor_id"))).drop("top_id", "alone")
