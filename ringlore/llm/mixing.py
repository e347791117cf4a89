"""Problem 9: mixing sources to target weights.

Method: hash-threshold histograms.  Tokens are summed by source and bucket of a hash of the record; the budgets of all
sources are found as nested thresholds in these sums; only the bucket in which a threshold falls is refined, by further
bits of the hash; then a record is taken by comparing its hash with its source's thresholds, without sorting.  The record at a
threshold is too long for what is left; the search goes on behind it among the records that still fit, until none does.

The blend is as large as the scarcest source allows: with A tokens in a source, a share s and at most m repeats, its size is
the least A * m / s.  Each source is used whole as often as its budget holds it, and once more in part.

Defined results: null and empty texts have no tokens and take no part; sources outside the targets take no part; a target
source without tokens cannot reach its share and is reported with none, the others' shares being scaled up; a null
identifier hashes like any value; equal rows count and are taken alike; extra columns are untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, checkpointed
from .tokens import TOKENIZER, token_count

#: Bits of the hash in each round of refinement: a round's histogram has at most 2 ** BITS rows a source.
BITS, ROUNDS = 12, 5


@dataclass
class Share:
    """A source's target, what it has, and what it gives: ``whole`` times all of it, and once more the records whose hash is in
    one of ``spans`` (first hash, end, most tokens)."""

    source: str
    target: float
    max_repeats: int
    available: int
    budget: float = 0.0
    whole: int = 0
    spans: list[tuple[int, int, int]] = field(default_factory=list)


def budgets(targets: list[tuple[str, float, int]], available: dict[str, int]) -> list[Share]:
    """The budget of every source, for the largest blend that no source limits further."""
    shares = [Share(s, t, m, available.get(s, 0)) for s, t, m in targets]
    able = [x for x in shares if x.available and x.target > 0 and x.max_repeats > 0]
    scale = sum(x.target for x in able)
    size = min((x.available * x.max_repeats * scale / x.target for x in able), default=0.0)
    for x in able:
        x.budget = size * x.target / scale
        x.whole = min(x.max_repeats, int(x.budget / x.available + 1e-9))
    return shares


def find_thresholds(rows: DataFrame, shares: list[Share]) -> None:
    """Sets each share's spans of hashes, numbers of 60 bits, that hold together at most the rest of its budget, and to which
    no record behind them can be added.

    What a pass leaves is less than the record that stopped it, and the next pass only looks at what is no longer than that.
    """
    rest = {x.source: x.budget - x.whole * x.available for x in shares if x.available and x.whole < x.max_repeats}
    low = {s: 0 for s, r in rest.items() if r >= 1}
    by = {x.source: x for x in shares}
    while low:
        most = {s: int(rest[s]) for s in low}
        ends = _descend(rows, low, rest)
        for s, (end, _) in ends.items():
            if end > low[s]:
                by[s].spans.append((low[s], end, most[s]))
        low = {s: behind for s, (_, behind) in ends.items() if behind < 1 << 60 and rest[s] >= 1}


def _descend(rows: DataFrame, low: dict[str, int], rest: dict[str, float]) -> dict[str, tuple[int, int]]:
    """For each source the end of the hashes from ``low`` on that ``rest`` holds, and the first hash behind the record there;
    records that are longer than ``rest`` are left out from the start."""
    above = F.lit(False)
    for s, a in low.items():
        above = above | ((F.col("source") == s) & (F.col("h") >= F.lit(a)) & (F.col("n") <= F.lit(int(rest[s]))))
    at, ends = dict.fromkeys(low, 0), {}
    for k in range(ROUNDS):
        shift = 60 - BITS * (k + 1)
        edge = above
        if k:  # only what falls into each source's boundary bucket
            inside = F.lit(False)
            for s, a in at.items():
                inside = inside | ((F.col("source") == s) & (F.shiftrightunsigned("h", shift + BITS) == F.lit(a >> (shift + BITS))))
            edge = edge & inside
        sums: dict[str, list[tuple[int, int, int]]] = {}
        bucket = F.shiftrightunsigned("h", shift).alias("bucket")
        for r in rows.where(edge).groupBy("source", bucket).agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect():
            sums.setdefault(r["source"], []).append((r["bucket"], r["n"], r["c"]))
        going = {}
        for s, a in at.items():
            for b, n, c in sorted(sums.get(s, ())):
                if n > rest[s]:
                    ends[s] = (b << shift, (b + 1) << shift)
                    if c > 1:
                        going[s] = b << shift
                    break
                rest[s] -= n
            else:
                ends[s] = (((a >> (shift + BITS)) + 1) << (shift + BITS),) * 2 if k else (1 << 60, 1 << 60)
        at = going
        if not at:
            break
    return ends


def measured(df: DataFrame, record: str, source: str, text: str, wanted: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, n, h): the tokens and the 60-bit hash of every record of the wanted sources, written once."""
    rows = df.where(F.col(source).isin(wanted)).select(F.col(record).alias("id"), F.col(source).alias("source"), token_count(F.col(text), tokenizer).alias("n"))
    return checkpointed(rows.where("n > 0").withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 4)))


def mixed(rows: DataFrame, targets: list[tuple[str, float, int]]) -> tuple[DataFrame, list[Share]]:
    """Rows (id, source, n_tokens, repeats) of the records in the blend, and the shares."""
    available = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # at most one row a target
    shares = budgets(targets, available)
    find_thresholds(rows, shares)
    spark = rows.sparkSession
    rule = spark.createDataFrame([(x.source, x.whole, x.spans) for x in shares] or [("", 0, [])], "source string, whole int, spans array<struct<a:bigint,b:bigint,most:bigint>>")
    out = rows.join(bounded_broadcast(rule, len(shares), 64 + 24 * max((len(x.spans) for x in shares), default=0)), "source")
    out = out.withColumn("repeats", F.col("whole") + F.exists("spans", lambda x: (F.col("h") >= x["a"]) & (F.col("h") < x["b"]) & (F.col("n") <= x["most"])).cast("int")).where("repeats > 0")
    return out.select("id", "source", F.col("n").alias("n_tokens"), "repeats"), shares


def share_report(blend: DataFrame, shares: list[Share]) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, used_tokens, actual_share) for every target."""
    spark = blend.sparkSession
    base = spark.createDataFrame([(x.source, x.target, x.max_repeats, x.available) for x in shares], "source string, target_share double, max_repeats int, available_tokens bigint")
    used = blend.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"))
    whole = used.agg(F.sum("used_tokens").alias("whole"))
    out = base.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0))).join(F.broadcast(whole))  # one row
    return out.withColumn("actual_share", F.when(F.col("whole") > 0, F.col("used_tokens") / F.col("whole")).otherwise(F.lit(0.0))).drop("whole")
