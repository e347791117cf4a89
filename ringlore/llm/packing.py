"""Problem 8: filling fixed-capacity containers with items.

Method: length-histogram planning.  Items are counted by length; best fit runs over the counts, on the driver, whose work
and memory depend on the capacity and never on how many items there are; then every item takes a planned slot by its rank
among the items of its length.  An item longer than the container gives as many whole pieces as it holds, and a rest.

Defined results: items of no tokens (null or empty texts) need no slot and get none; a null identifier is an item like any
other; equal rows are separate items; ties in length are ordered by identifier; no item is dropped; extra columns are
untouched.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, checkpointed, with_once
from .tokens import TOKENIZER, token_count

#: About how many items of one length are ranked by one task; a more common length is ranked in parts.
RANKED = 100_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first: (length, first rank, end rank, first container, items of it in each).

    Containers with the same room left are one entry; an item goes into the least room that holds it.
    """
    rooms: list[int] = []  # ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> runs of containers (first, how many)
    slots, made = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if n <= 0 or room <= 0:
            return
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                first, n, room = made, -(-left // each), capacity
                made += n
            else:
                room = rooms[k]
                each = room // length
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
                need = -(-left // each)
                if n > need:
                    leave(room, first + need, n - need)
                    n = need
            placed = min(left, n * each)
            slots.append((length, rank, rank + placed, first, each))
            full = placed // each
            leave(room - each * length, first, full)
            if full < n:  # the last one takes what remains
                leave(room - (placed - full * each) * length, first + full, 1)
            rank += placed
            left -= placed
    return slots


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """(id, piece_no, start_token, n_tokens) of items (id, n): whole pieces of the capacity first, then the rest."""
    count = F.ceil(F.col("n") / F.lit(capacity)).cast("bigint")
    many = items.where("n > 0").select("id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("piece_no"))
    start = F.col("piece_no") * capacity
    return many.select("id", "piece_no", start.alias("start_token"), F.least(F.lit(capacity), F.col("n") - start).cast("bigint").alias("n_tokens"))


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rows`` (id, piece_no, n_tokens, ...) with ``rank``: the place, from 0, among the rows of the same length."""
    spark = rows.sparkSession
    parts = spark.createDataFrame([(n, -(-c // RANKED)) for n, c in counts.items()], "n_tokens bigint, parts bigint")
    rows = rows.join(bounded_broadcast(parts, len(counts), 16), "n_tokens")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "piece_no"), F.col("parts")))
    held = rows.groupBy("n_tokens", "part").agg(F.count("*").alias("held"))
    before = held.withColumn("before", F.sum("held").over(Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("n_tokens", "part", F.coalesce("before", F.lit(0)).alias("before")).where("before > 0")
    own = F.row_number().over(Window.partitionBy("n_tokens", "part").orderBy("id", "piece_no"))
    rows = rows.withColumn("own", own)
    if max(counts.values(), default=0) > RANKED:
        rows = rows.join(before, ["n_tokens", "part"], "left").withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("own") - 1).drop("before")
    else:
        rows = rows.withColumn("rank", F.col("own") - 1)
    return rows.drop("parts", "part", "own")


def packed(items: DataFrame, capacity: int) -> DataFrame:
    """(id, piece_no, start_token, n_tokens, container) for items (id, n) and one capacity."""
    spark: SparkSession = items.sparkSession
    rows = pieces(items, capacity)
    # at most ``capacity`` rows, one a length
    counts = {r["n_tokens"]: r["c"] for r in rows.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()}
    slots = plan(counts, capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, *run in slots:
        runs.setdefault(n, []).append(tuple(run))
    planned = spark.createDataFrame(list(runs.items()), "n_tokens bigint, runs array<struct<from_rank:bigint,to_rank:bigint,first:bigint,each:bigint>>")
    # a row meets the runs of its length as one array, in which its rank falls into one run
    placed = ranked(rows, counts).join(bounded_broadcast(planned, len(slots), 40), "n_tokens")
    at = F.get(F.filter("runs", lambda r: (F.col("rank") >= r["from_rank"]) & (F.col("rank") < r["to_rank"])), F.lit(0))
    placed = with_once(placed.select("id", "piece_no", "start_token", "n_tokens", "rank", "runs"), "_run", at)
    return placed.select("id", "piece_no", "start_token", "n_tokens", (F.col("_run.first") + F.floor((F.col("rank") - F.col("_run.from_rank")) / F.col("_run.each"))).alias("container"))


def pack(df: DataFrame, record: str, text: str, capacities: list[tuple[str, int]], tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_kind, container, id, piece_no, start_token, n_tokens) for every kind of container; texts are measured once."""
    items = checkpointed(df.select(F.col(record).alias("id"), token_count(F.col(text), tokenizer).alias("n")))
    out = None
    for kind, capacity in capacities:
        part = packed(items, capacity).select(F.lit(kind).alias("container_kind"), "container", "id", "piece_no", "start_token", "n_tokens")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no container is given")
    return out
