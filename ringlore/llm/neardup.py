"""Problem 7: near-duplicate records with small edits.

Method: tensored banding.  Each record's set of word shingles is hashed into two small families of MinHash collections; a
table's key is a pair, one collection of either family, so SIDE + SIDE collections serve SIDE * SIDE tables.  Records with
equal sets form a class first and only classes are banded; only those that share a collection of the first family with
another class are keyed by the second.  Candidates whose signatures, three bits of each of the same MinHashes, agree too
rarely are set aside (a pair at the threshold of 0.6 agrees in 65 % of them on average; fewer than AGREE of 36 are more than
three standard deviations below); the others are verified by the exact similarity of their sets.

A bucket with very many classes is not cut off: its classes are keyed once more, by single MinHashes of a third family, and
meet in those smaller buckets.

Defined results: texts of fewer words than a shingle take no part; a null identifier takes no part; equal rows are one
record; links are between different records, smaller identifier first; extra columns are untouched.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, checkpointed, paired_sides, portions, python_udf
from .graph import components

#: Collections of either family, MinHashes in a collection, MinHashes of the third family, and the bucket keyed once more.
SIDE, EACH, MORE, BUCKET = 9, 2, 12, 64
#: Bits of each MinHash in a signature, and on how many MinHashes the least similar pair of a threshold of 0.6 still agrees.
BITS, AGREE = 3, 14

SKETCH = "struct<klass:bigint,grams:array<int>,a:array<bigint>,b:array<bigint>,c:array<int>,low:bigint,high:bigint>"
_WORD = re.compile(r"[^\W_]+")
_HASHES = 2 * SIDE * EACH + MORE
#: Where the bits of each MinHash of one family stand in its half of the signature, and the lowest of each.
_PLACES = np.arange(SIDE * EACH, dtype=np.uint64) * np.uint64(BITS)
_LOWEST = sum(1 << int(k) for k in _PLACES)
_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(1, 2**63, _HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """The hashes of the words of every blank-parted piece met so far, eight bytes a word."""

    def __missing__(self, piece: str) -> bytes:
        h = self[piece] = array("Q", map(xxhash.xxh3_64_intdigest, _WORD.findall(piece.lower()))).tobytes()
        return h


def gram_hashes(texts: list[list[str]], size: int, known: WordHashes) -> list[np.ndarray]:
    """Of each text, given as its pieces, the distinct 32-bit hashes of the runs of ``size`` words, ascending."""
    read = [b"".join(map(known.__getitem__, pieces)) for pieces in texts]
    runs = np.array([max(0, len(r) // 8 - size + 1) for r in read])
    read = [r for r, n in zip(read, runs) if n]
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    if not read:
        return out
    h = np.frombuffer(b"".join(read), np.uint64)
    n = len(h) - size + 1
    g = np.zeros(n, np.uint64)
    for k in range(size):
        g = (g ^ h[k : k + n]) * _P1
        g ^= g >> np.uint64(29)
    g = (g * _P2) >> np.uint64(32)
    some = np.flatnonzero(runs)
    text = np.repeat(np.arange(len(some), dtype=np.uint64), runs[some] + size - 1)
    g = (g | text[:n] << np.uint64(32))[text[:n] == text[size - 1 :]]  # no run goes on into the next text
    g.sort()
    g = g[np.concatenate(([True], g[1:] != g[:-1]))]
    ends = np.searchsorted(g, np.arange(1, len(some), dtype=np.uint64) << np.uint64(32))
    for k, grams in zip(some, np.split(g.astype(np.uint32), ends)):
        out[k] = grams
    return out


def sketch(sets: list[np.ndarray]) -> list[tuple]:
    """(class, grams, first family, second family, third family, the halves of the signature) of sets of gram hashes, none of them empty."""
    low = np.empty((len(sets), _HASHES), np.uint64)
    for k, grams in enumerate(sets):
        np.min((grams.astype(np.uint64) * _P3)[None, :] * _MUL[:, None], axis=1, out=low[k])
    low >>= np.uint64(32)
    pairs = low[:, : 2 * SIDE * EACH].reshape(-1, 2 * SIDE, EACH)
    keys = np.zeros((len(sets), 2 * SIDE), np.uint64)
    for k in range(EACH):
        keys = (keys ^ pairs[:, :, k]) * _P2
        keys ^= keys >> np.uint64(31)
    keys = ((keys + np.arange(2 * SIDE, dtype=np.uint64)) * _P1).astype(np.int64)
    classes = np.array([xxhash.xxh3_64_intdigest(grams.tobytes()) for grams in sets], np.uint64).astype(np.int64)
    singles = low[:, 2 * SIDE * EACH :].astype(np.uint32).astype(np.int32)
    few = (low[:, : 2 * SIDE * EACH] & np.uint64((1 << BITS) - 1)).reshape(-1, 2, SIDE * EACH)
    halves = np.bitwise_or.reduce(few << _PLACES, axis=2).astype(np.int64)
    return list(zip(classes, (grams.view(np.int32) for grams in sets), keys[:, :SIDE], keys[:, SIDE:], singles, halves[:, 0], halves[:, 1]))


def sketches(df: DataFrame, record: str, text: str, size: int, pieces: Callable[[list[str]], list[list[str]]] | None = None) -> DataFrame:
    """(record, klass, grams, a, b, c, low, high), written once; ``pieces`` reads the pieces between blanks of some texts, by default all."""
    read = pieces or (lambda texts: [t.split() for t in texts])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for texts in batches:
            out: list[tuple] = []
            for part in portions(texts):
                if len(known) > 300_000:
                    known.clear()
                sets = gram_hashes(read(part), size, known)
                some = iter(sketch([g for g in sets if len(g)]))
                out += [next(some) if len(g) else (None,) * 7 for g in sets]
            yield pd.DataFrame(out, columns=["klass", "grams", "a", "b", "c", "low", "high"])

    rows = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), python_udf(run, SKETCH)(text).alias("s"))
    return checkpointed(rows.where("s.klass IS NOT NULL").select("record", "s.*"))


def _differ(x: Column) -> Column:
    """On how many MinHashes of a half two signatures differ, ``x`` being their exclusive or."""
    any_bit = x
    for k in range(1, BITS):
        any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
    return F.bit_count(any_bit.bitwiseAND(F.lit(_LOWEST).cast("bigint")))


def class_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(klass_a, klass_b): classes, the smaller first, whose sets are similar enough."""
    # one row a class without its set, which only candidates need
    one = checkpointed(rows.groupBy("klass").agg(*[F.first(c).alias(c) for c in ("a", "b", "c", "low", "high")]))
    first = one.select("klass", F.explode("a").alias("x"))
    first = first.join(first.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"), "x").drop("n")
    keyed = first.join(one.select("klass", "b"), "klass").select("klass", "x", F.explode("b").alias("y")).select("klass", F.xxhash64("x", "y").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = checkpointed(keyed.join(met, "key"))
    small = keyed.where(F.col("n") <= BUCKET)
    again = keyed.where(F.col("n") > BUCKET).select("klass", "key").join(one.select("klass", "c"), "klass")
    again = again.select("klass", F.posexplode("c").alias("k", "v"), "key").select(F.xxhash64("key", "k", "v").alias("key"), "klass").distinct()
    keys = small.select("key", "klass").unionByName(again)
    pairs = keys.withColumnRenamed("klass", "klass_a").join(keys.withColumnRenamed("klass", "klass_b"), "key").where("klass_a < klass_b").select("klass_a", "klass_b").distinct()
    if threshold >= 0.6:
        for side in "ab":
            pairs = pairs.join(one.select(F.col("klass").alias(f"klass_{side}"), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}")), f"klass_{side}")
        differ = _differ(F.col("low_a").bitwiseXOR(F.col("low_b"))) + _differ(F.col("high_a").bitwiseXOR(F.col("high_b")))
        pairs = pairs.where(differ <= 2 * SIDE * EACH - AGREE).select("klass_a", "klass_b")
    pairs = checkpointed(pairs)
    asked = checkpointed(pairs.select(F.explode(F.array("klass_a", "klass_b")).alias("klass")).distinct())
    sets = rows.select("klass", "grams").join(bounded_broadcast(asked, asked.count(), 16), "klass", "left_semi").groupBy("klass").agg(F.first("grams").alias("grams"))
    joined = pairs.join(sets.withColumnRenamed("klass", "klass_a").withColumnRenamed("grams", "x"), "klass_a").join(sets.withColumnRenamed("klass", "klass_b").withColumnRenamed("grams", "y"), "klass_b")
    both = F.size(F.array_intersect("x", "y"))
    # shared / all >= threshold, without division: sets of hundreds of grams stay exact
    return joined.where(both * (1 + threshold) + 1e-9 >= (F.size("x") + F.size("y")) * F.lit(threshold)).select("klass_a", "klass_b")


def near_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: all pairs of records whose sets are similar enough, equal sets included."""
    members = rows.select("record", "klass").distinct()
    links = class_links(rows, threshold)
    a, b = members.select(F.col("record").alias("p"), F.col("klass").alias("klass_a")), members.select(F.col("record").alias("q"), F.col("klass").alias("klass_b"))
    across = links.join(a, "klass_a").join(b, "klass_b").select("p", "q")
    left, right = paired_sides(members, "klass")
    within = left.withColumnRenamed("record", "p").join(right.withColumnRenamed("record", "q"), ["klass", "_part"]).where("p < q").select("p", "q")
    return across.unionByName(within).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a <> b").distinct()


def near_groups(rows: DataFrame, threshold: float) -> DataFrame:
    """(record, group, links): each record's group, and to how many classes other than its own it is linked."""
    links = checkpointed(class_links(rows, threshold))
    found = components(links, "klass_a", "klass_b").select(F.col("node").alias("klass"), F.col("component").alias("group"))
    degree = links.select(F.explode(F.array("klass_a", "klass_b")).alias("klass")).groupBy("klass").agg(F.count("*").alias("links"))
    members = rows.select("record", "klass").distinct().join(found, "klass", "left").join(degree, "klass", "left")
    return members.select("record", F.coalesce("group", "klass").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
