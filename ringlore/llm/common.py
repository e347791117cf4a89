"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that is broadcast on purpose.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder named in ``spark.checkpoint.dir``; only on a single machine, and where that is unset, one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="ringlore-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
    context.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared checkpoint folder and cuts its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def prefixed(df: DataFrame, keep: Sequence[str], prefix: str = "_in_") -> DataFrame:
    """``df`` with every column outside ``keep`` renamed, so extra columns never clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else prefix + c) for c in df.columns])


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marks ``df`` for broadcast only if ``rows`` counted rows of about ``row_bytes`` stay within the limit."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: Members of one group that one task pairs with the others.
PAIRED = 2_000


def paired_sides(df: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join of a group's members with one another on ``group`` and ``_part``: a member of a large group
    stands in one part on the left and in all on the right, so no task pairs a whole hot group."""
    parts = df.groupBy(group).agg(F.ceil(F.count("*") / PAIRED).alias("_parts")).where("_parts > 1")
    rows = df.join(parts, group, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("bigint")))
    left = rows.withColumn("_part", F.pmod(F.xxhash64(*df.columns), "_parts")).drop("_parts")
    return left, rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` and the column ``name``, computed once a row however often it is read."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def python_udf(run, returns: str):
    """A pandas function over batches, marked as not deterministic: the optimizer then keeps one evaluation where it would
    otherwise copy the call into a filter and a projection."""
    return F.pandas_udf(run, returns).asNondeterministic()


def portions(texts: Iterable[str | None], most: int = 64, letters: int = 1 << 18) -> Iterator[list[str]]:
    """All ``texts`` in order, a few at a time: array operations cost by the call, and long texts are not held together.  Null texts are empty."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if len(part) >= most or size >= letters:
            yield part
            part, size = [], 0
    if part:
        yield part
