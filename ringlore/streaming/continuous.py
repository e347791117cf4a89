"""The batch operators run continuously: every batch of a stream goes through the same functions as a table does."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.phone import normalized
from ..plans.ingest import merged_numbers


def normalized_stream(rows: DataFrame, phone: str = "phone_raw") -> DataFrame:
    """A stream or table of sightings with their normalized numbers."""
    n = normalized(F.col(phone))
    return rows.withColumn("phone_normalized", n["normalized"]).withColumn("phone_type", n["type"])


def hourly_counts(rows: DataFrame, at: str, late: str = "2 hours") -> DataFrame:
    """Sightings by hour and type; rows later than ``late`` behind the stream's newest are left out."""
    rows = rows.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w"), "phone_type").agg(F.count("*").alias("observations")).select(F.col("w.start").alias("hour"), "phone_type", "observations")


def drain(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is there now, batch by batch, exactly once for each checkpoint; then the query ends."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_running(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "15 minutes") -> StreamingQuery:
    """As ``drain``, again and again until it is stopped."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stop_between_batches(query: StreamingQuery, patience: float = 600.0) -> None:
    """Stops a query when no batch is at work, or after so many seconds all the same; a batch cut off is done again later."""
    began = time.monotonic()
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() - began < patience:
        time.sleep(0.1)
    query.stop()


NUMBERS = "phone_e164 string, observation_count bigint, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, phone_type string"


class NumberStore:
    """Canonical numbers in ``folder``, kept in ``buckets`` parts by a hash of the number.

    A batch rewrites the parts that it touches, under its own number, and a list that says which batch wrote each part last;
    so a batch that is written twice (after a failure) gives the same again.  What two lists no longer name is removed.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _path(self, *parts: object) -> str:
        return "/".join([self.folder.rstrip("/"), *map(str, parts)])

    def _parts(self, version: int) -> dict[int, int]:
        """Which batch wrote each part, as of a version."""
        if version < 0:
            return {}
        return {r["bucket"]: r["batch"] for r in self.spark.read.json(self._path("lists", version), schema="bucket int, batch int").collect()}  # at most ``buckets`` rows

    def _read(self, parts: dict[int, int]) -> DataFrame:
        paths = [self._path("data", batch, f"bucket={b}") for b, batch in sorted(parts.items())]
        return self.spark.read.schema(NUMBERS).parquet(*paths) if paths else self.spark.createDataFrame([], NUMBERS)

    def read(self, version: int) -> DataFrame:
        return self._read(self._parts(version))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("phone_e164"), F.lit(self.buckets)).cast("int")
        rows = batch.where("phone_normalized IS NOT NULL")
        touched = {r["b"] for r in rows.select(F.col("phone_normalized").alias("phone_e164")).select(bucket.alias("b")).distinct().collect()}
        parts = self._parts(batch_id - 1)
        old = self._read({b: n for b, n in parts.items() if b in touched})
        merged_numbers(old, rows).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(self._path("data", batch_id))
        now = parts | dict.fromkeys(touched, batch_id)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, batch int").coalesce(1).write.mode("overwrite").json(self._path("lists", batch_id))
        if batch_id > 1:
            for b, n in self._parts(batch_id - 2).items():
                if parts.get(b) != n:
                    self._remove(self._path("data", n, f"bucket={b}"))

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
