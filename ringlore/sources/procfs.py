"""Host metrics out of captured /proc text, as native expressions."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cpu_times(stat: Column) -> Column:
    """struct<idle, total> of the first line of /proc/stat."""
    numbers = F.transform(F.split(F.trim(F.regexp_extract(stat, r"(?m)^cpu\s+([0-9 ]+)", 1)), r"\s+"), lambda x: x.cast("bigint"))
    total = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.struct(F.get(numbers, F.lit(3)).alias("idle"), total.alias("total"))


def busy_percent(idle: Column, total: Column) -> Column:
    """The busy share of the time between two samples, 0 if none passed."""
    return F.when(total > 0, F.round((1 - idle / total) * 100, 2)).otherwise(F.lit(0.0))


def load_averages(loadavg: Column) -> Column:
    parts = F.split(F.trim(loadavg), r"\s+")
    return F.struct(*[F.get(parts, F.lit(i)).cast("double").alias(n) for i, n in enumerate(("load_1", "load_5", "load_15"))])


def memory(meminfo: Column) -> Column:
    """struct<total_bytes, available_bytes>; without MemAvailable the free memory stands for it."""

    def kb(name: str) -> Column:
        return F.nullif(F.regexp_extract(meminfo, rf"(?m)^{name}:\s+(\d+)", 1), F.lit("")).cast("bigint")

    return F.struct((kb("MemTotal") * 1024).alias("total_bytes"), (F.coalesce(kb("MemAvailable"), kb("MemFree")) * 1024).alias("available_bytes"))


def disk(spark: SparkSession, path: str = "/") -> DataFrame:
    """(disk_total_bytes, disk_available_bytes) of the file system that holds ``path`` on the driver's host: what is left to all users."""
    s = os.statvfs(path)
    return spark.createDataFrame([(s.f_blocks * s.f_frsize, s.f_bavail * s.f_frsize)], "disk_total_bytes bigint, disk_available_bytes bigint")


def snapshots(samples: DataFrame) -> DataFrame:
    """Rows for the table of host metrics out of captured text (host, recorded_at, stat, loadavg, meminfo, disk_total_bytes, disk_available_bytes)."""
    read = samples.select("*", cpu_times(F.col("stat")).alias("c"), load_averages(F.col("loadavg")).alias("l"), memory(F.col("meminfo")).alias("m"))
    rows = cpu_percent_between(read.select("*", "c.idle", "c.total"))
    return rows.select(
        "host", "recorded_at", "cpu_percent", "l.load_1", "l.load_5", "l.load_15", F.col("m.total_bytes").alias("memory_total_bytes"), F.col("m.available_bytes").alias("memory_available_bytes"), "disk_total_bytes", "disk_available_bytes"
    )


def cpu_percent_between(samples: DataFrame, at: str = "recorded_at", host: str = "host") -> DataFrame:
    """``samples`` (host, recorded_at, idle, total) with ``cpu_percent`` since the host's sample before; null for the first."""
    w = Window.partitionBy(host).orderBy(at)
    idle, total = F.col("idle") - F.lag("idle").over(w), F.col("total") - F.lag("total").over(w)
    return samples.withColumn("cpu_percent", F.when(total.isNotNull(), busy_percent(idle, total)))
