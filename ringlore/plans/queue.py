"""The job queue as transitions of a table: jobs in, what becomes of them out.

A table has no row locks: one writer applies a transition at a time, as a stream's foreachBatch does.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.top import greatest_per, top
from ..rules import ACTIVE_STATUSES, BACKOFF_SECONDS, DISCOVERY_PRIORITY, JOB_PRIORITY, MAX_ACTIVE_JOBS, MAX_JOBS_PER_PASS, STALE_MINUTES
from .marts import before, due_sources, moment, next_schedule

#: What is unique among active jobs: a target, or a source and type where there is no target.
SLOT = ("crawl_target_id", "source_id", "job_type")


def _slot(df: DataFrame) -> DataFrame:
    """``df`` with ``slot``: null where any number of active jobs may stand side by side."""
    whole = F.concat_ws("|", F.lit("s"), "source_id", "job_type")
    return df.withColumn("slot", F.when(F.col("crawl_target_id").isNotNull(), F.concat(F.lit("t|"), F.col("crawl_target_id"))).when(F.col("source_id").isNotNull(), whole))


def _active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE_STATUSES))


def created_jobs(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, job_id, created) for every wanted job (id, job_type, source_id, crawl_target_id): its own, or the active one that has its slot.

    Of a batch's jobs for one slot the least is created and stands for the others.
    """
    holders = greatest_per(_slot(_active(jobs)).where("slot IS NOT NULL"), ["slot"], [F.col("created_at"), F.col("id")]).select("slot", F.col("id").alias("held_by"))
    rows = _slot(wanted).join(holders, "slot", "left")
    first = rows.where("slot IS NOT NULL").groupBy("slot").agg(F.min("id").alias("first_id"))
    rows = rows.join(first, "slot", "left").withColumn("job_id", F.coalesce("held_by", "first_id", "id"))
    return rows.select("id", "job_id", (F.col("job_id") == F.col("id")).alias("created"))


def new_rows(wanted: DataFrame, at: Column) -> DataFrame:
    """Rows to append for jobs that are created (id, job_type, source_id, crawl_target_id, priority, scheduled_at)."""
    return wanted.select(
        "id", "job_type", "source_id", "crawl_target_id", F.coalesce("priority", F.lit(JOB_PRIORITY)).alias("priority"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempt_count"),
        F.coalesce("scheduled_at", at).alias("scheduled_at"), at.alias("created_at"),
    )


def domain_discoveries(domains: DataFrame, at: Column) -> DataFrame:
    """Jobs to append for domains to be discovered (domain, source_name): without source or target, so each is put in."""
    body = F.to_json(F.struct("domain", "source_name"))
    return domains.select(
        F.lit("DISCOVER_DOMAIN").alias("job_type"), F.lit(DISCOVERY_PRIORITY).alias("priority"), body.alias("metadata"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempt_count"), at.alias("scheduled_at"),
    )


def claimed(jobs: DataFrame, as_of: str, n: int, worker: str) -> DataFrame:
    """The next ``n`` due jobs by priority, then age, as they run from now on."""
    due = jobs.where(F.col("status").isin("PENDING", "RETRY") & (F.col("scheduled_at") <= moment(as_of)))
    order = [F.col("priority").desc(), F.col("scheduled_at"), F.col("id")]
    out = top(due, order, n)
    return out.withColumns({"status": F.lit("RUNNING"), "started_at": moment(as_of), "locked_at": moment(as_of), "locked_by": F.lit(worker)}).orderBy(*order)


def completed(jobs: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """The jobs that ended well, as they stand then."""
    out = jobs.join(ids.select("id"), "id", "left_semi")
    return out.withColumns({"status": F.lit("SUCCESS"), "finished_at": moment(as_of), "locked_at": F.lit(None).cast("timestamp_ntz"), "locked_by": F.lit(None).cast("string")})


def failed(jobs: DataFrame, errors: DataFrame, as_of: str) -> DataFrame:
    """The jobs of ``errors`` (id, error) after their failure: tried again later, twice as late each time, or given up."""
    out = jobs.join(errors.select("id", F.col("error").alias("_error")), "id")
    tries = F.col("attempt_count") + 1
    over = tries >= F.col("max_attempts")
    wait = (F.lit(BACKOFF_SECONDS) * F.pow(F.lit(2), tries - 1)).cast("int")
    return out.withColumns(
        {
            "status": F.when(over, "FAILED").otherwise("RETRY"), "attempt_count": tries, "error_message": F.col("_error"), "finished_at": F.when(over, moment(as_of)).otherwise(F.col("finished_at")),
            "scheduled_at": F.when(over, F.col("scheduled_at")).otherwise(F.timestamp_add("SECOND", wait, moment(as_of))), "locked_at": F.lit(None).cast("timestamp_ntz"), "locked_by": F.lit(None).cast("string"),
        }
    ).drop("_error")


def recovered(jobs: DataFrame, as_of: str, minutes: int = STALE_MINUTES) -> DataFrame:
    """Running jobs whose lock is too old, as they wait again; their tries do not count up."""
    stale = jobs.where((F.col("status") == "RUNNING") & (F.col("locked_at") < before(moment(as_of), f"'{minutes}' MINUTE")))
    return stale.withColumns({"status": F.lit("RETRY"), "locked_at": F.lit(None).cast("timestamp_ntz"), "locked_by": F.lit(None).cast("string"), "error_message": F.lit("recovered from stale RUNNING lock")})


def after(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """The whole table after a transition."""
    return jobs.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(*jobs.columns))


def budget(active: Column, most: int = MAX_ACTIVE_JOBS, each: int = MAX_JOBS_PER_PASS) -> Column:
    """How many jobs one pass of the scheduler may put in beside so many active ones."""
    return F.greatest(F.lit(0), F.least(F.lit(each), F.lit(most) - active))


def scheduled(jobs: DataFrame, targets: DataFrame, sources: DataFrame, as_of: str, most: int = MAX_ACTIVE_JOBS, each: int = MAX_JOBS_PER_PASS, looked_at: int = 100) -> DataFrame:
    """What one pass of the scheduler creates: due targets first, then due sources with what is left of its budget.

    Of the ``looked_at`` first due targets those with an active job are passed over, as are sources with one of discovery.
    (place, job_type, source_id, crawl_target_id); as many rows as the budget at most.
    """
    active = _active(jobs)
    due = targets.where((F.col("status") == "active") & (F.col("next_crawl_at") <= moment(as_of)))
    order = [F.col("priority").desc(), F.col("next_crawl_at"), F.col("id")]
    first = top(due.select("id", "source_id", "priority", "next_crawl_at"), order, looked_at)
    free = first.join(active.select(F.col("crawl_target_id").alias("id")), "id", "left_anti")
    crawl = free.select(F.lit(0).alias("turn"), F.struct(-F.col("priority"), "next_crawl_at", "id").cast("struct<a:int,b:timestamp_ntz,c:string>").alias("at"), F.lit("CRAWL_URL").alias("job_type"), "source_id", F.col("id").alias("crawl_target_id"))
    busy = active.where("job_type = 'DISCOVER_SITEMAP'").select(F.col("source_id").alias("id"))
    found = due_sources(sources, as_of).join(busy, "id", "left_anti")
    none = F.struct(F.lit(0), F.lit(None).cast("timestamp_ntz"), "id").cast("struct<a:int,b:timestamp_ntz,c:string>")
    find = found.select(F.lit(1).alias("turn"), none.alias("at"), F.lit("DISCOVER_SITEMAP").alias("job_type"), F.col("id").alias("source_id"), F.lit(None).cast("string").alias("crawl_target_id"))
    # a pass never puts in more than its budget's bound, so what is ranked and joined to the one row of counts is small
    rows = top(crawl.unionByName(find), [F.col("turn"), F.col("at")], each).withColumn("all", F.lit(1))
    ranked = rows.groupBy("all").agg(F.array_sort(F.collect_list(F.struct("turn", "at", "job_type", "source_id", "crawl_target_id"))).alias("rows"))
    room = active.agg(budget(F.count("*"), most, each).alias("room"))
    placed = ranked.crossJoin(room).select("room", F.posexplode("rows").alias("place", "r")).where("place < room")
    return placed.select((F.col("place") + 1).alias("place"), "r.job_type", "r.source_id", "r.crawl_target_id")


def sources_after(sources: DataFrame, put_in: DataFrame, as_of: str) -> DataFrame:
    """When the sources that a pass put in are due again; the others stay due."""
    chosen = put_in.where("job_type = 'DISCOVER_SITEMAP'").select(F.col("source_id").alias("id"))
    return next_schedule(sources, as_of).join(chosen, "id", "left_semi")


class Worker:
    """Takes jobs and hands each to the handler of its type: ``step`` serves a stream's foreachBatch.

    A handler gets the jobs of its type as a table and returns (id, error), error being null where a job ended well; if it
    raises, or a type has no handler, all its jobs fail.  ``stop`` lets the batch at work end and takes none after it.
    """

    def __init__(self, handlers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> None:
        self.handlers = dict(handlers)
        self._stopped = threading.Event()

    def stop(self) -> None:
        self._stopped.set()

    def outcomes(self, jobs: DataFrame) -> DataFrame:
        """(id, error) of claimed jobs."""
        if self._stopped.is_set():
            return jobs.select("id", F.lit(None).cast("string").alias("error")).limit(0)
        known = F.col("job_type").isin(*self.handlers) if self.handlers else F.lit(False)
        out = jobs.where(~F.coalesce(known, F.lit(False))).select("id", F.concat(F.lit("no handler for "), F.coalesce("job_type", F.lit("null"))).alias("error"))
        for kind, handler in self.handlers.items():
            own = jobs.where(F.col("job_type") == kind)
            try:
                done = handler(own).select("id", "error")
            except Exception as e:  # a handler's failure is the jobs' failure
                done = own.select("id", F.lit(str(e)).alias("error"))
            out = out.unionByName(done)
        return out

    def step(self, jobs: DataFrame, as_of: str, n: int, name: str) -> DataFrame:
        """The table after ``n`` jobs were taken, worked and ended."""
        taken = claimed(jobs, as_of, n, name)
        ends = self.outcomes(taken)
        good = completed(taken, ends.where("error IS NULL"), as_of)
        bad = failed(taken, ends.where("error IS NOT NULL"), as_of)
        return after(jobs, good.unionByName(bad))
