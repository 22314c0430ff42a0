"""Batch jobs as tables: order of the queue, estimates, batches, statistics, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.plans.shared import globally_ranked

#: Time of a page for a query before there is any history, queries of a batch, memory of a page.
PAGE_MS, QUERY_LIMIT, PAGE_MB = 500.0, 256, 10
#: Limits below or above which something is recommended.
EFFICIENCY, MEMORY_SHARE, THROUGHPUT = 0.7, 0.8, 1.0
PRIORITIES = ("urgent", "high", "medium", "low")


def priority_rank(priority: Column) -> Column:
    """0 for the most urgent; what is no priority comes last."""
    rank = F.lit(len(PRIORITIES))
    for k, name in enumerate(PRIORITIES):
        rank = F.when(priority == name, k).otherwise(rank)
    return rank


def queue_order(jobs: DataFrame) -> DataFrame:
    """Jobs (job_id, priority, created_at) with their place in the queue: by priority, then time, then id."""
    return globally_ranked(jobs.withColumn("_p", priority_rank(F.col("priority"))), F.col("_p"), F.col("created_at"), F.col("job_id"), name="place").drop("_p")


def estimates(jobs: DataFrame, group: str) -> DataFrame:
    """Jobs with estimate_ms: pages times queries times the mean time of the group's last five jobs, or the default."""
    last = Window.partitionBy(group).orderBy("created_at", "job_id").rowsBetween(-5, -1)
    return jobs.withColumn("estimate_ms", F.col("pages") * F.col("queries") * F.coalesce(F.avg("page_ms").over(last), F.lit(PAGE_MS)))


def batches(pages: DataFrame, batch_size: int = 10) -> DataFrame:
    """Pages (job_id, page_no, queries) with the number of their batch in their job."""
    size = F.least(F.lit(batch_size), F.greatest(F.lit(1), F.floor(QUERY_LIMIT / F.greatest(F.col("queries"), F.lit(1)))))
    at = F.row_number().over(Window.partitionBy("job_id").orderBy("page_no"))
    return pages.withColumn("batch_no", F.floor((at - 1) / size))


def stats(jobs: DataFrame, *by: str) -> DataFrame:
    """Jobs, pages, mean time, pages a second and memory of groups of jobs (pages, total_ms)."""
    pages, time = F.sum("pages"), F.sum("total_ms")
    return jobs.groupBy(*by).agg(F.count("*").alias("jobs"), pages.alias("pages"), (time / pages).alias("mean_ms"), (pages / (time / 1000)).alias("per_second"), (pages * PAGE_MB).alias("memory_mb"))


def recommendations(jobs: DataFrame, group: str, memory_limit_mb: float) -> DataFrame:
    """What the means of each group's last ten jobs (efficiency, memory_mb, per_second) suggest, as an array."""
    latest = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("created_at"), F.desc("job_id")))
    recent = jobs.withColumn("_r", latest).where("_r <= 10").groupBy(group)
    means = recent.agg(*[F.avg(c).alias(c) for c in ("efficiency", "memory_mb", "per_second")])
    found = F.array_compact(
        F.array(
            F.when(F.col("efficiency") < EFFICIENCY, "smaller batches"),
            F.when(F.col("memory_mb") > MEMORY_SHARE * memory_limit_mb, "less memory"),
            F.when(F.col("per_second") < THROUGHPUT, "more workers"),
        )
    )
    return means.select(group, found.alias("recommendations"))


def worker_stats(tasks: DataFrame) -> DataFrame:
    """tasks, failed, mean_ms of each worker (worker_id, ms, failed)."""
    return tasks.groupBy("worker_id").agg(F.count("*").alias("tasks"), F.sum(F.col("failed").cast("long")).alias("failed"), F.avg("ms").alias("mean_ms"))
