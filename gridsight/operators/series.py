"""Executor samples over time.

``samples`` has one row per measurement: app_id, worker_id, executor_id, ts,
used, max_memory, region, cores, tasks, executor_cpu and system_cpu. Series
are long tables of (bucket, series, value). Formulas are ours and given below.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import int_mean, percent

HEAP_REGIONS = ["eden", "old", "survivor"]
OFFHEAP_REGIONS = ["metaspace", "code_cache", "compressed_class"]


def executors_overview(samples: DataFrame) -> DataFrame:
    """Executors, peak memory, allocation and storage of each worker, and the totals of each application.

    The peak is the largest single sample, the allocation the sum of each
    executor's maximum, storage the sum of each executor's largest use. The
    worker rows are the list of workers.
    """
    per_executor = samples.groupBy("app_id", "worker_id", "executor_id").agg(
        F.max("used").alias("used"), F.max("max_memory").alias("max_memory")
    )
    app, worker = F.col("app_id"), F.col("worker_id")
    return per_executor.groupingSets([[app, worker], [app]], app, worker).agg(
        F.grouping("worker_id").cast("boolean").alias("is_total"),
        F.count_distinct("executor_id").alias("executors"),
        F.max("used").alias("peak_used"),
        F.sum("max_memory").alias("allocated"),
        F.sum("used").alias("storage_used"),
    )


def worker_memory_series(samples: DataFrame) -> DataFrame:
    """Memory of each executor of a worker, as an array of hourly points per day.

    Samples are reduced to the largest use per hour first, so an array has at
    most 24 points however many samples there are.
    """
    executor = ["app_id", "worker_id", "executor_id"]
    hourly = samples.groupBy(*executor, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.max("used").alias("used")
    )
    return hourly.groupBy(*executor, F.to_date("hour").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("hour", "used"))).alias("points")
    )


def executor_summary(samples: DataFrame) -> DataFrame:
    """Memory limit, mean use and mean CPU of each executor of an application, rounded half up."""
    return samples.groupBy("app_id", "executor_id").agg(
        F.max("max_memory").alias("max_memory"),
        int_mean(F.sum("used"), F.count("used")).alias("avg_used"),
        int_mean(F.sum("executor_cpu"), F.count("executor_cpu")).alias("avg_cpu"),
    )


def executor_detail(samples: DataFrame) -> DataFrame:
    """Each sample as nested heap, non-heap and CPU structs.

    The usage of the region a sample measured is a whole percent of the limit.
    """

    def region(name: str) -> Column:
        return F.when(F.col("region") == name, F.col("used")).otherwise(0).alias(f"{name}_used")

    def usage(regions: Sequence[str]) -> Column:
        used = F.when(F.col("region").isin(*regions), F.col("used")).otherwise(0)
        fraction = F.try_divide(used, F.col("max_memory"))
        return F.struct(
            used.alias("used"),
            F.col("max_memory").alias("max"),
            fraction.alias("fraction"),
            percent(used, F.col("max_memory")).alias("percent"),
            *[region(name) for name in regions],
        )

    return samples.select(
        "app_id",
        "executor_id",
        "ts",
        usage(HEAP_REGIONS).alias("heap"),
        usage(OFFHEAP_REGIONS).alias("non_heap"),
        F.struct(F.col("executor_cpu").alias("process"), F.col("system_cpu").alias("system")).alias("cpu"),
    )


def within(samples: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    """Samples from ``start`` up to and including ``end``; an open end does not limit."""
    if start is not None:
        samples = samples.filter(F.col("ts") >= start)
    if end is not None:
        samples = samples.filter(F.col("ts") <= end)
    return samples


def bucket_of(step: str, ts: str = "ts", slide: str | None = None) -> Column:
    return F.window(ts, step, slide)["start"].alias("bucket")


def unpivot(buckets: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per bucket and series."""
    rows = F.array(*[F.struct(F.lit(name).alias("series"), F.col(name).cast("bigint").alias("value")) for name in names])
    return buckets.select("app_id", "bucket", F.inline(rows))


def _per_bucket(samples: DataFrame, step: str, measures: Mapping[str, Column]) -> DataFrame:
    """Largest value of each executor in each bucket, then the sum over executors."""
    names = list(measures)
    inner = samples.groupBy("app_id", "executor_id", bucket_of(step)).agg(
        *[F.max(measure).alias(name) for name, measure in measures.items()]
    )
    outer = inner.groupBy("app_id", "bucket").agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])
    return unpivot(outer, names)


def _regions(names: Sequence[str]) -> dict[str, Column]:
    return {name: F.when(F.col("region") == name, F.col("used")) for name in names}


def cores_vs_tasks_series(
    samples: DataFrame, step: str = "1 hour", start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Cores available and tasks active, each executor counting with its largest value."""
    measures = {"available_cores": F.col("cores"), "active_tasks": F.col("tasks")}
    return _per_bucket(within(samples, start, end), step, measures)


def cpu_series(
    samples: DataFrame, step: str = "1 hour", start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Mean executor and system CPU percent, rounded half up; null where nothing was measured."""
    buckets = within(samples, start, end).groupBy("app_id", bucket_of(step)).agg(
        int_mean(F.sum("executor_cpu"), F.count("executor_cpu")).alias("executor_cpu"),
        int_mean(F.sum("system_cpu"), F.count("system_cpu")).alias("system_cpu"),
    )
    return unpivot(buckets, ["executor_cpu", "system_cpu"])


def memory_series(
    samples: DataFrame, step: str = "1 hour", start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Heap and off-heap use, the memory limit and the total use, largest values summed over executors."""
    measures = {
        "heap": F.when(F.col("region").isin(*HEAP_REGIONS), F.col("used")),
        "off_heap": F.when(F.col("region").isin(*OFFHEAP_REGIONS), F.col("used")),
        "cluster_max": F.col("max_memory"),
        "cluster_usage": F.col("used"),
    }
    return _per_bucket(within(samples, start, end), step, measures)


def heap_region_series(
    samples: DataFrame, step: str = "1 hour", start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Eden, old and survivor use, largest values summed over executors."""
    return _per_bucket(within(samples, start, end), step, _regions(HEAP_REGIONS))


def offheap_region_series(
    samples: DataFrame, step: str = "1 hour", start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Metaspace, code cache and compressed class use, largest values summed over executors."""
    return _per_bucket(within(samples, start, end), step, _regions(OFFHEAP_REGIONS))


def series_range(series: DataFrame) -> DataFrame:
    """First and last bucket of each series; the first is the least value of the time axis."""
    return series.groupBy("app_id", "series").agg(
        F.min("bucket").alias("start_ts"), F.max("bucket").alias("end_ts"), F.count(F.lit(1)).alias("points")
    )
