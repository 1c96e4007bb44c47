"""Time series, duration distribution, failure groups and the slowest spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import histogram
from ..functions.semconv import duration
from ..schema import ORDER
from .aggregates import counters, windowed

POINTS = {"p50_ns": 50.0, "p75_ns": 75.0, "p90_ns": 90.0, "p95_ns": 95.0, "p99_ns": 99.0}
SLOWEST_LIMIT = 1000


def series(spans: DataFrame, since_ns: int, until_ns: int, buckets: int = 24) -> DataFrame:
    """Even buckets over the window, empty ones included; the last takes what is left."""
    if until_ns <= since_ns:
        raise ValueError("until must be after since")
    buckets = min(max(buckets, 1), 512)
    width = max(-(-(until_ns - since_ns) // buckets), 1)
    index = F.least(F.expr(f"(start_time_ns - {since_ns}L) div {width}L"), F.lit(buckets - 1)).cast("long")
    rows = windowed(spans, since_ns, until_ns).withColumn("bucket", index)
    sums = rows.groupBy("bucket").agg(*counters())
    points = histogram.percentiles(rows, ["bucket"], duration(), {"p50_ns": 50.0, "p95_ns": 95.0})
    spine = spans.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.least(F.lit(since_ns) + F.col("id") * width, F.lit(until_ns)).alias("start_ns"))
    out = spine.join(sums.join(points, "bucket"), "bucket", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0.0 if t == "double" else 0)).alias(c) for c, t in out.dtypes if c not in ("bucket", "start_ns")}
    return out.select("bucket", "start_ns", *zero.values()).withColumnRenamed("error_count", "errors")


def duration_summary(spans: DataFrame) -> DataFrame:
    """One row: count, min, max, mean (whole nanoseconds) and percentiles."""
    d = duration()
    points = histogram.percentiles(spans, [], d, POINTS)
    sums = spans.agg(F.count("*").alias("n"), F.coalesce(F.min(d), F.lit(0)).alias("min_ns"), F.coalesce(F.max(d), F.lit(0)).alias("max_ns"), F.expr("coalesce(sum(greatest(end_time_ns - start_time_ns, 0)) div count(*), 0)").alias("mean_ns"))
    return sums.crossJoin(F.broadcast(points)).select("n", "min_ns", "max_ns", "mean_ns", *[F.coalesce(c, F.lit(0)).alias(c) for c in POINTS])


def duration_buckets(spans: DataFrame) -> DataFrame:
    return histogram.occupied(spans, duration())


def failures(spans: DataFrame, status: str = "error") -> DataFrame:
    """Groups of (service, name, status) with the newest example; all of them, so nothing is left untracked."""
    rows = spans.where(F.col("status") == status)
    keys = ["service", "name", "status"]
    newest = F.struct(*ORDER)
    groups = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("start_time_ns").alias("first_seen_ns"), F.max("start_time_ns").alias("last_seen_ns"), F.max_by("trace_id", newest).alias("example_trace_id"), F.max_by("span_id", newest).alias("example_span_id")
    )
    return groups.join(histogram.percentiles(rows, keys, duration(), {"p50_ns": 50.0, "p95_ns": 95.0}), keys)


def ranked_failures(groups: DataFrame, limit: int = 100) -> DataFrame:
    return groups.orderBy(F.desc("n"), F.desc("last_seen_ns"), F.asc("service"), F.asc("name")).limit(limit)


def failure_totals(groups: DataFrame, limit: int = 100) -> DataFrame:
    """Spans and groups before the cut, and how many groups the cut omits."""
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("groups")).withColumn("groups_omitted", F.greatest(F.col("groups") - limit, F.lit(0)))


def slowest(spans: DataFrame, limit: int = 100) -> DataFrame:
    """The longest spans; ties in the stable order."""
    return spans.withColumn("duration_ns", duration()).orderBy(F.desc("duration_ns"), *ORDER).limit(min(limit, SLOWEST_LIMIT))
