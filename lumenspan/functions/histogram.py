"""Log-linear duration buckets: exact below 32, then sixteen to an octave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(v: Column) -> Column:
    """Bucket of a duration of 0 or more; exact for all of LONG."""
    octave = F.length(F.bin(v)) - 1
    return F.when(v < 32, v).otherwise(32 + (octave - 5) * 16 + (F.call_function("shiftright", v, octave - 4) - 16)).cast("long")


def upper_bound(b: Column) -> Column:
    """The largest duration of a bucket."""
    k = b - 32
    shift = (F.floor(k / 16) + 1).cast("int")
    low = F.call_function("shiftleft", (F.pmod(k, F.lit(16)) + 16).cast("long"), shift)
    return F.when(b < 32, b).otherwise(low + (F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1)).cast("long")


def percentiles(spans: DataFrame, keys: list[str], value: Column, points: dict[str, float]) -> DataFrame:
    """One row per key: for each point the upper bound of the first bucket whose running count reaches ceil(p * n), never above the largest value."""
    cells = spans.groupBy(*keys, bucket(value).alias("b")).agg(F.count("*").alias("n"), F.max(value).alias("top"), F.min(value).alias("low"))
    own = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    cells = cells.withColumns({"seen": F.sum("n").over(own.orderBy("b")), "all": F.sum("n").over(own), "most": F.max("top").over(own)})
    cells = cells.withColumn("bound", F.least(upper_bound(F.col("b")), F.col("most")))
    rank = lambda p: F.greatest(F.ceil(F.lit(p / 100) * F.col("all")), F.lit(1))
    return cells.groupBy(*keys).agg(*[F.min(F.when(F.col("seen") >= rank(p), F.col("bound"))).alias(name) for name, p in points.items()])


def occupied(spans: DataFrame, value: Column) -> DataFrame:
    """(upper_ns, n): the buckets that hold something."""
    return spans.groupBy(bucket(value).alias("b")).agg(F.count("*").alias("n")).select(upper_bound(F.col("b")).alias("upper_ns"), "n")
