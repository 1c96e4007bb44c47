"""Last write wins: the newest version of each span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, ORDER


def current(versions: DataFrame, newest: Column | str | list[str] = "ingest_seq", key: list[str] | None = None) -> DataFrame:
    """One row per key: the version with the highest ``newest``, in a list the columns that order versions and are all of them.

    ``max_by`` combines on the map side, so a key written very often does not
    gather its versions in one sort as a window would.
    """
    key = key or KEY
    rest = [c for c in versions.columns if c not in key]
    if isinstance(newest, list):
        # what orders versions is all that they hold, so it is kept and shuffled once
        if set(newest) != set(rest):
            raise ValueError("versions hold columns beside those that order them")
        best = versions.groupBy(*key).agg(F.max(F.struct(*newest)).alias("newest"))
    else:
        best = versions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(newest) if isinstance(newest, str) else newest).alias("newest"))
    return best.select(*[F.col(c) if c in key else F.col("newest")[c].alias(c) for c in versions.columns])


def snapshot(versions: DataFrame, upto: int) -> DataFrame:
    """The store as it was when ``upto`` had been written."""
    return current(versions.where(F.col("ingest_seq") <= upto))


def trace(spans: DataFrame, trace_id: str, tenant: str | None = None) -> DataFrame:
    found = spans.where(F.col("trace_id") == trace_id)
    return (found if tenant is None else found.where(F.col("tenant") == tenant)).orderBy(*ORDER)


def store_stats(versions: DataFrame) -> DataFrame:
    """Physical rows and distinct keys."""
    return versions.agg(F.count("*").alias("versions"), F.count_distinct(F.struct(*KEY)).alias("keys"))
