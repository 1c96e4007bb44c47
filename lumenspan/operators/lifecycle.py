"""Retention, erasure with receipts, payloads that nothing holds, and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .current import current


def _cutoff(now_ns: int, ttl_ns: int, tenants: dict[str, int]) -> Column:
    """When a row of a tenant expires; NULL for tenants that are exempt (a TTL of 0)."""
    out = None
    for tenant, ttl in sorted(tenants.items()):
        out = (F if out is None else out).when(F.col("tenant") == tenant, F.lit(now_ns - ttl if ttl else None).cast("long"))
    rest = F.lit(now_ns - ttl_ns if ttl_ns else None).cast("long")
    return rest if out is None else out.otherwise(rest)


def expired(now_ns: int, ttl_ns: int, tenants: dict[str, int] | None = None, at: str = "end_time_ns") -> Column:
    return F.coalesce(F.col(at) < _cutoff(now_ns, ttl_ns, tenants or {}), F.lit(False))


def expire(spans: DataFrame, now_ns: int, ttl_ns: int, tenants: dict[str, int] | None = None) -> DataFrame:
    """Spans that stay; they expire by when they ended, and a tenant's own TTL overrides."""
    return spans.where(~expired(now_ns, ttl_ns, tenants))


def expire_annotations(rows: DataFrame, now_ns: int, ttl_ns: int) -> DataFrame:
    """Annotations that stay; scores of experiments are exempt."""
    return rows.where(F.col("experiment_id").isNotNull() | ~expired(now_ns, ttl_ns, at="timestamp_ns"))


#: The columns by which each kind of subject is known.
SUBJECT = {"tenant": ["tenant"], "trace": ["tenant", "trace_id"], "span": KEY, "session": ["tenant", "session_id"], "payload": ["ref"]}


def unmasked(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows (spans, annotations, payloads) that no subject (kind, tenant, trace_id, span_id, session_id, ref) of an erasure covers, each kind by its own columns."""
    for kind, on in SUBJECT.items():
        if set(on) <= set(rows.columns) & set(subjects.columns):
            rows = rows.join(subjects.where(F.col("kind") == kind).select(*on).distinct(), on, "left_anti")
    return rows


def erased(spans: DataFrame, subjects: DataFrame) -> DataFrame:
    """Spans that a subject covers: what an erasure removes."""
    return spans.join(unmasked(spans, subjects).select(*KEY), KEY, "left_anti")


def redact_payloads(spans: DataFrame, refs: list[str]) -> DataFrame:
    """References to erased payloads become markers that keep the size, in attributes of spans, events and links."""

    def marked(_, v: Column) -> Column:
        ref = F.get_json_object(v, "$['$payload']")
        marker = F.concat(F.lit('{"$payload":"'), ref, F.lit('","bytes":'), F.get_json_object(v, "$.bytes"), F.lit(',"erased":true}'))
        return F.when(ref.isin(*refs), marker).otherwise(v)

    out = spans.withColumn("attributes", F.transform_values("attributes", marked))
    for c in ("events", "links"):
        if c in spans.columns:
            out = out.withColumn(c, F.transform(c, lambda x: x.withField("attributes", F.transform_values(x["attributes"], marked))))
    return out


def receipt(subjects: DataFrame, **tables: DataFrame) -> DataFrame:
    """(domain, occurrences): the rows of each table that subjects still cover; an erasure is conclusive if all are 0.

    Rows are counted one by one, whatever keys they share.  A table that has
    neither a span's key nor payload references can't be judged and is refused.
    """
    out = None
    for name, rows in tables.items():
        if not (set(KEY) <= set(rows.columns) or "ref" in rows.columns):
            raise ValueError(f"{name} has no columns by which subjects are known")
        signed = rows.select(F.lit(1).alias("n")).unionAll(unmasked(rows, subjects).select(F.lit(-1).alias("n")))
        one = signed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).select(F.lit(name).alias("domain"), "occurrences")
        out = one if out is None else out.union(one)
    return out


def orphans(payloads: DataFrame, refs: DataFrame) -> DataFrame:
    """Payloads that no live span refers to."""
    return payloads.join(refs.select("ref").distinct(), "ref", "left_anti")


def compact(versions: DataFrame, path: str, files: int) -> None:
    """The current spans, clustered for lookups: ranges of trace within a day, sorted by start."""
    rows = current(versions).withColumn("start_day", F.expr("to_date(timestamp_micros(start_time_ns div 1000))"))
    rows = rows.repartitionByRange(files, "start_day", "trace_id").sortWithinPartitions("start_day", "trace_id", "start_time_ns")
    rows.write.mode("overwrite").partitionBy("start_day").option("parquet.bloom.filter.enabled#trace_id", "true").parquet(path)
