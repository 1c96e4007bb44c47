"""Token and cost rollups, sessions, and usage per tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semconv import SESSION, duration, is_error, saturating_sum, total_tokens

_FLOAT_MAX = 1.7976931348623157e308


def _money(x: Column) -> Column:
    s = F.coalesce(F.sum(x), F.lit(0.0))
    return F.when(s == float("inf"), F.lit(_FLOAT_MAX)).when(s == float("-inf"), F.lit(-_FLOAT_MAX)).otherwise(s)


def _n(test: Column) -> Column:
    return F.count(F.when(test, 1))


def counters() -> list[Column]:
    """What every rollup counts; needs facts and costs."""
    derived, metered = F.col("cost_source") == "derived", F.col("cost_source") == "metered"
    return [
        F.count("*").alias("spans"), _n(F.col("is_llm")).alias("llm_calls"), saturating_sum(F.col("prompt_tokens")).alias("prompt_tokens"), saturating_sum(F.col("completion_tokens")).alias("completion_tokens"), saturating_sum(total_tokens()).alias("total_tokens"),
        _money(F.col("cost_usd")).alias("cost_usd"), _money(F.when(derived, F.col("cost_usd"))).alias("cost_derived_usd"), _n(metered).alias("cost_metered_calls"), _n(derived).alias("cost_derived_calls"), _n(F.col("cost_usd").isNull() & F.col("is_llm")).alias("cost_unpriced_calls"),
        _n(is_error()).alias("error_count"), saturating_sum(F.when(F.col("is_llm"), duration())).alias("llm_duration_ns"),
    ]


def windowed(spans: DataFrame, since_ns: int | None = None, until_ns: int | None = None) -> DataFrame:
    """Spans that start within the bounds, both inclusive."""
    if since_ns is not None:
        spans = spans.where(F.col("start_time_ns") >= since_ns)
    return spans if until_ns is None else spans.where(F.col("start_time_ns") <= until_ns)


def day() -> Column:
    """UTC day of the start."""
    return F.date_format(F.expr("timestamp_micros(start_time_ns div 1000)"), "yyyy-MM-dd")


def llm_by(spans: DataFrame, key: str) -> DataFrame:
    """Counters by model, provider, service, day or session; models and providers only where spans have one."""
    if key == "session":
        out = spans.where("session_id IS NOT NULL").groupBy("tenant", "session_id").agg(*counters())
        shown = F.when(F.col("tenant") == "", F.col("session_id")).otherwise(F.concat_ws("/", "tenant", "session_id"))
        return out.select(shown.alias("key"), *[c for c in out.columns if c not in ("tenant", "session_id")])
    by = day() if key == "day" else F.col(key)
    rows = spans.where(F.col(key).isNotNull()) if key in ("model", "provider") else spans
    return rows.groupBy(by.alias("key")).agg(*counters())


def ranked_llm(rows: DataFrame, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(F.desc("cost_usd"), F.desc("total_tokens"), F.asc("key"))
    return out if limit is None else out.limit(limit)


def sessions(spans: DataFrame) -> DataFrame:
    """One row per (tenant, session): counters, bounds, traces and the highest-ranked key that named it."""
    rank = F.array_position(F.array(*map(F.lit, SESSION)), F.col("session_key"))
    out = spans.where("session_id IS NOT NULL").groupBy("tenant", "session_id").agg(
        F.min("start_time_ns").alias("first_start_ns"), F.max("end_time_ns").alias("last_end_ns"), F.count_distinct("trace_id").alias("trace_count"), F.min(rank).alias("rank"), *counters()
    )
    return out.withColumn("session_attribute", F.element_at(F.array(*map(F.lit, SESSION)), F.col("rank").cast("int"))).drop("rank", "llm_duration_ns")


def ranked_sessions(rows: DataFrame, by: str = "recent", limit: int | None = None) -> DataFrame:
    """Ranked first, then cut; ties by tenant and id."""
    key = {"recent": "last_end_ns", "cost": "cost_usd", "errors": "error_count", "tokens": "total_tokens"}[by]
    out = rows.orderBy(F.desc(key), F.asc("tenant"), F.asc("session_id"))
    return out if limit is None else out.limit(limit)


def session_traces(spans: DataFrame, session_id: str, tenant: str | None = None) -> DataFrame:
    """The traces of a session; the root is the span that starts first."""
    rows = spans.where(F.col("session_id") == session_id)
    rows = rows if tenant is None else rows.where(F.col("tenant") == tenant)
    return _by_trace(rows)


def _by_trace(rows: DataFrame) -> DataFrame:
    first = F.struct("start_time_ns", "end_time_ns", "span_id")
    return rows.groupBy("tenant", "session_id", "trace_id").agg(F.min_by("name", first).alias("root_name"), F.min("start_time_ns").alias("first_start_ns"), F.max("end_time_ns").alias("last_end_ns"), *counters()).drop("llm_duration_ns", "llm_calls", "prompt_tokens", "completion_tokens")


def all_session_traces(spans: DataFrame) -> DataFrame:
    """The traces of every session."""
    return _by_trace(spans.where("session_id IS NOT NULL"))


def tenant_usage(spans: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """Spans, traces and bounds per tenant; with (tenant, ref, bytes) rows also payload bytes, each payload once."""
    out = spans.groupBy("tenant").agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces"), F.min("start_time_ns").alias("first_start_ns"), F.max("end_time_ns").alias("last_end_ns"))
    if payloads is None:
        return out
    held = payloads.groupBy("tenant", "ref").agg(F.max("bytes").alias("bytes")).groupBy("tenant").agg(F.sum("bytes").alias("payload_bytes"))
    return out.join(held, "tenant", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", F.lit(0)))


def dims(spans: DataFrame, *names: str) -> DataFrame:
    """(dim, value, spans): the values known of each dimension; one scan for all."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), F.col(n).cast("string").alias("value")) for n in names]))
    return spans.select(pairs.alias("p")).where("p.value IS NOT NULL").groupBy("p.dim", "p.value").agg(F.count("*").alias("spans"))


def period_over_period(spans: DataFrame, since_ns: int, until_ns: int) -> DataFrame:
    """The period and the one of equal length before it, apart by a nanosecond; p95 over each whole period."""
    from ..functions.histogram import percentiles

    length = until_ns - since_ns
    rows = windowed(spans, since_ns - length, until_ns).withColumn("period", F.when(F.col("start_time_ns") >= since_ns, "current").otherwise("previous"))
    sums = rows.groupBy("period").agg(*counters())
    p95 = percentiles(rows, ["period"], duration(), {"p95_ns": 95.0})
    return sums.join(p95, "period")


def trace_summary(spans: DataFrame) -> DataFrame:
    """Length, spans, tokens, cost and errors of each trace."""
    out = spans.groupBy("tenant", "trace_id").agg(F.min("start_time_ns").alias("start_ns"), F.max("end_time_ns").alias("end_ns"), *counters())
    return out.select("tenant", "trace_id", F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(1)).alias("duration_ns"), "spans", "total_tokens", "cost_usd", "error_count")


def trace_compare(spans: DataFrame, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """The summaries of two traces (tenant, id), side by side."""
    is_left, is_right = ((F.col("tenant") == t) & (F.col("trace_id") == i) for t, i in (left, right))
    both = trace_summary(spans.where(is_left | is_right))
    side = F.when(is_left, "left").otherwise("right")
    return both.withColumn("side", side)
