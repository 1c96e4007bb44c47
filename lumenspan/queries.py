"""The registered queries of the trace engine, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.attributes import has_words
from .operators import aggregates as A
from .operators import diagnosis, evals, insights, lifecycle, trees
from .operators.current import current, store_stats
from .plans import adapters as V
from .plans.filters import Cursor, SpanFilter, search
from .sources import payloads as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

COUNTERS = "spans, llm_calls, prompt_tokens, completion_tokens, total_tokens, round(cost_usd, 6) AS cost_usd, round(cost_derived_usd, 6) AS cost_derived_usd, cost_metered_calls, cost_derived_calls, cost_unpriced_calls, error_count, llm_duration_ns"
_SUMS = """count(*) AS spans, count(*) FILTER (is_llm) AS llm_calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens,
 round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, round(coalesce(sum(cost_usd) FILTER (cost_source = 'derived'), 0), 6) AS cost_derived_usd, count(*) FILTER (cost_source = 'metered') AS cost_metered_calls,
 count(*) FILTER (cost_source = 'derived') AS cost_derived_calls, count(*) FILTER (cost_usd IS NULL AND is_llm) AS cost_unpriced_calls, count(*) FILTER (status = 'error') AS error_count, sum(greatest(end_time_ns - start_time_ns, 0))::BIGINT AS llm_duration_ns"""
_SPAN = "tenant, trace_id, span_id, name, service, start_time_ns, end_time_ns, status"
_DUR = "greatest(end_time_ns - start_time_ns, 0)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _cols(df: DataFrame, text: str = _SPAN) -> DataFrame:
    return df.selectExpr(*[c.strip() for c in text.split(", ")]) if "(" not in text else df.selectExpr(*_split(text))


def _split(text: str) -> list[str]:
    """Select-list items; commas inside parentheses don't separate."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _percentiles_sql(source: str, keys: str, points: dict[str, float]) -> str:
    """CTEs ``cells`` and ``pct`` over the duration column ``d`` of ``source``."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    cells = f"""cells AS (SELECT {k}CASE WHEN d < 32 THEN d ELSE 32 + (length(bin(d)) - 6) * 16 + (d >> (length(bin(d)) - 5)) - 16 END AS b, count(*) AS n, max(d) AS top FROM {source} GROUP BY ALL),
bounds AS (SELECT *, sum(n) OVER ({part} ORDER BY b) AS seen, sum(n) OVER ({part}) AS total, max(top) OVER ({part}) AS most,
  CASE WHEN b < 32 THEN b ELSE (((b - 32) % 16 + 16)::BIGINT << ((b - 32) // 16 + 1)::INTEGER) + (1::BIGINT << ((b - 32) // 16 + 1)::INTEGER) - 1 END AS upper FROM cells)"""
    marks = ", ".join(f"min(CASE WHEN seen >= greatest(ceil({p / 100} * total), 1) THEN least(upper, most) END)::BIGINT AS {name}" for name, p in points.items())
    return f"{cells}, pct AS (SELECT {k}{marks} FROM bounds {'GROUP BY ' + keys if keys else ''})"


# --- last write wins and search ---


@query(f"WITH {V.LI_SQL} SELECT {_SPAN}, prompt_tokens FROM li")
def lww_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(V.li(spark, sf_dir), f"{_SPAN}, prompt_tokens")


@query(f"WITH {V.LI_SQL} SELECT count(*) AS versions, count(DISTINCT (tenant, trace_id, span_id)) AS keys FROM li_v")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_stats(V.li_versions(spark, sf_dir))


@query(f"WITH {V.LI_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY tenant, trace_id, span_id ORDER BY ingest_seq DESC) AS rn FROM li_v WHERE ingest_seq <= 2) SELECT {_SPAN} FROM s WHERE rn = 1")
def pinned_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(current(V.li_versions(spark, sf_dir).where("ingest_seq <= 2")))


@query(f"WITH {V.LI_SQL} SELECT {_SPAN} FROM li WHERE service = 'svc-3' AND status = 'error' AND tenant = 'acme'")
def search_service_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(search(V.li(spark, sf_dir), SpanFilter(tenant="acme", service="svc-3", status="error")))


@query(f"WITH {V.LI_SQL} SELECT {_SPAN} FROM li WHERE status NOT IN ('error', '')")
def search_not_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(search(V.li(spark, sf_dir), SpanFilter(not_status=("error", ""))))


@query(f"WITH {V.EV_SQL} SELECT {_SPAN} FROM ev WHERE {_DUR} BETWEEN 50000000 AND 120000000")
def search_duration_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(search(V.ev(spark, sf_dir), SpanFilter(min_duration_ns=50_000_000, max_duration_ns=120_000_000)))


@query(f"WITH {V.EV_SQL}, w AS (SELECT min(start_time_ns) AS lo, max(start_time_ns) AS hi FROM ev) SELECT {_SPAN} FROM ev, w WHERE start_time_ns >= lo + (hi - lo) // 4 AND start_time_ns <= lo + (hi - lo) // 2")
def search_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.ev(spark, sf_dir)
    lo, hi = _bounds(spans)
    return _cols(search(spans, SpanFilter(since_ns=lo + (hi - lo) // 4, until_ns=lo + (hi - lo) // 2)))


def _bounds(spans: DataFrame) -> tuple[int, int]:
    r = spans.agg(F.min("start_time_ns").alias("lo"), F.max("start_time_ns").alias("hi")).first()
    return r["lo"] or 0, r["hi"] or 0


@query(f"WITH {V.EV_SQL} SELECT {_SPAN} FROM ev WHERE k = 42")
def search_attr_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(search(V.ev(spark, sf_dir), SpanFilter(attributes={"k": "42"})))


@query(f"WITH {V.EV_SQL} SELECT {_SPAN} FROM ev WHERE NOT (k = 42 AND event_id % 2 = 0) AND name = 'error'")
def search_not_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(search(V.ev(spark, sf_dir), SpanFilter(name="error", not_attributes={"k": 42})))


@query(f"WITH {V.EV_SQL} SELECT {_SPAN} FROM ev WHERE k >= 10 AND k <= 19.5")
def search_attr_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(search(V.ev(spark, sf_dir), SpanFilter(min_attributes={"k": 10}, max_attributes={"k": 19.5})))


@query(f"WITH {V.EV_SQL} SELECT {_SPAN} FROM ev WHERE session_id = 'u7'")
def search_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(search(V.ev(spark, sf_dir), SpanFilter(session="u7")))


@query(f"WITH {V.CV_SQL} SELECT {_SPAN} FROM cv WHERE list_has_all(list_transform(regexp_extract_all(content, '[0-9A-Za-z]+'), lambda x: lower(x)), ['the', 'in'])")
def search_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(search(V.cv(spark, sf_dir), SpanFilter(content="The, in!"), attributes=""))


@query("SELECT doc_id FROM documents WHERE list_has_all(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+'), lambda x: lower(x)), ['license', 'version'])")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(has_words(F.col("text"), "version LICENSE")).select("doc_id")


@query(f"WITH {V.EV_SQL} SELECT {_SPAN} FROM ev WHERE status = 'ok' ORDER BY {_DUR} DESC, start_time_ns, end_time_ns, tenant, trace_id, span_id LIMIT 100")
def search_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(search(V.ev(spark, sf_dir), SpanFilter(status="ok", sort="-duration", limit=100)))


@query(f"WITH {V.EV_SQL} SELECT {_SPAN} FROM ev ORDER BY start_time_ns, end_time_ns, tenant, trace_id, span_id LIMIT 100 OFFSET 100")
def search_cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.ev(spark, sf_dir)
    first = search(spans, SpanFilter(limit=100)).collect()
    from .plans.filters import next_cursor

    at = next_cursor(first, SpanFilter(limit=100))
    return _cols(search(spans, SpanFilter(limit=100, cursor=Cursor.from_token(at.token())))) if at else _cols(spans.limit(0))


@query(f"WITH {V.LI_SQL} SELECT {_SPAN} FROM li WHERE trace_id = 'o1'")
def trace_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(V.li(spark, sf_dir).where(F.col("trace_id") == "o1"))


# --- rollups ---


def _llm(key: str, of: str, where: str = "TRUE") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.llm_by(V.li(spark, sf_dir), key).selectExpr("key", *_split(COUNTERS))

    run.__name__ = f"llm_by_{key}"
    query(f"WITH {V.LI_SQL} SELECT {of} AS key, {_SUMS} FROM li WHERE {where} GROUP BY 1")(run)


_llm("model", "model", "model IS NOT NULL")
_llm("service", "service")
_llm("day", "strftime(make_timestamp(start_time_ns // 1000), '%Y-%m-%d')")
_llm("session", "CASE WHEN tenant = '' THEN session_id ELSE tenant || '/' || session_id END")


@query(f"WITH {V.LI_SQL}, p AS (SELECT *, CASE WHEN service IN ('svc-0', 'svc-1') THEN 'openai' WHEN service = 'svc-2' THEN 'anthropic' END AS provider FROM li) SELECT provider AS key, {_SUMS} FROM p WHERE provider IS NOT NULL GROUP BY 1")
def llm_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.when(F.col("service").isin("svc-0", "svc-1"), "openai").when(F.col("service") == "svc-2", "anthropic")
    return A.llm_by(V.li(spark, sf_dir).withColumn("provider", provider), "provider").selectExpr("key", *_split(COUNTERS))


_SESSION = "tenant, session_id, session_attribute, first_start_ns, last_end_ns, trace_count, spans, llm_calls, total_tokens, round(cost_usd, 6) AS cost_usd, error_count"
_SESSION_SQL = """SELECT tenant, session_id, min(session_key) AS session_attribute, min(start_time_ns) AS first_start_ns, max(end_time_ns) AS last_end_ns, count(DISTINCT trace_id) AS trace_count, count(*) AS spans,
 count(*) FILTER (is_llm) AS llm_calls, sum(total_tokens)::BIGINT AS total_tokens, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, count(*) FILTER (status = 'error') AS error_count FROM li GROUP BY tenant, session_id"""


@query(f"WITH {V.LI_SQL} {_SESSION_SQL}")
def sessions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sessions(V.li(spark, sf_dir)).selectExpr(*_split(_SESSION))


@query(f"WITH {V.LI_SQL} {_SESSION_SQL} ORDER BY last_end_ns DESC, tenant, session_id LIMIT 50")
def sessions_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ranked_sessions(A.sessions(V.li(spark, sf_dir)), "recent", 50).selectExpr(*_split(_SESSION))


@query(f"WITH {V.LI_SQL} {_SESSION_SQL} ORDER BY error_count DESC, tenant, session_id LIMIT 50")
def sessions_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ranked_sessions(A.sessions(V.li(spark, sf_dir)), "errors", 50).selectExpr(*_split(_SESSION))


@query(f"WITH {V.LI_SQL}, s AS ({_SESSION_SQL}) SELECT * FROM s ORDER BY cost_usd DESC, tenant, session_id LIMIT 50")
def sessions_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ranked_sessions(A.sessions(V.li(spark, sf_dir)), "cost", 50).selectExpr(*_split(_SESSION))


_TRACE = "tenant, session_id, trace_id, root_name, first_start_ns, last_end_ns, spans, total_tokens, round(cost_usd, 6) AS cost_usd, error_count"


@query(f"""WITH {V.LI_SQL} SELECT tenant, session_id, trace_id, arg_min(name, (start_time_ns, end_time_ns, span_id)) AS root_name, min(start_time_ns) AS first_start_ns, max(end_time_ns) AS last_end_ns, count(*) AS spans,
 sum(total_tokens)::BIGINT AS total_tokens, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, count(*) FILTER (status = 'error') AS error_count FROM li GROUP BY tenant, session_id, trace_id""")
def session_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.all_session_traces(V.li(spark, sf_dir)).selectExpr(*_split(_TRACE))


@query(f"WITH {V.LI_SQL} SELECT tenant, trace_id, span_id, model, cost_source, round(cost_usd, 6) AS cost_usd FROM li")
def pricing_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.li(spark, sf_dir).selectExpr("tenant", "trace_id", "span_id", "model", "cost_source", "round(cost_usd, 6) AS cost_usd")


@query(f"WITH {V.EV_SQL} SELECT tenant, count(*) AS spans, count(DISTINCT trace_id) AS traces, min(start_time_ns) AS first_start_ns, max(end_time_ns) AS last_end_ns FROM ev GROUP BY tenant")
def tenant_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tenant_usage(V.ev(spark, sf_dir))


@query(f"WITH {V.LI_SQL} SELECT 'service' AS dim, service AS value, count(*) AS spans FROM li GROUP BY 2 UNION ALL SELECT 'model', model, count(*) FROM li WHERE model IS NOT NULL GROUP BY 2 UNION ALL SELECT 'session_key', session_key, count(*) FROM li GROUP BY 2")
def store_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dims(V.li(spark, sf_dir), "service", "model", "session_key")


# --- insights ---


@query(f"""WITH {V.EV_SQL}, w AS (SELECT min(start_time_ns) AS lo, max(start_time_ns) AS hi, ((max(start_time_ns) - min(start_time_ns) + 23) // 24) AS width FROM ev),
e AS (SELECT ev.*, {_DUR} AS d, least((start_time_ns - lo) // width, 23) AS bucket FROM ev, w), {_percentiles_sql('e', 'bucket', {'p50_ns': 50.0, 'p95_ns': 95.0})}
SELECT i AS bucket, least(lo + i * width, hi) AS start_ns, count(e.span_id) AS spans, count(*) FILTER (e.status = 'error') AS errors, coalesce(any_value(p50_ns), 0) AS p50_ns, coalesce(any_value(p95_ns), 0) AS p95_ns
FROM (SELECT unnest(range(24)) AS i) r CROSS JOIN w LEFT JOIN e ON e.bucket = i LEFT JOIN pct ON pct.bucket = i GROUP BY i, lo, hi, width""")
def series_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.ev(spark, sf_dir)
    return insights.series(spans, *_bounds(spans), 24).select("bucket", "start_ns", "spans", "errors", "p50_ns", "p95_ns")


@query(f"WITH {V.EV_SQL}, e AS (SELECT {_DUR} AS d FROM ev), {_percentiles_sql('e', '', {'p50_ns': 50.0})} SELECT upper::BIGINT AS upper_ns, n FROM bounds")
def duration_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.duration_buckets(V.ev(spark, sf_dir))


@query(f"""WITH {V.EV_SQL}, e AS (SELECT {_DUR} AS d FROM ev), {_percentiles_sql('e', '', insights.POINTS)}
SELECT (SELECT count(*) FROM e) AS n, (SELECT min(d) FROM e) AS min_ns, (SELECT max(d) FROM e) AS max_ns, (SELECT (sum(d) // count(*))::BIGINT FROM e) AS mean_ns, {', '.join(insights.POINTS)} FROM pct""")
def duration_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.duration_summary(V.ev(spark, sf_dir))


_NEWEST = "(start_time_ns, end_time_ns, tenant, trace_id, span_id)"


@query(f"""WITH {V.LI_SQL}, e AS (SELECT *, {_DUR} AS d FROM li WHERE status = 'error'), {_percentiles_sql('e', 'service, name, status', {'p50_ns': 50.0, 'p95_ns': 95.0})}
SELECT service, name, status, count(*) AS n, min(start_time_ns) AS first_seen_ns, max(start_time_ns) AS last_seen_ns, arg_max(trace_id, {_NEWEST}) AS example_trace_id, arg_max(span_id, {_NEWEST}) AS example_span_id, any_value(p50_ns) AS p50_ns, any_value(p95_ns) AS p95_ns
FROM e JOIN pct USING (service, name, status) GROUP BY service, name, status""")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.failures(V.li(spark, sf_dir))


@query(f"WITH {V.LI_SQL}, g AS (SELECT service, name, status, count(*) AS n FROM li WHERE status = 'error' GROUP BY ALL) SELECT sum(n)::BIGINT AS total, count(*) AS groups, greatest(count(*) - 100, 0) AS groups_omitted FROM g")
def failure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.failure_totals(insights.failures(V.li(spark, sf_dir)))


@query(f"WITH {V.LI_SQL} SELECT trace_id, span_id, {_DUR} AS duration_ns FROM li ORDER BY 3 DESC, start_time_ns, end_time_ns, tenant, trace_id, span_id LIMIT 100")
def slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.slowest(V.li(spark, sf_dir), 100).select("trace_id", "span_id", "duration_ns")


@query(f"""WITH {V.EV_SQL}, w AS (SELECT min(start_time_ns) AS lo, max(start_time_ns) AS hi FROM ev),
e AS (SELECT CASE WHEN start_time_ns >= lo + (hi - lo) // 2 THEN 'current' ELSE 'previous' END AS period, {_DUR} AS d, status FROM ev, w WHERE start_time_ns >= (lo + (hi - lo) // 2) - (hi - (lo + (hi - lo) // 2))),
{_percentiles_sql('e', 'period', {'p95_ns': 95.0})} SELECT period, count(*) AS spans, count(*) FILTER (status = 'error') AS error_count, any_value(p95_ns) AS p95_ns FROM e JOIN pct USING (period) GROUP BY period""")
def period_over_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.ev(spark, sf_dir)
    lo, hi = _bounds(spans)
    return A.period_over_period(spans, lo + (hi - lo) // 2, hi).select("period", "spans", "error_count", "p95_ns")


@query(f"WITH {V.LI_SQL} SELECT tenant, trace_id, greatest(max(end_time_ns) - min(start_time_ns), 1) AS duration_ns, count(*) AS spans, sum(total_tokens)::BIGINT AS total_tokens, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, count(*) FILTER (status = 'error') AS error_count FROM li GROUP BY tenant, trace_id")
def trace_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trace_summary(V.li(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 6))


# --- trees and diagnosis ---


@query(f"""WITH RECURSIVE {V.EV_SQL}, t AS (
  SELECT tenant, trace_id, span_id, 0::BIGINT AS depth, [lpad(start_time_ns::VARCHAR, 20, '0') || span_id] AS path FROM ev e WHERE parent_span_id IS NULL
  UNION ALL SELECT e.tenant, e.trace_id, e.span_id, t.depth + 1, list_append(t.path, lpad(e.start_time_ns::VARCHAR, 20, '0') || e.span_id) FROM t JOIN ev e ON e.tenant = t.tenant AND e.trace_id = t.trace_id AND e.parent_span_id = t.span_id)
SELECT tenant, trace_id, span_id, depth, row_number() OVER (PARTITION BY tenant, trace_id ORDER BY path) - 1 AS position FROM t""")
def trace_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.trace_trees(V.ev(spark, sf_dir))


@query(f"""WITH {V.LI_SQL}, k AS (SELECT *, max(end_time_ns) OVER (PARTITION BY tenant, trace_id, parent_span_id ORDER BY start_time_ns, end_time_ns, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM li WHERE parent_span_id IS NOT NULL),
c AS (SELECT tenant, trace_id, parent_span_id AS span_id, sum(greatest(end_time_ns - greatest(start_time_ns, coalesce(reached, start_time_ns)), 0)) AS covered FROM k GROUP BY ALL)
SELECT tenant, trace_id, span_id, greatest({_DUR} - coalesce(covered, 0), 0)::BIGINT AS self_time_ns FROM li LEFT JOIN c USING (tenant, trace_id, span_id)""")
def self_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.self_time(V.li(spark, sf_dir))


@query(f"""WITH RECURSIVE {V.LI_SQL}, r AS (
  SELECT a.*, row_number() OVER (PARTITION BY a.tenant, a.trace_id ORDER BY a.end_time_ns - a.start_time_ns DESC, a.span_id) AS rn FROM li a LEFT JOIN li b ON b.tenant = a.tenant AND b.trace_id = a.trace_id AND b.span_id = a.parent_span_id WHERE b.span_id IS NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY tenant, trace_id, parent_span_id ORDER BY end_time_ns DESC, span_id) AS rn FROM li WHERE parent_span_id IS NOT NULL),
p AS (SELECT tenant, trace_id, span_id, 0::BIGINT AS step FROM r WHERE rn = 1 UNION ALL SELECT k.tenant, k.trace_id, k.span_id, p.step + 1 FROM p JOIN k ON k.tenant = p.tenant AND k.trace_id = p.trace_id AND k.parent_span_id = p.span_id AND k.rn = 1)
SELECT * FROM p""")
def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.critical_paths(V.li(spark, sf_dir))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS rn FROM conversations) WHERE rn = 1")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.conversation_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "role", "text")


@query(f"""WITH {V.EV_SQL}, w AS (SELECT max(end_time_ns) AS now FROM ev)
SELECT tenant, session_id, CASE WHEN any_value(now) - max(end_time_ns) < 3600000000000 THEN 'unknown' WHEN arg_max(status, (end_time_ns, trace_id, span_id)) = 'error' THEN 'failure' ELSE 'success' END AS outcome,
 CASE WHEN any_value(now) - max(end_time_ns) < 3600000000000 THEN 'still_active' WHEN arg_max(status, (end_time_ns, trace_id, span_id)) = 'error' THEN 'last_span_failed' ELSE 'last_span_succeeded' END AS reason,
 count(*) FILTER (status = 'error') AS error_count, count(*) AS span_count FROM ev, w GROUP BY tenant, session_id""")
def session_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.ev(spark, sf_dir)
    now = spans.agg(F.max("end_time_ns")).first()[0] or 0
    return diagnosis.session_outcomes(spans, now, 3_600_000_000_000).select("tenant", "session_id", "outcome", "reason", "error_count", "span_count")


@query(f"""WITH {V.CV_SQL}, o AS (SELECT *, lag(end_time_ns) OVER w AS before, lag(prompt_tokens) OVER w AS less, row_number() OVER w AS rn FROM cv WINDOW w AS (PARTITION BY trace_id ORDER BY start_time_ns)),
g AS (SELECT tenant, trace_id, service, 'turn' AS name, count(*) AS n, count(*) FILTER (start_time_ns >= before) AS serial, min(prompt_tokens) AS context_first, max(prompt_tokens) AS context_last FROM o GROUP BY ALL HAVING count(*) >= 5)
SELECT tenant, trace_id, service, name, n, round(serial / (n - 1), 6) AS serial_fraction, context_first, context_last,
 CASE WHEN (context_first > 0 AND context_last >= 2 * context_first) OR context_last - context_first >= 20000 THEN 'context_runaway' WHEN serial / (n - 1) < 0.8 OR TRUE THEN 'iteration' END AS shape FROM g""")
def repetition_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.cv(spark, sf_dir).withColumn("name", F.lit("turn"))
    return diagnosis.repetitions(turns).select("tenant", "trace_id", "service", "name", "n", F.round("serial_fraction", 6).alias("serial_fraction"), "context_first", "context_last", "shape")


@query("SELECT NULL::VARCHAR AS trace_id, NULL::VARCHAR AS shape WHERE FALSE")
def repetition_per_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation with a trace per turn repeats nothing."""
    return diagnosis.repetitions(V.cv(spark, sf_dir, trace_per_turn=True)).select("trace_id", "shape")


_LEAF_SQL = f"""WITH {V.LI_SQL}, e AS (SELECT * FROM li WHERE status = 'error'), leaf AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.tenant = e.tenant AND c.trace_id = e.trace_id AND c.parent_span_id = e.span_id))"""


@query(f"{_LEAF_SQL} SELECT tenant, session_id, arg_min(trace_id, (start_time_ns, trace_id, span_id)) AS trace_id, arg_min(span_id, (start_time_ns, trace_id, span_id)) AS span_id, min(start_time_ns) AS start_time_ns FROM leaf GROUP BY tenant, session_id")
def leaf_error_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.causes(V.li(spark, sf_dir)).select("tenant", "session_id", "trace_id", "span_id", "start_time_ns")


@query(f"{_LEAF_SQL}, c AS (SELECT tenant, arg_min(trace_id, (start_time_ns, trace_id, span_id)) AS trace_id, arg_min(span_id, (start_time_ns, trace_id, span_id)) AS span_id FROM leaf GROUP BY tenant, session_id) SELECT 'span-' || substr(sha256(trace_id || '/' || span_id), 1, 16) AS example_id, tenant, trace_id, span_id, 'regression' AS split FROM c ORDER BY tenant, trace_id, span_id LIMIT 50")
def promote_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.li(spark, sf_dir)
    return diagnosis.promoted(diagnosis.causes(spans), diagnosis.repetitions(spans.where("status = 'error'")))


# --- evals and annotations ---


@query(f"WITH {V.SCORES_SQL} SELECT experiment_id, example_id, timestamp_ns FROM scores WHERE experiment_id = 1 AND source LIKE 'eval%' AND timestamp_ns >= 100 ORDER BY timestamp_ns DESC, example_id LIMIT 100")
def annotation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.search_annotations(V.scores(spark, sf_dir), experiment_id=1, source_prefix="eval", since_ns=100, limit=100).select("experiment_id", "example_id", "timestamp_ns")


@query(f"WITH {V.SCORES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY experiment_id) AS c FROM scores) SELECT experiment_id, name, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, max(v) FILTER (i = floor((c - 1) * 0.5 + 0.5)) AS p50, max(v) FILTER (i = floor((c - 1) * 0.95 + 0.5)) AS p95 FROM o GROUP BY experiment_id, name")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.score_summary(V.scores(spark, sf_dir)).drop("true_rate").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {V.SCORES_SQL}, j AS (SELECT coalesce(b.name, c.name) AS name, b.v AS b, c.v AS c FROM (SELECT * FROM scores WHERE experiment_id = 1) b FULL JOIN (SELECT * FROM scores WHERE experiment_id = 2) c USING (example_id, name))
SELECT name, round(avg(b), 6) AS mean_base, round(avg(c), 6) AS mean_candidate, count(*) FILTER (c > b) AS improved, count(*) FILTER (c < b) AS regressed, count(*) FILTER (c = b) AS unchanged, count(*) FILTER (c IS NULL) AS only_base, count(*) FILTER (b IS NULL) AS only_candidate FROM j GROUP BY name""")
def score_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evals.score_diff(V.scores(spark, sf_dir), 1, 2)
    return out.select("name", F.round("mean_base", 6).alias("mean_base"), F.round("mean_candidate", 6).alias("mean_candidate"), "unchanged", *[F.size(c).cast("long").alias(c) for c in ("improved", "regressed", "only_base", "only_candidate")])


@query(f"WITH {V.SCORES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY name) AS c FROM scores) SELECT name, count(*) AS n, count(*) FILTER (source LIKE 'human%') AS human, count(*) FILTER (source LIKE 'eval%') AS eval, count(*) FILTER (v = 0) AS lowest, count(*) FILTER (v = 1) AS highest, max(v) FILTER (i = c // 2) AS p50 FROM o GROUP BY name")
def score_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.score_population(V.scores(spark, sf_dir)).select("name", "n", "human", "eval", F.col("buckets")[0].alias("lowest"), F.col("buckets")[9].alias("highest"), "p50")


@query("SELECT 'b' || item_id AS example_id, sha256(text) AS digest FROM benchmark")
def dataset_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.digests(spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("e", F.concat(F.lit("b"), "item_id")), "e", F.col("text"))


# --- payloads and lifecycle ---


@query("SELECT doc_id, CASE WHEN strlen(text) > 4096 THEN 'sha256/' || sha256(text) END AS ref, CASE WHEN strlen(text) > 4096 THEN strlen(text) END AS bytes, CASE WHEN strlen(text) > 4096 THEN substring(text, 1, 256) END AS preview FROM documents")
def payload_offload(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ref = F.from_json(P.reference(F.col("text")), "`$payload` string, bytes long, preview string")
    return docs.select("doc_id", F.when(F.octet_length("text") > P.THRESHOLD, ref).alias("r")).select("doc_id", F.col("r")["$payload"].alias("ref"), F.col("r")["bytes"].alias("bytes"), F.col("r")["preview"].alias("preview"))


@query("SELECT 'sha256/' || sha256(text) AS ref, any_value(strlen(text)) AS bytes, any_value(text) AS content FROM documents WHERE strlen(text) > 4096 GROUP BY 1")
def payload_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.payloads(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")
    return out.withColumn("bytes", F.col("bytes").cast("long"))


@query("WITH p AS (SELECT sha256(text) AS h, bool_or(doc_id % 3 <> 0) AS live FROM documents WHERE strlen(text) > 4096 GROUP BY 1) SELECT 'sha256/' || h AS ref FROM p WHERE NOT live")
def payload_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    live = docs.where("doc_id % 3 <> 0").select(F.concat(F.lit("sha256/"), F.sha2("text", 256)).alias("ref"))
    return lifecycle.orphans(P.payloads(docs, "text").select("ref"), live)


@query(f"WITH {V.EV_SQL}, w AS (SELECT max(end_time_ns) AS now FROM ev) SELECT {_SPAN} FROM ev, w WHERE tenant = 't2' OR end_time_ns >= now - CASE WHEN tenant = 't1' THEN 864000000000000 ELSE 2592000000000000 END")
def ttl_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.ev(spark, sf_dir)
    now = spans.agg(F.max("end_time_ns")).first()[0] or 0
    day = 86_400_000_000_000
    return _cols(lifecycle.expire(spans, now, 30 * day, {"t1": 10 * day, "t2": 0}))


_SUBJECTS = [("session", "t1", None, None, "u1"), ("tenant", "t3", None, None, None), ("span", "", "u4-1970-01-01", "e4", None)]


def _subjects(spark: SparkSession) -> DataFrame:
    rows = " UNION ALL ".join("SELECT " + ", ".join(f"CAST({'NULL' if v is None else repr(v)} AS STRING) AS {c}" for c, v in zip(("kind", "tenant", "trace_id", "span_id", "session_id"), s)) for s in _SUBJECTS)
    return spark.sql(rows)


_MASKED = "((session_id = 'u1' AND tenant = 't1') OR tenant = 't3' OR (tenant = '' AND trace_id = 'u4-1970-01-01' AND span_id = 'e4'))"


@query(f"WITH {V.EV_SQL} SELECT {_SPAN} FROM ev WHERE NOT {_MASKED}")
def erasure_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cols(lifecycle.unmasked(V.ev(spark, sf_dir), _subjects(spark)))


@query(f"""WITH {V.EV_SQL}, p AS (SELECT DISTINCT 'p' || (event_id % 10) AS ref FROM ev)
SELECT 'spans' AS domain, count(*) FILTER ({_MASKED})::BIGINT AS occurrences FROM ev UNION ALL SELECT 'swept', count(*) FILTER ({_MASKED}) FROM (SELECT * FROM ev WHERE NOT {_MASKED})
UNION ALL SELECT 'half_swept', count(*) FILTER ({_MASKED}) FROM (SELECT * FROM ev WHERE tenant <> 't3') UNION ALL SELECT 'notes', 2 * count(*) FILTER ({_MASKED}) FROM ev
UNION ALL SELECT 'payloads', count(*) FILTER (ref IN ('p3', 'p4')) FROM p""")
def erasure_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes share keys, two a span; payloads are known by reference."""
    spans = V.ev(spark, sf_dir)
    subjects = _subjects(spark).withColumn("ref", F.lit(None).cast("string"))
    subjects = subjects.unionByName(spark.sql("SELECT 'payload' AS kind, explode(array('p3', 'p4', 'gone')) AS ref"), allowMissingColumns=True)
    notes = spans.select("tenant", "trace_id", "span_id", "session_id")
    payloads = spans.select(F.expr("concat('p', CAST(substring(span_id, 2) AS LONG) % 10)").alias("ref")).distinct()
    return lifecycle.receipt(subjects, spans=spans, swept=lifecycle.unmasked(spans, subjects), half_swept=spans.where("tenant <> 't3'"), notes=notes.union(notes), payloads=payloads)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost by model over current spans."""
    return QUERIES["llm_by_model"](spark, sf_dir)


from . import ingest_queries  # noqa: E402, F401  (adds its own)
