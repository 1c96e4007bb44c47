"""Spans over the star-schema tables, with facts as typed columns, and the same views as DuckDB SQL.

``li``: LLM calls from line items, where a key repeats and its last version
counts.  ``ev``: services and latencies from events, chained per user and day.
``cv``: chats from conversations, with a growing context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pricing import Pricing, with_cost
from ..operators.current import current

PRICING = Pricing({"Brand#11": (3.0, 15.0), "Brand#1*": (2.0, 8.0), "Brand#2*": (1.0, 4.0)})
_NULLS = {"provider": "string", "explicit_total": "long", "cache_read": "long", "cache_creation": "long", "declared_outcome": "string", "goal": "string", "model": "string", "prompt_tokens": "long", "completion_tokens": "long", "cost_metered": "double", "session_key": "string"}
#: From the oldest to the newest version of a line item.
_NEWER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filled(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in _NULLS.items() if c not in df.columns})


def _spans_of_lines(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    keep = ["ingest_seq"] if "ingest_seq" in lines.columns else []
    return with_cost(_filled(rows.selectExpr(
        "CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'acme' ELSE 'globex' END AS tenant", "concat('o', l_orderkey) AS trace_id", "concat('l', l_linenumber) AS span_id",
        "CASE WHEN l_linenumber > 1 THEN concat('l', l_linenumber div 2) END AS parent_span_id", "p_type AS name", "concat('svc-', l_suppkey % 8) AS service",
        "unix_micros(CAST(l_shipdate AS TIMESTAMP)) * 1000 + CAST(l_linenumber AS BIGINT) * 1000000000 AS start_time_ns",
        "unix_micros(CAST(l_shipdate AS TIMESTAMP)) * 1000 + CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 1000) AS BIGINT) * 1000 AS end_time_ns",
        "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'error' WHEN l_returnflag = 'R' THEN 'error' WHEN l_returnflag = 'N' THEN '' ELSE 'ok' END AS status",
        "concat('c', o_custkey) AS session_id", "CASE WHEN o_custkey % 2 = 0 THEN 'session.id' ELSE 'gen_ai.conversation.id' END AS session_key",
        "CASE WHEN l_linenumber % 4 <> 0 THEN p_brand END AS model", "CAST(l_quantity AS BIGINT) * 100 AS prompt_tokens", "CAST(p_size AS BIGINT) * 10 AS completion_tokens",
        "CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) / 1e6D END AS cost_metered", "true AS is_llm", *keep,
    )), PRICING)


def li_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions, numbered in the order in which they were written."""
    lines = _read(spark, sf_dir, "lineitem")
    seq = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy(*_NEWER)).cast("long")
    return _spans_of_lines(spark, sf_dir, lines.withColumn("ingest_seq", seq))


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current spans; the newest version is chosen before anything is joined."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_NEWER)
    return _spans_of_lines(spark, sf_dir, current(lines, _NEWER, ["l_orderkey", "l_linenumber"]))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").selectExpr("*", "CAST(ts AS DATE) AS d", "get_json_object(props, '$.k') AS k")
    before = F.lag("event_id").over(W.partitionBy("user_id", "d").orderBy("ts", "event_id"))
    rows = rows.withColumn("before", before)
    return with_cost(_filled(rows.selectExpr(
        "CASE WHEN user_id % 4 = 0 THEN '' ELSE concat('t', user_id % 4) END AS tenant", "concat('u', user_id, '-', d) AS trace_id", "concat('e', event_id) AS span_id", "concat('e', before) AS parent_span_id",
        "event_type AS name", "concat('svc-', event_id % 8) AS service", "unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS start_time_ns", "unix_micros(CAST(ts AS TIMESTAMP)) * 1000 + CAST(round(value * 1000) AS BIGINT) * 1000 AS end_time_ns",
        "CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status", "concat('u', user_id) AS session_id", "map('k', CASE WHEN event_id % 2 = 1 THEN concat('\"', k, '\"') ELSE k END) AS attributes", "false AS is_llm",
    )))


def cv(spark: SparkSession, sf_dir: str, trace_per_turn: bool = False) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    grown = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn")).cast("long")
    trace = "concat('conv', conv_id, '-', turn)" if trace_per_turn else "concat('conv', conv_id)"
    return with_cost(_filled(rows.withColumn("grown", grown).selectExpr(
        "'' AS tenant", f"{trace} AS trace_id", "concat('t', turn) AS span_id", "CASE WHEN turn > 0 THEN 't0' END AS parent_span_id", "role AS name", "'chat' AS service",
        "1700000000000000000 + conv_id * 3600000000000 + turn * 5000000000 AS start_time_ns", "1700000000000000000 + conv_id * 3600000000000 + turn * 5000000000 + length(text) * 1000000L AS end_time_ns",
        "'ok' AS status", "concat('conv', conv_id) AS session_id", "grown AS prompt_tokens", "text AS content", "true AS is_llm",
    )))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as scores of two experiments; the second lacks every seventh document."""
    rows = _read(spark, sf_dir, "labels").selectExpr("doc_id", "explode(array(struct(1L AS experiment_id, quality AS v), struct(2L AS experiment_id, toxic AS v))) AS e")
    return rows.where("NOT (e.experiment_id = 2 AND doc_id % 7 = 0)").selectExpr(
        "'' AS tenant", "'' AS trace_id", "'' AS span_id", "'' AS session_id", "e.experiment_id AS experiment_id", "concat('doc', doc_id) AS example_id", "'verdict' AS name", "CAST(e.v AS STRING) AS value", "CASE WHEN doc_id % 2 = 0 THEN 'human' ELSE 'eval/auto' END AS source", "doc_id AS timestamp_ns"
    )


LI_SQL = """
li_v AS (
  SELECT CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'acme' ELSE 'globex' END AS tenant, 'o' || l_orderkey AS trace_id, 'l' || l_linenumber AS span_id,
         CASE WHEN l_linenumber > 1 THEN 'l' || (l_linenumber // 2) END AS parent_span_id, p_type AS name, 'svc-' || (l_suppkey % 8) AS service,
         epoch_us(l_shipdate) * 1000 + CAST(l_linenumber AS BIGINT) * 1000000000 AS start_time_ns,
         epoch_us(l_shipdate) * 1000 + CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 1000) AS BIGINT) * 1000 AS end_time_ns,
         CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'N' THEN '' ELSE 'ok' END AS status, 'c' || o_custkey AS session_id,
         CASE WHEN o_custkey % 2 = 0 THEN 'session.id' ELSE 'gen_ai.conversation.id' END AS session_key, CASE WHEN l_linenumber % 4 <> 0 THEN p_brand END AS model,
         CAST(l_quantity AS BIGINT) * 100 AS prompt_tokens, CAST(p_size AS BIGINT) * 10 AS completion_tokens,
         CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) / 1e6::DOUBLE END AS cost_metered, true AS is_llm,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS ingest_seq,
         count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS versions
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
li AS (
  SELECT *, coalesce(cost_metered, derived) AS cost_usd,
         CASE WHEN cost_metered IS NOT NULL THEN 'metered' WHEN derived IS NOT NULL THEN 'derived' END AS cost_source,
         prompt_tokens + completion_tokens AS total_tokens
  FROM (SELECT *, CASE WHEN cost_metered IS NOT NULL THEN NULL WHEN model = 'Brand#11' THEN (prompt_tokens * 3.0::DOUBLE + completion_tokens * 15.0::DOUBLE) / 1e6 WHEN model LIKE 'Brand#1%' THEN (prompt_tokens * 2.0::DOUBLE + completion_tokens * 8.0::DOUBLE) / 1e6
                       WHEN model LIKE 'Brand#2%' THEN (prompt_tokens * 1.0::DOUBLE + completion_tokens * 4.0::DOUBLE) / 1e6 END AS derived
        FROM li_v WHERE ingest_seq = versions))
"""

EV_SQL = """
ev AS (
  SELECT CASE WHEN user_id % 4 = 0 THEN '' ELSE 't' || (user_id % 4) END AS tenant, 'u' || user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS trace_id, 'e' || event_id AS span_id,
         'e' || lag(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS parent_span_id,
         event_type AS name, 'svc-' || (event_id % 8) AS service, epoch_us(ts) * 1000 AS start_time_ns, epoch_us(ts) * 1000 + CAST(round(value * 1000) AS BIGINT) * 1000 AS end_time_ns,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, 'u' || user_id AS session_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)
"""

CV_SQL = """
cv AS (
  SELECT '' AS tenant, 'conv' || conv_id AS trace_id, 't' || turn AS span_id, CASE WHEN turn > 0 THEN 't0' END AS parent_span_id, role AS name, 'chat' AS service,
         1700000000000000000 + conv_id * 3600000000000 + turn * 5000000000 AS start_time_ns, 1700000000000000000 + conv_id * 3600000000000 + turn * 5000000000 + length(text) * 1000000 AS end_time_ns,
         'ok' AS status, 'conv' || conv_id AS session_id, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS prompt_tokens, text AS content
  FROM conversations)
"""

SCORES_SQL = """
scores AS (
  SELECT 1::BIGINT AS experiment_id, 'doc' || doc_id AS example_id, 'verdict' AS name, quality::DOUBLE AS v, doc_id AS timestamp_ns, CASE WHEN doc_id % 2 = 0 THEN 'human' ELSE 'eval/auto' END AS source FROM labels
  UNION ALL
  SELECT 2::BIGINT, 'doc' || doc_id, 'verdict', toxic::DOUBLE, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'human' ELSE 'eval/auto' END FROM labels WHERE doc_id % 7 <> 0)
"""
