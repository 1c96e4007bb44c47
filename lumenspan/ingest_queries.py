"""Registered queries that take the whole way from request bodies: decode, facts, prices, payloads, annotations; each with SQL over the tables the bodies were made from."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import semconv
from .functions.attributes import canonical
from .functions.pricing import Pricing, with_cost
from .operators import aggregates, evals, lifecycle
from .plans import adapters as V
from .plans.filters import SpanFilter, search
from .queries import _DUR, _SPAN, _SUMS, COUNTERS, _cols, _split, query
from .sources import payloads
from .sources.native import END, START, accepted, numbered, read_spans, suppressed
from .sources.otlp import read_otlp
from .sources.rows import BATCH
from .store import TraceStore

PRICING = Pricing({"m-a": (3.0, 15.0), "m-*": (2.0, 8.0)})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt evenly while they are narrow: a small file splits into few tasks, and the bodies made from it are large."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    return _narrow(spark, sf_dir).repartition(tasks, "e")


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS e", "user_id AS u", "event_type", "unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS at")


#: Attributes of a native span by event ``e`` and user ``u``; each key where its condition holds.
_NATIVE = {
    "gen_ai.response.model": ("e % 4 = 0", "'m-a'"), "gen_ai.request.model": ("e % 4 < 2", "'m-b'"), "llm.model": ("e % 4 = 2", "42"),
    "gen_ai.provider.name": ("e % 6 < 3", "element_at(array('anthropic', 'openai', 'other'), CAST(e % 6 + 1 AS INT))"), "gen_ai.system": ("e % 6 IN (0, 3)", "IF(e % 6 = 0, 'openai', 'azure.ai.openai')"),
    "gen_ai.usage.input_tokens": ("e % 5 = 0", "e"), "gen_ai.usage.prompt_tokens": ("e % 5 = 1", "concat(' ', e, ' ')"), "llm.prompt_tokens": ("e % 5 = 2", "CAST(e + 0.75 AS DOUBLE)"),
    "gen_ai.usage.output_tokens": ("e % 3 = 0", "e % 50"), "llm.completion_tokens": ("e % 3 = 1", "'abc'"), "llm.usage.total_tokens": ("e % 7 = 0", "1000"), "llm.cost_usd": ("e % 10 = 1", "'0.5'"), "gen_ai.usage.cost": ("e % 10 < 2", "0.25D"),
    "gen_ai.usage.cache_read.input_tokens": ("e % 9 = 0", "7"), "gen_ai.usage.cache_read_input_tokens": ("e % 9 < 2", "8"), "gen_ai.usage.cache_creation.input_tokens": ("e % 9 = 0", "3"),
    "session.id": ("u % 5 = 0", "concat('s', u)"), "gen_ai.conversation.id": ("u % 5 < 2", "concat('c', u)"), "traceloop.association.properties.session_id": ("u % 5 = 2", "u"), "traceloop.association.properties.chat_id": ("u % 5 = 3", "concat('x', u)"),
    "gen_ai.operation.name": ("e % 11 = 0", "'chat'"), "traceloop.span.kind": ("e % 13 < 2", "IF(e % 13 = 0, 'llm', 'tool')"), "session.outcome": ("e % 17 = 0", "'success'"), "traceloop.association.properties.outcome": ("e % 17 < 2", "'failure'"), "session.goal": ("e % 17 = 0", "concat('goal ', u)"),
    "arguments": ("e % 19 < 2", "named_struct('text', concat('line one\\nworld', e % 3), 'list', array('alpha', 'say \"beta\"'), 'world2', true, '$payload', 'hidden', 'n', 200)"),
}


def native_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): a JSON body per event; times under each alias in turn, single spans and lists of one."""
    columns = [F.expr(f"CASE WHEN {when} THEN {value} END").alias(k) for k, (when, value) in _NATIVE.items()]
    times = [F.expr(f"CASE WHEN e % {len(keys)} = {i} THEN at + {plus} END").alias(k) for keys, plus in ((START, "0"), (END, "(e % 100) * 1000000")) for i, k in enumerate(keys)]
    events = F.expr("CASE WHEN e % 23 = 0 THEN array(named_struct('name', 'retry delta', 'time', at + 5, 'attributes', named_struct('why', concat('gamma', e % 2)))) END").alias("events")
    span = F.struct(
        F.expr("CASE WHEN u % 4 > 0 THEN concat('t', u % 4) END").alias("$tenant"), F.expr("concat('u', u)").alias("trace_id"), F.expr("concat('e', e)").alias("span_id"), F.expr("CASE WHEN e % 2 = 1 THEN concat('e', e - 1) END").alias("parent_span_id"),
        F.col("event_type").alias("name"), F.expr("concat('svc-', e % 8)").alias("service"), *times, F.expr("CASE e % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' END").alias("status"), F.struct(*columns).alias("attributes"), events, F.expr("e % 6").alias("lane"),
    )
    body = F.to_json(span)
    bodies = _events(spark, sf_dir).select(F.when(F.col("e") % 2 == 0, body).otherwise(F.concat(F.lit('{"spans":['), body, F.lit("]}"))).alias("value"))
    bad = spark.createDataFrame([("not json",), ('{"trace_id":"","span_id":"x","name":"n","service":"s","start_time_ns":1,"end_time_ns":2}',), ('[{"trace_id":"t","span_id":"x","name":"n","service":"s","start_time_ns":-1,"end_time_ns":2}]',)], "value string")
    return bodies.union(bad)


def native_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cost(semconv.with_facts(accepted(read_spans(native_bodies(spark, sf_dir)))), PRICING)


_NATIVE_SQL = """
e AS (SELECT event_id AS e, user_id AS u, event_type, epoch_us(ts) * 1000 AS t0 FROM events),
f AS (
  SELECT e, CASE WHEN u % 4 > 0 THEN 't' || (u % 4) ELSE '' END AS tenant, 'u' || u AS trace_id, 'e' || e AS span_id, CASE WHEN e % 2 = 1 THEN 'e' || (e - 1) END AS parent_span_id, event_type AS name, 'svc-' || (e % 8) AS service,
         t0 AS start_time_ns, t0 + (e % 100) * 1000000 AS end_time_ns, CASE e % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE '' END AS status,
         CASE e % 4 WHEN 0 THEN 'm-a' WHEN 1 THEN 'm-b' WHEN 2 THEN '42' END AS model, CASE e % 6 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'other' WHEN 3 THEN 'azure.ai.openai' END AS provider,
         CASE WHEN e % 5 < 3 THEN e END AS prompt_tokens, CASE WHEN e % 3 = 0 THEN e % 50 END AS completion_tokens, CASE WHEN e % 7 = 0 THEN 1000 END AS explicit_total, CASE e % 10 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 END AS cost_metered,
         CASE e % 9 WHEN 0 THEN 7 WHEN 1 THEN 8 END AS cache_read, CASE WHEN e % 9 = 0 THEN 3 END AS cache_creation,
         CASE u % 5 WHEN 0 THEN 's' || u WHEN 1 THEN 'c' || u WHEN 2 THEN u::VARCHAR WHEN 3 THEN 'x' || u END AS session_id,
         CASE u % 5 WHEN 0 THEN 'session.id' WHEN 1 THEN 'gen_ai.conversation.id' WHEN 2 THEN 'traceloop.association.properties.session_id' WHEN 3 THEN 'traceloop.association.properties.chat_id' END AS session_key,
         CASE e % 17 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' END AS declared_outcome, CASE WHEN e % 17 = 0 THEN 'goal ' || u END AS goal
  FROM e),
g AS (SELECT *, model IS NOT NULL OR provider IS NOT NULL OR prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL OR explicit_total IS NOT NULL OR e % 11 = 0 OR e % 13 = 0 AS is_llm,
         coalesce(explicit_total, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS total_tokens FROM f),
n AS (SELECT *, CASE WHEN cost_metered IS NOT NULL THEN 'metered' WHEN model IN ('m-a', 'm-b') AND prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL THEN 'derived' END AS cost_source,
         coalesce(cost_metered, CASE model WHEN 'm-a' THEN prompt_tokens * 3 + completion_tokens * 15 WHEN 'm-b' THEN prompt_tokens * 2 + completion_tokens * 8 END / 1e6) AS cost_usd FROM g)
"""  # fmt: skip
_FACTS = "model, provider, prompt_tokens, completion_tokens, explicit_total, cost_metered, cache_read, cache_creation, session_id, session_key, declared_outcome, goal, is_llm"


@query(f"WITH {_NATIVE_SQL} SELECT {_SPAN}, parent_span_id FROM n")
def ingest_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(read_spans(native_bodies(spark, sf_dir))).selectExpr(*_split(f"{_SPAN}, parent_span_id"))


@query("SELECT 'empty trace_id or span_id' AS problem, 1 AS n UNION ALL SELECT 'not JSON', 1 UNION ALL SELECT 'times must be whole and not negative', 1 UNION ALL SELECT 'none', count(*) FROM events")
def ingest_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spans(native_bodies(spark, sf_dir)).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"""WITH {_NATIVE_SQL} SELECT span_id, {_FACTS}, total_tokens, CASE WHEN (cache_read IS NULL AND cache_creation IS NULL) OR provider IN ('openai', 'azure.ai.openai') THEN prompt_tokens
 WHEN provider = 'anthropic' THEN prompt_tokens + coalesce(cache_read, 0) + coalesce(cache_creation, 0) END AS context_tokens FROM n""")
def span_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native_spans(spark, sf_dir).select("span_id", *_FACTS.split(", "), semconv.total_tokens().alias("total_tokens"), semconv.context_tokens().alias("context_tokens"))


@query(f"WITH {_NATIVE_SQL} SELECT model AS key, {_SUMS} FROM n WHERE is_llm AND model IS NOT NULL GROUP BY 1")
def ingest_llm_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.llm_by(native_spans(spark, sf_dir), "model").selectExpr("key", *_split(COUNTERS))


@query(f"WITH {_NATIVE_SQL}, r AS (SELECT model, coalesce(sum(cost_usd), 0) AS c, sum(total_tokens) AS t FROM n WHERE is_llm AND model IS NOT NULL GROUP BY 1) SELECT model AS key, row_number() OVER (ORDER BY c DESC, t DESC, model) AS place FROM r")
def llm_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.ranked_llm(aggregates.llm_by(native_spans(spark, sf_dir), "model")).collect()
    return spark.createDataFrame([(r["key"], i + 1) for i, r in enumerate(rows)], "key string, place long")


@query(f"WITH {_NATIVE_SQL} SELECT {_SPAN} FROM n WHERE session_id = '7'")
def search_session_any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session named by a number under one of the conventions' keys."""
    return _cols(search(native_spans(spark, sf_dir), SpanFilter(session="7")))


def _content(name: str, said: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cols(search(accepted(read_spans(native_bodies(spark, sf_dir))), SpanFilter(content=said)))

    run.__name__ = name
    query(f"WITH {_NATIVE_SQL} SELECT {_SPAN} FROM n WHERE {where}")(run)


# the second line of a string; words of two values; event names and attributes; what is no string is not found: keys, numbers, true, digests
_content("search_content_nested", "World1", "e % 19 < 2 AND e % 3 = 1")
_content("search_content_values", "beta chat", "e % 19 < 2 AND e % 11 = 0")
_content("search_content_events", "delta GAMMA1", "e % 23 = 0 AND e % 2 = 1")
_content("search_content_not_text", "hidden", "FALSE")
_content("search_content_not_keys", "world2 line", "e % 19 < 2 AND e % 3 = 2")
_content("search_content_not_numbers", "200", "FALSE")


# --- OTLP ---

_OTLP = r"""concat('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-', e % 8, '"}}', IF(u % 4 > 0, concat(',{"key":"tenant","value":{"stringValue":"t', u % 4, '"}}'), ''), ']},
"scopeSpans":[{"scope":{"name":"lib","attributes":[{"key":"lib","value":{"stringValue":"scope"}},{"key":"both","value":{"stringValue":"scope"}}]},"spans":[{"traceId":"', upper(lpad(hex(u + 10), 32, '0')), '","spanId":"', lpad(hex(e + 10), 16, '0'), '"',
IF(e % 2 = 1, concat(',"parentSpanId":"', lpad(hex(e + 9), 16, '0'), '"'), ',"parentSpanId":""'), ',"name":"', event_type, '","startTimeUnixNano":"', at, '","endTimeUnixNano":', at + 7,
',"status":', element_at(array('{"code":2}', '{"code":"STATUS_CODE_OK"}', '{}', '{"code":"STATUS_CODE_ERROR"}'), CAST(e % 4 + 1 AS INT)),
',"attributes":[{"key":"both","value":{"stringValue":"span"}},{"key":"i","value":{"intValue":"', e, '"}},{"key":"d","value":{"doubleValue":', e, '.5}},{"key":"t","value":{"boolValue":', IF(e % 2 = 0, 'true', 'false'), '}},
{"key":"a","value":{"arrayValue":{"values":[{"stringValue":"x"},{"intValue":"', u, '"}]}}},{"key":"m","value":{"kvlistValue":{"values":[{"key":"z","value":{"intValue":"1"}},{"key":"b","value":{"stringValue":"y"}}]}}},{"key":"y","value":{"bytesValue":"', base64(CAST(concat('b', u) AS BINARY)), '"}}],
"events":[{"name":"ev', e % 3, '","timeUnixNano":"', at + 1, '","attributes":[{"key":"q","value":{"intValue":"3"}}]}],"links":[{"traceId":"', lpad(hex(u + 10), 32, '0'), '","spanId":"AB', lpad(hex(e), 14, '0'), '"},{"traceId":"","spanId":"AB"}]}]}]}]}')"""


_OTLP_SQL = """WITH e AS (SELECT event_id AS e, user_id AS u, event_type, epoch_us(ts) * 1000 AS t0 FROM events)
SELECT CASE WHEN u % 4 > 0 THEN 't' || (u % 4) ELSE '' END AS tenant, lower(lpad(hex(u + 10), 32, '0')) AS trace_id, lower(lpad(hex(e + 10), 16, '0')) AS span_id, CASE WHEN e % 2 = 1 THEN lower(lpad(hex(e + 9), 16, '0')) END AS parent_span_id,
 event_type AS name, 'svc-' || (e % 8) AS service, t0 AS start_time_ns, t0 + 7 AS end_time_ns, CASE e % 4 WHEN 1 THEN 'ok' WHEN 2 THEN '' ELSE 'error' END AS status,
 '"scope"' AS lib, '"span"' AS both, e::VARCHAR AS i, e || '.5' AS d, CASE WHEN e % 2 = 0 THEN 'true' ELSE 'false' END AS t, '["x",' || u || ']' AS a, '{"b":"y","z":1}' AS m, '"' || lower(hex('b' || u)) || '"' AS y,
 'ev' || (e % 3) AS event, t0 + 1 AS event_ns, '3' AS q, 1 AS links, 'ab' || lower(lpad(hex(e), 14, '0')) AS linked FROM e"""


def _otlp_rows(spans: DataFrame) -> DataFrame:
    own = [F.col("attributes")[k].alias(k) for k in ("lib", "both", "i", "d", "t", "a", "m", "y")]
    first = F.col("events")[0]
    return spans.select("tenant", "trace_id", "span_id", "parent_span_id", "name", "service", "start_time_ns", "end_time_ns", "status", *own, first["name"].alias("event"), first["timestamp_ns"].alias("event_ns"), first["attributes"]["q"].alias("q"), F.size("links").alias("links"), F.col("links")[0]["span_id"].alias("linked"))


def otlp_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.expr(_OTLP).alias("value"))


@query(_OTLP_SQL)
def ingest_otlp_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, ids in both cases, times as text and numbers, status by name and number, all kinds of values."""
    return _otlp_rows(accepted(read_otlp(otlp_bodies(spark, sf_dir))))


def _field(number: int, wire: int, body: bytes) -> bytes:
    return _size(number << 3 | wire) + (_size(len(body)) if wire == 2 else b"") + body


_ONE = [bytes([n]) for n in range(128)]


def _size(n: int) -> bytes:
    if n < 128:
        return _ONE[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _any(v: dict) -> bytes:
    (kind, x), *_ = v.items()
    if kind == "stringValue":
        return _field(1, 2, x.encode())
    if kind == "boolValue":
        return _field(2, 0, _size(int(x)))
    if kind == "intValue":
        return _field(3, 0, _size(int(x) % (1 << 64)))
    if kind == "doubleValue":
        return _field(4, 1, struct.pack("<d", x))
    if kind == "arrayValue":
        return _field(5, 2, b"".join(_field(1, 2, _any(i)) for i in x["values"]))
    if kind == "kvlistValue":
        return _field(6, 2, _pairs(1, x["values"]))
    return _field(7, 2, base64.b64decode(x))


def _pairs(number: int, items: list[dict]) -> bytes:
    return b"".join(_field(number, 2, _field(1, 2, i["key"].encode()) + _field(2, 2, _any(i["value"]))) for i in items)


def encoded(body: dict) -> bytes:
    """The protobuf form of a JSON export request, for tests of the decoder."""
    out = b""
    time = lambda x: struct.pack("<Q", int(x))
    codes = {"STATUS_CODE_OK": 1, "STATUS_CODE_ERROR": 2}
    for r in body["resourceSpans"]:
        scopes = b""
        for c in r["scopeSpans"]:
            inner = _field(1, 2, _field(1, 2, c["scope"]["name"].encode()) + _pairs(3, c["scope"]["attributes"]))
            for s in c["spans"]:
                code = s["status"].get("code", 0)
                span = _field(1, 2, bytes.fromhex(s["traceId"])) + _field(2, 2, bytes.fromhex(s["spanId"])) + _field(4, 2, bytes.fromhex(s["parentSpanId"])) + _field(5, 2, s["name"].encode()) + _field(7, 1, time(s["startTimeUnixNano"])) + _field(8, 1, time(s["endTimeUnixNano"])) + _pairs(9, s["attributes"])
                for e in s["events"]:
                    span += _field(11, 2, _field(1, 1, time(e["timeUnixNano"])) + _field(2, 2, e["name"].encode()) + _pairs(3, e["attributes"]))
                for k in s["links"]:
                    span += _field(13, 2, _field(1, 2, bytes.fromhex(k["traceId"])) + _field(2, 2, bytes.fromhex(k["spanId"])))
                inner += _field(2, 2, span + _field(15, 2, _field(3, 0, _size(codes.get(code, code)))) + _field(99, 2, b"unknown"))
            scopes += _field(2, 2, inner)
        out += _field(1, 2, _field(1, 2, _pairs(1, r["resource"]["attributes"])) + scopes)
    return out


@query(_OTLP_SQL)
def ingest_otlp_protobuf(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                part = whole.column(0).slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([pa.array([encoded(json.loads(x)) for x in part.to_pylist()], pa.binary())], ["value"])

    bodies = otlp_bodies(spark, sf_dir).mapInArrow(run, "value binary")
    return _otlp_rows(accepted(read_otlp(bodies, protobuf=True)))


# --- payloads ---


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span per document with its text as an attribute of its own, and of an event for every third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS d", "coalesce(text, '') AS t")
    said = F.expr("substring(to_json(named_struct('v', t)), 6, length(to_json(named_struct('v', t))) - 6)")
    event = F.expr("CASE WHEN d % 3 = 0 THEN array(named_struct('name', 'said', 'timestamp_ns', d, 'attributes', map('again', said))) ELSE array() END")
    spans = docs.withColumn("said", said).withColumn("events", event)
    return spans.selectExpr("IF(d % 2 = 0, '', 'acme') AS tenant", "concat('d', d) AS trace_id", "'s' AS span_id", "map('text', said, 'n', CAST(d AS STRING)) AS attributes", "events", "CAST(array() AS array<struct<trace_id:string, span_id:string, attributes:map<string, string>>>) AS links")


_BIG = "SELECT doc_id AS d, text AS t, 'sha256/' || sha256(text) AS ref FROM documents WHERE strlen(coalesce(text, '')) > 4096"


@query(f"WITH b AS ({_BIG}) SELECT CASE WHEN d % 2 = 0 THEN '' ELSE 'acme' END AS tenant, 'd' || d AS trace_id, ref FROM b")
def payload_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.refs(payloads.offload(document_spans(spark, sf_dir))).select("tenant", "trace_id", "ref")


@query(f"WITH b AS ({_BIG}) SELECT ref, any_value(strlen(t))::BIGINT AS bytes, any_value(md5(t)) AS content_md5, any_value(t[1:256]) AS preview FROM b GROUP BY ref")
def payload_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads, and the previews that references keep."""
    spans = document_spans(spark, sf_dir)
    table = payloads.span_payloads(spans).select("ref", F.col("bytes").cast("long"), F.md5(F.col("content").cast("binary")).alias("content_md5"))
    text = F.col("attributes")["text"]
    left = payloads.offload(spans).where(text.startswith("{")).select(F.get_json_object(text, "$['$payload']").alias("ref"), F.get_json_object(text, "$.preview").alias("preview")).distinct()
    return table.join(left, "ref")


@query(f"WITH b AS ({_BIG}), o AS (SELECT arg_min(ref, d) AS ref FROM b WHERE d % 2 = 0) SELECT DISTINCT ref, strlen(t)::BIGINT AS bytes FROM b WHERE ref = (SELECT ref FROM o)")
def payload_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant '' gets a payload that one of its own spans holds, and tenant 'nobody' gets none."""
    spans = document_spans(spark, sf_dir)
    table, held = payloads.span_payloads(spans), payloads.refs(payloads.offload(spans))
    first = held.where("tenant = ''").orderBy(F.expr("CAST(substring(trace_id, 2) AS LONG)")).select("ref").first()
    ref = first["ref"] if first else ""
    got = payloads.fetch(table, ref, held, "").union(payloads.fetch(table, ref, held, "nobody"))
    return got.select("ref", F.col("bytes").cast("long").alias("bytes"))


@query(f"""WITH b AS ({_BIG}), gone AS (SELECT DISTINCT ref FROM b WHERE d % 5 = 0) SELECT 'd' || d AS trace_id, ref FROM b WHERE ref NOT IN (SELECT ref FROM gone)""")
def payload_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that are left once the payloads of every fifth document are erased: markers hold nothing."""
    spans = payloads.offload(document_spans(spark, sf_dir))
    gone = payloads.refs(spans.where("CAST(substring(trace_id, 2) AS LONG) % 5 = 0")).select("ref").distinct().collect()
    return payloads.refs(lifecycle.redact_payloads(spans, [r["ref"] for r in gone])).select("trace_id", "ref")


# --- tenants, retention, suppression, annotations, versions ---


@query(f"WITH {V.EV_SQL} SELECT {_SPAN} FROM ev WHERE tenant = 't1' AND status = 'error' AND {_DUR} >= 50000000 ORDER BY start_time_ns, end_time_ns, tenant, trace_id, span_id LIMIT 100")
def search_bound_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = SpanFilter.from_params([("status", "error"), ("min_duration_ms", "50")], bound_tenant="t1")
    return _cols(search(V.ev(spark, sf_dir), f))


@query(f"WITH {V.EV_SQL} SELECT {_SPAN} FROM ev WHERE tenant <> 't2' AND NOT (tenant = 't1' AND session_id = 'u5')")
def suppressed_on_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = spark.createDataFrame([("tenant", "t2", None), ("session", "t1", "u5")], "kind string, tenant string, session_id string")
    return _cols(suppressed(V.ev(spark, sf_dir), subjects))


@query("SELECT doc_id, quality FROM labels WHERE doc_id >= 100 OR doc_id % 3 = 0")
def annotation_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of experiments outlive the bound, plain annotations don't."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality", "'' AS tenant", "IF(doc_id % 3 = 0, 1, NULL) AS experiment_id", "doc_id AS timestamp_ns")
    return lifecycle.expire_annotations(rows, 1100, 1000).select("doc_id", "quality")


@query(f"WITH {V.EV_SQL}, o AS (SELECT trace_id FROM ev WHERE event_id = 7), a AS (SELECT * FROM ev WHERE trace_id = (SELECT trace_id FROM o)) SELECT span_id, CASE WHEN event_id % 2 = 1 THEN 'verdict' END AS note, CASE WHEN event_id % 2 = 1 THEN event_id::VARCHAR END AS value FROM a")
def trace_with_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = numbered(V.ev(spark, sf_dir), 1)
    event = F.expr("CAST(substring(span_id, 2) AS LONG)")
    notes = spans.where(event % 2 == 1).select("tenant", "trace_id", "span_id", "session_id", F.lit("verdict").alias("note"), event.cast("string").alias("value"))
    wanted = spans.where(event == 7).select("trace_id").first()
    return TraceStore(spans, annotations=notes).get_trace_with_annotations(wanted["trace_id"] if wanted else "").select("span_id", "note", "value")


@query(f"""WITH {V.EV_SQL}, o AS (SELECT arg_min(trace_id, event_id) AS l, arg_max(trace_id, event_id) AS r FROM ev), s AS (SELECT * FROM ev, o WHERE trace_id IN (l, r))
SELECT CASE WHEN trace_id = l THEN 'left' ELSE 'right' END AS side, greatest(max(end_time_ns) - min(start_time_ns), 1) AS duration_ns, count(*) AS spans, count(*) FILTER (status = 'error') AS error_count FROM s GROUP BY trace_id, l""")
def two_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.ev(spark, sf_dir).withColumn("event", F.expr("CAST(substring(span_id, 2) AS LONG)"))
    left, right = spans.agg(F.min_by(F.struct("tenant", "trace_id"), "event").alias("l"), F.max_by(F.struct("tenant", "trace_id"), "event").alias("r")).first()
    return aggregates.trace_compare(spans, tuple(left), tuple(right)).select("side", "duration_ns", "spans", "error_count")


@query("SELECT 'v1' AS version_id, item_id::VARCHAR AS example_id, text FROM benchmark WHERE item_id % 2 = 0")
def dataset_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version's examples with their bodies; one that was taken back has none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("CAST(item_id AS STRING) AS item_id", "text")
    digests = evals.digests(items, "item_id", F.col("text"))
    bodies = items.select(F.sha2("text", 256).alias("digest"), "text").distinct()
    manifests = digests.where("example_id % 2 = 0").withColumn("version_id", F.lit("v1")).unionByName(digests.withColumn("version_id", F.lit("v0")))
    gone = spark.sql("SELECT 'v0' AS version_id")
    views = [evals.version_view(manifests, bodies, v, gone) for v in ("v1", "v0")]
    return views[0].union(views[1]).select("version_id", "example_id", "text")


@query("SELECT item_id AS run FROM benchmark WHERE item_id % 2 = 1")
def invalid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id AS run", "CAST(item_id AS STRING) AS example_id", "'v1' AS version_id")
    return evals.invalid_runs(items, items.where("run % 2 = 0").select("version_id", "example_id")).select("run")


@query("SELECT event_id, epoch_us(ts) * 1000 AS parsed FROM events WHERE event_id < 200")
def time_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants as people write them, read back; a fixed handful of events."""
    from .functions.times import parse_time

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 200").selectExpr("event_id", "unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS at", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS said").collect()
    forms = lambda r: (f"{r['said']}Z", f"{r['said']}+00:00", str(r["at"]), f"{r['said'].replace('T', ' ')}Z")
    return spark.createDataFrame([(r["event_id"], parse_time(forms(r)[r["event_id"] % 4], 0)) for r in rows], "event_id long, parsed long")


@query("SELECT event_id, '{\"a\":[1,true],\"k\":' || json_extract_string(props, '$.k') || '}' AS body FROM events WHERE event_id < 200")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 200").selectExpr("event_id", "CAST(get_json_object(props, '$.k') AS LONG) AS k").collect()
    return spark.createDataFrame([(r["event_id"], canonical({"k": r["k"], "a": [1, True]})) for r in rows], "event_id long, body string")
