"""What keeps queries within their limits on large tables: small batches, even tasks, one reading of what is shared."""

from __future__ import annotations

import json
import os

import pyarrow as pa
import pytest

from lumenspan.functions import attributes as A
from lumenspan.functions import semconv
from lumenspan.operators import diagnosis
from lumenspan.operators.current import current
from lumenspan.plans.filters import SpanFilter, search
from lumenspan.sources.native import read_spans
from lumenspan.sources.otlp import from_protobuf, read_otlp

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


class Caught:
    """A frame that runs the function that Spark would run in a worker."""

    def __init__(self, *values):
        self.batch = pa.RecordBatch.from_pydict({"value": list(values)})

    def select(self, _):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return list(run(iter([self.batch])))


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_workers_hold_small_batches():
    """one body of many spans comes back in parts, NULL where a span was rejected, in the order it has."""
    from lumenspan.ingest_queries import encoded

    links = [{"traceId": "0a", "spanId": "0b"}]
    events = [{"name": "e", "timeUnixNano": 3, "attributes": [{"key": "q", "value": {"intValue": "3"}}]}]
    one = lambda i: {"traceId": "0A", "spanId": f"{i:04x}", "parentSpanId": "", "name": "n", "startTimeUnixNano": i, "endTimeUnixNano": i, "status": {}, "attributes": [{"key": "i", "value": {"intValue": str(i)}}] * (i % 2), "events": events * (i % 3), "links": links * (i % 2)}
    spans = [one(i) for i in range(5000)]
    body = {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"scope": {"name": "", "attributes": []}, "spans": spans}]}]}
    spoilt = json.loads(json.dumps(body))
    spoilt["resourceSpans"][0]["scopeSpans"][0]["spans"][7]["spanId"] = "no hex"
    for batches in (read_otlp(Caught(json.dumps(spoilt), "no json")), read_otlp(Caught(encoded(body)), protobuf=True)):
        rows = [r for b in batches for r in b.to_pylist()]
        assert max(b.num_rows for b in batches) <= 1024 and len(rows) == sum(b.num_rows for b in batches) >= 5000
        assert [r["start_time_ns"] for r in rows[8:5000]] == list(range(8, 5000))
        assert rows[8]["attributes"] == [] and rows[11]["attributes"] == [("i", "11")] and rows[11]["links"] == [{"trace_id": "0a", "span_id": "0b", "attributes": []}]
        assert rows[11]["events"] == [{"name": "e", "timestamp_ns": 3, "attributes": [("q", "3")]}] * 2 and rows[9]["events"] == []
        for r in [rows[7], rows[5000]] if len(rows) > 5000 else []:
            assert r["problem"] and all(v is None for k, v in r.items() if k != "problem")


def test_protobuf_lengths_of_many_bytes_and_cut_messages():
    from lumenspan.ingest_queries import encoded

    body = {"resourceSpans": [{"resource": {"attributes": [{"key": "k" * 300, "value": {"kvlistValue": {"values": [{"key": "x", "value": {"intValue": "-5"}}]}}}]}, "scopeSpans": []}]}
    raw = encoded(body)
    got = from_protobuf(raw)["resourceSpans"][0]["resource"]["attributes"][0]
    assert got == {"key": "k" * 300, "value": {"kvlistValue": {"values": [{"key": "x", "value": {"intValue": -5}}]}}}
    for n in range(1, len(raw)):
        with pytest.raises((ValueError, IndexError)):
            from_protobuf(raw[:n])


def test_canonical_equals_the_encoder():
    for v in ("é\"\\\n\u0001 ", "", 0, -7, 1 << 70, True, False, None, 1.0, 1e300, float("inf"), [1, "a", None], {"b": {"d": 1, "c": 2}, "a": True}):
        assert A.canonical(v) == json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@tables
def test_bodies_are_dealt_evenly(spark):
    """a file of one row group makes bodies in all tasks."""
    from lumenspan.ingest_queries import native_bodies, otlp_bodies

    for bodies in (native_bodies(spark, SF), otlp_bodies(spark, SF)):
        sizes = bodies.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
        assert sum(n > 0 for n in sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 4


def test_each_attribute_is_looked_up_once(spark):
    """whatever a fact needs of a value comes from one lookup."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = _plan(semconv.with_facts(read_spans(spark.createDataFrame([("{}",)], "value string"))))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    for key in (*semconv.MODEL, *semconv.PROMPT, *semconv.COST, *semconv.CALL_KEYS, semconv.KIND):
        assert plan.count(f"attributes#") and plan.count(f", {key},") == 1, key


def test_scalar_texts_with_and_without_escapes(spark):
    texts = ['"plain"', '""', '"a\\"b\\\\"', '"\\u0001é"', '"', "12", "true", "null", "[1]", '{"a":1}', '" 7 "', None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").orderBy("i").select(A.scalar_text(A.F.col("v"))).collect()]
    assert got == ["plain", "", 'a"b\\', "\x01é", None, "12", "true", None, None, None, " 7 ", None]


def test_stored_text_holds_the_words_of_searchable_text(spark):
    """texts without the letters are left before their strings are taken apart."""
    base = {"trace_id": "t", "name": "n", "service": "v", "start_ns": 1, "end_ns": 2}
    rows = [{"attributes": {"a": "x\nWord y"}}, {"attributes": {"a": {"word": 1}}}, {"attributes": {"a": [["Word"]]}}, {"events": [{"name": "WORD", "time": 1}]}, {"events": [{"name": "e", "time": 1, "attributes": {"k": "word"}}]}, {"attributes": {"word": "k"}}, {"attributes": {"a": "wo\trd"}}, {}]
    spans = read_spans(spark.createDataFrame([(json.dumps([base | {"span_id": f"s{i}"} | r for i, r in enumerate(rows)]),)], "value string")).drop("problem")
    near = spans.where(A.near_words(A.stored_text(A.F.col("attributes"), A.F.col("events")), "word"))
    assert {r["span_id"] for r in near.collect()} == {"s0", "s1", "s2", "s3", "s4"}
    assert {r["span_id"] for r in search(spans, SpanFilter(content="word")).collect()} == {"s0", "s2", "s3", "s4"}


@tables
def test_promoted_failures_read_line_items_once_per_use(spark):
    """two uses, and both read the same exchange of versions."""
    from lumenspan.queries import QUERIES

    df = QUERIES["promote_failures"](spark, SF)
    assert _plan(df).count("Relation [l_orderkey") == 2
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_leaves_with_shared_and_missing_keys(spark):
    """a failed child takes its parent out; spans without a trace have no relatives, and a span written twice stays twice a leaf."""
    schema = "tenant string, trace_id string, span_id string, parent_span_id string, session_id string, service string, name string, start_time_ns long, status string"
    rows = [
        ("", "t", "a", None, "s1", "v", "n", 1, "error"), ("", "t", "b", "a", "s1", "v", "n", 2, "error"), ("", "t", "c", "b", "s1", "v", "n", 3, "ok"),
        ("x", "t", "a", "", "s2", "v", "n", 1, "error"), ("", None, "a", None, "s3", "v", "n", 1, "error"), ("", None, "b", "a", "s3", "v", "n", 2, "error"), ("", "u", "a", "a", "s4", "v", "n", 1, "error"),
        ("", "w", "d", None, "s5", "v", "n", 1, "error"), ("", "w", "d", None, "s6", "v", "n", 1, "error"),
    ]
    got = {(r["session_id"], r["span_id"]) for r in diagnosis.causes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("s1", "b"), ("s2", "a"), ("s3", "a"), ("s5", "d"), ("s6", "d")}


def test_newest_by_all_columns(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "b"), ("a", 2, "c"), ("b", 0, None)], "k string, n int, s string")
    assert {tuple(r) for r in current(df, ["n", "s"], ["k"]).collect()} == {("a", 2, "c"), ("b", 0, None)}
    with pytest.raises(ValueError, match="beside"):
        current(df, ["n"], ["k"])
