"""Attribute readings, facts, prices, buckets and filters on hand-built rows."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import attributes as A
from lumenspan.functions import histogram, semconv
from lumenspan.functions.pricing import Pricing, with_cost
from lumenspan.plans.filters import Cursor, SpanFilter, next_cursor, search
from lumenspan.sources.native import decode, read_spans
from lumenspan.sources.otlp import from_protobuf, read_otlp
from lumenspan.sources.payloads import offload, refs, span_payloads


def spans_of(spark, rows: list[dict]):
    base = {"trace_id": "t", "span_id": "s", "name": "n", "service": "svc", "start_time_ns": 10, "end_time_ns": 30}
    body = json.dumps([base | {"span_id": f"s{i}"} | r for i, r in enumerate(rows)])
    return semconv.with_facts(read_spans(spark.createDataFrame([(body,)], "value string")).drop("problem"))


def ids(df) -> set[str]:
    return {r["span_id"] for r in df.collect()}


def test_loose_and_strict_equality(spark):
    df = spans_of(spark, [{"attributes": {"code": v}} for v in (200, "200", 404, 200.0, True, "true", {"b": 1, "a": [2]}, None)] + [{}])
    assert ids(search(df, SpanFilter(attributes={"code": "200"}))) == {"s0", "s1"}
    assert ids(search(df, SpanFilter(attributes={"code": "true"}))) == {"s4", "s5"}
    assert ids(search(df, SpanFilter(attributes={"code": '{"a": [2], "b": 1}'}))) == {"s6"}
    assert ids(search(df, SpanFilter(not_attributes={"code": 200}))) == {f"s{i}" for i in range(1, 9)}
    assert ids(search(df, SpanFilter(not_attributes={"code": "200"}))) == {f"s{i}" for i in range(9)} - {"s1"}


def test_bounds_read_numbers_and_numeric_strings_only(spark):
    df = spans_of(spark, [{"attributes": {"n": v}} for v in (5, "5.5", " 5", "1e1", True, "nan", "inf", "5d", [], -3)] + [{}])
    assert ids(search(df, SpanFilter(min_attributes={"n": 5}))) == {"s0", "s1", "s3", "s6"}
    assert ids(search(df, SpanFilter(max_attributes={"n": 5}))) == {"s0", "s9"}


def test_words_are_whole_and_ascii(spark):
    df = spans_of(spark, [{"attributes": {"t": "Timeout in db-7"}}, {"attributes": {"t": "timeouts"}}, {"events": [{"name": "db", "time": 1, "attributes": {"x": "a TIMEOUT"}}]}, {"attributes": {"p": {"$payload": "sha256/timeout", "bytes": 9, "preview": "the timeout"}}}, {"name": "timeout"}, {"attributes": {"t": "Kelvin"}}])
    assert ids(search(df, SpanFilter(content="timeout"))) == {"s0", "s2", "s3"}
    assert ids(search(df, SpanFilter(content="DB timeout"))) == {"s0", "s2"}
    assert ids(search(df, SpanFilter(content="!?"))) == set() and ids(search(df, SpanFilter(content="kelvin"))) == set()


def test_facts_fall_through_and_clamp(spark):
    rows = [
        {"attributes": {"gen_ai.usage.input_tokens": "many", "llm.prompt_tokens": " 7 ", "gen_ai.usage.output_tokens": -4}},
        {"attributes": {"gen_ai.response.model": "", "gen_ai.request.model": 4, "llm.cost_usd": "0.25", "gen_ai.conversation.id": 12, "session.id": True}},
        {"attributes": {"llm.cost_usd": 1.0}}, {"attributes": {"traceloop.span.kind": "llm"}}, {"attributes": {"gen_ai.operation.name": None}},
        {"attributes": {"gen_ai.provider.name": "anthropic", "gen_ai.usage.input_tokens": 10, "gen_ai.usage.cache_read.input_tokens": 90}}, {"attributes": {"gen_ai.usage.input_tokens": 10, "gen_ai.usage.cache_read.input_tokens": 90}},
    ]
    got = spans_of(spark, rows).withColumns({"context": semconv.context_tokens(), "vague": semconv.context_is_ambiguous(), "total": semconv.total_tokens()}).orderBy("span_id").collect()
    assert (got[0]["prompt_tokens"], got[0]["completion_tokens"], got[0]["total"]) == (7, 0, 7)
    assert (got[1]["model"], got[1]["cost_metered"], got[1]["session_id"], got[1]["session_key"]) == ("4", 0.25, "12", "gen_ai.conversation.id")
    assert [r["is_llm"] for r in got] == [True, True, False, True, True, True, True]
    assert (got[5]["context"], got[5]["vague"], got[6]["context"], got[6]["vague"]) == (100, False, None, True)


def test_prices(spark):
    p = Pricing.from_json({"m-1": {"input_per_mtok": 1, "output_per_mtok": 2}, "m*": {"input_per_mtok": 10, "output_per_mtok": 10}, "m-1-x*": {"input_per_mtok": 0, "output_per_mtok": 0}})
    rows = [("m-1", 1_000_000, 1_000_000, None), ("m-2", 1, None, None), ("m-2", 100_000, 0, None), ("m-1-xy", 5, 5, None), ("other", 1, 1, None), ("m-1", 1, 1, 9.0)]
    got = with_cost(spark.createDataFrame(rows, "model string, prompt_tokens long, completion_tokens long, cost_metered double"), p).collect()
    assert [(r["cost_usd"], r["cost_source"]) for r in got] == [(3.0, "derived"), (None, None), (1.0, "derived"), (0.0, "derived"), (None, None), (9.0, "metered")]
    with pytest.raises(ValueError, match="finite"):
        Pricing({"m": (math.nan, 1.0)})


def test_buckets_are_exact_and_tight(spark):
    rng = random.Random(1)
    values = [*range(70), *(2**k + d for k in range(5, 62) for d in (-1, 0, 1)), *(rng.getrandbits(rng.randrange(1, 63)) for _ in range(500)), 2**63 - 1]

    def plain(v: int) -> int:
        octave = v.bit_length() - 1
        return v if v < 32 else 32 + (octave - 5) * 16 + (v >> (octave - 4)) - 16

    got = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", histogram.bucket(F.col("v"))).withColumn("u", histogram.upper_bound(F.col("b"))).collect()
    for r in got:
        assert r["b"] == plain(r["v"]) and r["v"] <= r["u"] <= r["v"] + r["v"] / 16 + 1


def test_percentiles_never_above_the_largest(spark):
    df = spark.createDataFrame([("a", v) for v in (10, 20, 1000)] + [("b", 7)], "k string, v long")
    got = {r["k"]: (r["p50"], r["p100"]) for r in histogram.percentiles(df, ["k"], F.col("v"), {"p50": 50.0, "p100": 100.0}).collect()}
    assert got == {"a": (20, 1000), "b": (7, 7)}


def test_random_filters_match_a_plain_evaluator(spark):
    rng = random.Random(5)
    rows = [{"service": f"s{rng.randrange(4)}", "name": f"n{rng.randrange(5)}", "status": rng.choice(["ok", "error", ""]), "start_time_ns": 1000 + i, "end_time_ns": 1000 + i + rng.randrange(50), "attributes": {"b": rng.randrange(6), "f": rng.random() < 0.5}} for i in range(600)]
    df = spans_of(spark, rows).cache()
    for _ in range(15):
        f = SpanFilter(service=rng.choice([None, "s1"]), status=rng.choice([None, "error"]), not_status=rng.choice([(), ("",)]), since_ns=rng.choice([None, 1100]), until_ns=rng.choice([None, 1400]), min_duration_ns=rng.choice([None, 20]), attributes=rng.choice([{}, {"b": "3"}]), max_attributes=rng.choice([{}, {"b": 2}]))
        want = {
            f"s{i}" for i, r in enumerate(rows)
            if (f.service in (None, r["service"])) and f.status in (None, r["status"]) and r["status"] not in f.not_status and r["start_time_ns"] >= (f.since_ns or 0) and r["start_time_ns"] <= (f.until_ns or 10**9)
            and r["end_time_ns"] - r["start_time_ns"] >= (f.min_duration_ns or 0) and all(str(r["attributes"][k]) == v for k, v in f.attributes.items()) and all(r["attributes"][k] <= v for k, v in f.max_attributes.items())
        }
        assert ids(search(df, f)) == want


def test_pages_of_equal_times_lose_nothing(spark):
    df = spans_of(spark, [{} for _ in range(25)])
    seen, f = [], SpanFilter(limit=10)
    while True:
        page = search(df, f).collect()
        seen += [r["span_id"] for r in page]
        at = next_cursor(page, f)
        if at is None:
            break
        f = SpanFilter(limit=10, cursor=Cursor.from_token(at.token()))
    assert sorted(seen) == sorted(f"s{i}" for i in range(25)) and len(seen) == 25
    for bad in ("", "x", "!!", Cursor(1, 2, "", "t", "s").token()[:-4]):
        with pytest.raises(ValueError, match="cursor"):
            Cursor.from_token(bad)
    with pytest.raises(ValueError, match="sort"):
        search(df, SpanFilter(sort="start", cursor=Cursor(1, 2, "", "t", "s")))


def test_parameters():
    f = SpanFilter.from_params([("service", "a"), ("attr.k", "1"), ("not_attr.k", "2"), ("min_duration_ms", "3"), ("not_status", "x"), ("not_status", "y"), ("q", "w")], bound_tenant="t")
    assert (f.tenant, f.attributes, f.not_attributes, f.min_duration_ns, f.not_status, f.content, f.limit) == ("t", {"k": "1"}, {"k": 2}, 3_000_000, ("x", "y"), "w", 100)
    with pytest.raises(ValueError, match="unknown"):
        SpanFilter.from_params([("colour", "red")])
    with pytest.raises(PermissionError):
        SpanFilter.from_params([("tenant", "other")], bound_tenant="t")


def test_native_decode():
    ok = {"trace_id": "t", "span_id": "s", "name": "n", "service": "v", "start_ns": 1, "end_time_unix_nano": 2, "tenant": "client", "$tenant": "acme"}
    got = decode(ok)
    assert (got["problem"], got["tenant"], got["extra"], got["start_time_ns"], got["end_time_ns"]) == (None, "acme", {"tenant": '"client"'}, 1, 2)
    for bad in ({"trace_id": ""}, {"$tenant": "Bad!"}, {"start_ns": -1}, {"start_ns": 1 << 63}, {"links": [{}] * 257}, {"start_ns": True}):
        assert decode(ok | bad)["problem"]


OTLP = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}, {"key": "tenant", "value": {"stringValue": "acme"}}]}, "scopeSpans": [{"scope": {"attributes": [{"key": "a", "value": {"stringValue": "scope"}}, {"key": "b", "value": {"intValue": "7"}}]}, "spans": [
    {"traceId": "0A0B", "spanId": "0C", "parentSpanId": "", "name": "n", "startTimeUnixNano": "5", "endTimeUnixNano": 9, "status": {"code": 2}, "attributes": [{"key": "a", "value": {"stringValue": "span"}}, {"key": "l", "value": {"arrayValue": {"values": [{"boolValue": True}, {"doubleValue": 1.5}]}}}, {"key": "y", "value": {"bytesValue": "AQI="}}], "links": [{"traceId": "0A", "spanId": ""}]}, {"traceId": "xyz", "spanId": "01"}]}]}]}


def test_otlp_json_and_protobuf_agree(spark):
    import struct

    size = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])
    field = lambda n, b: bytes([n << 3 | 2]) + size(len(b)) + b
    kv = lambda k, v: field(1, k.encode()) + field(2, v)
    text = lambda s: field(1, s.encode())
    values = field(1, b"\x10\x01") + field(1, b"\x21" + struct.pack("<d", 1.5))
    span = field(1, b"\x0a\x0b") + field(2, b"\x0c") + field(5, b"n") + b"\x39" + struct.pack("<Q", 5) + b"\x41" + struct.pack("<Q", 9) + field(9, kv("a", text("span"))) + field(9, kv("l", field(5, values))) + field(9, kv("y", field(7, b"\x01\x02"))) + field(13, field(1, b"\x0a")) + field(15, b"\x18\x02")
    scope = field(1, field(3, kv("a", text("scope"))) + field(3, kv("b", b"\x18\x07"))) + field(2, span)
    body = field(1, field(1, field(1, kv("service.name", text("api"))) + field(1, kv("tenant", text("acme")))) + field(2, scope))
    assert from_protobuf(body)["resourceSpans"][0]["scopeSpans"][0]["spans"][0]["name"] == "n"
    one = read_otlp(spark.createDataFrame([(json.dumps(OTLP),)], "value string")).collect()
    two = read_otlp(spark.createDataFrame([(body,)], "value binary"), protobuf=True).collect()
    good = [r for r in one if r["problem"] is None]
    assert good == two and len(one) == 2
    assert (good[0]["tenant"], good[0]["service"], good[0]["trace_id"], good[0]["status"], good[0]["links"]) == ("acme", "api", "0a0b", "error", [])
    assert good[0]["attributes"] == {"a": '"span"', "b": "7", "l": "[true,1.5]", "y": '"0102"'}


def test_payloads(spark):
    df = spans_of(spark, [{"attributes": {"t": "é" * 3000, "u": "small"}}, {"events": [{"name": "e", "time": 1, "attributes": {"x": "é" * 3000}}]}])
    small = offload(df)
    ref = json.loads(small.where("span_id = 's0'").first()["attributes"]["t"])
    assert ref["bytes"] == 6000 and ref["preview"] == "é" * 256 and small.where("span_id = 's0'").first()["attributes"]["u"] == '"small"'
    assert [r["ref"] for r in span_payloads(df).collect()] == [ref["$payload"]] and {r["span_id"] for r in refs(small).collect()} == {"s0", "s1"}
    assert A.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_times():
    from lumenspan.functions.times import parse_time

    now = 1_700_000_000_000_000_000
    assert parse_time("now", now) == now and parse_time(" 2h ", now) == now - 7200 * 10**9 and parse_time(str(now), now) == now
    assert parse_time("2026-07-27T09:00:00.5+02:00", now) == 1785135600500000000 and parse_time("1970-01-02", now) == 86_400 * 10**9
    for bad in ("", "soon", "1700000000", "2026-13-01", "2026-07-27T9:00", "１２"):
        with pytest.raises(ValueError):
            parse_time(bad, now)


def test_messages(spark):
    from lumenspan.functions.messages import messages

    rows = [
        {"attributes": {"gen_ai.input.messages": json.dumps([{"role": "user", "parts": [{"type": "text", "content": "hi"}, {"type": "image", "mime_type": "image/png"}]}]), "gen_ai.output.messages": [{"role": "assistant", "parts": [{"type": "tool_call", "name": "f", "arguments": {"a": 1}}]}], "gen_ai.prompt.0.content": "ignored"}},
        {"attributes": {"gen_ai.prompt.10.content": "second", "gen_ai.prompt.2.content": "first", "gen_ai.prompt.2.role": "user", "gen_ai.completion.0.content": "done"}},
        {"events": [{"name": "llm.prompt", "time": 1, "attributes": {"role": "user", "content": "e"}}, {"name": "other", "time": 2}]}, {"attributes": {"gen_ai.input.messages": {"$payload": "sha256/ab", "bytes": 1, "preview": ""}}}, {},
    ]
    got = [(r["span_id"], r["direction"], r["role"], r["kind"], r["text"]) for r in messages(spans_of(spark, rows)).orderBy("span_id", "position").collect()]
    assert got == [
        ("s0", "prompt", "user", "text", "hi"), ("s0", "prompt", "user", "media", "image/png"), ("s0", "completion", "assistant", "tool_call", 'f({"a": 1})'),
        ("s1", "prompt", "user", "text", "first"), ("s1", "prompt", None, "text", "second"), ("s1", "completion", None, "text", "done"), ("s2", "prompt", "user", "text", "e"), ("s3", "prompt", None, "payload", "sha256/ab"),
    ]


def test_store(spark):
    from lumenspan.store import TraceStore

    rows = [{"attributes": {"session.id": "a", "gen_ai.request.model": "m", "gen_ai.usage.input_tokens": 3}}, {"status": "error", "attributes": {"session.id": "a"}}, {"$tenant": "x", "attributes": {"session.id": "a"}}]
    base = spans_of(spark, rows).select(*[f.name for f in __import__("lumenspan.schema", fromlist=["SPAN"]).SPAN.fields]).withColumn("ingest_seq", F.monotonically_increasing_id())
    store = TraceStore(base)
    assert store.spans.count() == 3 and store.for_tenant("x").spans.count() == 1 and store.list_sessions().count() == 2
    assert store.for_tenant("").get_session("a").first()["spans"] == 2 and store.analyze_cost().first()["total_tokens"] == 3
    outcome, cause, findings = store.for_tenant("").diagnose_session("a", 10**18)
    assert outcome.first()["error_count"] == 1 and cause.first()["span_id"] == "s1" and findings.count() == 0
    assert store.top_failures().count() == 1 and store.waterfall("t").count() == 3 and store.describe().count() == 3 and store.promote_failures().count() == 1
    assert store.get_trace("t").count() == 3 and store.slowest_spans(1).count() == 1 and store.search_spans(SpanFilter(status="error", limit=5)).count() == 1
