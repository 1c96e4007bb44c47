"""Versions, rollups, trees, diagnosis, evals, lifecycle and the tail on hand-built rows."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from lumenspan.functions.pricing import with_cost
from lumenspan.operators import aggregates, diagnosis, evals, insights, lifecycle, trees
from lumenspan.operators.current import current
from lumenspan.plans.adapters import _filled
from lumenspan.plans.filters import SpanFilter
from lumenspan.streaming.tail import Gap, Ring, tail

SPAN = "tenant string, trace_id string, span_id string, parent_span_id string, name string, service string, start_time_ns long, end_time_ns long, status string, session_id string, prompt_tokens long"


def frame(spark, rows: list[dict]):
    base = {"tenant": "", "trace_id": "t", "span_id": "", "parent_span_id": None, "name": "n", "service": "v", "start_time_ns": 0, "end_time_ns": 1, "status": "ok", "session_id": "x", "prompt_tokens": None}
    names = [c.split()[0] for c in SPAN.split(", ")]
    full = [base | {"span_id": f"s{i}"} | r for i, r in enumerate(rows)]
    return with_cost(_filled(spark.createDataFrame([tuple(r[n] for n in names) for r in full], SPAN).withColumn("is_llm", F.col("prompt_tokens").isNotNull())))


def test_the_last_write_wins_before_any_filter(spark):
    df = frame(spark, [{"span_id": "a", "status": "error"}, {"span_id": "a", "status": "ok"}, {"span_id": "a", "tenant": "b"}]).withColumn("ingest_seq", F.monotonically_increasing_id())
    now = current(df)
    assert now.count() == 2 and now.where("status = 'error'").count() == 0


def test_sums_saturate(spark):
    df = frame(spark, [{"prompt_tokens": 2**63 - 1}, {"prompt_tokens": 5}])
    assert aggregates.llm_by(df, "service").first()["total_tokens"] == 2**63 - 1


def test_series_keeps_empty_buckets_and_every_span(spark):
    df = frame(spark, [{"start_time_ns": t, "end_time_ns": t + 1} for t in (0, 99, 100, 3)])
    got = insights.series(df, 0, 100, 10).orderBy("bucket").collect()
    assert [r["spans"] for r in got] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 2] and got[3]["p95_ns"] == 0
    with pytest.raises(ValueError, match="after"):
        insights.series(df, 5, 5)


def test_trees_with_orphans_and_cycles():
    s = lambda i, p, a, b: {"span_id": i, "parent_span_id": p, "start_time_ns": a, "end_time_ns": b}
    spans = [s("a", None, 0, 100), s("b", "a", 5, 50), s("c", "a", 1, 99), s("o", "gone", 3, 4), s("x", "y", 6, 7), s("y", "x", 7, 8)]
    assert [(r["span_id"], d) for r, d in trees.tree_order(spans)] == [("a", 0), ("c", 1), ("b", 1), ("o", 0), ("x", 0), ("y", 0)]
    assert trees.critical_path(spans) == ["a", "c"] and trees.critical_path([]) == []


def test_self_time_unites_children(spark):
    df = frame(spark, [{"span_id": "a", "end_time_ns": 100}, {"span_id": "b", "parent_span_id": "a", "start_time_ns": 10, "end_time_ns": 40}, {"span_id": "c", "parent_span_id": "a", "start_time_ns": 20, "end_time_ns": 30}, {"span_id": "d", "parent_span_id": "a", "start_time_ns": 35, "end_time_ns": 60}])
    assert {r["span_id"]: r["self_time_ns"] for r in trees.self_time(df).collect()} == {"a": 50, "b": 30, "c": 10, "d": 25}


def finding(spark, rows: list[dict]) -> dict | None:
    got = diagnosis.repetitions(frame(spark, rows)).collect()
    return got[0].asDict() if got else None


def test_shapes(spark):
    serial = [{"start_time_ns": i * 10, "end_time_ns": i * 10 + 5} for i in range(6)]
    assert finding(spark, serial[:4]) is None
    assert finding(spark, [s | {"prompt_tokens": 1000 * (i + 1)} for i, s in enumerate(serial)])["shape"] == "context_runaway"
    assert finding(spark, [s | {"status": "Error"} for s in serial])["shape"] == "retry_storm"
    assert finding(spark, [s | {"prompt_tokens": 1000} for s in serial])["shape"] == "iteration"
    burst = finding(spark, [{"status": "error", "start_time_ns": i, "end_time_ns": 100} for i in range(6)])
    assert burst["shape"] == "inconclusive" and "attempts overlap" in burst["missing"]
    assert finding(spark, serial)["missing"] == ["few context readings", "no failure"]
    chain = [{"parent_span_id": f"s{i - 1}" if i else None, "name": ("think", "act")[i % 2]} for i in range(14)]
    assert finding(spark, chain)["shape"] == "self_similar_chain"
    assert diagnosis.trend_of([0, 5, 10], False)[0] == "varying" and diagnosis.trend_of([1000, 1050, 1010], False)[0] == "flat"


def test_outcomes_and_causes(spark):
    df = frame(spark, [
        {"session_id": "ok", "status": "error", "end_time_ns": 5}, {"session_id": "ok", "end_time_ns": 9}, {"session_id": "bad", "end_time_ns": 3}, {"session_id": "bad", "span_id": "p", "status": "ERROR", "end_time_ns": 9, "start_time_ns": 1},
        {"session_id": "bad", "span_id": "c", "parent_span_id": "p", "status": "error", "end_time_ns": 8, "start_time_ns": 2}, {"session_id": "live", "end_time_ns": 990}, {"session_id": "said", "status": "error", "end_time_ns": 4},
    ]).withColumn("declared_outcome", F.when(F.col("session_id") == "said", "Resolved"))
    got = {r["session_id"]: (r["outcome"], r["reason"], r["error_count"]) for r in diagnosis.session_outcomes(df, 1000, 100).collect()}
    assert got == {"ok": ("success", "last_span_succeeded", 1), "bad": ("failure", "last_span_failed", 2), "live": ("unknown", "still_active", 0), "said": ("success", "declared", 1)}
    causes = {r["session_id"]: (r["span_id"], r["rule"]) for r in diagnosis.causes(df, diagnosis.repetitions(df)).collect()}
    assert causes["bad"] == ("c", "leaf_error")


def test_scores(spark):
    rows = [(1, "a", "m", "0.5", "human", 1, "t", "s"), (1, "a", "m", "0.9", "human", 2, "t", "s"), (1, "b", "m", '"x"', "eval", 1, "t", "s"), (1, "c", "m", "true", "bot", 1, "t", "s"), (2, "a", "m", "0.1", "eval", 1, "t", "s"), (2, "b", "m", '"x"', "eval", 1, "t", "s"), (2, "d", "m", "1", "eval", 1, "t", "s")]
    df = spark.createDataFrame(rows, "experiment_id long, example_id string, name string, value string, source string, timestamp_ns long, trace_id string, span_id string")
    one = evals.score_summary(df).where("experiment_id = 1").first()
    assert (one["n"], one["min"], one["max"], one["p50"], one["true_rate"]) == (3, 0.9, 1.0, 1.0, 1.0)
    d = evals.score_diff(df, 1, 2).first()
    assert (d["improved"], d["regressed"], d["unchanged"], d["changed"], d["only_base"], d["only_candidate"]) == ([], ["a"], 1, [], ["c"], ["d"])
    first = evals.version_of(7, [{"example_id": "b", "input": 1}, {"example_id": "a", "input": 2}])
    assert first == evals.version_of(7, [{"example_id": "a", "input": 2}, {"example_id": "b", "input": 1}]) and first[0] != evals.version_of(8, [{"example_id": "a", "input": 2}])[0]
    for bad in ([], [{"example_id": "a"}, {"example_id": "a"}]):
        with pytest.raises(ValueError, match="version"):
            evals.version_of(1, bad)


def test_retention_and_erasure(spark):
    df = frame(spark, [{"end_time_ns": 10}, {"end_time_ns": 90}, {"tenant": "keep", "end_time_ns": 1}, {"tenant": "long", "end_time_ns": 30}])
    assert lifecycle.expire(df, 100, 50, {"keep": 0, "long": 80}).count() == 3
    subjects = spark.createDataFrame([("trace", "", "t", None, None), ("span", "long", "t", "s3", None)], "kind string, tenant string, trace_id string, span_id string, session_id string")
    left = lifecycle.unmasked(df, subjects)
    assert {r["span_id"] for r in left.collect()} == {"s2"}
    assert {r["domain"]: r["occurrences"] for r in lifecycle.receipt(subjects, before=df, after=left).collect()} == {"before": 3, "after": 0}


def test_receipt_judges_each_table_by_its_own_columns(spark):
    subjects = spark.createDataFrame([("trace", "", "t", None, None, None), ("payload", None, None, None, None, "sha256/a")], "kind string, tenant string, trace_id string, span_id string, session_id string, ref string")
    notes = spark.createDataFrame([("", "t", ""), ("", "t", ""), ("", "u", "")], "tenant string, trace_id string, span_id string")
    payloads = spark.createDataFrame([("sha256/a",), ("sha256/b",)], "ref string")
    assert {r["domain"]: r["occurrences"] for r in lifecycle.receipt(subjects, notes=notes, payloads=payloads).collect()} == {"notes": 2, "payloads": 1}
    with pytest.raises(ValueError, match="no columns"):
        lifecycle.receipt(subjects, other=spark.range(3))


def test_ring_counts_what_a_batch_skipped():
    ring = Ring("e", most_spans=3)
    ring.admit([(i,) for i in range(2)])
    ring.admit([(i,) for i in range(12, 15)], skipped=10)
    assert ring.read("e", 12) == ([(12,), (13,), (14,)], 15)
    with pytest.raises(Gap):
        ring.read("e", 2)


def test_compaction(spark, tmp_path):
    df = frame(spark, [{"span_id": "a", "status": "error"}, {"span_id": "a"}, {"span_id": "b"}]).withColumn("ingest_seq", F.monotonically_increasing_id())
    lifecycle.compact(df, str(tmp_path / "c"), 2)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_ring_gaps():
    ring = Ring("e", most_spans=3)
    ring.admit([(i,) for i in range(5)])
    assert ring.backfill(2) == 3 and ring.read("e", 3) == ([(3,), (4,)], 5) and ring.read("e", 5) == ([], 5)
    for epoch, seq in (("other", 3), ("e", 1), ("e", 9)):
        with pytest.raises(Gap):
            ring.read(epoch, seq)


def test_tail_is_in_admission_order(spark, tmp_path):
    rows = frame(spark, [{"start_time_ns": 100 - i, "status": "error" if i % 2 else "ok"} for i in range(6)]).withColumn("ingest_seq", F.expr("CAST(substring(span_id, 2) AS LONG)"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ring = Ring("e")
    q = tail(stream, SpanFilter(status="error"), ring, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    deadline = time.time() + 10
    while not ring.head and time.time() < deadline:
        time.sleep(0.1)
    assert [r["span_id"] for r in ring.read("e", 0)[0]] == ["s1", "s3", "s5"]
    with pytest.raises(ValueError, match="event time"):
        tail(stream, SpanFilter(since_ns=1), ring, str(tmp_path / "x"))
