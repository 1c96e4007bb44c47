"""Spans from JSON lines or bodies, with the aliases and rules of the wire format."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import LONG_MAX, canonical
from ..schema import MAX_LINKS, TENANT
from .rows import decoded

# Fixed aliases of the wire format.
START = ("start_time_ns", "start_time_unix_nano", "start_timestamp_ns", "start_ns", "start_time")
END = ("end_time_ns", "end_time_unix_nano", "end_timestamp_ns", "end_ns", "end_time")
EVENT_TIME = ("timestamp_ns", "time_unix_nano", "timestamp_unix_nano", "time_ns", "time")
_KNOWN = {"trace_id", "span_id", "parent_span_id", "name", "service", "status", "attributes", "events", "links", "$tenant", *START, *END}


def _first(d: dict, keys: tuple[str, ...]) -> object:
    return next((d[k] for k in keys if k in d), None)


def _map(d: object) -> dict[str, str]:
    return {k: canonical(v) for k, v in d.items()} if isinstance(d, dict) else {}


def decode(span: dict) -> dict:
    """One span in the store's columns; ``problem`` says why it is rejected."""
    start, end = _first(span, START), _first(span, END)
    tenant, links = span.get("$tenant") or "", span.get("links") or []
    text = lambda k: span.get(k) if isinstance(span.get(k), str) else ""
    problems = [
        ("empty trace_id or span_id", not text("trace_id") or not text("span_id")), ("name and service must be strings", not isinstance(span.get("name"), str) or not isinstance(span.get("service"), str)),
        ("times must be whole and not negative", not all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in (start, end))), ("a time is past the range", any(isinstance(x, int) and x > LONG_MAX for x in (start, end))),
        ("bad tenant", bool(tenant) and not re.match(TENANT, str(tenant))), ("too many links", len(links) > MAX_LINKS),
    ]
    problem = next((why for why, true in problems if true), None)
    return {
        "tenant": str(tenant), "trace_id": text("trace_id"), "span_id": text("span_id"), "parent_span_id": span.get("parent_span_id") or None, "name": text("name"), "service": text("service"), "start_time_ns": None if problem else start, "end_time_ns": None if problem else end,
        "status": text("status"), "attributes": _map(span.get("attributes")), "events": [{"name": e.get("name", ""), "timestamp_ns": _first(e, EVENT_TIME), "attributes": _map(e.get("attributes"))} for e in span.get("events") or []],
        "links": [{"trace_id": x.get("trace_id", ""), "span_id": x.get("span_id", ""), "attributes": _map(x.get("attributes"))} for x in links][: MAX_LINKS + 1], "extra": {k: canonical(v) for k, v in span.items() if k not in _KNOWN}, "problem": problem,
    }


def _spans_of(body: str | None) -> list[dict]:
    try:
        got = json.loads(body)
    except (TypeError, ValueError):
        return [decode({}) | {"problem": "not JSON"}]
    spans = got["spans"] if isinstance(got, dict) and "spans" in got else got if isinstance(got, list) else [got]
    return [decode(s if isinstance(s, dict) else {}) for s in spans]


def read_spans(bodies: DataFrame, column: str = "value") -> DataFrame:
    """Spans of JSON bodies, each ``[...]``, ``{"spans": [...]}`` or one span; rejected ones have a ``problem``."""
    return decoded(bodies, column, _spans_of)


def accepted(rows: DataFrame, whole_batch: bool = False) -> DataFrame:
    """Valid spans; with ``whole_batch`` one bad span rejects all."""
    if whole_batch and not rows.where("problem IS NOT NULL").isEmpty():
        raise ValueError("a span of the batch was rejected")
    return rows.where("problem IS NULL").drop("problem")


def suppressed(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    """New spans without those that a pending erasure covers."""
    from ..operators.lifecycle import unmasked

    return unmasked(rows, subjects)


def numbered(rows: DataFrame, first: int | Column) -> DataFrame:
    """Rows of a batch with increasing write numbers from ``first`` on."""
    return rows.withColumn("ingest_seq", F.monotonically_increasing_id() + first)
