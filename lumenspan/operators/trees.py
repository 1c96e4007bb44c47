"""The span forest of a trace: tree order, self time, critical path, self depth.

A trace is read as a whole by one task (``per_group`` over (tenant, trace)):
its order depends on all of its spans.  Self time needs only siblings and stays
in the JVM.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semconv import duration
from .grouped import per_group


def tree_order(spans: list[dict]) -> list[tuple[dict, int]]:
    """(span, depth) depth first; orphans are roots; spans on cycles come last, at depth 0."""
    spans = sorted(spans, key=lambda s: (s["start_time_ns"], s["span_id"]))
    ids = {s["span_id"] for s in spans}
    children, roots = defaultdict(list), []
    for s in spans:
        parent = s["parent_span_id"]
        (children[parent] if parent and parent in ids and parent != s["span_id"] else roots).append(s)
    out, seen, todo = [], set(), [(r, 0) for r in reversed(roots)]
    while todo:
        s, depth = todo.pop()
        if s["span_id"] in seen:
            continue
        seen.add(s["span_id"])
        out.append((s, depth))
        todo += [(c, depth + 1) for c in reversed(children[s["span_id"]])]
    return out + [(s, 0) for s in spans if s["span_id"] not in seen]


def critical_path(spans: list[dict]) -> list[str]:
    """From the longest root on, always the child that ends last; ties by id."""
    ids = {s["span_id"] for s in spans}
    children = defaultdict(list)
    for s in spans:
        children[s["parent_span_id"] or ""].append(s)
    roots = [s for s in spans if not s["parent_span_id"] or s["parent_span_id"] not in ids]
    path: list[str] = []
    now = min(roots, key=lambda s: (s["start_time_ns"] - s["end_time_ns"], s["span_id"]), default=None)
    while now is not None and now["span_id"] not in path:
        path.append(now["span_id"])
        now = min(children[now["span_id"]], key=lambda s: (-s["end_time_ns"], s["span_id"]), default=None)
    return path


_NEEDED = ["tenant", "trace_id", "span_id", "parent_span_id", "start_time_ns", "end_time_ns"]


def trace_trees(spans: DataFrame) -> DataFrame:
    """(tenant, trace_id, position, depth, span_id) for every trace."""

    def run(rows: list[dict]) -> list[tuple]:
        return [(s["tenant"], s["trace_id"], i, d, s["span_id"]) for i, (s, d) in enumerate(tree_order(rows))]

    return per_group(spans.select(_NEEDED), ["tenant", "trace_id"], run, "tenant string, trace_id string, position long, depth long, span_id string")


def critical_paths(spans: DataFrame) -> DataFrame:
    """(tenant, trace_id, step, span_id) for every trace."""

    def run(rows: list[dict]) -> list[tuple]:
        return [(rows[0]["tenant"], rows[0]["trace_id"], i, s) for i, s in enumerate(critical_path(rows))]

    return per_group(spans.select(_NEEDED), ["tenant", "trace_id"], run, "tenant string, trace_id string, step long, span_id string")


def self_time(spans: DataFrame) -> DataFrame:
    """(tenant, trace_id, span_id, self_time_ns): duration less the union of the children's intervals, 0 at least."""
    own = W.partitionBy("tenant", "trace_id", "parent_span_id")
    earlier = own.orderBy("start_time_ns", "end_time_ns", "span_id").rowsBetween(W.unboundedPreceding, -1)
    kids = spans.where("parent_span_id <> ''").withColumn("reached", F.max("end_time_ns").over(earlier))
    new = F.greatest(F.col("end_time_ns") - F.greatest("start_time_ns", F.coalesce("reached", "start_time_ns")), F.lit(0))
    covered = kids.groupBy("tenant", "trace_id", F.col("parent_span_id").alias("span_id")).agg(F.sum(new).alias("covered"))
    out = spans.select("tenant", "trace_id", "span_id", duration().alias("d")).join(covered, ["tenant", "trace_id", "span_id"], "left")
    return out.select("tenant", "trace_id", "span_id", F.greatest(F.col("d") - F.coalesce("covered", F.lit(0)), F.lit(0)).alias("self_time_ns"))


def conversation_turns(messages: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """Messages in order without those that an earlier one of the conversation said already."""
    first = W.partitionBy(*by, text).orderBy(*order)
    return messages.withColumn("said", F.row_number().over(first)).where("said = 1").drop("said")
