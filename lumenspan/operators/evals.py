"""Annotations, datasets and versions, and the scores of experiments."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import canonical
from .current import current


def valid_subject() -> Column:
    """An annotation is about a trace, a span, a session, or an example of an experiment: one of these."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    scored = F.col("experiment_id").isNotNull()
    about = has("trace_id").cast("int") + (has("session_id") & ~has("trace_id")).cast("int")
    return has("name") & F.when(scored, has("example_id")).otherwise((about == 1) & ~(has("session_id") & has("trace_id")) & (has("trace_id") | ~has("span_id")))


def search_annotations(rows: DataFrame, *, source_prefix: str | None = None, since_ns: int | None = None, until_ns: int | None = None, limit: int | None = None, **equal: object) -> DataFrame:
    """Annotations by any of their keys; the newest first, then by key."""
    out = rows
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    if source_prefix is not None:
        out = out.where(F.col("source").startswith(source_prefix))
    if since_ns is not None:
        out = out.where(F.col("timestamp_ns") >= since_ns)
    if until_ns is not None:
        out = out.where(F.col("timestamp_ns") <= until_ns)
    if limit is None:
        return out
    return out.orderBy(F.desc("timestamp_ns"), "tenant", "trace_id", "span_id", "example_id", "name").limit(limit)


def numeric_score(value: Column) -> Column:
    """Numbers, and booleans as 0 and 1; strings are not read as numbers."""
    return F.when(value == "true", 1.0).when(value == "false", 0.0).when(value.rlike(r"^-?[0-9]"), value.try_cast("double"))


def latest_scores(scores: DataFrame) -> DataFrame:
    """The score that stands for each (experiment, example, name): the one with the highest (timestamp, trace, span)."""
    return current(scores, F.struct("timestamp_ns", "trace_id", "span_id"), ["experiment_id", "example_id", "name"])


def score_summary(scores: DataFrame) -> DataFrame:
    """Distribution per (experiment, name); percentiles are the value at place round((n - 1) * p)."""
    rows = latest_scores(scores).withColumn("v", numeric_score(F.col("value")))
    flags = F.col("value").isin("true", "false")
    at = lambda p: F.element_at("sorted", (F.floor((F.size("sorted") - 1) * F.lit(p) + 0.5) + 1).cast("int"))
    out = rows.groupBy("experiment_id", "name").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.array_sort(F.collect_list("v")).alias("sorted"), F.count(F.when(flags, 1)).alias("flags"), F.count(F.when(F.col("value") == "true", 1)).alias("true"))
    some = lambda x: F.when(F.size("sorted") > 0, x)
    return out.select("experiment_id", "name", "n", "mean", "min", "max", some(at(0.5)).alias("p50"), some(at(0.95)).alias("p95"), F.when(F.col("flags") > 0, F.col("true") / F.col("flags")).alias("true_rate"))


def score_diff(scores: DataFrame, base: int, candidate: int) -> DataFrame:
    """Per name: means, and how the examples of two experiments moved."""
    rows = latest_scores(scores.where(F.col("experiment_id").isin(base, candidate))).withColumn("v", numeric_score(F.col("value")))
    side = lambda e, p: rows.where(F.col("experiment_id") == e).select("example_id", "name", F.col("value").alias(f"{p}_value"), F.col("v").alias(p), F.lit(True).alias(f"in_{p}"))
    both = side(base, "b").join(side(candidate, "c"), ["example_id", "name"], "full_outer")
    numbers, here, there = F.col("b").isNotNull() & F.col("c").isNotNull(), F.col("in_b").isNotNull(), F.col("in_c").isNotNull()
    kind = (
        F.when(~there, "only_base").when(~here, "only_candidate").when(numbers & (F.col("c") > F.col("b")), "improved").when(numbers & (F.col("c") < F.col("b")), "regressed")
        .when(numbers, "unchanged").when(F.col("b_value").eqNullSafe(F.col("c_value")), "unchanged").otherwise("changed")
    )
    moved = both.withColumn("kind", kind)
    names = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("example_id")))).alias(k)
    out = moved.groupBy("name").agg(F.avg("b").alias("mean_base"), F.avg("c").alias("mean_candidate"), *map(names, ("improved", "regressed", "changed", "only_base", "only_candidate")), F.count(F.when(F.col("kind") == "unchanged", 1)).alias("unchanged"))
    return out.withColumn("delta", F.col("mean_candidate") - F.col("mean_base"))


def score_population(scores: DataFrame) -> DataFrame:
    """Per name: who scored, and the numeric values in ten even buckets, with the median at place floor(n / 2)."""
    v = numeric_score(F.col("value"))
    by = F.when(F.col("source").startswith("human"), "human").when(F.col("source").startswith("eval"), "eval").otherwise("other")
    rows = scores.withColumns({"v": v, "by": by})
    bounds = rows.groupBy("name").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    cell = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * 10), F.lit(9))).otherwise(F.lit(0))
    rows = rows.join(bounds, "name").withColumn("cell", F.when(F.col("v").isNotNull(), cell))
    count = lambda test: F.count(F.when(test, 1))
    out = rows.groupBy("name").agg(F.count("*").alias("n"), *[count(F.col("by") == k).alias(k) for k in ("human", "eval", "other")], F.array(*[count(F.col("cell") == i) for i in range(10)]).alias("buckets"), F.array_sort(F.collect_list("v")).alias("sorted"))
    return out.withColumn("p50", F.when(F.size("sorted") > 0, F.element_at("sorted", (F.floor(F.size("sorted") / 2) + 1).cast("int")))).drop("sorted")


def version_of(dataset_id: int, examples: list[dict], parent: str | None = None) -> tuple[str, list[dict]]:
    """(version id, manifest) of a dataset version: examples by id, each body by digest; equal content gives the same id."""
    ids = [e["example_id"] for e in examples]
    if not ids or len(set(ids)) < len(ids) or "" in ids:
        raise ValueError("a version needs examples, each with an id of its own")
    manifest = [{"example_id": e["example_id"], "digest": hashlib.sha256(canonical({k: v for k, v in e.items() if k != "example_id"}).encode()).hexdigest()} for e in sorted(examples, key=lambda e: e["example_id"])]
    body = canonical({"dataset_id": dataset_id, "parent": parent, "examples": manifest})
    return hashlib.sha256(body.encode()).hexdigest(), manifest


def version_view(manifests: DataFrame, bodies: DataFrame, version_id: str, tombstones: DataFrame | None = None) -> DataFrame:
    """The examples of a version with their bodies; none if the version is gone."""
    rows = manifests.where(F.col("version_id") == version_id)
    if tombstones is not None:
        rows = rows.join(tombstones.select("version_id"), "version_id", "left_anti")
    return rows.join(bodies, "digest").orderBy("example_id")


def digests(examples: DataFrame, id_col: str, body: Column) -> DataFrame:
    """(example_id, digest) of many examples at once."""
    return examples.select(F.col(id_col).alias("example_id"), F.sha2(body, 256).alias("digest"))


def invalid_runs(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Runs whose example is not in the manifest of their version."""
    return runs.join(manifests, ["version_id", "example_id"], "left_anti")


def parse_value(text: str) -> object:
    return json.loads(text)
