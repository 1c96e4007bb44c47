"""Large attribute values are moved to a payload table and referred to by digest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, PREVIEW = 4096, 256


def reference(text: Column) -> Column:
    """The reference that replaces a text: digest, size in bytes, and the first characters."""
    body = F.struct(F.concat(F.lit("sha256/"), F.sha2(text, 256)).alias("$payload"), F.octet_length(text).alias("bytes"), F.substring(text, 1, PREVIEW).alias("preview"))
    return F.to_json(body)


def _text(v: Column) -> Column:
    return F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"))


def offload(spans: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``spans`` with large strings of span, event and link attributes replaced by references."""
    small = lambda m: F.transform_values(m, lambda _, v: F.when(F.octet_length(_text(v)) > threshold, reference(_text(v))).otherwise(v))
    out = spans.withColumn("attributes", small(F.col("attributes")))
    for c in ("events", "links"):
        if c in spans.columns:
            out = out.withColumn(c, F.transform(c, lambda x: x.withField("attributes", small(x["attributes"]))))
    return out


def payloads(texts: DataFrame, text: str, threshold: int = THRESHOLD) -> DataFrame:
    """(ref, bytes, content): each large text once."""
    t = F.col(text)
    rows = texts.where(F.octet_length(t) > threshold)
    return rows.groupBy(F.concat(F.lit("sha256/"), F.sha2(t, 256)).alias("ref")).agg(F.first(F.octet_length(t)).alias("bytes"), F.first(t).alias("content"))


def span_payloads(spans: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The payload table of spans, before they are offloaded."""
    maps = [F.map_values("attributes")] + [F.flatten(F.transform(c, lambda x: F.map_values(x["attributes"]))) for c in ("events", "links") if c in spans.columns]
    texts = spans.select(F.explode(F.concat(*[F.coalesce(m, F.array().cast("array<string>")) for m in maps])).alias("v")).select(_text(F.col("v")).alias("text"))
    return payloads(texts, "text", threshold)


def refs(spans: DataFrame) -> DataFrame:
    """(tenant, trace_id, span_id, ref): the payloads that spans hold; the marker of an erased one holds nothing."""
    maps = [F.map_values("attributes")] + [F.flatten(F.transform(c, lambda x: F.map_values(x["attributes"]))) for c in ("events", "links") if c in spans.columns]
    values = F.concat(*[F.coalesce(m, F.array().cast("array<string>")) for m in maps])
    live = F.filter(values, lambda v: v.startswith("{") & v.contains('"$payload":"') & ~(v.contains('"erased":true') & (F.get_json_object(v, "$.erased") == "true")))
    held = F.array_distinct(F.filter(F.transform(live, lambda v: F.get_json_object(v, "$['$payload']")), lambda r: r.isNotNull()))
    return spans.select("tenant", "trace_id", "span_id", F.explode(held).alias("ref"))


def fetch(table: DataFrame, ref: str, held: DataFrame, tenant: str | None = None) -> DataFrame:
    """A payload, if a span of the tenant holds it."""
    of = held.where(F.col("ref") == ref)
    of = of if tenant is None else of.where(F.col("tenant") == tenant)
    return table.where(F.col("ref") == ref).join(of.select("ref"), "ref", "left_semi")


def parse_reference(text: str) -> dict:
    return json.loads(text)
