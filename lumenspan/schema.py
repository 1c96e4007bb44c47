"""Column types of the span store."""

from __future__ import annotations

from pyspark.sql import types as T

_MAP = T.MapType(T.StringType(), T.StringType())

EVENT = T.StructType([T.StructField("name", T.StringType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("attributes", _MAP)])
LINK = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("span_id", T.StringType()), T.StructField("attributes", _MAP)])

#: Attribute values are canonical JSON text, so their types survive.
SPAN = T.StructType([
    T.StructField("tenant", T.StringType()), T.StructField("trace_id", T.StringType()), T.StructField("span_id", T.StringType()), T.StructField("parent_span_id", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("service", T.StringType()), T.StructField("start_time_ns", T.LongType()), T.StructField("end_time_ns", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("attributes", _MAP), T.StructField("events", T.ArrayType(EVENT)), T.StructField("links", T.ArrayType(LINK)), T.StructField("extra", _MAP),
])

#: What identifies a span; a later version of the same key replaces it.
KEY = ["tenant", "trace_id", "span_id"]
#: The total order of spans.
ORDER = ["start_time_ns", "end_time_ns", *KEY]
MAX_LINKS = 256
TENANT = r"^[a-z0-9][a-z0-9._-]{0,63}$"
