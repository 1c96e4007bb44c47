"""Spans from Python to Spark in small Arrow batches, column by column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import SPAN

#: Spans in a batch that goes back to the JVM, which bounds what a worker holds.
BATCH = 1024
ROW = T.StructType([*SPAN.fields, T.StructField("problem", T.StringType())])


def _offsets(items: Iterable[list | dict | None]) -> pa.Array:
    """Where each item begins; NULL where there is none."""
    out: list[int | None] = []
    at = 0
    for x in items:
        out.append(None if x is None else at)
        at += len(x or ())
    return pa.array([*out, at], pa.int32())


def _maps(items: list[dict[str, str] | None], kind: pa.DataType) -> pa.Array:
    keys = pa.array([k for x in items if x for k in x], kind.key_type)
    values = pa.array([v for x in items if x for v in x.values()], kind.item_type)
    return pa.MapArray.from_arrays(_offsets(items), keys, values, type=kind)


def _structs(items: list[list[dict] | None], kind: pa.DataType) -> pa.Array:
    flat = [s for x in items if x for s in x]
    of = kind.value_type
    parts = [column([s[f.name] for s in flat], f.type) for f in of]
    return pa.ListArray.from_arrays(_offsets(items), pa.StructArray.from_arrays(parts, fields=list(of)), type=kind)


def column(items: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_map(kind):
        return _maps(items, kind)
    return _structs(items, kind) if pa.types.is_list(kind) else pa.array(items, kind)


def decoded(bodies: DataFrame, name: str, spans_of: Callable[[object], Iterable[dict]]) -> DataFrame:
    """The spans of each body, as ``spans_of`` reads them."""
    arrow = to_arrow_schema(ROW)

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for body in b.column(0):
                for span in spans_of(body.as_py()):
                    rows.append(span)
                    if len(rows) >= BATCH:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    return bodies.select(name).mapInArrow(run, ROW)
