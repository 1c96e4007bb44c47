"""Python over whole groups, without a call to pandas for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in a batch that goes back to the JVM.
BATCH = 8192


def per_group(df: DataFrame, keys: list[str], f: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """``f`` of each group's rows, as records.

    Rows are dealt by key and sorted, and a task walks through them; a group is
    all that it holds at a time, and small groups cost no call of their own.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[dict] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), arrow)], schema=arrow)

        for b in batches:
            for row in b.to_pylist():
                if group and any(group[-1][k] != row[k] for k in keys):
                    out += f(group)
                    group = []
                    if len(out) >= BATCH:
                        yield packed()
                        out = []
                group.append(row)
        if group:
            out += f(group)
        if out:
            yield packed()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
