"""Times the headline queries on ``$BENCH_SF_DIR`` and prints one line of JSON.

Spans are first written as a store of current spans (what ingest and compaction
leave behind); its time is reported as ``ingest``.  The queries then read that
store, each the better of two runs, written to the noop sink; one of them reads
all versions and picks the last writes itself.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.operators import aggregates, diagnosis, insights, trees
from lumenspan.operators.current import current
from lumenspan.plans import adapters
from lumenspan.plans.filters import SpanFilter, search


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        began = time.perf_counter()
        for name, make in (("li", adapters.li), ("ev", adapters.ev), ("cv", adapters.cv), ("li_versions", adapters.li_versions)):
            make(spark, sf).write.parquet(f"{folder}/{name}")
        ingest = time.perf_counter() - began
        li, ev, cv = (spark.read.parquet(f"{folder}/{n}") for n in ("li", "ev", "cv"))
        versions = spark.read.parquet(f"{folder}/li_versions")
        lo, hi = ev.agg(F.min("start_time_ns"), F.max("start_time_ns")).first()
        queries: dict[str, DataFrame] = {
            "llm_by_model": aggregates.llm_by(li, "model"),
            "llm_by_model_window": aggregates.llm_by(aggregates.windowed(li, 800_000_000_000_000_000, 830_000_000_000_000_000), "model"),
            "llm_by_model_of_versions": aggregates.llm_by(current(versions), "model"),
            "llm_by_service": aggregates.llm_by(li, "service"),
            "llm_by_session": aggregates.llm_by(li, "session"),
            "sessions_recent": aggregates.ranked_sessions(aggregates.sessions(li), "recent", 50),
            "trace_lookup": li.where("trace_id = 'o1'"),
            "attribute_filter": search(ev, SpanFilter(attributes={"k": "42"}, limit=100)),
            "content_search": search(cv, SpanFilter(content="the in"), attributes=""),
            "series_24": insights.series(ev, lo, hi, 24),
            "duration_percentiles": insights.duration_summary(li),
            "failures": insights.failures(li),
            "slowest": insights.slowest(li, 100),
            "self_time": trees.self_time(li),
            "critical_path": trees.critical_paths(li),
            "session_outcome": diagnosis.session_outcomes(li, hi),
            "leaf_error_cause": diagnosis.causes(li),
        }
        took = {"ingest": round(ingest, 3)}
        for name, df in queries.items():
            runs = []
            for _ in range(2):
                began = time.perf_counter()
                df.select("*").write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - began)
            took[name] = round(min(runs), 3)
        total = round(sum(v for k, v in took.items() if k != "ingest"), 3)
        print(json.dumps({"metric": "trace queries, total of the better of two runs", "value": total, "unit": "sec", "queries": took, "sf": sf, "spans": li.count()}))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        spark.stop()


if __name__ == "__main__":
    main()
