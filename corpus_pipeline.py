"""The corpus pipeline: quality rules, near-duplicates, decontamination, PII, packing.

``run(spark, sf_dir)`` applies ``STAGES`` to ``documents``; each stage is written
as Parquet to the shared folder and read again, so that a lost executor never
costs more than the stage it runs.  Before each, executors return the memory
that the stage before it took.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm.common import Rows, give_back, staged, table, unused
from lumenspan.llm.op2_pii import sanitise
from lumenspan.llm.op5_quality import quality_filter
from lumenspan.llm.op7_decontam import decontaminate
from lumenspan.llm.op8_simhash import similar_groups
from lumenspan.llm.op9_packing import pack


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_filter(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their five-word shingles: the first row of the smallest id.

    SimHash finds them, with op8's plan and buckets, and by prefixes of shingles
    what no number of bits guarantees; the share decides on both.
    """
    (row_id,) = unused(docs, "row_id")
    rows = Rows(docs, row_id, "rows")
    groups = similar_groups(rows)
    first = F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))
    ids = rows.df.select(F.col(row_id).alias("key"), F.col("doc_id").alias("id"))
    stay = ids.join(groups, "key").groupBy("group").agg(F.min_by("key", first).alias(row_id))
    return rows.join(stay.select(row_id), "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it taken out of their texts."""
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    return pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        give_back(spark)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs


#: Packing can't be expressed in SQL.
ORACLE_SQL = None
