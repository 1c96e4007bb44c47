"""The pipeline's stages, and its registered queries."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("lumenspan.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from helpers import awkward, frame, prose  # noqa: E402


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(12)
    item = prose(rng, 40)
    long = lambda: " ".join(f"{w}{rng.randrange(10**6)}" for w in prose(rng, 120).split())
    docs = awkward() + [(700, long()), (701, f"{long()} {item} {long()}"), (702, f"{long()} write to someone@mail.example now")]
    same = long()
    docs += [(710 + i, same) for i in range(4)]
    frame(spark, docs, "doc_id long, text string, lang string, source string, n_chars long, row_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        ids.append({r["doc_id"] for r in docs.collect()})
    quality, near, clean, pii = ids
    assert {700, 701, 702, 710, 711} <= quality and not {1, 2, 3, 4, 91} & quality
    assert near & {710, 711, 712, 713} == {710} and {700, 701, 702} <= near
    assert 701 in near and 701 not in clean and {700, 702, 710} <= clean
    assert pii == clean and "[EMAIL]" in {r["doc_id"]: r["text"] for r in docs.collect()}[702]


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert {700, 702, 710} <= {r["doc_id"] for r in got} and not {701, 711} & {r["doc_id"] for r in got}
    assert sum(r["length"] for r in got if r["doc_id"] == 700) == next(r["doc_tokens"] for r in got if r["doc_id"] == 700)


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= names
