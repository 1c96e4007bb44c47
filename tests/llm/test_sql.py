"""The registered SQL on awkward documents."""

from __future__ import annotations

import duckdb
import pytest

queries = pytest.importorskip("lumenspan.llm.queries")

from helpers import awkward, frame  # noqa: E402
from lumenspan.llm.op3_license import license_paragraphs  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_awkward_documents(spark, tmp_path, name):
    docs = awkward() + [(800, "Licensed under the Apache License, Version 2.0\nx"), (801, "a\tb\x0bc\x0cd\re\nf " * 20)]
    frame(spark, docs).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.queries()[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    result = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


def test_cues_broken_over_lines(spark, tmp_path):
    """Notices whose only cue is broken over two lines, where a line's words alone are no cue."""
    notices = [
        ("unlicense", "This is free and unencumbered software released into the public\ndomain."), ("unlicense", "# This is free and unencumbered software released into the public\n# domain."),
        ("unlicense", " * This is free and unencumbered software released into the public \t\r\n *  domain."), ("cc-by-nc", "Creative\nCommons Attribution-NonCommercial-ShareAlike 4.0 International"),
        ("cc0", "To the extent possible under law, the author has waived all\ncopyright and related or neighboring rights to this work"), ("", "The public\n\ndomain is where the author has waived."), ("", "creative\ncommons"),
    ]
    frame(spark, [(i, t) for i, (_, t) in enumerate(notices)]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.queries()["op3_license"](spark, str(tmp_path)).collect())
    assert got == [(i, int(bool(family)), family) for i, (family, _) in enumerate(notices)]
    assert got == sorted(con.execute(queries.oracle_sql()["op3_license"]).fetchall())
    paragraphs = license_paragraphs(spark.read.parquet(f"{tmp_path}/documents.parquet"), key="doc_id")
    assert sorted((r["doc_id"], r["family"]) for r in paragraphs.where("confirmed").collect()) == [(i, family) for i, (family, _) in enumerate(notices) if family]
