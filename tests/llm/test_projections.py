"""What SQL can say of the corpus operators, on the driver's tables and on odd rows."""

from __future__ import annotations

import duckdb
import pytest

from shapelake.llm import queries

SF = "/root/testdata/sf0.001"


def rows(table):
    return sorted(map(repr, table))


def equal(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'/*.parquet' if folder != SF else ''}'")
    ours = queries.PROJECTIONS[name](spark, folder)
    theirs = con.execute(queries.PROJECTION_SQL[name])
    assert ours.columns == [d[0] for d in theirs.description]
    assert rows(map(tuple, ours.collect())) == rows(theirs.fetchall())


@pytest.mark.parametrize("name", sorted(queries.PROJECTIONS))
def test_projection_equals_sql(spark, name):
    equal(spark, SF, name)


@pytest.mark.parametrize("name", sorted(queries.PROJECTIONS))
def test_projection_on_odd_rows(spark, tmp_path, name):
    texts = [None, "", " ", "a b c a b c", "x\x0by z\x1cz \x85 \u3000q", "MIT License, mit license", "# | x\n\n# | x\n \n", "\u65e5\u672c general public license \U0001f600", "no\r\nno\r\nno", "same", "same"]
    spark.createDataFrame([(i // 2, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    equal(spark, str(tmp_path), name)


def test_registered():
    assert set(queries.PROJECTION_SQL) == set(queries.PROJECTIONS) and not set(queries.PROJECTIONS) & set(queries.QUERIES)
