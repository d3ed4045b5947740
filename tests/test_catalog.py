"""Every registered query with SQL against DuckDB on the smallest tables; the others must give rows."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from shapelake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = ordered(catalog.QUERIES[name](spark, SF).toPandas()), ordered(duck.execute(catalog.ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours.columns:
        if pd.api.types.is_float_dtype(ours[c]):
            assert np.allclose(ours[c].astype(float), theirs[c].astype(float), atol=1.1e-6, equal_nan=True), c
        else:
            assert ours[c].astype(str).tolist() == theirs[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_xyz_block_equals_sql_at_ties_and_odd_values(spark, tmp_path):
    """Halves of the last place, which are exact in binary, values of many digits, no number, no position, no vector."""
    odd = [k / 1024 for k in range(1, 22)], [-k / 1024 for k in range(1, 22)], [1e-12, -1e-12, -0.0, 12345678.9, 1e9, 3e22, float("nan"), float("inf"), -float("inf"), *[0.1] * 12], [None, 0.2, 0.3, *[0.4] * 18], [None] * 21
    rows = [(k, [*v, *[0.5] * 43], 0) for k, v in enumerate(odd)] + [(len(odd), None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    ours = {r["mol_id"]: r["xyz"] for r in catalog.xyz_block(spark, str(tmp_path)).collect()}
    assert ours == dict(con.execute(catalog.ORACLES["xyz_block"]).fetchall())
    assert ours[len(odd)] is None
