"""Queries without SQL run over the whole table, and aligned ones over the panel of eight."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.operators import conformers
from shapelake.plans import catalog
from shapelake.sources.stand_in import profiles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", ["clustered_features", "smooth_surface", "volume_samples"])
def test_every_molecule_takes_part(spark, name):
    found = {r[0] for r in catalog.QUERIES[name](spark, SF).select("mol_id").distinct().collect()}
    assert found == {r[0] for r in profiles(spark, SF).select("mol_id").collect()}


def test_conformers_by_brute_force(spark):
    labels: dict[int, list] = {}
    for r in profiles(spark, SF).select("label", "mol_id", F.col("atoms")[0].alias("p")).orderBy("mol_id").collect():
        labels.setdefault(r["label"], []).append((r["p"]["x"], r["p"]["y"], r["p"]["z"]))
    want = set()
    for label, own in labels.items():
        at = np.array(own)
        i, j = np.triu_indices(len(at), 1)
        want |= {(label, c) for c in conformers.representatives(len(at), i, j, np.linalg.norm(at[i] - at[j], axis=1), 1.0, 5)}
    assert {(r["mol_id"], r["conf"]) for r in catalog.conformer_clusters(spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["align_vol", "screen_aligned_topk"])
def test_panel_of_eight(spark, name):
    out = catalog.QUERIES[name](spark, SF)
    id_col = next(c for c in ("query_id", "ref_id") if c in out.columns)
    assert {r[0] for r in out.select(id_col).distinct().collect()} == set(range(8))


def test_conformers_make_no_pairs(spark, tmp_path):
    """No join of a label with itself; one molecule alone represents its label, and one without a position itself."""
    rows = [(0, [0.1] * 64, 5), *[(k, [k / 1000, None if k == 9 else 0.0, *[0.1] * 62], 6) for k in range(1, 40)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = catalog.conformer_clusters(spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(5, 0), (6, 8), (6, 38)]


@pytest.mark.parametrize("kind", ["even", "grid", "copies", "flat"])
def test_conformers_by_position_are_those_by_pairs(kind):
    rng = np.random.default_rng(3)
    for n, threshold, most in ((1, 0.2, 1), (7, 0.2, 5), (90, 1.0, 5), (300, 0.5, 20)):
        at = rng.standard_normal((n, 3))
        at = {"even": at, "grid": np.round(at * 2) / 2, "copies": at[rng.integers(0, n, n)], "flat": at * [3, 0.5, 0]}[kind]
        i, j = np.triu_indices(n, 1)
        x, y, z = ((at[i] - at[j]) ** 2).T
        assert sorted(conformers.point_representatives(at, threshold, most)) == sorted(conformers.representatives(n, i, j, np.sqrt(x + y + z), threshold, most))
