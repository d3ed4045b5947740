"""Constructors, coarse grids, directions and hydrophobe clusters against plain numpy."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.constants import COULOMB_SCALING
from shapelake.operators import alignment, kernels, molecules, pharmacophores, surfaces
from shapelake.sources.stand_in import profiles as stand_in

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@needs_tables
def test_molecule_builds_what_is_missing(spark):
    rows = stand_in(spark, SF).where("mol_id < 5")
    built = {r["mol_id"]: r for r in molecules.molecule(rows.select("mol_id", "atoms", "pharm"), 40, density=0.1, per_atom=8).collect()}
    flat = surfaces.smooth_surface(rows, 40, per_atom=8).orderBy("mol_id", "idx").collect()
    assert sum(len(r["surface"]) for r in built.values()) == len(flat) > 0
    for mol, r in built.items():
        own = [f for f in flat if f["mol_id"] == mol]
        assert [tuple(p)[:4] for p in r["surface"]] == [tuple(f)[1:] for f in own]
        p, a = (np.array([[x[c] for c in "xyz"] for x in side]) for side in (r["surface"], r["atoms"]))
        want = COULOMB_SCALING * (np.array([x["q"] for x in r["atoms"]]) / np.linalg.norm(p[:, None] - a, axis=2)).sum(axis=1)
        assert np.allclose([x["q"] for x in r["surface"]], want)
    kept = molecules.molecule(rows, 40)
    assert kept.select("mol_id", "surface").exceptAll(rows.select("mol_id", "surface")).count() == 0
    assert "surface" not in molecules.molecule(rows.select("mol_id", "atoms")).columns
    with pytest.raises(ValueError, match="mesh_surface"):
        molecules.molecule(rows.select("mol_id", "atoms"), density=0.5)


def test_molecule_without_atoms_or_rows(spark):
    kind = "mol_id long, atoms array<struct<idx:int,x:double,y:double,z:double,q:double,radius:double>>"
    rows = spark.createDataFrame([(1, []), (2, None), (3, [(0, 0.0, 0.0, 0.0, 0.5, 1.7)])], kind)
    got = {r["mol_id"]: r["surface"] for r in molecules.molecule(rows, 10).collect()}
    assert not got[1] and not got[2] and len(got[3]) == 10
    assert molecules.molecule(rows.where("mol_id > 3"), 10).count() == 0


def test_centering_by_heavy_atoms(spark):
    kind = "mol_id long, atoms array<struct<x:double,y:double,z:double,z_number:int>>"
    rows = spark.createDataFrame([(1, [(1.0, 0.0, 0.0, 6), (3.0, 0.0, 0.0, 8), (50.0, 0.0, 0.0, 1)]), (2, [(2.0, 0.0, 0.0, 1), (4.0, 0.0, 0.0, 1)])], kind)
    got = {r["mol_id"]: [a["x"] for a in r["atoms"]] for r in molecules.centered(rows, ("atoms",)).collect()}
    assert got == {1: [-1.0, 1.0, 48.0], 2: [-1.0, 1.0]}
    pairs = spark.createDataFrame([(1, 2)], "ref_id long, fit_id long")
    assert [a["x"] for a in molecules.paired(pairs, rows, rows, ("atoms",), True).first()["ref_atoms"]] == got[1]
    assert [a["x"] for a in molecules.paired(pairs, rows, rows, ("atoms",)).first()["fit_atoms"]] == [2.0, 4.0]


def test_coarse_grid():
    rng = np.random.default_rng(5)
    ref, fit = rng.normal(size=(9, 3)), rng.normal(size=(7, 3))
    q, t = kernels.coarse_grid(ref, fit, 50)
    own, shift = kernels.seeds(ref, fit, 50)
    assert q.shape == (500, 4) and t.shape == (500, 3)
    assert np.allclose(q[:100:2], own) and np.allclose(t[::2], shift[0])
    tip = max(ref.tolist(), key=lambda p: sum(x * x for x in p))
    assert np.allclose(t[1::2], np.array(tip) - fit.mean(axis=0))
    half = np.diag([1.0, -1.0, -1.0])  # half a turn about x, after the seed's own
    assert np.allclose(kernels.matrices(q[100:200:2]), half @ kernels.matrices(own))


@needs_tables
def test_coarse_search_keeps_the_best_starts(spark):
    rows = stand_in(spark, SF).where("mol_id < 4")
    few = {(r["ref_id"], r["fit_id"]): r["score"] for r in alignment.align_panel(rows, rows, "vol", max_num_steps=0).collect()}
    many = {(r["ref_id"], r["fit_id"]): r["score"] for r in alignment.align_panel(rows, rows, "vol", max_num_steps=0, coarse=30).collect()}
    assert few.keys() == many.keys() and all(many[k] >= few[k] - 1e-9 or k[0] != k[1] for k in few)
    moved = {(r["ref_id"], r["fit_id"]): r["score"] for r in alignment.align_panel(rows, rows, "vol", coarse=30).collect()}
    assert all(moved[k] >= many[k] - 1e-9 for k in many) and all(moved[m, m] == pytest.approx(1.0, abs=1e-6) for m in range(4))


def test_directions_equal_the_plain_rules(spark):
    rng = np.random.default_rng(6)
    P = "struct<x:double,y:double,z:double>"
    rows, want = [], {}

    def add(kind, element, near, beyond, hydrogens, ways, at):
        i = len(rows)
        want[i] = ways
        rows.append((1, i, kind, element, tuple(map(float, at)), [tuple(map(float, n)) for n in near], None if beyond is None else tuple(map(float, beyond)), hydrogens))

    for _ in range(5):
        at, near, beyond = rng.normal(size=3), rng.normal(size=(4, 3)) + 2, rng.normal(size=3)
        add("aromatic", None, near, None, 0, pharmacophores.aromatic_directions(at, near), at)
        add("halogen", "F", near[:1], None, 0, pharmacophores.halogen_directions(at, near[0]), at)
        for n in range(4):
            add("donor", "N", near[:n], None, n, pharmacophores.donor_directions(at, near[:n]), at)
            for element in ("N", "O", "S"):
                for h in (0, 1):
                    for b in (None, beyond):
                        add("acceptor", element, near[:n], b, h, pharmacophores.acceptor_directions(element, at, near[:n], b, h), at)
    zero, x = np.zeros(3), np.array([[1.0, 0, 0], [-1.0, 0, 0]])
    add("acceptor", "N", x, None, 0, pharmacophores.acceptor_directions("N", zero, x), zero)  # ways that cancel
    flat = np.array([[1.0, 0, 0], [-0.5, 0.75**0.5, 0], [-0.5, -(0.75**0.5), 0]])
    add("acceptor", "N", flat, None, 0, pharmacophores.acceptor_directions("N", zero, flat), zero)
    add("acceptor", "O", x[:1], np.array([2.0, 0, 0]), 0, pharmacophores.acceptor_directions("O", zero, x[:1], np.array([2.0, 0, 0])), zero)
    frame = spark.createDataFrame(rows, f"mol_id long, idx int, kind string, element string, at {P}, near array<{P}>, beyond {P}, hydrogens int")
    got = {r["idx"]: [tuple(w) for w in r["ways"]] for r in pharmacophores.directions(frame).collect()}
    assert got.keys() == want.keys()
    for i, ways in want.items():
        assert len(got[i]) == len(ways) and np.allclose(np.array(got[i]).reshape(-1, 3), np.array(ways).reshape(-1, 3)), rows[i]


def test_hydrophobes_equal_the_single_pass(spark):
    rng = np.random.default_rng(7)
    clouds = {m: rng.uniform(0, 6, size=(m, 3)) for m in (0, 1, 2, 9, 25)}
    clouds[3] = np.array([[0.0, 0, 0], [1.9, 0, 0], [3.8, 0, 0]])  # a chain
    frame = spark.createDataFrame([(m, [tuple(map(float, p)) for p in c]) for m, c in clouds.items()], "mol_id long, points array<struct<x:double,y:double,z:double>>")
    got = {(r["mol_id"], r["cluster"]): (r["size"], r["x"], r["y"], r["z"]) for r in pharmacophores.hydrophobes(frame).collect()}
    want = {}
    for m, c in clouds.items():
        labels = pharmacophores.cluster_once(c)
        want |= {(m, int(k)): (int((labels == k).sum()), *c[labels == k].mean(axis=0)) for k in set(labels.tolist())}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
