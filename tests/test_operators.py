"""Literals, invariants and edge cases of the operators."""

from __future__ import annotations

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake import modes
from shapelake.functions import vectors as V
from shapelake.operators import alignment, conformers, diagnostics, evaluation, external, interactions, pharmacophores, profiles, scoring, screening, surfaces
from shapelake.sources import profile_store, tables, xyz
from shapelake.sources.stand_in import profiles as stand_in

SF = "/root/testdata/sf0.001"
POINT = "struct<idx:int,x:double,y:double,z:double,q:double,radius:double>"


def cloud(spark, mol, points):
    rows = [(mol, [(i, *map(float, p), 0.1 * i, 1.5) for i, p in enumerate(points)])]
    return spark.createDataFrame(rows, f"mol_id long, atoms array<{POINT}>")


def test_hard_sphere_literals(spark):
    a = cloud(spark, 1, [(10 * i,) * 3 for i in range(5)])
    for points, want in (([(10, 10, 10)], 1.0), ([(21, 20, 20)], 0.5), ([(32, 30, 30)], 0.0), ([(44, 40, 40)], 0.0), ([(10, 10, 10), (21, 20, 20), (32, 30, 30), (44, 40, 40)], 1.5)):
        assert scoring.clash(a, cloud(spark, 2, points), 2.0).first()["clash"] == pytest.approx(want)


def test_self_similarity_is_one_and_order_does_not_matter(spark):
    rows = stand_in(spark, SF).where("mol_id < 6")
    for scores in (scoring.shape(rows, rows), scoring.esp(rows, rows, 0.1), scoring.pharm(rows, rows)):
        own = scores.where("ref_id = fit_id").collect()
        assert len(own) == 6 and all(r["score"] is None or r["score"] == pytest.approx(1.0) for r in own)
    one = {(r[0], r[1]): r["score"] for r in scoring.shape(rows, rows).collect()}
    two = {(r[0], r[1]): r["score"] for r in scoring.shape(rows.repartition(5), rows.repartition(3)).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_features_that_never_count_give_null(spark):
    schema = "mol_id long, pharm array<struct<idx:int,ptype:int,x:double,y:double,z:double,vx:double,vy:double,vz:double>>"
    dummy = spark.createDataFrame([(1, [(0, 8, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)])], schema)
    assert scoring.pharm(dummy, dummy).first()["score"] is None
    still = spark.createDataFrame([(1, [(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)])], schema)
    directed, flat = scoring.pharm(still, still).first(), scoring.pharm(still, still, directionless=True).first()
    assert directed["ab"] == pytest.approx(flat["ab"] * 2 / 3)  # no direction weighs two thirds


def test_potential_on_an_atom_is_zero(spark):
    from shapelake.operators.overlap import coulomb

    atoms = cloud(spark, 1, [(0, 0, 0), (3, 0, 0)])
    points = spark.createDataFrame([(1, [(0, 0.0, 0.0, 0.0), (1, 0.0, 4.0, 0.0)])], "mol_id long, surface array<struct<idx:int,x:double,y:double,z:double>>")
    got = {r["idx"]: r["potential"] for r in coulomb(points.join(atoms, "mol_id")).collect()}
    assert got[0] == 0 and got[1] == pytest.approx(14.399774088621262 * 0.1 / 5)


def test_transform_then_back(spark):
    rows = stand_in(spark, SF).where("mol_id < 3")
    q = [0.5, 0.5, -0.5, 0.5]
    there = profiles.transform(rows, [F.lit(x) for x in q], [F.lit(x) for x in (1.0, 2.0, 3.0)], ("atoms", "pharm"))
    before, after = (scoring.shape(r, r).orderBy("ref_id", "fit_id").toPandas() for r in (rows, there))
    assert np.allclose(before["score"], after["score"])
    assert np.allclose(*(scoring.pharm(r, r).orderBy("ref_id", "fit_id").toPandas()["ab"] for r in (rows, there)))


def test_zero_axis_raises(spark):
    row = spark.range(1).select(V.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("a"))
    with pytest.raises(Exception, match="no length"):
        row.select(*[c.alias(f"q{i}") for i, c in enumerate(V.quaternion_of(F.col("a"), F.lit(1.0)))]).collect()


def test_moments_match_numpy(spark):
    from shapelake.operators.kernels import inertia

    rows = stand_in(spark, SF).where("mol_id < 5")
    got = {r["mol_id"]: [r["m1"], r["m2"], r["m3"]] for r in profiles.principal_moments(profiles.inertia(rows)).collect()}
    for r in rows.collect():
        p = np.array([[a["x"], a["y"], a["z"]] for a in r["atoms"]])
        assert np.allclose(sorted(got[r["mol_id"]]), np.linalg.eigvalsh(inertia(p)), atol=1e-8)


def test_top_k_ties_nulls_and_nans(spark):
    rows = spark.createDataFrame([(1, 5, 0.5), (1, 2, 0.5), (1, 9, 0.7), (1, 3, None), (1, 4, float("nan"))], "ref_id long, fit_id long, score double")
    assert [(r["rank"], r["id"]) for r in screening.top_k(rows, 2).orderBy("rank").collect()] == [(1, 9), (2, 2)]
    plan = screening.top_k(rows, 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_aligned_screening_finds_moved_copies(spark):
    library = stand_in(spark, SF).where("mol_id < 12")
    moved = profiles.transform(library, [F.lit(x) for x in (0.9, 0.2, -0.3, 0.1)], [F.lit(x) for x in (3.0, 0.0, -2.0)], ("atoms", "surface", "pharm"))
    hits = alignment.screen_aligned(library.where("mol_id < 3"), moved, "vol", 1).collect()
    assert {r["query_id"]: r["id"] for r in hits} == {0: 0, 1: 1, 2: 2}
    assert all(r["score"] > 0.99 and len(r["transform"]) == 16 for r in hits)
    # the transform reproduces the score
    pose = alignment.align_panel(library.where("mol_id = 1"), moved.where("mol_id = 5"), "vol")
    r = pose.first()
    posed = profiles.transform(moved.where("mol_id = 5"), [F.lit(r[c]) for c in ("qw", "qx", "qy", "qz")], [F.lit(r[c]) for c in ("tx", "ty", "tz")], ("atoms",))
    assert scoring.shape(library.where("mol_id = 1"), posed).first()["score"] == pytest.approx(r["score"])


def test_preset_pairs_find_their_moved_copies(spark):
    library = stand_in(spark, SF).where("mol_id < 6")
    moved = profiles.transform(library, [F.lit(x) for x in (0.9, 0.2, -0.3, 0.1)], [F.lit(x) for x in (3.0, 0.0, -2.0)], ("atoms", "surface", "pharm"))
    listed = library.select(F.col("mol_id").alias("ref_id"), F.col("mol_id").alias("fit_id"))
    for center in (False, True):
        rows = alignment.align_preset(listed, library, moved, "vol", center=center).collect()
        assert len(rows) == 6 and all(r["score"] > 0.99 and len(r["transform"]) == 16 for r in rows)
    combo = alignment.align_preset(listed, library, moved, "vol_and_surf_esp", lam=0.5).collect()
    start = alignment.align_preset(listed, library, moved, "vol_and_surf_esp", lam=0.5, num_repeats=1, max_num_steps=0).collect()
    assert np.mean([r["score"] for r in combo]) > np.mean([r["score"] for r in start])


def test_scores_against_a_target_and_variants(spark):
    rows = stand_in(spark, SF).where("mol_id < 5")
    target = rows.where("mol_id = 0")
    posed = {r["mol_id"]: r for r in evaluation.conditional(target, rows).collect()}
    best = {r["mol_id"]: r for r in evaluation.conditional(target, rows, aligned=True).collect()}
    assert len(posed) == len(best) == 5 and posed[0]["sim_surf_target"] == pytest.approx(1.0)
    assert all(best[i]["sim_surf_target_aligned"] >= posed[i]["sim_surf_target"] - 1e-6 for i in best)
    whole = evaluation.evaluate_all(target, rows, {"regen": rows, "relaxed": rows.where("mol_id < 3")})
    got = {r["mol_id"]: r for r in whole.collect()}
    assert got[1]["sim_esp_consistent_regen"] == pytest.approx(1.0) and got[4]["sim_surf_consistent_relaxed"] is None
    again = evaluation.resampled_scores(rows, 3).collect()
    assert len(again) == 5 * 3 and all(0 < r["score"] < 1 for r in again)
    few = evaluation.objective_of_conformers(target, rows, "label").collect()
    assert {r["label"] for r in few} <= {r["label"] for r in rows.collect()} and max(r["score"] for r in few) == pytest.approx(2.0, abs=0.02)


def test_modes_registry():
    assert modes.canonical("esp") == "surf_esp" and modes.canonical("nothing") == "nothing"
    with pytest.raises(ValueError, match="unknown mode"):
        modes.mode("nothing")
    with pytest.raises(ValueError, match="needs lam"):
        modes.resolve("vol_esp")
    assert modes.supports({"atoms", "charges"}, "vol_esp") and not modes.supports({"atoms"}, "pharm")
    assert set(screening.POSED) == set(modes.MODES)


def test_profile_store(spark, tmp_path):
    rows = stand_in(spark, SF).where("mol_id < 7")
    path = str(tmp_path / "store")
    manifest = profile_store.write(rows, path, modes=["vol", "pharm"], shard_size=3, pre_centered=False)
    assert manifest.n == 7 and manifest.columns == ["atoms", "pharm"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        profile_store.write(rows, path, modes=["vol"])
    store = profile_store.open_store(spark, path)
    back = profile_store.for_mode(store, "vol")
    assert back.columns == ["id", "atoms"] and back.count() == 7
    want = {str(r["mol_id"]): r["atoms"][0]["x"] for r in rows.collect()}
    assert all(r["atoms"][0]["x"] == pytest.approx(want[r["id"]], rel=1e-6) for r in back.collect())
    with pytest.raises(ValueError, match="surface"):
        profile_store.for_mode(store, "surf")
    profile_store.append(rows.limit(2), path)
    assert profile_store.open_store(spark, path)[1].n == 9
    shutil.rmtree(f"{path}/profiles")  # a build that was killed before its first commit
    (tmp_path / "store" / "profiles" / "_temporary").mkdir(parents=True)
    assert profile_store.open_store(spark, path)[1].n == 0 and profile_store.for_mode(profile_store.open_store(spark, path), "vol").columns == ["id", "atoms"]
    half = profile_store.write(rows, str(tmp_path / "half"), modes=["vol"], dtype="float16")
    assert half.pre_centered
    x = [a["x"] for r in profile_store.open_store(spark, str(tmp_path / "half"))[0].collect() for a in r["atoms"]]
    assert np.allclose(x, np.array(x).astype(np.float16).astype(float), atol=1e-6)


def test_xyz_round_trip_and_breaks(spark, tmp_path):
    atoms = spark.createDataFrame([(1, 1, 6, 0.5, -1.25, 3.0), (1, 0, 8, 1.0, 2.0, 3.0), (1, 2, 0, 9.0, 9.0, 9.0)], "mol_id long, idx int, z_number int, x double, y double, z double")
    block = xyz.blocks(atoms, drop_dummies=True).first()["xyz"]
    assert block.splitlines()[0] == "2" and xyz.parse(block) == [[("O", 1.0, 2.0, 3.0), ("C", 0.5, -1.25, 3.0)]]
    text = block + "next\n" + "C 1.0 2.0 3.0\nC 1e-3 2.0 3.0\nN 0.0 0.0 1.5\n"
    assert [len(s) for s in xyz.parse(text)] == [2, 1, 1]  # an exponent is no coordinate line
    (tmp_path / "a.xyz").write_text(text)
    assert xyz.read(spark, str(tmp_path / "a.xyz")).count() == 4


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", ref_mol_morgan_fp=np.zeros(64), score=np.array([1.0, 2.0]), name=np.array("x"))
    rows = tables.read_archives(spark, f"{tmp_path}/*.npz")
    assert {(r["row"], r["name"], r["value"]) for r in rows.collect()} == {(0, "score", "1.0"), (1, "score", "2.0"), (0, "name", "x"), (1, "name", "x")}
    assert tables.wide(rows, ["name", "score"]).count() == 2
    assert sorted(r["score"] for r in tables.wide(rows, {"name": "string", "score": "double"}).collect()) == [1.0, 2.0]
    for arrays in ({"a": np.zeros(60), "b": np.array(1)}, {"a": np.zeros(3), "b": np.zeros(4)}, {"a": np.zeros(3), "b": np.zeros((3, 2))}):
        np.savez(tmp_path / "bad.npz", **arrays)
        with pytest.raises(Exception, match="bad.npz"):
            tables.read_archives(spark, f"{tmp_path}/bad.npz").collect()


def test_evaluation_keeps_failures(spark):
    samples = spark.createDataFrame([(0, "C"), (1, "bad"), (2, "C")], "i long, smiles string")

    def one(row):
        if row["smiles"] == "bad":
            raise ValueError("no molecule")
        return {"is_valid": True, "smiles": row["smiles"]}

    out = {r["i"]: r for r in evaluation.evaluate(samples, one, "i long, is_valid boolean, smiles string, error string").collect()}
    assert out[1]["is_valid"] is None and "no molecule" in out[1]["error"] and out[0]["is_valid"]
    frame = spark.createDataFrame(list(out.values()), "i long, is_valid boolean, smiles string, error string")
    assert evaluation.unique_fraction(frame).first()[0] == pytest.approx(0.5)
    none = frame.where("i = 1")
    assert evaluation.unique_fraction(none).first()[0] == 0
    assert evaluation.diversity(spark.createDataFrame([(1, 5)], "mol_id long, bits long")).first()["diversity"] is None


def test_diversity_by_blocks(spark):
    rng = np.random.default_rng(12)
    rows = [(i, int(i % 3 == 0), int(b)) for i, b in enumerate(rng.integers(0, 1 << 20, 60))] + [(100, 1, 0), (101, 1, 0), (102, 7, 5), (103, 0, None)]
    prints = spark.createDataFrame(rows, "mol_id long, label int, bits long")

    def mean(own):
        pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        return np.mean([1 - (a & b).bit_count() / (a | b).bit_count() for a, b in pairs if a | b]), len(pairs)

    for block in (1000, 7):
        got = {r["label"]: (r["diversity"], r["n_pairs"]) for r in evaluation.diversity(prints, group="label", block=block).collect()}
        assert set(got) == {0, 1}  # one fingerprint makes no pair
        for label, (diversity, n) in got.items():
            want = mean([b for _, x, b in rows if x == label and b is not None])
            assert (diversity, n) == (pytest.approx(want[0]), want[1])
        whole = evaluation.diversity(prints, block=block).first()
        assert whole["diversity"] == pytest.approx(mean([b for *_, b in rows if b is not None])[0])
    assert evaluation.diversity(prints.limit(0)).first()["diversity"] is None


def test_external_contracts(spark):
    rows = spark.createDataFrame([(0, "C"), (1, None)], "i long, smiles string")
    with pytest.raises(external.BackendNotInstalled):
        external.apply("dock", rows)
    with pytest.raises(ValueError, match="unknown contract"):
        external.register("nothing", dict)
    external.register("dock", lambda r: {"smiles": r["smiles"], "energy": -float(len(r["smiles"]))})
    try:
        got = {r["i"]: r for r in external.apply("dock", rows).collect()}
    finally:
        external.unregister("dock")
    assert got[0]["energy"] == -1 and got[1]["energy"] is None and got[1]["error"]


def test_docking_shell(spark):
    ligands = spark.createDataFrame([(0, "C"), (1, "N"), (2, "C"), (3, None), (4, "O")], "ordinal long, smiles string")
    runs = spark.createDataFrame([("C", -3.0), ("C", -5.0), ("N", float("nan"))], "smiles string, energy double")
    docked = interactions.dock(ligands, lambda distinct: distinct.join(runs, "smiles"))
    assert {r["ordinal"]: r["energy"] for r in docked.collect()} == {0: -5.0, 1: None, 2: -5.0, 3: None, 4: None}
    summary = interactions.dock_summary(docked).first()
    assert (summary["num_failed"], summary["repeats"], summary["best_energy"]) == (3, 1, -5.0)
    assert [r["ordinal"] for r in interactions.by_energy(docked).collect()] == [0, 2, 1, 3, 4]
    assert interactions.by_energy(docked, True).count() == 4  # three SMILES and the missing one


def test_bad_charges(spark):
    rows = spark.createDataFrame([("CC",), ("C[CH-]C",), ("c1cc[o+]cc1",), (None,)], "smiles string")
    assert [r[0] for r in interactions.without_bad_charges(rows).collect()] == ["CC", None]


def test_priority_labels_ring_threshold(spark):
    features = spark.createDataFrame([(1, 0, 2, [0, 1, 2, 3, 4, 5]), (1, 1, 3, [0, 1, 2, 3, 4, 5]), (1, 2, 0, [5])], "mol_id long, idx int, ptype int, atom_ids array<int>")
    rings = spark.createDataFrame([(1, 0, [0, 1, 2, 3, 4, 5])], "mol_id long, ring_id int, heavy_ids array<int>")

    def labels(atoms, least=3):
        priority = spark.createDataFrame([(1, atoms)], "mol_id long, atom_ids array<int>")
        return [r["label"] for r in pharmacophores.priority_labels(features, rings, priority, least).orderBy("idx").collect()]

    assert labels([5]) == [0, 0, 1]
    assert labels([3, 4, 5]) == [1, 1, 1]
    assert labels([0], 1) == [1, 1, 0]


def test_directions():
    up = np.array([0.0, 0.0, 1.0])
    assert np.allclose(pharmacophores.aromatic_directions(np.zeros(3), np.array([[1.0, 0, 0], [0, 1.0, 0]]))[0], up)
    assert np.allclose(pharmacophores.acceptor_directions("N", np.zeros(3), np.array([-up]))[0], up)
    assert pharmacophores.acceptor_directions("N", np.zeros(3), np.array([[1.0, 0, 0], [-0.5, 0.8660254, 0], [-0.5, -0.8660254, 0]])) == []
    two = pharmacophores.acceptor_directions("O", np.zeros(3), np.array([[0, 0, -1.0]]), np.array([1.0, 0, -1.5]))
    assert len(two) == 2 and all(np.dot(t, [0, 0, -1.0]) == pytest.approx(-0.5) for t in two)
    assert pharmacophores.donor_directions(np.zeros(3), np.zeros((0, 3))) == []
    assert np.allclose(pharmacophores.mean_direction(np.array([up, -up]), True), up)


def test_clusters():
    line = np.array([[0.0, 0, 0], [1.5, 0, 0], [3.0, 0, 0], [9.0, 0, 0]])
    assert pharmacophores.cluster_once(line).tolist() == [0, 0, 0, 3]
    assert pharmacophores.density_clusters(line).tolist() == [0, 0, 0, -1]
    i, j = np.triu_indices(4, 1)
    d = np.abs(line[i, 0] - line[j, 0])
    assert sorted(map(len, conformers.butina(conformers.adjacency(4, i, j, d, 1.6)))) == [1, 3]
    assert len(conformers.representatives(4, i, j, d, 0.1, 2)) <= 2


def plain_butina(n, near):
    """The rule as a loop: neighbours of the free items are counted again before every choice."""
    free, out = set(range(n)), []
    while free:
        center = max(free, key=lambda i: (len(near[i] & free), i))
        out.append({center} | (near[center] & free))
        free -= out[-1]
    return out


def test_butina_counts_again_after_each_cluster():
    rng = np.random.default_rng(3)
    for _ in range(50):
        p = rng.random((14, 2)) * 3
        i, j = np.triu_indices(14, 1)
        d = np.linalg.norm(p[i] - p[j], axis=1)
        near = [{int(b) for a, b in [*zip(i, j), *zip(j, i)] if a == k and np.linalg.norm(p[a] - p[b]) <= 1.0} for k in range(14)]
        assert [set(c) for c in conformers.butina(conformers.adjacency(14, i, j, d, 1.0))] == plain_butina(14, near)


def test_surface_points(spark):
    centers, radii = np.array([[0.0, 0, 0], [1.5, 0, 0]]), np.array([1.7, 1.5])
    p = surfaces.smooth_surface_points(centers, radii, 50)
    assert p.shape == (50, 3) and np.allclose(p, surfaces.smooth_surface_points(centers, radii, 50))
    few = surfaces.project_smooth(p, centers, radii + 1.2, nearest=2)
    assert np.allclose(few, surfaces.project_smooth(p, centers, radii + 1.2, nearest=8))
    one = {r["idx"]: (r["x"], r["y"], r["z"]) for r in surfaces.smooth_surface(molecule(spark, centers, radii, p[:1]), 50, per_atom=25).collect()}
    assert np.allclose([one[i] for i in range(50)], p)
    order = surfaces.farthest_points(np.array([[0.0, 0, 0], [1.0, 0, 0], [5.0, 0, 0], [5.0, 0, 0]]), 4)
    assert sorted(order.tolist()) == [0, 1, 2, 3] and order[1] == 2
    with pytest.raises(ValueError):
        surfaces.sphere_samples(None, 60)


def test_projection_lands_on_the_soft_level():
    rng = np.random.default_rng(5)
    centers, reach = rng.normal(size=(6, 3)) * 1.5, np.full(6, 2.7)
    p = surfaces.project_smooth(centers[0] + 3.0 * rng.normal(size=(40, 3)), centers, reach, steps=60)
    gap = np.linalg.norm(p[:, None] - centers, axis=2) - reach
    assert np.allclose(np.log(np.exp(-2.0 * gap).sum(axis=1)), 0, atol=1e-6)


def test_farthest_points_of_a_batch():
    rng = np.random.default_rng(6)
    clouds = [rng.normal(size=(n, 3)) for n in (1, 5, 9)]
    padded, real = np.zeros((3, 9, 3)), np.arange(9) < np.array([[1], [5], [9]])
    for k, c in enumerate(clouds):
        padded[k, : len(c)] = c
    for k, (c, got) in enumerate(zip(clouds, surfaces.farthest(padded, real, 6, 2), strict=True)):
        chosen = [2 % len(c)]
        while len(chosen) < min(6, len(c)):
            rest = [i for i in range(len(c)) if i not in chosen]
            chosen.append(max(rest, key=lambda i: (min(((c[i] - c[x]) ** 2).sum() for x in chosen), -i)))
        assert [x for x in got.tolist() if x >= 0] == chosen, k


def molecule(spark, atoms, radii, points):
    rows = [(1, [(i, *map(float, p), 0.0, float(r)) for i, (p, r) in enumerate(zip(atoms, radii, strict=True))], [(i, *map(float, p)) for i, p in enumerate(points)])]
    return spark.createDataFrame(rows, f"mol_id long, atoms array<{POINT}>, surface array<struct<idx:int,x:double,y:double,z:double>>")


def test_surface_summary_by_brute_force(spark):
    rng = np.random.default_rng(8)
    centers, radii = rng.normal(size=(4, 3)) * 2, np.array([1.7, 1.5, 1.2, 1.6])
    points = surfaces.fibonacci_spheres(centers, radii, 1.2, 5)
    points = points + rng.normal(size=points.shape) * 0.05
    got = diagnostics.summarise(molecule(spark, centers, radii, points)).first()
    residual = np.abs(np.linalg.norm(points[:, None] - centers, axis=2) - (radii + 1.2))
    order, r = residual.argsort(axis=1), np.sort(residual, axis=1)
    crimp = (r[:, 0] < 0.10) & (r[:, 1] < 0.35)
    errors = []
    for a in range(4):
        own = points[order[:, 0] == a]
        if len(own) >= 8:
            fit = np.linalg.lstsq(np.column_stack([own * 2, np.ones(len(own))]), (own**2).sum(axis=1), rcond=None)[0]
            errors.append(np.linalg.norm(fit[:3] - centers[a]))
    bend = []
    for p in points:
        near = points[np.argsort(((points - p) ** 2).sum(axis=1))[:12]]
        w = np.linalg.eigvalsh(np.cov(near.T, bias=True))
        bend.append(w[0] / w.sum())
    bend = np.array(bend)
    want = [np.median(r[:, 0]), r[:, 0].mean(), (r[:, 0] < 0.05).mean() * 100, (r[:, 0] < 0.1).mean() * 100, np.median(errors), np.percentile(errors, 90), len(errors), crimp.mean(), bend[crimp].mean(), bend[~crimp].mean()]
    assert [got[c] for c in diagnostics.SUMMARY[1:]] == pytest.approx(want, rel=1e-6)
    sphere = surfaces.fibonacci_spheres(centers[:1], radii[:1], 1.2, 10)
    sharp = diagnostics.summarise(molecule(spark, centers[:1], radii[:1], sphere)).first()
    assert sharp["median_residual"] < 1e-9 and sharp["median_center_error"] < 1e-6 and sharp["curvature_at_crimps"] is None
    few = diagnostics.summarise(molecule(spark, centers[:1], radii[:1], sphere[:2])).first()
    assert few["median_center_error"] is None and few["n_atoms_tested"] == 0


def test_random_sphere_samples_lie_on_their_spheres(spark):
    rows = stand_in(spark, SF).where("mol_id < 3")
    out = surfaces.sphere_samples(rows, 4, random_seed=9).toPandas()
    assert len(out) == surfaces.sphere_samples(rows, 4).count() and out.equals(surfaces.sphere_samples(rows, 4, random_seed=9).toPandas())
    at = {(r["mol_id"], a["idx"]): a for r in rows.collect() for a in r["atoms"]}
    for r in out.itertuples():
        a = at[r.mol_id, r.atom]
        assert np.linalg.norm([r.p[c] - a[c] for c in "xyz"]) == pytest.approx(a["radius"] + 1.2)


def test_volume_samples_fill_their_balls(spark):
    rows = stand_in(spark, SF).where("mol_id < 4")
    out = surfaces.volume_samples(rows, 50, seed=1).toPandas()
    at = {(r["mol_id"], a["idx"]): a for r in rows.collect() for a in r["atoms"]}
    share = [np.linalg.norm([getattr(r, c) - at[r.mol_id, r.atom][c] for c in "xyz"]) / at[r.mol_id, r.atom]["radius"] for r in out.itertuples()]
    assert len(share) == 4 * 7 * 50 and max(share) <= 1 and np.mean(np.array(share) ** 3) == pytest.approx(0.5, abs=0.05)
    some = surfaces.volume_samples(rows, 50, seed=1, total=10).toPandas()
    assert some.groupby("mol_id").size().tolist() == [10] * 4


def test_large_panels_are_joined_and_score_alike(spark, monkeypatch):
    from shapelake.operators import clouds

    rows = stand_in(spark, SF).where("mol_id < 5")
    for score in (scoring.shape, lambda a, b: scoring.shaep(a, b, lam=0.5), scoring.pharm_combo, lambda a, b: scoring.shape_avoiding(a, b, "surface")):
        small = {(r[0], r[1]): r["score"] for r in score(rows, rows).collect()}
        monkeypatch.setattr(clouds, "PANEL_ROWS", 2)
        large = {(r[0], r[1]): r["score"] for r in score(rows, rows).collect()}
        monkeypatch.undo()
        assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k]) for k in small)


def test_points_without_a_position_are_left_out(spark):
    schema = f"mol_id long, atoms array<{POINT}>"
    whole = spark.createDataFrame([(1, [(0, 0.0, 0.0, 0.0, 0.1, 1.5), (1, 1.0, 0.0, 0.0, 0.2, 1.5)])], schema)
    holed = spark.createDataFrame([(2, [(0, 0.0, 0.0, 0.0, 0.1, 1.5), (1, 1.0, 0.0, 0.0, 0.2, 1.5), (2, None, 0.0, 0.0, 0.1, 1.5)]), (3, []), (4, None)], schema)
    got = {r["fit_id"]: r["score"] for r in scoring.shape(whole, holed).collect()}
    assert got[2] == pytest.approx(1.0) and got[3] == 0 and got[4] == 0


def test_posed_screening_shuffles_only_for_the_top_k(spark):
    rows = stand_in(spark, SF)
    plan = screening.screen(rows.where("mol_id < 8"), rows, "vol_and_surf_esp", 10, lam=0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "HashAggregate" not in plan


def test_streamed_screening_equals_batch(spark, tmp_path):
    from shapelake.streaming.arrivals import latest, screen_stream

    library = stand_in(spark, SF).where("mol_id < 40")
    panel = library.where("mol_id < 2")
    for i in range(3):
        library.where(F.pmod("mol_id", F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(library.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = screen_stream(stream, panel, str(tmp_path / "state"), str(tmp_path / "check"), k=5)
    query.awaitTermination()
    got = {(r["query_id"], r["rank"]): r["id"] for r in latest(spark, str(tmp_path / "state"), query).collect()}
    assert got == {(r["query_id"], r["rank"]): r["id"] for r in screening.screen(panel, library, "vol", 5).collect()}
