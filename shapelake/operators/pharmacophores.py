"""Pharmacophore features once their atoms are known: labels, access, directions, clusters.

Finding the atoms needs a chemistry toolkit (see ``external``); all that follows from coordinates is here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.functions import vectors as V
from shapelake.functions.vectors import fibonacci_point, square_distance

RING_TYPES = (2, 3)  # aromatic, hydrophobe


def priority_labels(features: DataFrame, rings: DataFrame, priority: DataFrame, min_ring_atoms: int = 3) -> DataFrame:
    """Label 1 for features that touch priority atoms; ring types need ``min_ring_atoms`` of them in one touched ring.

    features (mol_id, idx, ptype, atom_ids), rings (mol_id, ring_id, heavy_ids), priority (mol_id, atom_ids).
    """
    listed = rings.groupBy("mol_id").agg(F.collect_list("heavy_ids").alias("_rings"))  # a molecule's rings, few by nature
    rows = features.join(priority.select("mol_id", F.col("atom_ids").alias("_priority")), "mol_id", "left").join(listed, "mol_id", "left")
    hits = F.transform(
        F.filter(F.coalesce("_rings", F.array().cast("array<array<int>>")), lambda ring: F.arrays_overlap(ring, F.col("atom_ids"))), lambda ring: F.size(F.array_intersect(ring, F.col("_priority")))
    )
    most = F.coalesce(F.array_max(hits), F.lit(0))
    touches = F.coalesce(F.arrays_overlap("atom_ids", "_priority"), F.lit(False))
    ringed = F.col("ptype").isin(*RING_TYPES)
    return rows.select("mol_id", "idx", "ptype", F.when(touches & (~ringed | (most >= min_ring_atoms)), 1).otherwise(0).alias("label"))


def split_by_priority(pharm: DataFrame, labels: DataFrame) -> DataFrame:
    """Exploded features with their label, for scores over priority and other features apart."""
    return pharm.join(labels.select("mol_id", "idx", "label"), ["mol_id", "idx"])


def accessible(features: DataFrame, samples: int = 200, reach: float = 1.8, slack: float = 0.8, least: int = 4) -> DataFrame:
    """Whether more than ``least`` of the points around a feature lie outside all other atoms' widened spheres.

    features (mol_id, idx, p, atom_ids, atoms): a feature's row holds its molecule's atoms, so the points are
    generated, tested and counted there. No join.
    """
    around = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: fibonacci_point(i.cast("double"), F.lit(float(samples))))
    rows = features.withColumn("_others", F.filter("atoms", lambda a: ~F.array_contains(F.col("atom_ids"), a["idx"])))

    def free(u):
        at = F.struct(*[(F.col(f"p.{c}") + reach * u[c]).alias(c) for c in "xyz"])
        return ~F.exists("_others", lambda a: F.sqrt(square_distance(at, a)) < a["radius"] + slack)

    return rows.select("mol_id", "idx", (F.size(F.filter(around, free)) > least).alias("accessible"))


def mean_direction(vectors: np.ndarray, antiparallel: bool = False) -> np.ndarray:
    """Normalised mean of unit vectors; flipped into the first one's half space where either way counts."""
    v = np.asarray(vectors, dtype=float)
    if antiparallel:
        side = np.sign(v @ v[0])
        v = v * np.where(side == 0, 1, side)[:, None]
    mean = v.mean(axis=0)
    length = np.linalg.norm(mean)
    return mean / length if length else mean


def _turned(v: np.ndarray, axis: np.ndarray, degrees: float) -> np.ndarray:
    """v turned about an axis (right-handed)."""
    k, a = axis / np.linalg.norm(axis), np.radians(degrees)
    return v * np.cos(a) + np.cross(k, v) * np.sin(a) + k * (k @ v) * (1 - np.cos(a))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v)


def aromatic_directions(center: np.ndarray, atoms: np.ndarray, both: bool = True) -> list[np.ndarray]:
    normal = _unit(np.cross(atoms[0] - center, atoms[1] - center))
    return [normal, -normal] if both else [normal]


def donor_directions(at: np.ndarray, hydrogens: np.ndarray, multi: bool = True) -> list[np.ndarray]:
    """One direction per hydrogen, or their mean; none without hydrogens."""
    ways = [_unit(h - at) for h in hydrogens]
    return ways if multi or not ways else [mean_direction(np.array(ways))]


def acceptor_directions(element: str, at: np.ndarray, neighbours: np.ndarray, beyond: np.ndarray | None = None, hydrogens: int = 0) -> list[np.ndarray]:
    """Lone-pair directions by element and number of neighbours; an empty list drops the feature.

    ``beyond`` is an atom bonded to the only neighbour; it fixes the plane of a carbonyl's two pairs.
    """
    ways = [_unit(n - at) for n in neighbours]
    if element == "N":
        if len(ways) in (1, 2):
            return [-mean_direction(np.array(ways))]
        if len(ways) == 3:
            out = -np.mean(ways, axis=0)
            return [_unit(out)] if np.linalg.norm(out) > 0.1 else []
        return []
    if element == "O":
        if len(ways) == 1:
            if beyond is None:
                return [-ways[0]]
            plane = np.cross(ways[0], beyond - neighbours[0])
            if np.linalg.norm(plane) < 1e-9:
                return [-ways[0]]
            return [_turned(ways[0], plane, d) for d in (120, -120)]
        if len(ways) == 2:
            out = -mean_direction(np.array(ways))
            return [_turned(out, ways[0] - ways[1], d) for d in (54.5, -54.5)]
        return []
    return [-ways[0]] if ways and not hydrogens else []


def halogen_directions(at: np.ndarray, neighbour: np.ndarray) -> list[np.ndarray]:
    return [_unit(at - neighbour)]


def _turned_by(v: Column, k: Column, degrees: float) -> Column:
    """v turned about the unit vector k (right-handed)."""
    a = float(np.radians(degrees))
    side = V.cross(k, v)
    return V.vec(*(v[c] * np.cos(a) + side[c] * np.sin(a) + k[c] * V.dot(k, v) * (1 - np.cos(a)) for c in "xyz"))


def _less(a: Column, b: Column) -> Column:
    return V.vec(*(a[c] - b[c] for c in "xyz"))


def directions(features: DataFrame) -> DataFrame:
    """(mol_id, idx, kind, ways): the directions of each feature, by the rules of the functions above, as Columns.

    features (mol_id, idx, kind, element, at, near, beyond, hydrogens): ``near`` holds the ring's atoms of an aromatic, the
    hydrogens of a donor, the neighbours of an acceptor or halogen; ``beyond`` is NULL or an atom past the only
    neighbour. No ways: the feature is dropped by its reader. Other kinds have none.
    """
    c, n, minus = F.col, F.size("near"), F.lit(-1.0)
    none = F.array().cast("array<struct<x:double,y:double,z:double>>")
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    # step by step: each column is read often by the next ones, and one expression of all would grow with every reading
    rows = features.withColumn("_ways", F.transform("near", lambda p: V.unit(_less(p, c("at")))))
    rows = rows.withColumns({"_way": F.get("_ways", F.lit(0)), "_next": F.get("_ways", F.lit(1)), "_normal": V.cross(_less(first, c("at")), _less(second, c("at"))), "_sum": V.vec(*(F.aggregate(c("_ways")[x], F.lit(0.0), lambda s, v: s + v) for x in "xyz"))})
    rows = rows.withColumns({"_plane": V.cross(c("_way"), _less(c("beyond"), first)), "_between": _less(c("_way"), c("_next")), "_away": V.scaled(c("_way"), minus), "_length": V.norm(c("_sum")), "_normal": V.unit(c("_normal"))})
    opposite = V.vec(*(-F.coalesce(F.try_divide(c("_sum")[x], c("_length")), F.lit(0.0)) for x in "xyz"))
    rows = rows.withColumns({"_opposite": opposite, "_flat": F.coalesce(V.norm(c("_plane")), F.lit(0.0)) < 1e-9, "_plane": V.unit(c("_plane")), "_between": V.unit(c("_between"))})
    away, opposite = c("_away"), c("_opposite")
    nitrogen = F.when(n.isin(1, 2) | ((n == 3) & (c("_length") / 3 > 0.1)), F.array(opposite)).otherwise(none)
    oxygen = (
        F.when((n == 1) & c("_flat"), F.array(away))
        .when(n == 1, F.array(*(_turned_by(c("_way"), c("_plane"), d) for d in (120, -120))))
        .when(n == 2, F.array(*(_turned_by(opposite, c("_between"), d) for d in (54.5, -54.5))))
        .otherwise(none)
    )
    other = F.when((n > 0) & (F.coalesce("hydrogens", F.lit(0)) == 0), F.array(away)).otherwise(none)
    acceptor = F.when(F.col("element") == "N", nitrogen).when(F.col("element") == "O", oxygen).otherwise(other)
    found = (
        F.when((F.col("kind") == "aromatic") & (n > 1), F.array(c("_normal"), V.scaled(c("_normal"), minus)))
        .when(F.col("kind") == "donor", c("_ways"))
        .when(F.col("kind") == "acceptor", acceptor)
        .when((F.col("kind") == "halogen") & (n > 0), F.array(away))
        .otherwise(none)
    )
    return rows.select("mol_id", "idx", "kind", found.alias("ways"))


def hydrophobes(rows: DataFrame, points: str = "points", reach: float = 2.0) -> DataFrame:
    """(mol_id, cluster, size, x, y, z): a molecule's points merged by ``cluster_once``, each cluster at its centroid.

    In that pass a point ends with the label that its last near predecessor has, so one fold over the row's array does.
    """

    def label(done: Column, j: Column) -> Column:
        near = F.filter(F.sequence(F.lit(0), j), lambda i: (i < j) & (F.sqrt(square_distance(F.get(points, i), F.get(points, j))) <= reach))
        return F.array_append(done, F.coalesce(F.get(done, F.array_max(near)), j))

    numbers = F.filter(F.sequence(F.lit(0), F.size(points)), lambda j: j < F.size(points))
    labelled = rows.where(F.size(points) > 0).select("mol_id", points, F.aggregate(numbers, F.array().cast("array<int>"), label).alias("_labels"))
    each = labelled.select("mol_id", F.inline(F.transform(points, lambda p, i: F.struct(F.get("_labels", i).alias("cluster"), *[p[c].alias(c) for c in "xyz"]))))
    return each.groupBy("mol_id", "cluster").agg(F.count("*").cast("int").alias("size"), *[F.avg(c).alias(c) for c in "xyz"])


def cluster_once(points: np.ndarray, reach: float = 2.0) -> np.ndarray:
    """Labels of a single forward pass: every later point within reach takes the present point's label.

    The order of points matters and the result is no transitive closure; that is the rule.
    """
    labels = np.arange(len(points))
    for i in range(len(points)):
        near = np.linalg.norm(points[i + 1 :] - points[i], axis=1) <= reach
        labels[i + 1 :][near] = labels[i]
    return labels


def density_clusters(points: np.ndarray, reach: float = 2.0, least: int = 2) -> np.ndarray:
    """Density-based clusters (-1 for noise). Cores have ``least`` points within reach, themselves among them."""
    near = np.linalg.norm(points[:, None] - points[None], axis=2) <= reach
    core, labels, mark = near.sum(axis=1) >= least, np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        open_points = [i]
        labels[i] = mark
        while open_points:
            j = open_points.pop()
            for k in np.flatnonzero(near[j] & (labels < 0)):
                labels[k] = mark
                if core[k]:
                    open_points.append(k)
        mark += 1
    return labels


CLUSTERED = "mol_id long, ptype int, cluster int, size int, x double, y double, z double, vx double, vy double, vz double"


def cluster_features(pharm: DataFrame, reach: float = 2.0, least: int = 2, keep_single: bool = False) -> DataFrame:
    """Features of one type merged across fragments: centroid, mean direction (either way for aromatics), zero for hydrophobes.

    Input is nested (mol_id, pharm); a molecule's features are one row, so groups stay small by nature.
    """

    def run(frames):
        names = [c.split()[0] for c in CLUSTERED.split(", ")]
        for frame in frames:
            rows = []
            for mol, features in zip(frame["mol_id"], frame["pharm"], strict=True):
                table = pd.DataFrame(list(features))
                for ptype, own in table.groupby("ptype") if len(table) else []:
                    own = own.sort_values("idx")
                    p, v = own[["x", "y", "z"]].to_numpy(float), own[["vx", "vy", "vz"]].to_numpy(float)
                    labels = density_clusters(p, reach, least)
                    groups = [np.flatnonzero(labels == c) for c in range(labels.max() + 1)] + ([np.array([i]) for i in np.flatnonzero(labels < 0)] if keep_single else [])
                    for n, at in enumerate(groups):
                        way = np.zeros(3) if ptype == 3 else mean_direction(v[at], ptype == 2)
                        rows.append((mol, ptype, n, len(at), *p[at].mean(axis=0), *way))
            yield pd.DataFrame(rows, columns=names)

    return pharm.select("mol_id", "pharm").mapInPandas(run, CLUSTERED)
