"""Surfaces: sphere samples, masking, smooth projection, even subsampling, volumes, radii."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelake.functions.vectors import fibonacci_point, square_distance, vec
from shapelake.operators.clouds import cloud, xyz


def sphere_samples(profiles: DataFrame, per_atom: int = 20, probe: float = 1.2, atoms: str = "atoms", keep: bool = False, random_seed: int | None = None) -> DataFrame:
    """(mol_id, atom, idx, p): ceil((per_atom * r / 1.7)^2) points on each atom's sphere of radius r + probe.

    The points are even; with ``random_seed`` they are uniform draws, from a hash of molecule, atom and number, the
    same whatever the partitions. ``keep`` leaves the molecule's atoms in the row as ``_atoms``.
    """
    if per_atom > 50:
        raise ValueError("per_atom is squared; do not set it above 50")
    kept = ["_atoms"] if keep else []
    each = profiles.select("mol_id", F.col(atoms).alias("_atoms"), F.explode(atoms).alias("a"))
    n = F.ceil(F.pow(per_atom * (F.col("a.radius") / 1.7), F.lit(2.0)))
    rows = each.withColumn("n", n).select("mol_id", *kept, "a", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("idx"))
    if random_seed is None:
        on = fibonacci_point(F.col("idx").cast("double"), F.col("n").cast("double"))
    else:
        h, turn = (F.pmod(F.xxhash64(F.lit(random_seed), F.lit(k), "mol_id", "a.idx", "idx"), F.lit(1 << 32)) / float(1 << 32) for k in "hz")
        flat = F.sqrt(1 - (2 * h - 1) * (2 * h - 1))
        on = vec(flat * F.cos(2 * np.pi * turn), flat * F.sin(2 * np.pi * turn), 2 * h - 1)
    size = F.col("a.radius") + probe
    return rows.select("mol_id", *kept, F.col("a.idx").alias("atom"), "idx", F.struct(*[(on[c] * size + F.col(f"a.{c}")).alias(c) for c in "xyz"]).alias("p"))


def exposed(profiles: DataFrame, per_atom: int = 20, probe: float = 1.2, atoms: str = "atoms", random_seed: int | None = None) -> DataFrame:
    """The samples outside every sphere of their molecule (with 0.01 of slack).

    A sample's row carries its molecule's atoms, nested, so the test is one expression there: no join, no shuffle.
    """
    rows = sphere_samples(profiles, per_atom, probe, atoms, True, random_seed)
    inside = F.exists("_atoms", lambda b: F.sqrt(square_distance(F.col("p"), b)) < b["radius"] + probe - 0.01)
    return rows.where(~inside).drop("_atoms")


def near_in_row(profiles: DataFrame, a: str, b: str, reach: float) -> DataFrame:
    """(mol_id, i, j, d): points of a molecule's two clouds nearer than ``reach``, tested inside its row."""
    rows = profiles.select("mol_id", F.col(b).alias("_b"), F.explode(a).alias("p"))
    hits = F.filter(F.transform("_b", lambda q: F.struct(q["idx"].alias("j"), F.sqrt(square_distance(F.col("p"), q)).alias("d"))), lambda h: h["d"] < reach)
    return rows.select("mol_id", F.col("p.idx").alias("i"), F.inline(hits))


def near_pairs(a: DataFrame, b: DataFrame, reach: float, key: str = "mol_id") -> DataFrame:
    """Pairs of points (of the same key) nearer than ``reach``: an equi-join on grid cells, then the distance.

    a and b: (key, idx, p). Each b stands in its own cell, each a in the 27 around it.
    """
    def cell(c: str):
        return F.floor(F.col(f"p.{c}") / reach)

    left = a.select(F.col(key), F.col("idx").alias("i"), F.col("p").alias("pa"), *[cell(c).alias(f"c{c}") for c in "xyz"])
    for c in "xyz":
        left = left.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + d for d in (-1, 0, 1)])))
    right = b.select(F.col(key), F.col("idx").alias("j"), F.col("p").alias("pb"), *[cell(c).alias(f"c{c}") for c in "xyz"])
    pairs = left.join(right, [key, "cx", "cy", "cz"])
    return pairs.withColumn("d", F.sqrt(square_distance(F.col("pa"), F.col("pb")))).where(F.col("d") < reach).select(key, "i", "j", "d")


def vdw_radii(atoms: DataFrame, radii: DataFrame, number: str = "z_number") -> DataFrame:
    """Radii from an element table (z_number, radius), which has at most 118 rows."""
    return atoms.join(F.broadcast(radii.limit(128)), number, "left")


def esp_colours(profiles: DataFrame, points: str = "surface", value: str = "q") -> DataFrame:
    """(mol_id, the point's fields, red, blue): red for the negative, blue for the positive, each as strong as its share
    of the molecule's own extreme, which is found in the row."""
    low, high = F.array_min(F.col(points)[value]), F.array_max(F.col(points)[value])
    rows = profiles.select("mol_id", low.alias("_low"), high.alias("_high"), F.explode(points).alias("p")).select("mol_id", "_low", "_high", "p.*")
    red = F.when(F.col(value) < 0, F.try_divide(F.col(value), F.col("_low"))).otherwise(F.lit(0.0))
    blue = F.when(F.col(value) > 0, F.try_divide(F.col(value), F.col("_high"))).otherwise(F.lit(0.0))
    return rows.withColumn("red", red).withColumn("blue", blue).drop("_low", "_high")


# ---------------------------------------------------------------- numpy, over the molecules of a batch at once


def on_spheres(centers: np.ndarray, radii: np.ndarray, real: np.ndarray, probe: float, per_atom: int) -> tuple[np.ndarray, np.ndarray]:
    """(molecule of each point, points): even samples of all atoms (B, A) of a batch, molecule by molecule."""
    mol, atom = np.nonzero(real)
    r = radii[mol, atom]
    n = np.ceil((per_atom * r / 1.7) ** 2).astype(np.int64)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    height = (2 * i + 1) / np.repeat(n, n) - 1
    turn = np.mod(i + 1, np.repeat(n, n)) * (np.pi * (3 - np.sqrt(5)))
    flat = np.sqrt(np.maximum(0, 1 - height * height))
    way = np.column_stack([np.cos(turn) * flat, height, np.sin(turn) * flat])
    return np.repeat(mol, n), way * np.repeat(r + probe, n)[:, None] + np.repeat(centers[mol, atom], n, axis=0)


def project_smooth(points: np.ndarray, centers: np.ndarray, reach: np.ndarray, real: np.ndarray | None = None, sharpness: float = 2.0, steps: int = 6, nearest: int = 8) -> np.ndarray:
    """Points moved onto the zero level of f(x) = -ln(sum_i exp(-s g_i(x))) / s, with g_i the signed distance to sphere i.

    The gradient of f is the mean of the unit vectors away from the centers, weighted by exp(s (f - g_i)), which sum
    to one; a Newton step follows it by f over its squared length. ``centers`` (A, 3) serve all points, or (P, A, 3)
    each its own, with ``real`` marking those that exist; the ``nearest`` at the start count throughout.
    """
    x = np.array(points, dtype=float)
    if len(x) == 0:
        return x
    centers, reach = np.broadcast_to(centers, (len(x), *centers.shape[-2:])), np.broadcast_to(reach, (len(x), reach.shape[-1]))
    away = ((x[:, None] - centers) ** 2).sum(axis=2)
    if real is not None:
        away = np.where(real, away, np.inf)
    if away.shape[1] > nearest:
        own = np.argpartition(away, nearest - 1, axis=1)[:, :nearest]
        centers, reach, away = np.take_along_axis(centers, own[..., None], axis=1), np.take_along_axis(reach, own, axis=1), np.take_along_axis(away, own, axis=1)
    penalty = np.where(np.isinf(away), np.inf, 0.0)  # spheres that do not exist are infinitely far
    for _ in range(steps):
        out = x[:, None] - centers
        length = np.sqrt((out * out).sum(axis=2))
        gap = length - reach + penalty
        level = -np.logaddexp.reduce(-sharpness * gap, axis=1) / sharpness
        share = np.exp(sharpness * (level[:, None] - gap))
        slope = (np.divide(share, length, out=np.zeros_like(share), where=length > 0)[..., None] * out).sum(axis=1)
        size = (slope * slope).sum(axis=1)
        x -= np.divide(level, size, out=np.zeros_like(level), where=size > 0)[:, None] * slope
    return x


def farthest(points: np.ndarray, real: np.ndarray, n: int | None = None, start: int = 0) -> np.ndarray:
    """(B, n) places in clouds (B, P, 3), each the farthest from those before it; -1 where a cloud has no more."""
    count = real.sum(axis=1)
    n = int(count.max(initial=0)) if n is None else min(n, int(count.max(initial=0)))
    out, row = np.full((len(points), n), -1, dtype=np.int64), np.arange(len(points))
    away = np.where(real, np.inf, -1.0)
    last = start % np.maximum(count, 1)
    for step in range(n):
        alive = step < count
        out[:, step] = np.where(alive, last, -1)
        away = np.minimum(away, ((points - points[row, last][:, None]) ** 2).sum(axis=2))
        away[row, last] = -1.0
        last = away.argmax(axis=1)
    return out


def farthest_points(points: np.ndarray, n: int | None, start: int = 0) -> np.ndarray:
    """Places of min(n, all) points of one cloud; no point twice."""
    if len(points) == 0 or n == 0:
        return np.zeros(0, dtype=np.int64)
    return farthest(points[None], np.ones((1, len(points)), dtype=bool), n, start)[0]


def fibonacci_spheres(centers: np.ndarray, radii: np.ndarray, probe: float, per_atom: int) -> np.ndarray:
    return on_spheres(centers[None], radii[None], np.ones((1, len(radii)), dtype=bool), probe, per_atom)[1]


def smooth_batch(centers: np.ndarray, radii: np.ndarray, real: np.ndarray, n: int | None, probe: float, per_atom: int, sharpness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(molecule, rank, point) of the smooth surfaces of a batch: even samples, masked, projected, evenly thinned."""
    mol, p = on_spheres(centers, radii, real, probe, per_atom)
    reach, there = (radii + probe)[mol], real[mol]
    out = np.where(there, np.sqrt(((p[:, None] - centers[mol]) ** 2).sum(axis=2)) >= reach - 0.01, True).all(axis=1)
    mol, p = mol[out], project_smooth(p[out], centers[mol[out]], reach[out], there[out], sharpness)
    count = np.bincount(mol, minlength=len(centers))
    padded, place = np.zeros((len(centers), max(int(count.max(initial=0)), 1), 3)), np.arange(len(mol)) - np.repeat(np.cumsum(count) - count, count)
    padded[mol, place] = p
    order = farthest(padded, np.arange(padded.shape[1]) < count[:, None], n)
    m, rank = np.nonzero(order >= 0)
    return m, rank, padded[m, order[m, rank]]


def smooth_surface_points(centers: np.ndarray, radii: np.ndarray, n: int | None = 100, probe: float = 1.2, per_atom: int = 25, sharpness: float = 2.0) -> np.ndarray:
    """Mesh-free surface of one molecule."""
    return smooth_batch(centers[None], radii[None], np.ones((1, len(radii)), dtype=bool), n, probe, per_atom, sharpness)[2]


def _slices(mask: np.ndarray, numbers: int, most: int = 4_000_000) -> list[slice]:
    """Rows of a batch in slices whose arrays hold at most ``most`` numbers; a row makes about ``numbers`` of them."""
    step = max(1, most // max(numbers, 1))
    return [slice(at, at + step) for at in range(0, len(mask), step)]


def smooth_slices(column: pa.Array, n: int | None, probe: float, per_atom: int, sharpness: float):
    """Slices of a column of nested atoms, each with the (row in the slice, rank, place) of its smooth surfaces' points."""
    atoms = cloud(column, ["x", "y", "z", "radius"])
    centers, radii = xyz(atoms), atoms[1]["radius"]
    per_row = int((np.ceil((per_atom * radii / 1.7) ** 2) * atoms[0]).sum(axis=1).max(initial=1)) * radii.shape[1] * 4
    for rows in _slices(radii, per_row):
        yield rows, *smooth_batch(centers[rows], radii[rows], atoms[0][rows], n, probe, per_atom, sharpness)


def smooth_surface(profiles: DataFrame, n: int = 100, probe: float = 1.2, per_atom: int = 10, sharpness: float = 2.0) -> DataFrame:
    """(mol_id, idx, x, y, z) of each molecule's smooth surface. A molecule is one row: no shuffle."""

    def run(batches):
        for batch in batches:
            mols = batch.column("mol_id").to_numpy(zero_copy_only=False)
            for rows, m, rank, p in smooth_slices(batch.column("atoms"), n, probe, per_atom, sharpness):
                yield pa.RecordBatch.from_arrays([pa.array(mols[rows][m]), pa.array(rank.astype(np.int32)), *(pa.array(p[:, i].copy()) for i in range(3))], names=["mol_id", "idx", "x", "y", "z"])

    return profiles.select(F.col("mol_id").cast("long").alias("mol_id"), "atoms").mapInArrow(run, "mol_id long, idx int, x double, y double, z double")


def subsample(profiles: DataFrame, points: str, n: int, start: int = 0) -> DataFrame:
    """(mol_id, rank, idx): farthest-point order of the first n points of a nested cloud."""

    def run(batches):
        for batch in batches:
            mask, fields = cloud(batch.column(points), ["x", "y", "z", "idx"])
            mols, idx = batch.column("mol_id").to_numpy(zero_copy_only=False), fields["idx"].astype(np.int32)
            for rows in _slices(mask, 4 * mask.shape[1]):
                order = farthest(xyz((mask[rows], {k: v[rows] for k, v in fields.items()})), mask[rows], n, start)
                m, rank = np.nonzero(order >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(mols[rows][m]), pa.array(rank.astype(np.int32)), pa.array(idx[rows][m, order[m, rank]])], names=["mol_id", "rank", "idx"])

    return profiles.select(F.col("mol_id").cast("long").alias("mol_id"), points).mapInArrow(run, "mol_id long, rank int, idx int")


def volume_samples(profiles: DataFrame, per_atom: int = 15, seed: int = 0, total: int | None = None) -> DataFrame:
    """(mol_id, atom, idx, x, y, z): points spread evenly through each atom's ball.

    Draws come from a hash of seed, molecule, atom and number, so they are the same whatever the partitions. With
    ``total`` only so many of a molecule's points stay, the first by another such hash.
    """

    def draw(name: str):
        return F.pmod(F.xxhash64(F.lit(f"{name}{seed}"), "mol_id", "a.idx", "idx"), F.lit(1 << 32)) / float(1 << 32)

    each = profiles.select("mol_id", F.explode("atoms").alias("a")).select("mol_id", "a", F.explode(F.sequence(F.lit(0), F.lit(per_atom - 1))).alias("idx"))
    height = 2 * draw("h") - 1
    flat, turn, size = F.sqrt(1 - height * height), 2 * np.pi * draw("t"), F.col("a.radius") * F.pow(draw("r"), F.lit(1 / 3))
    rows = each.select("mol_id", F.col("a.idx").cast("int").alias("atom"), "idx", *[(F.col(f"a.{c}") + size * w).alias(c) for c, w in zip("xyz", (flat * F.cos(turn), flat * F.sin(turn), height), strict=True)], draw("o").alias("_order"))
    if total is not None:
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("mol_id").orderBy("_order", "atom", "idx"))).where(F.col("_place") <= total).drop("_place")
    return rows.drop("_order")
