"""Overlaps: sums over all point pairs of two clouds.

A pair of molecules never leaves its row: the sums are numpy arrays over chunks of bounded size (see ``clouds``), so
nothing is shuffled before a top-k, and a self overlap is found once a molecule. The same terms exist as Columns where
a plan needs them inside an expression (self sums, potentials).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.constants import ANTIPARALLEL, COULOMB_SCALING, DIRECTIONAL, DUMMY, LAM_SCALING, PHARM_ALPHAS, kernel_scale
from shapelake.functions.vectors import square_distance
from shapelake.operators.clouds import Cloud, panel_pairs  # noqa: F401

Fields = dict[str, np.ndarray]
#: (fields of a (K, N), fields of b (K, M)) -> (K, N, M)
Term = Callable[[Fields, Fields], np.ndarray]
TYPE_ALPHA = np.array(PHARM_ALPHAS)
TYPE_SCALE = np.array([kernel_scale(x) for x in PHARM_ALPHAS])
TYPE_DIRECTED = np.isin(np.arange(len(PHARM_ALPHAS)), DIRECTIONAL)


# ---------------------------------------------------------------- terms


def squares(a: Fields, b: Fields, shift: str | None = None) -> np.ndarray:
    """Squared distances; with ``shift``, of the points that directions end at."""
    total = 0.0
    for c in "xyz":
        p, q = (a[c] + a[shift + c], b[c] + b[shift + c]) if shift else (a[c], b[c])
        step = p[:, :, None] - q[:, None, :]
        total = total + step * step
    return total


def gauss(alpha: float) -> Term:
    return lambda a, b: kernel_scale(alpha) * np.exp(-alpha / 2 * squares(a, b))


def esp_gauss(alpha: float, lam: float) -> Term:
    """Damped by the squared difference of charges; ``lam`` as it stands, already scaled where it has to be."""
    return lambda a, b: kernel_scale(alpha) * np.exp(-alpha / 2 * squares(a, b) - (a["q"][:, :, None] - b["q"][:, None, :]) ** 2 / lam)


def free_gauss(a: Fields, b: Fields) -> np.ndarray:
    """Each point with its own width ``w`` and weight ``p``."""
    w, v = a["w"][:, :, None], b["w"][:, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):  # padding has no width
        return a["p"][:, :, None] * b["p"][:, None, :] * (np.pi / (w + v)) ** 1.5 * np.exp(-(w * v / (w + v)) * squares(a, b))


def peak(alpha: float) -> Term:
    """Between 0 and 1, whatever the width's scale."""
    return lambda a, b: np.exp(-alpha / 2 * squares(a, b))


def hard_sphere(reach: float) -> Term:
    return lambda a, b: np.maximum((reach - np.sqrt(squares(a, b))) / reach, 0.0)


def pharm_term(directionless: bool = False, extended: bool = False, only_extended: bool = False) -> Term:
    """Of two features: 0 unless they share a type that counts.

    A cosine c between directions weighs (c + 2) / 3: its size where antiparallel counts, else held to [0, 1], and 0
    for no direction. ``extended`` scores anchors and the points that directional features look at in its place;
    ``only_extended`` the latter alone. Types without a direction are scored by their anchors.
    """

    def term(a: Fields, b: Fields) -> np.ndarray:
        ptype = a["ptype"]
        alpha, scale, directed = (table[ptype][:, :, None] for table in (TYPE_ALPHA, TYPE_SCALE, TYPE_DIRECTED))
        out = scale * np.exp(-alpha / 2 * squares(a, b))
        if extended and not directionless:
            ends = scale * np.exp(-alpha / 2 * squares(a, b, "v"))
            out = np.where(directed, ends if only_extended else out + ends, out)
        elif not directionless:
            dot = sum(a[f"v{c}"][:, :, None] * b[f"v{c}"][:, None, :] for c in "xyz")
            size = np.sqrt(sum(a[f"v{c}"] ** 2 for c in "xyz"))[:, :, None] * np.sqrt(sum(b[f"v{c}"] ** 2 for c in "xyz"))[:, None, :]
            cosine = np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)
            cosine = np.where(np.isin(ptype, ANTIPARALLEL)[:, :, None], np.abs(cosine), np.clip(cosine, 0, 1))
            out = np.where(directed, out * (cosine + 2) / 3, out)
        return np.where((ptype[:, :, None] == b["ptype"][:, None, :]) & (ptype != DUMMY)[:, :, None], out, 0.0)

    return term


# ---------------------------------------------------------------- over a pair's clouds


def both(a: Cloud, b: Cloud) -> np.ndarray:
    return a[0][:, :, None] & b[0][:, None, :]


def total(term: Term, a: Cloud, b: Cloud) -> np.ndarray:
    """(K,) sums of a term over real point pairs; a side of one row meets every row of the other."""
    return np.where(both(a, b), term(a[1], b[1]), 0.0).sum(axis=(1, 2))


def greatest(term: Term, a: Cloud, b: Cloud) -> np.ndarray:
    """(K,) greatest values; NaN where there is no point pair."""
    best = np.where(both(a, b), term(a[1], b[1]), -np.inf).max(axis=(1, 2))
    return np.where(np.isneginf(best), np.nan, best)


def own_total(term: Term, a: Cloud, most: int = 2_000_000) -> np.ndarray:
    """(K,) sums over all ordered pairs of each molecule's own points."""
    step = max(1, most // a[0].shape[1] ** 2)
    parts = [total(term, *[(a[0][at : at + step], {k: v[at : at + step] for k, v in a[1].items()})] * 2) for at in range(0, len(a[0]), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def agreement(points: Cloud, atoms: Cloud, probe: float, lam: float) -> np.ndarray:
    """(K,): over the points outside all of the atoms' spheres, sums of exp(-(own - potential there)^2 / (lam * LAM))."""
    d = np.sqrt(squares(points[1], atoms[1]))
    real = atoms[0][:, None, :]
    outside = np.where(real, d >= atoms[1]["radius"][:, None, :] + probe, True).all(axis=2)
    there = COULOMB_SCALING * np.divide(np.broadcast_to(atoms[1]["q"][:, None, :], d.shape), d, out=np.zeros_like(d), where=real & (d > 0)).sum(axis=2)
    return np.where(points[0] & outside, np.exp(-((points[1]["q"] - there) ** 2) / (lam * LAM_SCALING)), 0.0).sum(axis=1)


# ---------------------------------------------------------------- as Columns


def self_sum(points: str, alpha: float) -> Column:
    """Self overlap of one cloud, within its row: no join and no shuffle."""

    def term(a: Column, b: Column) -> Column:
        return F.coalesce(F.lit(kernel_scale(alpha)) * F.exp(F.lit(-alpha / 2) * square_distance(a, b)), F.lit(0.0))

    return F.aggregate(F.col(points), F.lit(0.0), lambda sum_a, a: sum_a + F.aggregate(F.col(points), F.lit(0.0), lambda sum_b, b: sum_b + term(a, b)))


def potential(p: Column, atoms: str = "atoms") -> Column:
    """C * sum(q / d) at a point from the charges of its own row; 0 for a point that coincides with any atom."""
    at = F.exists(atoms, lambda b: square_distance(p, b) == 0)
    there = F.aggregate(F.col(atoms), F.lit(0.0), lambda s, b: s + F.coalesce(F.try_divide(b["q"], F.sqrt(square_distance(p, b))), F.lit(0.0)))
    return F.when(at, F.lit(0.0)).otherwise(COULOMB_SCALING * there)


def coulomb(profiles: DataFrame, points: str = "surface", atoms: str = "atoms") -> DataFrame:
    """(mol_id, idx, potential) at each point of a molecule, from its own atoms: both clouds are in the row."""
    rows = profiles.select("mol_id", atoms, F.explode(points).alias("p"))
    return rows.select("mol_id", F.col("p.idx").alias("idx"), potential(F.col("p"), atoms).alias("potential"))
