"""Scores of posed pairs. Input: profile rows; output: (ref_id, fit_id, score) and what it is made of.

Overlaps are summed inside a pair's row; the quotients are Columns. No plan here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.constants import SHAPE_ALPHA
from shapelake.functions.similarity import similarity, tanimoto
from shapelake.functions.vectors import square_distance
from shapelake.operators import overlap as O
from shapelake.operators.clouds import over_panel, over_pairs, panel_pairs

KEYS = ["ref_id", "fit_id"]
XYZ = ["x", "y", "z"]
DIRECTED = ["ptype", *XYZ, "vx", "vy", "vz"]


def ratio_parts(points: str, term: O.Term):
    """Kernel and own sums of one term, for ``over_panel`` and ``over_pairs``."""
    return (lambda a, b: {"ab": O.total(term, a[points], b[points])}), (lambda a: {"own": O.own_total(term, a[points])})


def _ratio(panel: DataFrame, library: DataFrame, points: str, fields: list[str], term: O.Term, name: str = "tanimoto") -> DataFrame:
    """Cross overlap of each pair against both self overlaps."""
    sums = over_panel(panel, library, {points: fields}, *ratio_parts(points, term), ["ab", "ref_own", "fit_own"])
    return sums.select(*KEYS, "ab", F.col("ref_own").alias("aa"), F.col("fit_own").alias("bb"), similarity(name, F.col("ab"), F.col("ref_own"), F.col("fit_own")).alias("score"))


def shape(panel: DataFrame, library: DataFrame, points: str = "atoms", alpha: float = SHAPE_ALPHA, name: str = "tanimoto") -> DataFrame:
    return _ratio(panel, library, points, XYZ, O.gauss(alpha), name)


def shape_of_pairs(pairs: DataFrame, points: str = "atoms", alpha: float = SHAPE_ALPHA, name: str = "tanimoto", keep: str = "") -> DataFrame:
    """The same for rows that hold both molecules."""
    sums = over_pairs(pairs, {points: XYZ}, *ratio_parts(points, O.gauss(alpha)), ["ab", "ref_own", "fit_own"], keep)
    return sums.withColumn("score", similarity(name, F.col("ab"), F.col("ref_own"), F.col("fit_own")))


def shape_free(panel: DataFrame, library: DataFrame, points: str = "atoms", name: str = "tanimoto") -> DataFrame:
    """Points with their own widths w and weights p."""
    return _ratio(panel, library, points, [*XYZ, "w", "p"], O.free_gauss, name)


def esp(panel: DataFrame, library: DataFrame, lam: float, points: str = "atoms", alpha: float = SHAPE_ALPHA, name: str = "tanimoto") -> DataFrame:
    """``lam`` as it stands."""
    return _ratio(panel, library, points, [*XYZ, "q"], O.esp_gauss(alpha, lam), name)


def pharm(panel: DataFrame, library: DataFrame, name: str = "tanimoto", **kind: bool) -> DataFrame:
    return _ratio(panel, library, "pharm", DIRECTED, O.pharm_term(**kind), name)


def pharm_combo(panel: DataFrame, library: DataFrame, weight: float = 0.5, name: str = "tanimoto", alpha: float = SHAPE_ALPHA, **kind: bool) -> DataFrame:
    """(1 - weight) * shape + weight * pharmacophore similarity, both from one pass over the pairs."""
    volume, features = O.gauss(alpha), O.pharm_term(**kind)
    sums = over_panel(
        panel, library, {"atoms": XYZ, "pharm": DIRECTED},
        lambda a, b: {"s": O.total(volume, a["atoms"], b["atoms"]), "p": O.total(features, a["pharm"], b["pharm"])},
        lambda a: {"s": O.own_total(volume, a["atoms"]), "p": O.own_total(features, a["pharm"])},
        ["s", "ref_s", "fit_s", "p", "ref_p", "fit_p"],
    )
    parts = {n: similarity(name, *(F.col(c) for c in (k, f"ref_{k}", f"fit_{k}"))).alias(n) for n, k in (("shape", "s"), ("pharm", "p"))}
    return sums.select(*KEYS, *parts.values()).withColumn("score", (1 - weight) * F.col("shape") + weight * F.col("pharm"))


def max_overlap(panel: DataFrame, library: DataFrame, points: str = "atoms", alpha: float = SHAPE_ALPHA) -> DataFrame:
    """Greatest overlap of any two points, between 0 and 1."""
    return over_panel(panel, library, {points: XYZ}, lambda a, b: {"score": O.greatest(O.peak(alpha), a[points], b[points])}, lambda a: {}, ["score"])


def clash(panel: DataFrame, library: DataFrame, reach: float, points: str = "atoms") -> DataFrame:
    """Sum over point pairs nearer than ``reach`` of how far they go in, linearly."""
    return over_panel(panel, library, {points: XYZ}, lambda a, b: {"clash": O.total(O.hard_sphere(reach), a[points], b[points])}, lambda a: {}, ["clash"])


def shape_avoiding(panel: DataFrame, library: DataFrame, avoid: str, reach: float = 2.0, weight: float = 1.0, alpha: float = SHAPE_ALPHA) -> DataFrame:
    """Shape similarity less ``weight`` times the clash of the fit's atoms with the reference's ``avoid`` points."""
    kernel, own = ratio_parts("atoms", O.gauss(alpha))
    sums = over_panel(panel, library, {"atoms": XYZ, avoid: XYZ}, lambda a, b: {**kernel(a, b), "clash": O.total(O.hard_sphere(reach), a[avoid], b["atoms"])}, own, ["ab", "ref_own", "fit_own", "clash"])
    return sums.select(*KEYS, "clash", (tanimoto(F.col("ab"), F.col("ref_own"), F.col("fit_own")) - weight * F.col("clash")).alias("score"))


ESP_FIELDS = {"surface": [*XYZ, "q"], "atoms": [*XYZ, "q", "radius"]}


def esp_agreement(panel: DataFrame, library: DataFrame, probe: float = 1.0, lam: float = 0.001) -> DataFrame:
    """How the potentials agree on each other's surface: (ref_id, fit_id, e_ref, e_fit), sums over points."""
    return over_panel(panel, library, ESP_FIELDS, lambda a, b: {"e_ref": O.agreement(a["surface"], b["atoms"], probe, lam), "e_fit": O.agreement(b["surface"], a["atoms"], probe, lam)}, lambda a: {}, ["e_ref", "e_fit"])


def shaep(panel: DataFrame, library: DataFrame, weight: float = 0.5, probe: float = 1.0, lam: float = 0.001, alpha: float = SHAPE_ALPHA, points: str = "atoms") -> DataFrame:
    """weight * share of surface points whose potentials agree, both ways, + (1 - weight) * shape similarity: one pass."""
    volume = O.gauss(alpha)
    sums = over_panel(
        panel, library, ESP_FIELDS,
        lambda a, b: {"ab": O.total(volume, a[points], b[points]), "e_ref": O.agreement(a["surface"], b["atoms"], probe, lam), "e_fit": O.agreement(b["surface"], a["atoms"], probe, lam)},
        lambda a: {"own": O.own_total(volume, a[points]), "n": a["surface"][0].sum(axis=1).astype(float)},
        ["ab", "ref_own", "fit_own", "e_ref", "e_fit", "ref_n", "fit_n"],
    )
    esp_part = F.try_divide(F.col("e_ref") + F.col("e_fit"), F.col("ref_n") + F.col("fit_n"))
    out = sums.withColumn("shape", tanimoto(F.col("ab"), F.col("ref_own"), F.col("fit_own")))
    return out.select(*KEYS, "e_ref", "e_fit", "shape", (weight * esp_part + (1 - weight) * F.col("shape")).alias("score"))


def pair_distances(panel: DataFrame, library: DataFrame, points: str = "atoms") -> DataFrame:
    """Every point pair's squared distance: (ref_id, fit_id, i, j, d2). The output is all point pairs by definition."""
    pairs = panel_pairs(panel, library, [points])
    half = pairs.select(*KEYS, F.explode(f"ref_{points}").alias("a"), F.col(f"fit_{points}").alias("_fit"))
    each = half.select(*KEYS, "a", F.explode("_fit").alias("b"))
    return each.select(*KEYS, F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), square_distance(F.col("a"), F.col("b")).alias("d2"))


def combined(parts: list[tuple[Column, Column, Column]], name: str = "tanimoto") -> Column:
    """One similarity over several channels' overlaps (ab, aa, bb), added before the quotient."""
    ab, aa, bb = (sum((p[i] for p in parts[1:]), parts[0][i]) for i in range(3))
    return tanimoto(ab, aa, bb) if name == "tanimoto" else similarity(name, ab, aa, bb)
