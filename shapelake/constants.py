"""Values that define results. They must equal the published ones for scores to agree."""

from __future__ import annotations

import math

#: eV * A / e^2
COULOMB_SCALING = 1e4 / (4 * 55.263 * math.pi)
LAM_SCALING = COULOMB_SCALING**2
#: A pharmacophore's code is its place here; Dummy is padding and is never scored.
PHARM_TYPES = ("Acceptor", "Donor", "Aromatic", "Hydrophobe", "Halogen", "Cation", "Anion", "ZnBinder", "Dummy")
DUMMY = 8
PHARM_ALPHAS = (1.0, 1.0, 0.7, 0.7, 1.0, 1.0, 1.0, 1.0, 1.0)
#: Types whose direction counts: acceptor, donor, aromatic, halogen. An aromatic plane has no front.
DIRECTIONAL = (0, 1, 2, 4)
ANTIPARALLEL = (2,)
#: Width of a surface point's Gaussian by the number of points.
ALPHA_NODES = ((50, 0.6011), (100, 0.8668), (150, 1.022), (200, 1.118), (300, 1.216), (400, 1.258))
#: Substrings of SMILES that mark an unlikely charge.
BAD_CHARGES = ("[C-]", "[CH-]", "[CH2-]", "[C+]", "[CH+]", "[CH2+]", "[NH-]", "[c-]", "[cH-]", "[o+]", "[OH+]")
SHAPE_ALPHA = 0.81
TVERSKY_SIGMA = {"tversky": 0.95, "tversky_ref": 1.0, "tversky_fit": 0.05}


def kernel_scale(alpha: float) -> float:
    """Integral of the product of two equal unit Gaussians at distance 0."""
    return (math.pi / (2 * alpha)) ** 1.5


def surface_alpha(n_points: int) -> float:
    """Gaussian width for a surface of n points: the quadratic interpolating spline through ``ALPHA_NODES``."""
    xs, ys = [float(x) for x, _ in ALPHA_NODES], [y for _, y in ALPHA_NODES]
    if not xs[0] <= n_points <= xs[-1]:
        raise ValueError(f"surfaces have {xs[0]:.0f} to {xs[-1]:.0f} points, not {n_points}")
    inner = [(a + b) / 2 for a, b in zip(xs[1:-2], xs[2:-1], strict=True)]
    knots = [xs[0]] * 3 + inner + [xs[-1]] * 3

    def basis(i: int, degree: int, x: float) -> float:
        if degree == 0:
            last = knots[i + 1] == knots[-1] and knots[i] < knots[i + 1]
            return float(knots[i] <= x < knots[i + 1] or (last and x == knots[-1]))
        out = 0.0
        if knots[i + degree] > knots[i]:
            out += (x - knots[i]) / (knots[i + degree] - knots[i]) * basis(i, degree - 1, x)
        if knots[i + degree + 1] > knots[i + 1]:
            out += (knots[i + degree + 1] - x) / (knots[i + degree + 1] - knots[i + 1]) * basis(i + 1, degree - 1, x)
        return out

    import numpy as np

    n = len(xs)
    weights = np.linalg.solve(np.array([[basis(i, 2, x) for i in range(n)] for x in xs]), np.array(ys))
    return float(sum(w * basis(i, 2, float(n_points)) for i, w in enumerate(weights)))
