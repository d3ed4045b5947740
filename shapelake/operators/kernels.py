"""Rigid alignment in numpy: overlaps with gradients, seeds, and an Adam loop over all poses of a batch at once.

Everything is float64 and each pose is independent of its neighbours in the batch, so partitioning never changes a
result. Shapes: K pairs, S poses a pair, N and M points (padded, weight 0).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from shapelake.constants import ANTIPARALLEL, COULOMB_SCALING, DIRECTIONAL, DUMMY, LAM_SCALING, PHARM_ALPHAS, TVERSKY_SIGMA


@dataclass
class Channel:
    """One sum over point pairs. ``weight`` (K, N, M) holds what no pose changes; ``ua``, ``ub`` are directions."""

    a: np.ndarray
    b: np.ndarray
    alpha: np.ndarray  # (K, N, M)
    weight: np.ndarray
    aa: np.ndarray  # (K,) self overlaps
    bb: np.ndarray
    ua: np.ndarray | None = None
    ub: np.ndarray | None = None
    directed: np.ndarray | None = None  # (K, N, M) 0 none, 1 front only, 2 both ways


# ---------------------------------------------------------------- rotations


def matrices(q: np.ndarray) -> np.ndarray:
    """(..., 3, 3) of quaternions (..., 4) of any length."""
    r, i, j, k = np.moveaxis(q / np.linalg.norm(q, axis=-1, keepdims=True), -1, 0)
    return np.stack(
        [1 - 2 * (j * j + k * k), 2 * (i * j - k * r), 2 * (i * k + j * r), 2 * (i * j + k * r), 1 - 2 * (i * i + k * k), 2 * (j * k - i * r), 2 * (i * k - j * r), 2 * (j * k + i * r), 1 - 2 * (i * i + j * j)],
        axis=-1,
    ).reshape(*q.shape[:-1], 3, 3)


def to_quaternion_gradient(q: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Gradient over a unit quaternion from the gradient g (..., 3, 3) over its matrix."""
    r, i, j, k = np.moveaxis(q, -1, 0)
    g00, g01, g02, g10, g11, g12, g20, g21, g22 = (g[..., x, y] for x in range(3) for y in range(3))
    dr = -k * g01 + j * g02 + k * g10 - i * g12 - j * g20 + i * g21
    di = j * g01 + k * g02 + j * g10 - 2 * i * g11 - r * g12 + k * g20 + r * g21 - 2 * i * g22
    dj = -2 * j * g00 + i * g01 + r * g02 + i * g10 + k * g12 - r * g20 + k * g21 - 2 * j * g22
    dk = -2 * k * g00 - r * g01 + i * g02 + r * g10 - 2 * k * g11 + j * g12 + i * g20 + j * g21
    return 2 * np.stack([dr, di, dj, dk], axis=-1)


def product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    pr, pi, pj, pk = np.moveaxis(p, -1, 0)
    qr, qi, qj, qk = np.moveaxis(q, -1, 0)
    return np.stack([pr * qr - pi * qi - pj * qj - pk * qk, pi * qr + pr * qi - pk * qj + pj * qk, pj * qr + pk * qi + pr * qj - pi * qk, pk * qr - pj * qi + pi * qj + pr * qk], axis=-1)


def from_axis_angle(axis: np.ndarray, angle: float) -> np.ndarray:
    length = np.linalg.norm(axis)
    if length == 0:
        raise ZeroDivisionError("the rotation axis has no length")
    return np.concatenate([[np.cos(angle / 2)], np.asarray(axis) / length * np.sin(angle / 2)])


def between(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Quaternion that turns v towards w; any normal axis serves opposite ones."""
    v, w = v / np.linalg.norm(v), w / np.linalg.norm(w)
    axis = np.cross(v, w)
    if np.linalg.norm(axis) < 1e-9:
        if v @ w > 0:
            return np.array([1.0, 0, 0, 0])
        axis = np.cross(v, np.eye(3)[np.argmin(np.abs(v))])
    return from_axis_angle(axis, float(np.arccos(np.clip(v @ w, -1, 1))))


def inertia(points: np.ndarray) -> np.ndarray:
    p = points - points.mean(axis=0)
    return (np.sum(p * p) * np.eye(3) - p.T @ p) / len(p)


def principal_axes(points: np.ndarray) -> np.ndarray:
    """Rows are axes, by falling moment."""
    values, axes = np.linalg.eigh(inertia(points))
    return axes[:, np.argsort(-values)].T


def pca_quaternions(ref: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Four turns that lay the fit's principal axes on the reference's, for the four choices of signs."""
    target, own = principal_axes(ref), principal_axes(fit)
    out = []
    for s0, s1 in ((1, 1), (-1, 1), (1, -1), (-1, -1)):
        first = between(own[0], s0 * target[0])
        second_axis = matrices(first) @ own[1]
        out.append(product(between(second_axis, s1 * target[1]), first))
    return np.array(out)


def fibonacci(n: int) -> np.ndarray:
    i = np.arange(n)
    y = i * (2.0 / n) - 1 + 1.0 / n
    r = np.sqrt(np.maximum(0, 1 - y * y))
    phi = np.mod(i + 1, n) * (np.pi * (3 - np.sqrt(5)))
    return np.column_stack([np.cos(phi) * r, y, np.sin(phi) * r])


@lru_cache(maxsize=64)
def fixed_turns(room: int) -> np.ndarray:
    """The start turns that no molecule changes, for so many places: quarter turns of the axes, then even directions."""
    half = np.sqrt(0.5)
    own = [np.array([half, *(s * half * np.eye(3)[x])]) for x in range(3) for s in (1, -1)][: max(0, min(6, room))]
    if room > len(own):
        own += [between(np.array([1.0, 0, 0]), p) for p in fibonacci(room - len(own))]
    return np.array(own).reshape(-1, 4)


def seeds(ref: np.ndarray, fit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n start poses: identity, four by principal axes, quarter turns of the axes, then even directions; centroids meet.

    Fewer than three or non-finite points leave out the principal axes. One seed is the identity without a shift.
    """
    if n == 1:
        return np.array([[1.0, 0, 0, 0]]), np.zeros((1, 3))
    own = [np.array([1.0, 0, 0, 0])]
    if min(len(ref), len(fit)) >= 3 and np.isfinite(ref).all() and np.isfinite(fit).all():
        own += list(pca_quaternions(ref, fit))
    q = np.concatenate([np.array(own), fixed_turns(n - len(own))])[: max(n, 5)]
    t = ref.mean(axis=0) - np.einsum("sij,j->si", matrices(q), fit.mean(axis=0))
    return q, t


def _betweens(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``between`` of unit vectors (..., 3)."""
    axis, dot = np.cross(v, w), (v * w).sum(axis=-1, keepdims=True)
    size = np.linalg.norm(axis, axis=-1, keepdims=True)
    level = size < 1e-9
    if level.any():
        other = np.cross(v, np.eye(3)[np.argmin(np.abs(v), axis=-1)])
        axis = np.where(level, other, axis)
        size = np.linalg.norm(axis, axis=-1, keepdims=True)
    half = np.arccos(np.clip(dot, -1, 1)) / 2
    turn = np.concatenate([np.cos(half), axis / size * np.sin(half)], axis=-1)
    return np.where(level & (dot > 0), [1.0, 0, 0, 0], turn)


def seeds_of(a: np.ndarray, ma: np.ndarray, b: np.ndarray, mb: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``seeds`` of K pairs of clouds with masks at once; pairs with fewer poses repeat their first."""
    real = [m > 0 for m in (ma, mb)]
    points = [np.where(w[..., None], x, 0.0) for x, w in zip((a, b), real, strict=True)]
    sound = np.isfinite(points[0]).all(axis=(1, 2)) & np.isfinite(points[1]).all(axis=(1, 2)) & (np.minimum(*(w.sum(axis=1) for w in real)) >= 3)
    if n == 1:
        sound[:] = False
    rest = {k: seeds(a[k][real[0][k]], b[k][real[1][k]], n) if real[0][k].any() and real[1][k].any() else (np.array([[1.0, 0, 0, 0]]), np.zeros((1, 3))) for k in np.flatnonzero(~sound)}
    count = max([max(n, 5) * bool(sound.any()), *(len(x[0]) for x in rest.values())])
    q, t = np.empty((len(a), count, 4)), np.empty((len(a), count, 3))
    for k, own in rest.items():
        q[k], t[k] = (np.concatenate([x, np.repeat(x[:1], count - len(x), axis=0)]) for x in own)
    if not sound.any():
        return q, t
    means, axes = [], []
    for x, w in zip(points, real, strict=True):
        x, w = x[sound], w[sound]
        size = w.sum(axis=1)[:, None]
        mean = x.sum(axis=1) / size
        p = (x - mean[:, None]) * w[..., None]
        values, own = np.linalg.eigh(((p * p).sum(axis=(1, 2))[:, None, None] * np.eye(3) - np.swapaxes(p, 1, 2) @ p) / size[..., None])
        means.append(mean)
        axes.append(np.swapaxes(np.take_along_axis(own, np.argsort(-values, axis=1)[:, None], axis=2), 1, 2))
    target, own = axes
    s0, s1 = (np.array(x)[None, :, None] for x in ((1, -1, 1, -1), (1, 1, -1, -1)))
    first = _betweens(np.broadcast_to(own[:, None, 0], (len(own), 4, 3)), s0 * target[:, None, 0])
    second = (matrices(first) @ own[:, None, 1, :, None])[..., 0]
    turns = product(_betweens(second, s1 * target[:, None, 1]), first)
    fixed = np.concatenate([[[1.0, 0, 0, 0]], fixed_turns(n - 5)])
    q[sound] = np.concatenate([np.broadcast_to(fixed[:1], (len(own), 1, 4)), turns, np.broadcast_to(fixed[1:], (len(own), len(fixed) - 1, 4))], axis=1)
    t[sound] = means[0][:, None] - (matrices(q[sound]) @ means[1][:, None, :, None])[..., 0]
    return q, t


def seeds_at(ref: np.ndarray, fit: np.ndarray, centers: np.ndarray, per_center: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Five seeds on the centroid, and ``per_center`` turns with the fit's centroid on each further center."""
    q, t = seeds(ref, fit, 5)
    turns = np.array([between(np.array([1.0, 0, 0]), p) for p in fibonacci(per_center)])
    shift = np.einsum("sij,j->si", matrices(turns), fit.mean(axis=0))
    return np.concatenate([q, *([turns] * len(centers))]), np.concatenate([t, *(c - shift for c in centers)])


def coarse_grid(ref: np.ndarray, fit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ten poses a seed: the seed and its half turns about x, y, z and about z by way of x and y, each with the first
    seed's shift and with the fit's centroid on the reference point farthest from the origin."""
    q, t = seeds(ref, fit, n)
    x, y, z = np.eye(4)[1:]
    turns = np.concatenate([q, *(product(half[None], q) for half in (x, y, z, product(x, y)))])
    tip = ref[np.linalg.norm(ref, axis=1).argmax()]
    shifts = np.stack([t[0], tip - fit.mean(axis=0)])
    return np.repeat(turns, 2, axis=0), np.tile(shifts, (len(turns), 1))


def best_poses(score, q: np.ndarray, t: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` poses of each pair that score best where they stand, the first of equals."""
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    at = np.argsort(-score(q, t)[0], axis=1, kind="stable")[:, :keep, None]
    return np.take_along_axis(q, at, axis=1), np.take_along_axis(t, at, axis=1)


# ---------------------------------------------------------------- overlaps


def moved(b: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(K, S, M, 3)"""
    return np.einsum("ksij,kmj->ksmi", matrices(q), b) + t[:, :, None, :]


@dataclass
class PairChannel:
    """The same over the point pairs that can count at all: typed features meet few of the other cloud's. All (K, P, ...)."""

    a: np.ndarray
    b: np.ndarray
    alpha: np.ndarray
    weight: np.ndarray
    aa: np.ndarray
    bb: np.ndarray
    ua: np.ndarray | None = None
    ub: np.ndarray | None = None
    directed: np.ndarray | None = None


def paired(c: Channel) -> Channel | PairChannel:
    """A channel's pairs of any weight, listed, if they are less than half of all."""
    real = c.weight != 0
    count = real.reshape(len(real), -1).sum(axis=1)
    width = max(int(count.max(initial=0)), 1)
    if 2 * width > real.shape[1] * real.shape[2]:
        return c
    k, n, m = np.nonzero(real)
    place = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)

    def listed(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(real), width, *values.shape[1:]))
        out[k, place] = values
        return out

    directed = c.ua is not None
    return PairChannel(listed(c.a[k, n]), listed(c.b[k, m]), listed(c.alpha[k, n, m]), listed(c.weight[k, n, m]), c.aa, c.bb, listed(c.ua[k, n]) if directed else None, listed(c.ub[k, m]) if directed else None, listed(c.directed[k, n, m]) if directed else None)


def _facing(raw: np.ndarray, directed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weight of two directions with cosine ``raw``, and its slope over the cosine."""
    both, one = directed == 2, directed > 0
    cosine = np.where(both, np.abs(raw), np.clip(raw, 0, 1))
    slope = np.where(both, np.sign(raw), ((raw > 0) & (raw < 1)).astype(float)) / 3
    return np.where(one, (cosine + 2) / 3, 1.0), np.where(one, slope, 0.0)


def overlap(c: Channel | PairChannel, q: np.ndarray, t: np.ndarray, gradient: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(value (K, S), gradient over q, gradient over t) of a channel at some poses; q are unit quaternions."""
    m = matrices(q)
    if isinstance(c, PairChannel):
        return _overlap_pairs(c, q, t, m, gradient)
    b = np.einsum("ksij,kmj->ksmi", m, c.b) + t[:, :, None, :]
    square = (c.a**2).sum(-1)[:, None, :, None] + (b**2).sum(-1)[:, :, None, :] - 2 * (c.a[:, None] @ np.swapaxes(b, 2, 3))
    term = c.weight[:, None] * np.exp(-c.alpha[:, None] / 2 * np.maximum(square, 0))
    turn = None
    if c.ua is not None:
        factor, slope = _facing(np.einsum("kni,ksmi->ksnm", c.ua, np.einsum("ksij,kmj->ksmi", m, c.ub)), c.directed[:, None])
        if gradient:
            turn = np.einsum("ksnm,kni,kmj->ksij", term * slope, c.ua, c.ub, optimize=True)
        term = term * factor
    value = term.sum(axis=(2, 3))
    if not gradient:
        return value, None, None
    pull = term * c.alpha[:, None]
    force = np.swapaxes(pull, 2, 3) @ c.a[:, None] - pull.sum(axis=2)[..., None] * b
    g = np.swapaxes(force, 2, 3) @ c.b[:, None]
    return value, to_quaternion_gradient(q, g if turn is None else g + turn), force.sum(axis=2)


def _overlap_pairs(c: PairChannel, q: np.ndarray, t: np.ndarray, m: np.ndarray, gradient: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Coordinates stand before the listed pairs, (K, S, 3, P), so that all poses of a pair turn in one product."""
    k, s, p = *q.shape[:2], c.a.shape[1]
    turns = m.reshape(k, 3 * s, 3)
    diff = np.swapaxes(c.a, 1, 2)[:, None] - (turns @ np.swapaxes(c.b, 1, 2)).reshape(k, s, 3, p) - t[..., None]
    square = diff[:, :, 0] * diff[:, :, 0] + diff[:, :, 1] * diff[:, :, 1] + diff[:, :, 2] * diff[:, :, 2]
    term = c.weight[:, None] * np.exp(-c.alpha[:, None] / 2 * square)
    turn = None
    if c.ua is not None:
        ua = np.swapaxes(c.ua, 1, 2)[:, None]
        looks = (turns @ np.swapaxes(c.ub, 1, 2)).reshape(k, s, 3, p) * ua
        factor, slope = _facing(looks[:, :, 0] + looks[:, :, 1] + looks[:, :, 2], c.directed[:, None])
        if gradient:
            turn = (((term * slope)[:, :, None] * ua).reshape(k, 3 * s, p) @ c.ub).reshape(k, s, 3, 3)
        term = term * factor
    value = term.sum(axis=2)
    if not gradient:
        return value, None, None
    force = (term * c.alpha[:, None])[:, :, None] * diff
    g = (force.reshape(k, 3 * s, p) @ c.b).reshape(k, s, 3, 3)
    return value, to_quaternion_gradient(q, g if turn is None else g + turn), force.sum(axis=3)


def meetings(ta: np.ndarray, tb: np.ndarray, ma: np.ndarray, mb: np.ndarray) -> np.ndarray:
    """How many pairs of features of one type each row has, Dummy apart."""
    return sum(((ta == k) * ma).sum(axis=1) * ((tb == k) * mb).sum(axis=1) for k in range(len(PHARM_ALPHAS)) if k != DUMMY)


def self_overlap(a: np.ndarray, alpha: np.ndarray, weight: np.ndarray, u: np.ndarray | None = None, directed: np.ndarray | None = None) -> np.ndarray:
    identity = np.tile([1.0, 0, 0, 0], (len(a), 1, 1))
    c = Channel(a, a, alpha, weight, np.zeros(len(a)), np.zeros(len(a)), u, u, directed)
    return overlap(c, identity, np.zeros((len(a), 1, 3)), False)[0][:, 0]


def _scale(alpha: np.ndarray) -> np.ndarray:
    return (np.pi / (2 * alpha)) ** 1.5


def shape_channel(a, b, ma, mb, alpha: float, qa=None, qb=None, lam: float | None = None) -> Channel:
    """Clouds (K, N, 3) with masks; charges weigh pairs where ``lam`` is given."""

    def weight(x, y, mx, my, cx, cy):
        out = mx[:, :, None] * my[:, None, :] * _scale(np.float64(alpha))
        return out if lam is None else out * np.exp(-((cx[:, :, None] - cy[:, None, :]) ** 2) / lam)

    def width(x, y):
        return np.full((len(x), x.shape[1], y.shape[1]), alpha)

    aa = self_overlap(a, width(a, a), weight(a, a, ma, ma, qa, qa))
    bb = self_overlap(b, width(b, b), weight(b, b, mb, mb, qb, qb))
    return Channel(a, b, width(a, b), weight(a, b, ma, mb, qa, qb), aa, bb)


def pharm_channel(a, b, ma, mb, ta, tb, ua=None, ub=None) -> Channel | PairChannel:
    """Typed features; without directions every type is scored by its anchors."""
    alphas = np.array(PHARM_ALPHAS)
    kinds = np.array([2 if i in ANTIPARALLEL else 1 if i in DIRECTIONAL else 0 for i in range(len(alphas))])

    def tables(tx, ty, mx, my):
        same = (tx[:, :, None] == ty[:, None, :]) & (tx != DUMMY)[:, :, None]
        alpha = np.broadcast_to(alphas[tx][:, :, None], same.shape)
        return alpha, same * mx[:, :, None] * my[:, None, :] * _scale(alpha), np.broadcast_to(kinds[tx][:, :, None], same.shape)

    def own(x, tx, mx, ux):
        alpha, weight, kind = tables(tx, tx, mx, mx)
        return self_overlap(x, alpha, weight, ux, kind if ux is not None else None)

    alpha, weight, kind = tables(ta, tb, ma, mb)
    return paired(Channel(a, b, alpha, weight, own(a, ta, ma, ua), own(b, tb, mb, ub), ua, ub, kind if ua is not None else None))


def tanimoto(value: np.ndarray, c: Channel) -> tuple[np.ndarray, np.ndarray]:
    """Similarity and its slope over the overlap; 0 where there is nothing to compare."""
    total = (c.aa + c.bb)[:, None]
    below = np.maximum(total - value, 1e-12)
    return np.where(total > 0, value / below, 0.0), np.where(total > 0, total / below**2, 0.0)


def tversky(value: np.ndarray, c: Channel, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Held to at most 1, where the slope ends."""
    below = (sigma * c.aa + (1 - sigma) * c.bb)[:, None]
    raw = np.where(below > 0, value / np.maximum(below, 1e-12), 0.0)
    return np.minimum(raw, 1.0), np.where((below > 0) & (raw < 1), 1 / np.maximum(below, 1e-12), 0.0)


def similarity(name: str, value: np.ndarray, c: Channel) -> tuple[np.ndarray, np.ndarray]:
    return tanimoto(value, c) if name == "tanimoto" else tversky(value, c, TVERSKY_SIGMA[name])


def clash(avoid: np.ndarray, mask: np.ndarray, b: np.ndarray, mb: np.ndarray, reach: float, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far the posed points go into spheres around the points to avoid, with gradients over q and t."""
    posed = moved(b, q, t)
    diff = posed[:, :, None, :, :] - avoid[:, None, :, None, :]
    d = np.sqrt(np.einsum("ksnmi,ksnmi->ksnm", diff, diff))
    real = (mask[:, :, None] * mb[:, None, :])[:, None]
    near = (d < reach) & (d > 0) & (real > 0)
    value = (np.maximum((reach - d) / reach, 0) * real).sum(axis=(2, 3))
    force = (np.where(near, -1 / (reach * np.where(d > 0, d, 1.0)), 0.0)[..., None] * diff).sum(axis=2)
    return value, to_quaternion_gradient(q, np.einsum("ksmi,kmj->ksij", force, b)), force.sum(axis=2)


def _agreement(points, own, mask, atoms, charges, radii, amask, probe: float, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """(K, S) sums of exp(-(own - potential there)^2 / (lam * LAM)) over the points (K, S, P, 3) outside all spheres around
    the atoms (K, S, M, 3), and the slope (K, S, P, M, 3) of each point's term over its way from each atom.

    Whether a point is outside is taken as it is: it has no slope.
    """
    way = points[..., :, None, :] - atoms[..., None, :, :]
    d = np.sqrt((way * way).sum(axis=-1))
    real = amask[:, None, None, :] > 0
    outside = np.where(real, d >= radii[:, None, None, :] + probe, True).all(axis=-1)
    part = COULOMB_SCALING * np.divide(np.broadcast_to(charges[:, None, None, :], d.shape), d, out=np.zeros_like(d), where=real & (d > 0))
    off = own[:, None, :] - part.sum(axis=-1)
    term = mask[:, None, :] * outside * np.exp(-(off**2) / (lam * LAM_SCALING))
    steep = term * 2 * off / (lam * LAM_SCALING)  # slope of a term over the potential
    inverse = np.divide(1.0, d * d, out=np.zeros_like(d), where=d > 0)
    return term.sum(axis=-1), -(steep[..., None] * part * inverse)[..., None] * way


def esp_score(surface: tuple, atoms: tuple, probe: float, lam: float, weight: float):
    """``(q, t) -> (value, dq, dt)``: weight * share of surface points whose potentials agree, both ways.

    surface and atoms: ((points, potentials, mask), (points, charges, radii, mask)) of the reference, then of the fit.
    """
    (sa, va, ms), (sb, vb, mz) = surface
    (pa, ca, ra, ma), (pb, cb, rb, mb) = atoms
    n = np.maximum(ms.sum(axis=1) + mz.sum(axis=1), 1)[:, None]

    def score(q, t):
        there, skin = moved(pb, q, t), moved(sb, q, t)
        one, slope_one = _agreement(np.broadcast_to(sa[:, None], (*q.shape[:2], *sa.shape[1:])), va, ms, there, cb, rb, mb, probe, lam)
        two, slope_two = _agreement(skin, vb, mz, np.broadcast_to(pa[:, None], (*q.shape[:2], *pa.shape[1:])), ca, ra, ma, probe, lam)
        on_atoms, on_skin = -slope_one.sum(axis=2), slope_two.sum(axis=3)  # the fit's atoms pull back, its points go along
        g = np.swapaxes(on_atoms, 2, 3) @ pb[:, None] + np.swapaxes(on_skin, 2, 3) @ sb[:, None]
        scale = weight / n
        return scale * (one + two), scale[..., None] * to_quaternion_gradient(q, g), scale[..., None] * (on_atoms.sum(axis=2) + on_skin.sum(axis=2))

    return score


# ---------------------------------------------------------------- search


def optimise(score, q: np.ndarray, t: np.ndarray, steps: int, lr: float = 0.075) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best (score, q, t) of each pair over all its poses (K, S, ...) after some Adam steps.

    ``score(q, t) -> (value, dq, dt)``. Adam has no bias correction, keeps epsilon under the root, and moves q within
    its tangent before it is renormed. A pose is remembered before the step that follows it.
    """
    q, t = q / np.linalg.norm(q, axis=-1, keepdims=True), t.copy()
    best = np.full(q.shape[:2], -np.inf)
    best_q, best_t = q.copy(), t.copy()
    m = [np.zeros_like(q), np.zeros_like(t)]
    v = [np.zeros_like(q), np.zeros_like(t)]
    for step in range(steps + 1):
        value, dq, dt = score(q, t)
        better = value > best
        best = np.where(better, value, best)
        best_q, best_t = np.where(better[..., None], q, best_q), np.where(better[..., None], t, best_t)
        if step == steps:
            break
        dq = dq - (dq * q).sum(-1, keepdims=True) * q
        for n, g in enumerate((dq, dt)):
            m[n] = 0.9 * m[n] + 0.1 * g
            v[n] = 0.999 * v[n] + 0.001 * g * g
        q = q + lr * m[0] / np.sqrt(v[0] + 1e-8)
        q = q / np.linalg.norm(q, axis=-1, keepdims=True)
        t = t + lr * m[1] / np.sqrt(v[1] + 1e-8)
    k, at = np.arange(len(best)), best.argmax(axis=1)
    return best[k, at], best_q[k, at], best_t[k, at]


def channel_score(channels: list[tuple[float, Channel | PairChannel]], name: str = "tanimoto", penalty=None, bonus=None):
    """Weighted sum of the channels' similarities, less a penalty and more a bonus, both ``(q, t) -> (value, dq, dt)``,
    with its gradients."""

    def score(q, t):
        total, gq, gt = 0.0, 0.0, 0.0
        for weight, c in channels:
            value, dq, dt = overlap(c, q, t)
            s, slope = similarity(name, value, c)
            total, gq, gt = total + weight * s, gq + (weight * slope)[..., None] * dq, gt + (weight * slope)[..., None] * dt
        if penalty is not None:
            value, dq, dt = penalty(q, t)
            total, gq, gt = total - value, gq - dq, gt - dt
        if bonus is not None:
            value, dq, dt = bonus(q, t)
            total, gq, gt = total + value, gq + dq, gt + dt
        return total, gq, gt

    return score


def transform(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(K, 16) 4 x 4 matrices, row by row."""
    out = np.zeros((len(q), 4, 4))
    out[:, :3, :3], out[:, :3, 3], out[:, 3, 3] = matrices(q), t, 1
    return out.reshape(len(q), 16)
