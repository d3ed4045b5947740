"""Numpy kernels: gradients by finite differences, seeds, and what an alignment must satisfy."""

from __future__ import annotations

import numpy as np
import pytest

from shapelake.constants import surface_alpha
from shapelake.operators import kernels as K
from shapelake.operators.alignment import align_arrays


def clouds(seed: int, k: int = 2, n: int = 6, m: int = 5):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, n, 3)) * 2, rng.normal(size=(k, m, 3)) * 2, np.ones((k, n)), np.ones((k, m)), rng


def channels(seed: int):
    a, b, ma, mb, rng = clouds(seed)
    mb[0, -1] = 0  # padding
    qa, qb = rng.normal(size=ma.shape), rng.normal(size=mb.shape)
    ua, ub = (x / np.linalg.norm(x, axis=-1, keepdims=True) for x in (rng.normal(size=a.shape), rng.normal(size=b.shape)))
    ta, tb = rng.integers(0, 9, ma.shape), rng.integers(0, 9, mb.shape)
    ta[:, :3], tb[:, :3] = [0, 2, 3], [0, 2, 3]
    return [K.shape_channel(a, b, ma, mb, 0.81), K.shape_channel(a, b, ma, mb, 0.81, qa, qb, 0.3), K.pharm_channel(a, b, ma, mb, ta, tb, ua, ub), K.pharm_channel(a, b, ma, mb, ta, tb)]


@pytest.mark.parametrize("which", range(4))
def test_gradients_match_finite_differences(which):
    c = channels(3)[which]
    rng = np.random.default_rng(5)
    q = rng.normal(size=(2, 3, 4))
    q /= np.linalg.norm(q, axis=-1, keepdims=True)
    t = rng.normal(size=(2, 3, 3))
    _, dq, dt = K.overlap(c, q, t)
    h = 1e-6
    for i in range(3):
        e = np.zeros(3)
        e[i] = h
        fd = (K.overlap(c, q, t + e, False)[0] - K.overlap(c, q, t - e, False)[0]) / (2 * h)
        assert np.allclose(fd, dt[..., i], atol=1e-5)
    way = rng.normal(size=q.shape)
    way -= (way * q).sum(-1, keepdims=True) * q  # along the sphere
    fd = (K.overlap(c, q + h * way, t, False)[0] - K.overlap(c, q - h * way, t, False)[0]) / (2 * h)
    assert np.allclose(fd, (dq * way).sum(-1), atol=1e-5)


def test_listed_pairs_equal_the_dense_sum():
    rng = np.random.default_rng(4)
    a, b, ma, mb, _ = clouds(4, 3, 9, 8)
    ma[1, 5:] = 0
    ta, tb = rng.integers(0, 9, ma.shape), rng.integers(0, 9, mb.shape)
    ua, ub = (x / np.linalg.norm(x, axis=-1, keepdims=True) for x in (rng.normal(size=a.shape), rng.normal(size=b.shape)))
    q = rng.normal(size=(3, 4, 4))
    q, t = q / np.linalg.norm(q, axis=-1, keepdims=True), rng.normal(size=(3, 4, 3))
    made = K.pharm_channel(a, b, ma, mb, ta, tb, ua, ub)
    assert isinstance(made, K.PairChannel)
    alphas, kinds = np.array(K.PHARM_ALPHAS), np.array([2 if i in K.ANTIPARALLEL else 1 if i in K.DIRECTIONAL else 0 for i in range(9)])
    same = ((ta[:, :, None] == tb[:, None, :]) & (ta != K.DUMMY)[:, :, None]) * ma[:, :, None] * mb[:, None, :]
    alpha = np.broadcast_to(alphas[ta][:, :, None], same.shape)
    dense = K.Channel(a, b, alpha, same * K._scale(alpha), made.aa, made.bb, ua, ub, np.broadcast_to(kinds[ta][:, :, None], same.shape))
    for x, y in zip(K.overlap(made, q, t), K.overlap(dense, q, t), strict=True):
        assert np.allclose(x, y)


def test_potential_agreement_and_its_gradients():
    rng = np.random.default_rng(9)
    sa, sb, pa_, pb = (rng.normal(size=(2, n, 3)) * s for n, s in ((7, 4.0), (6, 4.0), (4, 1.5), (5, 1.5)))
    va, vb, ca, cb = (rng.normal(size=(2, n)) * 0.3 for n in (7, 6, 4, 5))
    ra, rb, ms, mz, ma, mb = np.full((2, 4), 1.0), np.full((2, 5), 1.1), np.ones((2, 7)), np.ones((2, 6)), np.ones((2, 4)), np.ones((2, 5))
    mz[0, -1] = mb[1, -1] = 0
    score = K.esp_score(((sa, va, ms), (sb, vb, mz)), ((pa_, ca, ra, ma), (pb, cb, rb, mb)), 0.5, 0.05, 0.4)
    q = rng.normal(size=(2, 3, 4))
    q, t = q / np.linalg.norm(q, axis=-1, keepdims=True), rng.normal(size=(2, 3, 3))
    value, dq, dt = score(q, t)
    for k in range(2):  # by loops
        for s in range(3):
            m = K.matrices(q[k, s])
            there, skin, total = pb[k] @ m.T + t[k, s], sb[k] @ m.T + t[k, s], 0.0
            for points, own, real, atoms, charge, radius, amask in ((sa[k], va[k], ms[k], there, cb[k], rb[k], mb[k]), (skin, vb[k], mz[k], pa_[k], ca[k], ra[k], ma[k])):
                for p, o, w in zip(points, own, real, strict=True):
                    d = np.linalg.norm(atoms - p, axis=1)
                    if w and all(x >= r + 0.5 for x, r, y in zip(d, radius, amask, strict=True) if y):
                        v = K.COULOMB_SCALING * sum(c / x for c, x, y in zip(charge, d, amask, strict=True) if y)
                        total += np.exp(-((o - v) ** 2) / (0.05 * K.LAM_SCALING))
            assert np.isclose(value[k, s], 0.4 * total / (ms[k].sum() + mz[k].sum()))
    h = 1e-6
    for i in range(3):
        e = np.eye(3)[i] * h
        assert np.allclose((score(q, t + e)[0] - score(q, t - e)[0]) / (2 * h), dt[..., i], atol=1e-5)
    way = rng.normal(size=q.shape)
    way -= (way * q).sum(-1, keepdims=True) * q
    assert np.allclose((score(q + h * way, t)[0] - score(q - h * way, t)[0]) / (2 * h), (dq * way).sum(-1), atol=1e-5)
    assert np.abs(dt).max() > 1e-4


def test_padding_has_no_effect():
    a, b, ma, mb, _ = clouds(1)
    mb[:, -2:] = 0
    q, t = np.tile([1.0, 0, 0, 0], (2, 1, 1)), np.zeros((2, 1, 3))
    full = K.overlap(K.shape_channel(a, b, ma, mb, 0.81), q, t, False)[0]
    cut = K.overlap(K.shape_channel(a, b[:, :-2], ma, mb[:, :-2], 0.81), q, t, False)[0]
    assert np.allclose(full, cut)


def test_transform_literals():
    m = K.matrices(np.array([5, 0.2, -3.4, 0.4]))
    assert np.allclose(m, [[0.3623504, -0.1458107, -0.9205658], [0.0718172, 0.9891186, -0.1284004], [0.9292709, -0.0195865, 0.3688792]], atol=1e-6)


def test_pca_turns_lay_axes_on_each_other():
    a, _, _, _, rng = clouds(2, 1, 9)
    turn = K.matrices(np.array([0.3, 0.5, -0.2, 0.7]))
    quats = K.pca_quaternions(a[0], a[0] @ turn.T)
    best = min(np.abs(K.matrices(q) @ turn - np.eye(3)).max() for q in quats)
    assert best < 1e-6


def test_seed_counts_and_centroids():
    a, b, *_ = clouds(4)
    for n in (8, 10, 32):
        q, t = K.seeds(a[0], b[0], n)
        assert len(q) == len(t) == n
        assert np.allclose(np.einsum("sij,j->si", K.matrices(q), b[0].mean(0)) + t, a[0].mean(0))
    assert np.allclose(K.seeds(a[0], b[0], 1)[1], 0)
    assert len(K.seeds(a[0][:2], b[0], 8)[0]) == 8
    assert len(K.seeds_at(a[0], b[0], a[0][:2])[0]) == 25


def sides(seed: int, k: int = 3, n: int = 7):
    rng = np.random.default_rng(seed)
    atoms = {c: rng.normal(size=(k, n)) * 3 for c in "xyz"} | {"q": rng.normal(size=(k, n)) * 0.2, "radius": 1.2 + rng.random((k, n))}
    surface = {c: rng.normal(size=(k, n)) * 4 for c in "xyz"} | {"q": rng.normal(size=(k, n)) * 0.2}
    v = rng.normal(size=(k, n, 3))
    v /= np.linalg.norm(v, axis=-1, keepdims=True)
    pharm = {c: atoms[c] for c in "xyz"} | {f"v{c}": v[..., i] for i, c in enumerate("xyz")} | {"ptype": rng.integers(0, 9, (k, n))}
    one = np.ones((k, n))
    return {"atoms": (one, atoms), "surface": (one, surface), "pharm": (one, pharm)}


def turned(side, q, t):
    out = {}
    m = K.matrices(np.array(q))
    for name, (mask, f) in side.items():
        f = dict(f)
        p = np.stack([f[c] for c in "xyz"], -1) @ m.T + t
        f |= {c: p[..., i] for i, c in enumerate("xyz")}
        if "vx" in f:
            v = np.stack([f[f"v{c}"] for c in "xyz"], -1) @ m.T
            f |= {f"v{c}": v[..., i] for i, c in enumerate("xyz")}
        out[name] = (mask, f)
    return out


OPTIONS = {"alpha": 0.81, "lam": 0.3, "lr": 0.1, "weight": 0.5, "probe": 1.0}


@pytest.mark.parametrize("mode", ["vol", "vol_esp", "surf", "surf_esp", "pharm", "vol_color"])
def test_a_moved_copy_aligns_to_one(mode):
    ref = sides(7)
    fit = turned(ref, [0.8, 0.1, -0.5, 0.3], np.array([2.0, -1.0, 4.0]))
    score, q, t = align_arrays(mode, ref, fit, **OPTIONS, seeds=16, steps=60)
    assert np.all(score <= 1 + 1e-9)
    assert np.allclose(score, 1, atol=1e-2)


def test_pairs_do_not_depend_on_their_batch():
    ref, fit = sides(1), sides(2)
    whole = align_arrays("vol", ref, fit, **OPTIONS, seeds=10, steps=30)
    for i in range(3):
        one = [{c: (m[i : i + 1], {k: v[i : i + 1] for k, v in f.items()}) for c, (m, f) in s.items()} for s in (ref, fit)]
        assert np.allclose(align_arrays("vol", *one, **OPTIONS, seeds=10, steps=30)[0], whole[0][i : i + 1], atol=1e-9)


def test_combo_without_shape_weight_still_moves():
    score, *_ = align_arrays("vol_and_surf_esp", sides(1), sides(2), **OPTIONS, seeds=8, steps=20)
    assert np.all(np.isfinite(score)) and np.all(score <= 1 + 1e-9)


def test_surface_alpha_nodes_and_range():
    assert surface_alpha(50) == pytest.approx(0.6011)
    assert surface_alpha(400) == pytest.approx(1.258)
    assert surface_alpha(75) == pytest.approx(0.748778, abs=1e-5)
    with pytest.raises(ValueError):
        surface_alpha(20)


def test_avoided_points_push_the_pose_away_and_their_gradient_holds():
    a, b, ma, mb, rng = clouds(8)
    q = rng.normal(size=(2, 3, 4))
    q /= np.linalg.norm(q, axis=-1, keepdims=True)
    t = rng.normal(size=(2, 3, 3))
    value, _, dt = K.clash(a, ma, b, mb, 2.0, q, t)
    for i in range(3):
        e = np.zeros(3)
        e[i] = 1e-6
        fd = (K.clash(a, ma, b, mb, 2.0, q, t + e)[0] - K.clash(a, ma, b, mb, 2.0, q, t - e)[0]) / 2e-6
        assert np.allclose(fd, dt[..., i], atol=1e-4)
    assert np.all(value >= 0)
    ref, fit = sides(1), sides(2)
    free = align_arrays("vol", ref, fit, **OPTIONS, seeds=10, steps=30)[0]
    pushed = align_arrays("vol", ref, fit, **OPTIONS, seeds=10, steps=30, avoid="surface")[0]
    assert np.all(pushed <= free + 1e-9)


def test_other_similarities_and_more_starts():
    ref, fit = sides(4), sides(5)
    plain = align_arrays("pharm", ref, fit, **OPTIONS, seeds=8, steps=20)[0]
    wide = align_arrays("pharm", ref, fit, **OPTIONS, seeds=8, steps=20, trans_init=True)[0]
    assert np.all(np.isfinite(plain)) and np.all(wide >= plain - 0.2)
    assert np.all(align_arrays("pharm", ref, ref, **OPTIONS, seeds=8, steps=20, similarity="tversky_ref")[0] > 0.99)


def test_start_poses_at_once_are_those_pair_by_pair(monkeypatch):
    """Masks, few points, none; and no turn is found anew for each pair."""
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(30, 7, 3)) + 2, rng.normal(size=(30, 7, 3))
    ma, mb = ((rng.random((30, 7)) < 0.5).astype(float) for _ in "ab")
    ma[0], mb[1] = 0, 0
    for n in (1, 3, 5, 16, 32):
        alone = [K.seeds(x[m > 0], y[w > 0], n) if m.any() and w.any() else (np.array([[1.0, 0, 0, 0]]), np.zeros((1, 3))) for x, m, y, w in zip(a, ma, b, mb, strict=True)]
        q, t = K.seeds_of(a, ma, b, mb, n)
        for k, own in enumerate(alone):
            long = len(own[0])
            assert np.allclose(K.matrices(q[k, :long]), K.matrices(own[0]), atol=1e-6) and np.allclose(t[k, :long], own[1], atol=1e-6)
            assert (q[k, long:] == q[k, 0]).all() and (t[k, long:] == t[k, 0]).all()
    K.seeds_of(a, ma, b, mb, 32)
    calls, between = [], K.between
    monkeypatch.setattr(K, "between", lambda v, w: calls.append(1) or between(v, w))
    K.seeds_of(a, np.ones((30, 7)), b, np.ones((30, 7)), 32)
    assert not calls


def test_few_typed_pairs_score_as_all_pairs():
    """The list of pairs that count against the whole table, with slopes."""
    rng = np.random.default_rng(12)
    a, b, ua, ub = (rng.normal(size=(6, 7, 3)) for _ in range(4))
    ua, ub = (u / np.linalg.norm(u, axis=-1, keepdims=True) for u in (ua, ub))
    ta, tb = (rng.integers(0, 9, (6, 7)) for _ in "ab")
    listed = K.pharm_channel(a, b, np.ones((6, 7)), np.ones((6, 7)), ta, tb, ua, ub)
    assert isinstance(listed, K.PairChannel)
    assert K.meetings(ta, tb, np.ones((6, 7)), np.ones((6, 7))).tolist() == (listed.weight != 0).sum(axis=1).tolist()
    q, t = rng.normal(size=(6, 5, 4)), rng.normal(size=(6, 5, 3))
    q /= np.linalg.norm(q, axis=-1, keepdims=True)
    same = (ta[:, :, None] == tb[:, None, :]) & (ta != K.DUMMY)[:, :, None]
    alpha = np.array(K.PHARM_ALPHAS)[ta][:, :, None] * np.ones((1, 1, 7))
    kinds = np.array([2 if i in K.ANTIPARALLEL else 1 if i in K.DIRECTIONAL else 0 for i in range(9)])[ta][:, :, None] * np.ones((1, 1, 7), dtype=int)
    whole = K.Channel(a, b, alpha, same * (np.pi / (2 * alpha)) ** 1.5, listed.aa, listed.bb, ua, ub, kinds)
    for x, y in zip(K.overlap(listed, q, t), K.overlap(whole, q, t), strict=True):
        assert np.allclose(x, y, atol=1e-12)
