"""Clustering of conformers, over a table of pairwise distances or over one position each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Numbers that one array over point pairs holds at most.
CHUNK = 2_000_000
#: Bounds between boxes are widened by this share, so that rounding never leaves out a neighbour.
SLACK = 1e-9


def adjacency(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray, threshold: float) -> np.ndarray:
    """(n, n): which items lie within the threshold; pairs that are not listed do not."""
    near = np.zeros((n, n), dtype=bool)
    hit = np.asarray(distance) <= threshold
    near[i[hit], j[hit]] = near[j[hit], i[hit]] = True
    np.fill_diagonal(near, False)
    return near


def butina(near: np.ndarray) -> list[list[int]]:
    """Clusters, each around the free item with most free neighbours; ties go to the greater index.

    Neighbours are counted anew once a cluster has taken its members away.
    """
    n = len(near)
    free, out = np.ones(n, dtype=bool), []
    count = near.sum(axis=1)
    while free.any():
        center = int(n - 1 - np.where(free, count, -1)[::-1].argmax())
        taken = np.flatnonzero(near[center] & free)
        out.append([center, *taken.tolist()])
        gone = np.append(taken, center)
        free[gone] = False
        count = count - near[:, gone].sum(axis=1)
    return out


def representatives(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray, threshold: float = 0.2, most: int = 100, step: float = 0.1) -> list[int]:
    """Cluster centers, the threshold raised until there are at most ``most``."""
    while True:
        clusters = butina(adjacency(n, i, j, distance, threshold))
        if len(clusters) <= most:
            return [c[0] for c in clusters]
        threshold += step


def cluster_conformers(distances: DataFrame, threshold: float = 0.2, most: int = 100) -> DataFrame:
    """(mol_id, conf): representatives of each molecule's conformers, from (mol_id, i, j, rmsd).

    A molecule's conformers are some hundreds by nature, and their distances one group.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].to_numpy(), frame["j"].to_numpy()
        found = representatives(int(max(i.max(), j.max())) + 1, i, j, frame["rmsd"].to_numpy(), threshold, most)
        return pd.DataFrame({"mol_id": frame["mol_id"].iloc[0], "conf": found})

    return distances.groupBy("mol_id").applyInPandas(run, "mol_id long, conf int")


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the 2 ** level nodes of a level start, and the end."""
    return (n * np.arange((1 << level) + 1)) >> level


def _tree(points: np.ndarray) -> tuple[np.ndarray, int]:
    """(order, levels): each node holds two halves along its widest side, down to some eight points."""
    n, order = len(points), np.arange(len(points))
    depth = max(0, int(np.log2(max(n, 1) / 8)))
    for level in range(depth):
        at, half = _bounds(n, level), _bounds(n, level + 1)[1::2]
        for k in range(1 << level):
            own = order[at[k] : at[k + 1]]
            order[at[k] : at[k + 1]] = own[np.argpartition(points[own, np.ptp(points[own], axis=0).argmax()], half[k] - at[k])]
    return order, depth


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of (..., 3) points are near: as by square roots of squares added up in order."""
    x, y, z = ((a[..., k] - b[..., k]) ** 2 for k in range(3))
    return np.sqrt(x + y + z) <= threshold


def _apart(points: np.ndarray, count: int) -> float:
    """So far apart are some ``count`` of the points at least, each the farthest from those before it."""
    if len(points) < count:
        return 0.0
    gap, least = np.linalg.norm(points - points.mean(axis=0), axis=1), np.inf
    at = int(gap.argmax())
    gap = np.full(len(points), np.inf)
    for _ in range(count - 1):
        gap = np.minimum(gap, np.linalg.norm(points - points[at], axis=1))
        at = int(gap.argmax())
        least = min(least, gap[at])
    return float(least)


def _densest(points: np.ndarray, weight: np.ndarray, index: np.ndarray, depth: int, threshold: float) -> int:
    """The place of the point with the most weight within the threshold; of equals that of the greatest index.

    Points are in a tree's order. From level to level a node's box is held against those boxes that were neither all
    near its parent's nor all far: what is surely near and what can be near bound the weight that its points reach, and
    a node is given up once another surely reaches more, or one of the points at the means of what is near them. The
    last boxes' points are compared one by one.
    """
    n, total = len(points), np.concatenate([[0], np.cumsum(weight)])
    best, near = 0, np.ones(n, dtype=bool)
    for _ in range(8):
        at = np.argmin(((points - np.average(points[near], axis=0, weights=weight[near])) ** 2).sum(axis=1))
        near = _near(points[at], points, threshold)
        best = max(best, int(weight[near].sum()))
    node, sure, q, r = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for level in range(depth + 1):  # q: places in node; r: nodes of the same level
        at = _bounds(n, level)
        low, high, mass = np.minimum.reduceat(points, at[:-1]), np.maximum.reduceat(points, at[:-1]), np.diff(total[at])
        inner, outer = np.empty(len(q), dtype=bool), np.empty(len(q), dtype=bool)
        for k in range(0, len(q), CHUNK // 8):
            cut = slice(k, k + CHUNK // 8)
            a, b = node[q[cut]], r[cut]
            span, gap = np.maximum(high[a] - low[b], high[b] - low[a]), np.maximum(np.maximum(low[a] - high[b], low[b] - high[a]), 0)
            inner[cut] = np.sqrt((span * span).sum(axis=1)) * (1 + SLACK) <= threshold
            outer[cut] = np.sqrt((gap * gap).sum(axis=1)) * (1 - SLACK) <= threshold
        open_ = outer & ~inner
        sure = sure + np.bincount(q[inner], mass[r[inner]], len(node)).astype(np.int64)
        live = sure + np.bincount(q[open_], mass[r[open_]], len(node)).astype(np.int64) >= max(best, sure.max())
        keep = open_ & live[q]
        q, r, node, sure = (np.cumsum(live) - 1)[q[keep]], r[keep], node[live], sure[live]
        if level < depth:
            q, r = (2 * q[:, None] + [0, 0, 1, 1]).ravel(), (2 * r[:, None] + [0, 1, 0, 1]).ravel()
            node, sure = (2 * node[:, None] + [0, 1]).ravel(), np.repeat(sure, 2)
    width = int(np.diff(at).max())
    own = at[node][:, None] + np.arange(width)
    count = np.where(own < at[node + 1][:, None], sure[:, None], -1)
    own = np.minimum(own, n - 1)
    step = max(1, CHUNK // (4 * width * width))
    for k in range(0, len(q), step):
        a, b = q[k : k + step], at[r[k : k + step]][:, None] + np.arange(width)
        real, b = b < at[r[k : k + step] + 1][:, None], np.minimum(b, n - 1)
        met = (_near(points[own[a]][:, :, None], points[b][:, None], threshold) * (weight[b] * real)[:, None]).sum(axis=2)
        np.add.at(count, a, np.where(count[a] < 0, 0, met))
    top = own[count == count.max()]
    return int(top[index[top].argmax()])


def point_representatives(points: np.ndarray, threshold: float = 0.2, most: int = 100, step: float = 0.1) -> list[int]:
    """``representatives`` of items at (n, 3) positions, by distance, without a table of pairs.

    A threshold is given up once more than the clusters left of ``most`` would be needed: of points more than twice the
    threshold apart no two share a cluster. Items without a finite position are alone at any threshold; where they
    leave no room, the rest ends as one cluster.
    """
    sound = np.isfinite(points).all(axis=1)
    alone = np.flatnonzero(~sound).tolist()
    if not sound.any():
        return alone
    place, inverse, weight = np.unique(points[sound], axis=0, return_inverse=True, return_counts=True)
    index = np.zeros(len(place), dtype=np.int64)
    np.maximum.at(index, inverse.ravel(), np.flatnonzero(sound))
    order, depth = _tree(place)
    place, weight, index = place[order], weight[order], index[order]
    room = max(most - len(alone), 1)
    apart = _apart(place, room + 1)
    while True:
        centers, free = [], np.ones(len(place), dtype=bool)
        while apart <= 2 * threshold * (1 + SLACK) and len(centers) < room and free.any():
            if centers and _apart(place[free], room - len(centers) + 1) > 2 * threshold * (1 + SLACK):
                break
            left, deep = np.arange(len(place)), depth  # in their first order
            if centers:
                left = np.flatnonzero(free)
                order, deep = _tree(place[left])
                left = left[order]
            at = left[_densest(place[left], weight[left], index[left], deep, threshold)]
            centers.append(int(index[at]))
            free &= ~_near(place[at], place, threshold)
        if apart <= 2 * threshold * (1 + SLACK) and not free.any():
            return [*centers, *alone]
        threshold += step


def cluster_points(points: DataFrame, threshold: float = 0.2, most: int = 100) -> DataFrame:
    """(mol_id, conf): representatives of each molecule's conformers, from (mol_id, conf, x, y, z), a position each.

    The same as ``cluster_conformers`` of all distances, whose rows grow with the square of a molecule's conformers;
    here a molecule's positions are one group, and no pair becomes a row.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("conf")
        found = point_representatives(frame[["x", "y", "z"]].to_numpy(np.float64), threshold, most)
        return pd.DataFrame({"mol_id": frame["mol_id"].iloc[0], "conf": frame["conf"].to_numpy()[found]})

    return points.groupBy("mol_id").applyInPandas(run, "mol_id long, conf int")
