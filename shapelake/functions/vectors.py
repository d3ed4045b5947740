"""Geometry as Column expressions. A vector is a struct with x, y, z; a quaternion is four columns (r, i, j, k)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return vec(a["x"] * by, a["y"] * by, a["z"] * by)


def unit(a: Column) -> Column:
    """NULL components for the zero vector."""
    return vec(*(F.try_divide(a[c], norm(a)) for c in "xyz"))


def square_distance(a: Column, b: Column) -> Column:
    return (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["z"] - b["z"]) * (a["z"] - b["z"])


def angle(a: Column, b: Column) -> Column:
    """Angle between two vectors, the cosine held within [-1, 1]."""
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def rotation_axis(a: Column, b: Column) -> Column:
    """Unit normal of two vectors; (1, 0, 0) for nearly equal ones."""

    def close(c: str) -> Column:
        return F.abs(a[c] - b[c]) <= 1e-8 + 1e-5 * F.abs(b[c])

    n = unit(cross(a, b))
    same = close("x") & close("y") & close("z")
    return vec(*(F.when(same, F.lit(1.0 if c == "x" else 0.0)).otherwise(n[c]) for c in "xyz"))


def quaternion_of(axis: Column, turn: Column) -> list[Column]:
    """Quaternion of a turn about an axis, which need not be a unit vector but must not be zero."""
    length = norm(axis)
    safe = F.when(length == 0, F.raise_error(F.lit("the rotation axis has no length")).cast("double")).otherwise(length)
    return [F.cos(turn / 2), *(axis[c] / safe * F.sin(turn / 2) for c in "xyz")]


def quaternion_product(p: list[Column], q: list[Column]) -> list[Column]:
    """Hamilton product: turning by q, then by p."""
    return [
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3],
        p[1] * q[0] + p[0] * q[1] - p[3] * q[2] + p[2] * q[3],
        p[2] * q[0] + p[3] * q[1] + p[0] * q[2] - p[1] * q[3],
        p[3] * q[0] - p[2] * q[1] + p[1] * q[2] + p[0] * q[3],
    ]


def rotation_matrix(q: list[Column]) -> list[list[Column]]:
    """3 x 3 matrix of a quaternion of any length but zero."""
    r, i, j, k = q
    s = F.try_divide(F.lit(2.0), r * r + i * i + j * j + k * k)
    return [
        [1 - s * (j * j + k * k), s * (i * j - k * r), s * (i * k + j * r)],
        [s * (i * j + k * r), 1 - s * (i * i + k * k), s * (j * k - i * r)],
        [s * (i * k - j * r), s * (j * k + i * r), 1 - s * (i * i + j * j)],
    ]


def rotated(matrix: list[list[Column]], p: Column) -> Column:
    return vec(*(row[0] * p["x"] + row[1] * p["y"] + row[2] * p["z"] for row in matrix))


def moved(matrix: list[list[Column]], t: list[Column], p: Column) -> Column:
    turned = rotated(matrix, p)
    return vec(*(turned[c] + t[n] for n, c in enumerate("xyz")))


def transform_matrix(q: list[Column], t: list[Column]) -> Column:
    """4 x 4, row by row, as an array of 16."""
    m = rotation_matrix(q)
    cells = [c for n, row in enumerate(m) for c in (*row, t[n])]
    return F.array(*cells, *(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))


def fibonacci_point(i: Column, n: Column) -> Column:
    """The i-th of n evenly spread points on the unit sphere."""
    turn = math.pi * (3 - math.sqrt(5))
    y = i * (F.lit(2.0) / n) - 1 + F.lit(1.0) / n
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    phi = F.pmod(i + 1, n) * turn
    return vec(F.cos(phi) * r, y, F.sin(phi) * r)
