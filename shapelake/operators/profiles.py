"""Profiles: centering, hydrogens, dummies, transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.constants import DUMMY
from shapelake.functions.vectors import moved, rotated, rotation_matrix, vec


def mean_of(points: str) -> Column:
    n = F.size(points)
    return vec(*(F.aggregate(F.col(points)[c], F.lit(0.0), lambda s, x: s + x) / n for c in "xyz"))  # field c of every struct


def _mapped(points: str, fields: list[str], new) -> Column:
    """Each struct with the fields that ``new(struct)`` names replaced and every other field as it was."""

    def one(p: Column) -> Column:
        changed = new(p)
        return F.struct(*[changed.get(f, p[f]).alias(f) for f in fields])

    return F.transform(points, one)


def _fields(df: DataFrame, column: str) -> list[str]:
    return df.schema[column].dataType.elementType.names


def center(df: DataFrame, by: str = "atoms", columns: tuple[str, ...] = ("atoms", "surface", "pharm")) -> DataFrame:
    """All positions shifted by the mean of ``by``. Directions, charges and potentials stay."""
    out = df.withColumn("_mean", mean_of(by))
    for column in columns:
        if column in df.columns:
            out = out.withColumn(column, _mapped(column, _fields(df, column), lambda p: {c: p[c] - F.col("_mean")[c] for c in "xyz"}))
    return out.drop("_mean")


def transform(df: DataFrame, q: list[Column], t: list[Column], columns: tuple[str, ...] = ("atoms", "surface", "pharm")) -> DataFrame:
    """All positions turned and shifted; directions (vx, vy, vz) only turned."""
    m = rotation_matrix(q)
    out = df
    for column in columns:
        if column not in df.columns:
            continue
        names = _fields(df, column)

        def new(p: Column) -> dict[str, Column]:
            at = moved(m, t, p)
            return {c: at[c] for c in "xyz"}

        def new_directed(p: Column) -> dict[str, Column]:
            way = rotated(m, vec(*(p[f"v{c}"] for c in "xyz")))
            return {**new(p), **{f"v{c}": way[c] for c in "xyz"}}

        out = out.withColumn(column, _mapped(column, names, new_directed if "vx" in names else new))
    return out


def heavy(df: DataFrame, atoms: str = "atoms", number: str = "z_number") -> DataFrame:
    """Without hydrogens (atomic number 1)."""
    return df.withColumn(atoms, F.filter(atoms, lambda p: p[number] != 1))


def without_dummy_atoms(df: DataFrame, atoms: str = "atoms", number: str = "z_number") -> DataFrame:
    return df.withColumn(atoms, F.filter(atoms, lambda p: p[number] != 0))


def without_dummy_features(df: DataFrame, pharm: str = "pharm") -> DataFrame:
    return df.withColumn(pharm, F.filter(pharm, lambda p: p["ptype"] != DUMMY))


def picked(values: Column, indices: Column) -> Column:
    """Values at some places, e.g. heavy atoms' charges by their indices."""
    return F.transform(indices, lambda i: values[i])


def nearest_one_hot(values: Column) -> Column:
    """Place of the number nearest to 1 in a soft one-hot vector."""
    off = F.transform(values, lambda x: F.abs(x - 1))
    return (F.array_position(off, F.array_min(off)) - 1).cast("int")


def inertia(df: DataFrame, points: str = "atoms", key: str = "mol_id") -> DataFrame:
    """Tensor of inertia of the centered points, over their number: (key, xx, xy, xz, yy, yz, zz)."""
    centered = center(df.select(key, points), points, (points,))

    def total(term) -> Column:
        return F.aggregate(F.col(points), F.lit(0.0), lambda s, p: s + term(p)) / F.size(points)

    return centered.select(
        key,
        total(lambda p: p["y"] * p["y"] + p["z"] * p["z"]).alias("xx"), (-total(lambda p: p["x"] * p["y"])).alias("xy"), (-total(lambda p: p["x"] * p["z"])).alias("xz"),
        total(lambda p: p["x"] * p["x"] + p["z"] * p["z"]).alias("yy"), (-total(lambda p: p["y"] * p["z"])).alias("yz"), total(lambda p: p["x"] * p["x"] + p["y"] * p["y"]).alias("zz"),
    )


def principal_moments(tensor: DataFrame, key: str = "mol_id") -> DataFrame:
    """Eigenvalues of the tensor, descending, by the trigonometric closed form of a symmetric 3 x 3 matrix."""
    c = F.col
    mean = (c("xx") + c("yy") + c("zz")) / 3
    off = c("xy") * c("xy") + c("xz") * c("xz") + c("yz") * c("yz")
    a, b, d = c("xx") - mean, c("yy") - mean, c("zz") - mean
    p = F.sqrt((a * a + b * b + d * d + 2 * off) / 6)
    det = a * (b * d - c("yz") * c("yz")) - c("xy") * (c("xy") * d - c("yz") * c("xz")) + c("xz") * (c("xy") * c("yz") - b * c("xz"))
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(0.0))))) / 3
    high, low = mean + 2 * p * F.cos(phi), mean + 2 * p * F.cos(phi + 2.0943951023931953)
    return tensor.select(key, high.alias("m1"), (3 * mean - high - low).alias("m2"), low.alias("m3"))
