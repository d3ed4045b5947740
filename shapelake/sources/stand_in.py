"""Molecule profiles cut from the ``embeddings`` table, in a fixed layout of its 64 numbers.

points 0-20 (seven, times 10), charges 21-27, surface points 28-48 (times 10), surface potentials 49-55, radii 56-62
(1.2 plus the absolute value); pharmacophores sit on the points, look along the surface triples, and their types go
round all nine codes, Dummy included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.functions.vectors import unit, vec

N = 7


def _e(i: Column) -> Column:
    return F.col("embedding")[i].cast("double")


def _triple(i: Column, at: int) -> Column:
    return vec(*(10 * _e(3 * i + at + n) for n in range(3)))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol_id, label, atoms, surface, pharm): one row per molecule, features nested, nothing shuffled.

    atoms: idx, x, y, z, q, radius; surface: idx, x, y, z, q (the potential); pharm: idx, ptype, x, y, z, vx, vy, vz.
    """
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")

    def points(at: int, scalar: int, more: bool):
        def one(i: Column) -> Column:
            p = _triple(i, at)
            fields = [i.alias("idx"), *(p[c].alias(c) for c in "xyz"), _e(i + scalar).alias("q")]
            return F.struct(*fields, *([(1.2 + F.abs(_e(i + 56))).alias("radius")] if more else []))

        return F.transform(F.sequence(F.lit(0), F.lit(N - 1)), one)

    def feature(i: Column) -> Column:
        p, v = _triple(i, 0), unit(_triple(i, 28))
        ptype = F.pmod(7 * F.col("vec_id") + 3 * i, F.lit(9)).cast("int")
        return F.struct(i.alias("idx"), ptype.alias("ptype"), *(p[c].alias(c) for c in "xyz"), *(v[c].alias(f"v{c}") for c in "xyz"))

    return raw.select(
        F.col("vec_id").cast("long").alias("mol_id"),
        F.col("label").cast("int").alias("label"),
        points(0, 21, True).alias("atoms"),
        points(28, 49, False).alias("surface"),
        F.transform(F.sequence(F.lit(0), F.lit(N - 1)), feature).alias("pharm"),
    )


#: The same tables for DuckDB; each is a common table expression.
DUCK = {
    "atoms": "atoms AS (SELECT vec_id AS mol_id, i AS idx, " + ", ".join(f"10*embedding[3*i+{n + 1}]::DOUBLE AS {c}" for n, c in enumerate("xyz")) + ", embedding[i+22]::DOUBLE AS q, 1.2+abs(embedding[i+57]::DOUBLE) AS radius FROM embeddings, range(7) r(i))",
    "surface": "surface AS (SELECT vec_id AS mol_id, i AS idx, " + ", ".join(f"10*embedding[3*i+{n + 29}]::DOUBLE AS {c}" for n, c in enumerate("xyz")) + ", embedding[i+50]::DOUBLE AS q FROM embeddings, range(7) r(i))",
    "pharm": "pharm AS (SELECT a.mol_id, a.idx, ((7*a.mol_id+3*a.idx)%9)::INTEGER AS ptype, a.x, a.y, a.z, " + ", ".join(f"s.{c}/sqrt(s.x*s.x+s.y*s.y+s.z*s.z) AS v{c}" for c in "xyz") + " FROM atoms a JOIN surface s ON a.mol_id=s.mol_id AND a.idx=s.idx)",
}
