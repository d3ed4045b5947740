"""Molecules and pairs built from atoms: what a row brings is kept, what it lacks is computed inside the row.

Nothing shuffles but the listing of pairs, whose molecules meet by equi-joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.operators import overlap, profiles, surfaces

POINTS = "array<struct<idx:int,x:double,y:double,z:double>>"
CLOUDS = ("atoms", "surface", "pharm")


def smooth_points(atoms: str, n: int, probe: float = 1.2, per_atom: int = 10, sharpness: float = 2.0) -> Column:
    """n points of the smooth surface about nested atoms, nested as well. Atoms that are NULL or none have no points."""

    @F.arrow_udf(POINTS)
    def run(column: pa.Array) -> pa.Array:
        counts, places = np.zeros(len(column), dtype=np.int64), [np.empty((0, 3))]
        ranks = [np.empty(0, dtype=np.int64)]
        for rows, m, rank, p in surfaces.smooth_slices(column, n, probe, per_atom, sharpness):
            order = np.lexsort((rank, m))
            counts[rows] = np.bincount(m, minlength=len(counts[rows]))
            places.append(p[order])
            ranks.append(rank[order])
        p = np.concatenate(places)
        each = pa.StructArray.from_arrays([pa.array(np.concatenate(ranks).astype(np.int32)), *(pa.array(p[:, i].copy()) for i in range(3))], names=["idx", "x", "y", "z"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), each)

    return run(F.col(atoms))


def molecule(rows: DataFrame, num_surf_points: int | None = None, density: float | None = None, probe: float = 1.2, per_atom: int = 10) -> DataFrame:
    """Profiles from rows with (mol_id, atoms) and, where they have them, surface and pharm.

    A surface that comes with the row is kept; else it gets ``num_surf_points`` smooth points, which go before a density.
    Surface points without a potential q get the Coulomb potential of the row's own charges. Without a surface and a
    number there is none. A density alone needs a mesh, which is a contract (see ``external``).
    """
    out = rows
    if "surface" not in rows.columns:
        if num_surf_points is None:
            if density is not None:
                raise ValueError("a surface of some density needs the contract mesh_surface; give num_surf_points for one without a mesh")
            return out
        out = out.withColumn("surface", smooth_points("atoms", num_surf_points, probe, per_atom))
    names = out.schema["surface"].dataType.elementType.names
    if "q" in names:
        return out
    return out.withColumn("surface", F.transform("surface", lambda p: F.struct(*[p[n].alias(n) for n in names], overlap.potential(p).alias("q"))))


def centered(rows: DataFrame, columns: tuple[str, ...] = CLOUDS) -> DataFrame:
    """Each molecule moved to the mean of its heavy atoms; of all atoms where none is heavy or none has a z_number."""
    if "z_number" not in rows.schema["atoms"].dataType.elementType.names:
        return profiles.center(rows, "atoms", columns)
    heavy = F.filter("atoms", lambda a: a["z_number"] != 1)
    return profiles.center(rows.withColumn("_heavy", F.when(F.size(heavy) > 0, heavy).otherwise(F.col("atoms"))), "_heavy", columns).drop("_heavy")


def paired(listed: DataFrame, refs: DataFrame, fits: DataFrame, columns: tuple[str, ...] = CLOUDS, center: bool = False) -> DataFrame:
    """(ref_id, fit_id, ref_<column>, fit_<column>) of each listed pair (ref_id, fit_id), molecules centered on request."""
    made = listed.select("ref_id", "fit_id")
    for side, rows in (("ref", refs), ("fit", fits)):
        own = centered(rows, columns) if center else rows
        made = made.join(own.select(F.col("mol_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns]), f"{side}_id")
    return made.select("ref_id", "fit_id", *[f"{s}_{c}" for s in ("ref", "fit") for c in columns])
