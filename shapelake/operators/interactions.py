"""Docking results and interaction fingerprints, as relations. ``rows``: (pose, key, n)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.constants import BAD_CHARGES


def matrix(rows: DataFrame, keys: list[str], reference: Column | None = None) -> DataFrame:
    """One row per pose, one column per key, 0 where an interaction is missing; the reference (a Column) is pose -1.

    ``keys`` is given, so the pivot needs no pass of its own and the schema is known.
    """
    pose = F.when(F.col("pose") == reference, F.lit(-1)).otherwise(F.col("pose")).cast("long") if reference is not None else F.col("pose")
    return rows.withColumn("pose", pose).groupBy("pose").pivot("key", keys).agg(F.sum("n")).fillna(0, keys)


def _reference(rows: DataFrame, reference: Column) -> DataFrame:
    return rows.where((F.col("pose") == reference) & (F.col("n") > 0)).select("key", F.col("n").alias("r"))


def similarity(rows: DataFrame, reference: Column) -> DataFrame:
    """Tanimoto of each pose's set of interactions with the reference's."""
    ref = _reference(rows, reference)
    size = ref.agg(F.count("*").alias("_size"))
    found = rows.where((F.col("pose") != reference) & (F.col("n") > 0)).join(ref, "key", "left")
    sets = found.groupBy("pose").agg(F.count("*").alias("_own"), F.count("r").alias("_both")).crossJoin(F.broadcast(size))
    return sets.select("pose", F.try_divide(F.col("_both"), F.col("_own") + F.col("_size") - F.col("_both")).alias("similarity"))


def recovery(rows: DataFrame, reference: Column) -> DataFrame:
    """Share of the reference's interactions, counted, that each pose has. Others cost nothing."""
    ref = _reference(rows, reference)
    size = ref.agg(F.sum("r").alias("_size"))
    poses = rows.where(F.col("pose") != reference)
    met = poses.join(ref, "key", "left").groupBy("pose").agg(F.sum(F.coalesce(F.least("r", "n"), F.lit(0))).alias("_met"))
    return met.crossJoin(F.broadcast(size)).select("pose", F.try_divide(F.col("_met"), F.col("_size")).alias("recovery"))


def without_bad_charges(rows: DataFrame, smiles: str = "smiles", bad: tuple[str, ...] = BAD_CHARGES) -> DataFrame:
    """Rows whose SMILES holds none of the substrings."""
    hit = None
    for b in bad:
        hit = F.contains(smiles, F.lit(b)) if hit is None else hit | F.contains(smiles, F.lit(b))
    return rows if hit is None else rows.where(~F.coalesce(hit, F.lit(False)))


def dock(ligands: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ordinal, smiles, energy): each distinct SMILES is docked once; NULL and failed ones have a NULL energy."""
    distinct = ligands.select("smiles").where("smiles is not null").distinct()
    done = run(distinct).groupBy("smiles").agg(F.min(F.when(~F.isnan("energy"), F.col("energy"))).alias("energy"))
    return ligands.join(done, "smiles", "left").select("ordinal", "smiles", "energy")


def dock_summary(docked: DataFrame) -> DataFrame:
    """How many failed, how many repeated an earlier SMILES, and the best energy."""
    return docked.agg(
        F.sum(F.col("energy").isNull().cast("int")).alias("num_failed"), (F.count("smiles") - F.countDistinct("smiles")).alias("repeats"), F.min("energy").alias("best_energy")
    )


def by_energy(docked: DataFrame, distinct: bool = False) -> DataFrame:
    """Export, best first, failures last; each input, or each SMILES once."""
    rows = docked.groupBy("smiles").agg(F.min("ordinal").alias("ordinal"), F.min("energy").alias("energy")) if distinct else docked
    return rows.orderBy(F.col("energy").asc_nulls_last(), "ordinal")
