"""A store of molecule profiles: a manifest, then Parquet files, written with Spark's own atomic commit.

The manifest holds what is known before the first row, the schema included, and never changes. So a store whose build was
killed opens with the rows that were committed, and writers that append at once don't disturb each other.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapelake.modes import columns_for, mode

VERSION = 2
PHYSICAL = {"atoms": "atoms", "charges": "atoms", "surface": "surface", "esp": "surface", "atoms_with_h": "atoms", "charges_with_h": "atoms", "radii": "atoms", "pharm": "pharm"}


@dataclass(frozen=True)
class Manifest:
    version: int
    modes: list[str]
    columns: list[str]
    num_surf_points: int | None
    dtype: str
    pre_centered: bool
    schema: str
    n: int = 0  # counted on opening, from the files' footers


def write(profiles: DataFrame, path: str, *, modes: list[str], num_surf_points: int | None = None, dtype: str = "float32", shard_size: int = 100_000, pre_centered: bool = True, overwrite: bool = False, id_col: str = "mol_id") -> Manifest:
    """Store the columns that the modes need. An existing store is kept unless ``overwrite``.

    dtype float16 rounds positions to half precision (at rest they are floats): smaller files, about 0.01 off.
    """
    if dtype not in ("float16", "float32"):
        raise ValueError("dtype is float16 or float32")
    wanted = columns_for(modes)
    physical = sorted({PHYSICAL[c] for c in wanted})
    missing = [c for c in physical if c not in profiles.columns]
    if missing:
        raise ValueError(f"modes {modes} need the profile columns {missing}")
    rows = profiles
    if pre_centered:
        from shapelake.operators.profiles import center

        rows = center(rows, physical[0] if "atoms" not in rows.columns else "atoms", tuple(physical))
    rows = rows.select(F.col(id_col).cast("string").alias("id"), *physical)
    for c in physical:
        rows = rows.withColumn(c, F.transform(c, _at_rest(rows.schema[c].dataType.elementType, dtype)))
    how, spark = "overwrite" if overwrite else "errorifexists", profiles.sparkSession
    manifest = Manifest(VERSION, list(modes), sorted(wanted), num_surf_points, dtype, pre_centered, rows.schema.json())
    kept = {k: v for k, v in asdict(manifest).items() if k != "n"}
    spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode(how).text(f"{path}/manifest")
    spark.createDataFrame([], rows.schema).write.mode(how).parquet(f"{path}/profiles")
    rows.write.mode("append").option("maxRecordsPerFile", shard_size).parquet(f"{path}/profiles")
    return open_store(spark, path)[1]


def _at_rest(fields, dtype: str):
    """A rule for one struct: its doubles as they are stored, all else as it is."""

    def one(p):
        return F.struct(*[(_rounded(p[f.name], dtype) if f.dataType.typeName() == "double" else p[f.name]).alias(f.name) for f in fields])

    return one


def _rounded(x, dtype: str):
    if dtype == "float32":
        return x.cast("float")

    # ten explicit bits of mantissa, as half precision keeps, without leaving the JVM
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.when(x == 0, F.lit(1.0)).otherwise(F.abs(x)))) - 10)
    return (F.rint(x / scale) * scale).cast("float")


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, Manifest]:
    """The profiles, as they were written, and the manifest. Only columns that a query names are read."""
    manifest = Manifest(**json.loads(spark.read.text(f"{path}/manifest").first()[0]))
    if manifest.version != VERSION:
        raise ValueError(f"store version {manifest.version}, expected {VERSION}")
    rows = spark.read.schema(T.StructType.fromJson(json.loads(manifest.schema))).parquet(f"{path}/profiles")
    return rows, replace(manifest, n=rows.count())


def for_mode(store: tuple[DataFrame, Manifest], name: str) -> DataFrame:
    """The id and the columns of one mode; an error names what the store lacks."""
    rows, manifest = store
    lacking = [c for c in mode(name).columns if c not in manifest.columns]
    if lacking:
        raise ValueError(f"the store holds no {', '.join(lacking)}; it was written for modes {manifest.modes}")
    return rows.select("id", *sorted({PHYSICAL[c] for c in mode(name).columns}))


def shard(store: tuple[DataFrame, Manifest], file: str) -> DataFrame:
    """One file's profiles."""
    return store[0].where(F.input_file_name().endswith(file))


def append(profiles: DataFrame, path: str, id_col: str = "mol_id") -> None:
    """More profiles, in the store's own columns."""
    spark = profiles.sparkSession
    rows, _ = open_store(spark, path)
    out = profiles.select(F.col(id_col).cast("string").alias("id"), *[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "id"])
    out.write.mode("append").parquet(f"{path}/profiles")
