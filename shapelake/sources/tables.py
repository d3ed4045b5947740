"""Other sources and sinks: result archives, targets, structure files, viewer exports."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Docking targets: box center, box size, ligand, pH. Fixed values.
TARGETS = (
    ("1iep", 15.61389189189189, 53.38013513513513, 15.454837837837842, 15, "Cc1ccc(cc1Nc2nccc(n2)c3cccnc3)NC(=O)c4ccc(cc4)CN5CCN(CC5)C", 6.5),
    ("3eml", -9.063639999999998, -7.1446, 55.86259999999999, 15, "c1cc(oc1)c2nc3nc(nc(n3n2)N)NCCc4ccc(cc4)O", 6.5),
    ("3ny8", 2.2488, 4.68495, 51.39820000000001, 15, "Cc1ccc(c2c1CCC2)OC[C@H]([C@H](C)NC(C)C)O", 7.5),
    ("4rlu", -0.7359999999999999, 22.75547368421052, -31.2368947368421, 15, "c1cc(ccc1C=CC(=O)c2ccc(cc2O)O)O", 7.5),
    ("4unn", 5.684346153846153, 18.191769230769232, -7.37157692307692, 15, "COc1cccc(c1)C2=CC(=C(C(=O)N2)C#N)c3ccc(cc3)C(=O)O", 7.4),
    ("5mo4", -44.901709677419355, 20.490354838709674, 8.483354838709678, 15, "c1cc(ccc1NC(=O)c2cc(c(nc2)N3CC[C@H](C3)O)c4ccn[nH]4)OC(F)(F)Cl", 7.5),
    ("7l11", -21.814812500000006, -4.216062499999999, -27.983781250000, 15, "CCCOc1cc(cc(c1)Cl)C2=CC(=CN(C2=O)c3cccnc3)c4ccccc4C#N", 6.0),
)
#: Arrays of an archive that are not per row. Fixed values.
SKIPPED_KEYS = ("ref_surf_resampling_scores", "ref_surf_esp_resampling_scores", "ref_mol_morgan_fp")


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t[0], *t[1:4], t[4], t[5], t[6]) for t in TARGETS], "pdb_id string, cx double, cy double, cz double, size int, ligand string, ph double")


def read_archives(spark: SparkSession, path: str, skip: tuple[str, ...] = SKIPPED_KEYS, below: int = 50) -> DataFrame:
    """(file, row, name, value) of .npz archives, in long form: 0-d values repeat, 1-d ones line up.

    The row count is the length of the archive's first 1-d array with fewer than ``below`` values; an archive without
    one is an error, and so is an array of another length or dimension that is not skipped.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    every = {k: archive[k] for k in archive.files}
                n = next((len(a) for a in every.values() if a.ndim == 1 and len(a) < below), None)
                if n is None:
                    raise ValueError(f"{name}: no 1-d array of fewer than {below} values")
                arrays = {k: a for k, a in every.items() if k not in skip}
                for k, a in arrays.items():
                    if a.ndim > 1 or (a.ndim and len(a) != n):
                        raise ValueError(f"{name}: {k} is of shape {a.shape}, expected {n} values or one")
                    rows += [(name, i, k, str(v)) for i, v in enumerate(a.tolist() if a.ndim else [a.item()] * n)]
            yield pd.DataFrame(rows, columns=["file", "row", "name", "value"])

    return files.mapInPandas(run, "file string, row int, name string, value string")


def wide(archives: DataFrame, names: list[str] | dict[str, str]) -> DataFrame:
    """One row per archive row, the named arrays as columns: strings, or of the types that a mapping gives."""
    out = archives.groupBy("file", "row").pivot("name", list(names)).agg(F.first("value"))
    return out.select("file", "row", *[F.col(n).cast(names[n]).alias(n) for n in names]) if isinstance(names, dict) else out


def apo_records(spark: SparkSession, path: str) -> DataFrame:
    """A PDB file's lines without ligands and waters, in order: (file, line_no, line)."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return whole.where(~F.col("line").startswith("HETATM"))


def feature_markers(pharm: DataFrame) -> DataFrame:
    """Viewer commands for features: a sphere at the anchor and an arrow along the direction (BILD text)."""
    colours = F.element_at(F.array(*[F.lit(c) for c in ("red", "blue", "orange", "forest green", "cyan", "navy", "magenta", "purple", "gray")]), F.col("f.ptype") + 1)
    each = pharm.select("mol_id", F.explode("pharm").alias("f"))
    ball = F.format_string("sphere %.3f %.3f %.3f 0.5", "f.x", "f.y", "f.z")
    ends = [F.col(f"f.{c}") + 2 * F.coalesce(F.col(f"f.v{c}"), F.lit(0.0)) for c in "xyz"]
    arrow = F.format_string("arrow %.3f %.3f %.3f %.3f %.3f %.3f 0.05 0.1", "f.x", "f.y", "f.z", *ends)
    text = F.concat(F.lit(".color "), colours, F.lit("\n"), ball, F.lit("\n"), arrow)
    return each.select("mol_id", F.col("f.idx").alias("idx"), text.alias("bild")).groupBy("mol_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "bild"))), lambda p: p["bild"]), "\n").alias("bild"))


def surface_markers(profiles: DataFrame) -> DataFrame:
    """Viewer commands for a surface coloured by potential, one marker a point."""
    from shapelake.operators.surfaces import esp_colours

    points = esp_colours(profiles)
    line = F.format_string(".color %.3f 0.0 %.3f\n.dot %.3f %.3f %.3f", "red", "blue", "x", "y", "z")
    return points.select("mol_id", "idx", line.alias("bild")).groupBy("mol_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "bild"))), lambda p: p["bild"]), "\n").alias("bild"))
