"""XYZ files: blocks from tables, and tables from files with many structures."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbols by atomic number, 0 for a dummy.
SYMBOLS = (
    "* H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn"
).split()
ATOM = re.compile(r"^\s*([A-Z][a-z]?)\s+(-?\d+\.\d+)\s+(-?\d+\.\d+)\s+(-?\d+\.\d+)\s*$")


def symbol(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), number.cast("int") + 1)


def atom_line(s: Column, x: Column, y: Column, z: Column) -> Column:
    """A symbol and three coordinates of eight places, NULL if one is. Python rounds the double itself, half to even, as
    C's printf does; Java's format rounds its shortest digits, half up."""

    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([None if None in r else "%s %15.8f %15.8f %15.8f" % r for r in rows], pa.string())

    return F.arrow_udf(run, "string")(s, x, y, z)


def blocks(atoms: DataFrame, key: str = "mol_id", drop_dummies: bool = False) -> DataFrame:
    """(key, xyz) from (key, idx, z_number, x, y, z): count, blank, an atom a line, blank. Order is by idx.

    An atom without a position counts and has no line; xyz is NULL if no atom has one.
    """
    rows = atoms.where("z_number <> 0") if drop_dummies else atoms
    line = atom_line(symbol(F.col("z_number")), *(F.col(c).cast("double") for c in "xyz"))
    each = rows.select(key, "idx", line.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("lines"))
    text = F.when(F.exists("lines", lambda p: p["line"].isNotNull()), F.array_join(F.transform("lines", lambda p: p["line"]), "\n"))
    return each.select(key, F.concat(F.size("lines").cast("string"), F.lit("\n\n"), text, F.lit("\n\n")).alias("xyz"))


def dummies(atoms: DataFrame) -> DataFrame:
    """The atoms that ``drop_dummies`` leaves out."""
    return atoms.where("z_number = 0")


def parse(text: str) -> list[list[tuple[str, float, float, float]]]:
    """Structures of one file: runs of atom lines, ended by the first other line that is not blank."""
    found: list[list[tuple[str, float, float, float]]] = []
    now: list[tuple[str, float, float, float]] = []
    for line in text.splitlines():
        if m := ATOM.match(line):
            now.append((m[1], float(m[2]), float(m[3]), float(m[4])))
        elif line.strip() and now:
            found.append(now)
            now = []
    return [*found, now] if now else found


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, structure, idx, symbol, x, y, z) of files with one or many structures. A file is one row, so its order holds."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(f, s, i, *atom) for f, text in zip(frame["file"], frame["value"], strict=True) for s, atoms in enumerate(parse(text)) for i, atom in enumerate(atoms)]
            yield pd.DataFrame(rows, columns=["file", "structure", "idx", "symbol", "x", "y", "z"])

    return files.mapInPandas(run, "file string, structure int, idx int, symbol string, x double, y double, z double")


def write(blocks_df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    blocks_df.select("xyz").write.mode(mode).text(path, lineSep="\n")
