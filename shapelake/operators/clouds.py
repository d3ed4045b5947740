"""Nested clouds as padded numpy arrays, and maps over molecules that see a whole panel at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (mask, field -> values), both (rows, points); padding and points without a position have mask False.
Cloud = tuple[np.ndarray, dict[str, np.ndarray]]
#: A panel is sent to the executors only while its rows and the bytes of its clouds stay below these bounds.
PANEL_ROWS, PANEL_BYTES = 10_000, 64 << 20
#: Numbers that one array over point pairs holds at most.
CHUNK = 2_000_000


def cloud(column: pa.Array, fields: Iterable[str]) -> Cloud:
    """Straight from Arrow's buffers. A point with a NULL position is left out; other NULLs count as 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    width = max(int(lengths.max(initial=0)), 1)
    mask = np.arange(width)[None, :] < lengths[:, None]
    flat, places = column.flatten(), mask.copy()
    out = {}
    for name in fields:
        own = np.zeros(places.shape, dtype=np.int64 if name == "ptype" else np.float64)
        values = flat.field(name)
        if name in ("x", "y", "z") and values.null_count:
            mask[places] &= values.is_valid().to_numpy(zero_copy_only=False)
        own[places] = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        out[name] = own
    return mask, out


def rows_of(c: Cloud, rows) -> Cloud:
    return c[0][rows], {k: v[rows] for k, v in c[1].items()}


def xyz(c: Cloud, prefix: str = "") -> np.ndarray:
    return np.stack([c[1][f"{prefix}{k}"] for k in "xyz"], axis=-1)


def heavy_bytes(df: DataFrame, columns: Iterable[str]):
    """Bytes of the nested columns of a row, as a Column."""
    total = F.lit(0).cast("long")
    for c in columns:
        kind = df.schema[c].dataType
        width = 8 * len(kind.elementType.names) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else 8
        total = total + (F.coalesce(F.size(c), F.lit(0)) * width if isinstance(kind, T.ArrayType) else F.lit(8))
    return total


def panel_size(panel: DataFrame, columns: list[str]) -> tuple[int, int]:
    """Rows and bytes of a panel, counted up to one row above the bound."""
    n, size = panel.select(heavy_bytes(panel, columns).alias("b")).limit(PANEL_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n, size


def fits(size: tuple[int, int]) -> bool:
    return size[0] <= PANEL_ROWS and size[1] <= PANEL_BYTES


def panel_pairs(panel: DataFrame, library: DataFrame, columns: list[str]) -> DataFrame:
    """Each panel molecule with each library molecule: (ref_id, fit_id, ref_<c>, fit_<c>).

    The panel is broadcast only if its size, in rows and bytes, is proved small.
    """
    ref = panel.select(F.col("mol_id").alias("ref_id"), *[F.col(c).alias(f"ref_{c}") for c in columns])
    fit = library.select(F.col("mol_id").alias("fit_id"), *[F.col(c).alias(f"fit_{c}") for c in columns])
    return fit.crossJoin(F.broadcast(ref) if fits(panel_size(panel, columns)) else ref)


Side = dict[str, Cloud]
#: (reference side, fit side) -> name -> value per pair; the reference side may be a single row.
Kernel = Callable[[Side, Side], dict[str, np.ndarray]]
#: side -> name -> value per molecule.
Own = Callable[[Side], dict[str, np.ndarray]]


def _read(batch, fields: dict[str, list[str]], prefix: str = "") -> Side:
    return {c: cloud(batch.column(f"{prefix}{c}"), f) for c, f in fields.items()}


def _cut(side: Side, rows) -> Side:
    return {c: rows_of(v, rows) for c, v in side.items()}


def _step(ref: Side, fit: Side) -> int:
    """Pairs whose arrays over point pairs stay within ``CHUNK``."""
    return max(1, CHUNK // (max(c[0].shape[1] for c in ref.values()) * max(c[0].shape[1] for c in fit.values())))


def over_panel(panel: DataFrame, library: DataFrame, fields: dict[str, list[str]], kernel: Kernel, own: Own, names: list[str]) -> DataFrame:
    """(ref_id, fit_id, names...) of every panel molecule with every library molecule, without a join or a shuffle.

    ``kernel`` gets one panel molecule and a chunk of library rows; ``own`` what a molecule has by itself, found once
    a molecule, and named ``ref_<name>`` and ``fit_<name>``. A library row crosses to Python once, however large the
    panel. A panel beyond the bounds is joined in the ordinary way and scored pair by pair.
    """
    columns = list(fields)
    if not fits(panel_size(panel, columns)):
        return over_pairs(panel_pairs(panel, library, columns), fields, kernel, own, names)
    table = panel.select(F.col("mol_id").cast("long").alias("mol_id"), *columns).toArrow()  # bounded by the test above
    held = _read(table, fields)
    shared = library.sparkSession.sparkContext.broadcast((table.column("mol_id").to_numpy(), held, own(held)))

    def run(batches):
        ids, held, ref_own = shared.value
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            fit = _read(batch, fields)
            fit_own, step = own(fit), _step(held, fit)
            for k, ref_id in enumerate(ids):
                ref = _cut(held, slice(k, k + 1))
                parts = [kernel(ref, _cut(fit, slice(at, at + step))) for at in range(0, n, step)]
                found = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
                found |= {f"ref_{name}": np.full(n, v[k]) for name, v in ref_own.items()} | {f"fit_{name}": v for name, v in fit_own.items()}
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ref_id)), batch.column("mol_id"), *(pa.array(found[x], pa.float64()) for x in names)], names=["ref_id", "fit_id", *names])

    schema = "ref_id long, fit_id long, " + ", ".join(f"{n} double" for n in names)
    return library.select(F.col("mol_id").cast("long").alias("mol_id"), *columns).mapInArrow(run, schema)


def over_pairs(pairs: DataFrame, fields: dict[str, list[str]], kernel: Kernel, own: Own, names: list[str], keep: str = "") -> DataFrame:
    """The same for rows that hold both molecules: (ref_id, fit_id, ref_<c>, fit_<c>). ``keep``: further columns, as DDL."""
    kept = [k.split()[0] for k in keep.split(", ")] if keep else []

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            ref, fit = _read(batch, fields, "ref_"), _read(batch, fields, "fit_")
            step = _step(ref, fit)
            for at in range(0, len(batch), step):
                a, b = _cut(ref, slice(at, at + step)), _cut(fit, slice(at, at + step))
                found = kernel(a, b) | {f"ref_{n}": v for n, v in own(a).items()} | {f"fit_{n}": v for n, v in own(b).items()}
                cut = [batch.column(c).slice(at, step) for c in (*kept, "ref_id", "fit_id")]
                yield pa.RecordBatch.from_arrays([*cut, *(pa.array(found[n], pa.float64()) for n in names)], names=[*kept, "ref_id", "fit_id", *names])

    ids = [F.col(c).cast("long").alias(c) for c in ("ref_id", "fit_id")]
    schema = ", ".join([*([keep] if keep else []), "ref_id long, fit_id long", *(f"{n} double" for n in names)])
    return pairs.select(*kept, *ids, *[f"{s}_{c}" for s in ("ref", "fit") for c in fields]).mapInArrow(run, schema)
