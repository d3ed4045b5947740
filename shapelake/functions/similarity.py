"""Similarities from three overlaps, as Columns. A quotient of nothing by nothing is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shapelake.constants import TVERSKY_SIGMA


def tanimoto(ab: Column, aa: Column, bb: Column) -> Column:
    return F.try_divide(ab, aa + bb - ab)


def tversky(ab: Column, aa: Column, bb: Column, sigma: float) -> Column:
    """Held to at most 1; only above, since an overlap is never negative."""
    return F.least(F.try_divide(ab, F.lit(sigma) * aa + F.lit(1 - sigma) * bb), F.lit(1.0))


def similarity(name: str, ab: Column, aa: Column, bb: Column) -> Column:
    if name == "tanimoto":
        return tanimoto(ab, aa, bb)
    if name not in TVERSKY_SIGMA:
        raise ValueError(f"unknown similarity {name!r}")
    return tversky(ab, aa, bb, TVERSKY_SIGMA[name])
