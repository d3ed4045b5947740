"""Screening: a panel of queries against a library, the best of each.

The panel is broadcast after a check of its size; the library is scanned once for all queries, and only the columns
of the mode are read. ``row_number() <= k`` becomes a limit per task before the shuffle and again after it, so a
query's shuffle holds k rows per task at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelake.operators import scoring

#: mode -> score of posed pairs
POSED: dict[str, Callable[..., DataFrame]] = {
    "vol": lambda p, lib, **kw: scoring.shape(p, lib, "atoms", **kw),
    "surf": lambda p, lib, **kw: scoring.shape(p, lib, "surface", **kw),
    "vol_esp": lambda p, lib, lam=0.1, **kw: scoring.esp(p, lib, lam, "atoms", **kw),
    "surf_esp": lambda p, lib, lam=0.3, **kw: scoring.esp(p, lib, lam * scoring_scale(), "surface", **kw),
    "vol_and_surf_esp": lambda p, lib, **kw: scoring.shaep(p, lib, **kw),
    "pharm": lambda p, lib, **kw: scoring.pharm(p, lib, **kw),
    "vol_color": lambda p, lib, **kw: scoring.pharm_combo(p, lib, directionless=True, **kw),
}


def scoring_scale() -> float:
    from shapelake.constants import LAM_SCALING

    return LAM_SCALING


def top_k(scores: DataFrame, k: int, query: str = "ref_id", item: str = "fit_id") -> DataFrame:
    """The k best items of each query: (query_id, rank, score, id). NULL and NaN scores never rank; ties go to the smaller id."""
    sound = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(item).asc()))
    return sound.withColumn("rank", place).where(F.col("rank") <= k).select(F.col(query).alias("query_id"), "rank", "score", F.col(item).alias("id"))


def screen(panel: DataFrame, library: DataFrame, mode: str = "vol", k: int = 1000, **options) -> DataFrame:
    """Posed screening in a mode."""
    from shapelake.modes import canonical, mode as known

    known(mode)
    return top_k(POSED[canonical(mode)](panel, library, **options), k)


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """The best of several partial results (query_id, rank, score, id)."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return top_k(whole.drop("rank"), k, "query_id", "id")


def full_scores(scores: DataFrame) -> DataFrame:
    """Every score, in no order of its own: (query_id, id, score)."""
    return scores.select(F.col("ref_id").alias("query_id"), F.col("fit_id").alias("id"), "score")


def size_buckets(pairs: DataFrame, a: str, b: str, n: int, tie: str) -> DataFrame:
    """Pairs dealt to n equal buckets of rising size (greater size, then smaller). One global order: for planning only."""
    return pairs.withColumn("bucket", F.ntile(n).over(Window.orderBy(F.greatest(a, b), F.least(a, b), tie)))


def size_bands(pairs: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """The same idea at scale: a range partitioning by the work a pair makes, without a global window."""
    return pairs.withColumn("_work", F.col(a).cast("long") * F.col(b)).repartitionByRange(n, "_work").drop("_work")
