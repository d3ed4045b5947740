"""Alignment of pairs: one Arrow map over rows that hold both molecules, no shuffle.

A task groups its rows into chunks of bounded work, so memory does not follow the batch. Each pair's best pose and
score are the output; the 4 x 4 transform is built from seven numbers, after any top-k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelake.constants import LAM_SCALING, SHAPE_ALPHA
from shapelake.functions.vectors import transform_matrix
from shapelake.modes import canonical, resolve
from shapelake.operators import kernels as K
from shapelake.operators import molecules
from shapelake.operators.clouds import cloud, panel_pairs

POSE = "ref_id long, fit_id long, score double, qw double, qx double, qy double, qz double, tx double, ty double, tz double"
#: Floats that one chunk's point-pair arrays hold at most.
CHUNK = 4_000_000


def _cloud(column: pa.Array, fields: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A cloud with its mask as weights; what is not a number becomes 0."""
    mask, values = cloud(column, fields)
    return mask.astype(np.float64), {k: np.nan_to_num(v) for k, v in values.items()}


def _xyz(c: dict[str, np.ndarray], prefix: str = "") -> np.ndarray:
    return np.stack([c[f"{prefix}{k}"] for k in "xyz"], axis=-1)


def _needs(mode: str) -> list[str]:
    return {"vol": ["atoms"], "vol_esp": ["atoms"], "surf": ["surface"], "surf_esp": ["surface"], "vol_and_surf_esp": ["atoms", "surface"], "pharm": ["pharm"], "vol_color": ["atoms", "pharm"]}[mode]


FIELDS = {"atoms": ["x", "y", "z", "q", "radius"], "surface": ["x", "y", "z", "q"], "pharm": ["ptype", "x", "y", "z", "vx", "vy", "vz"]}


def align_arrays(mode: str, ref: dict, fit: dict, *, alpha: float, lam: float | None, seeds: int, steps: int, lr: float, weight: float, probe: float, similarity: str = "tanimoto", trans_init: bool = False, coarse: int | None = None, avoid: str | None = None, avoid_min_dist: float = 2.0, avoid_weight: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best score, quaternion and shift for each pair of a chunk. ref and fit: column -> (mask, fields).

    ``trans_init`` adds ten turns about each reference point. ``coarse`` scores a grid of poses, ten a seed (or those of
    ``trans_init``), and searches on from so many of the best. ``avoid`` names reference points that cost where the
    fit's atoms come nearer than ``avoid_min_dist`` (scores can then fall below 0).
    """
    main = "surface" if mode.startswith("surf") else "pharm" if mode == "pharm" else "atoms"
    (ma, a), (mb, b) = ref[main], fit[main]
    pa_, pb = _xyz(a), _xyz(b)

    def poses(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(x) or not len(y):
            return np.array([[1.0, 0, 0, 0]]), np.zeros((1, 3))
        return K.seeds_at(x, y, x) if trans_init else K.coarse_grid(x, y, seeds)

    if trans_init or coarse:
        start = [poses(x[m > 0], y[n > 0]) for x, m, y, n in zip(pa_, ma, pb, mb, strict=True)]
        count = max(len(s[0]) for s in start)  # pairs with fewer poses repeat their first
        q, t = (np.stack([np.concatenate([s[i], np.repeat(s[i][:1], count - len(s[i]), axis=0)]) for s in start]) for i in range(2))
    else:
        q, t = K.seeds_of(pa_, ma, pb, mb, seeds)
    bonus = None
    if mode in ("vol", "surf"):
        channels = [(1.0, K.shape_channel(pa_, pb, ma, mb, alpha))]
    elif mode in ("vol_esp", "surf_esp"):
        channels = [(1.0, K.shape_channel(pa_, pb, ma, mb, alpha, a["q"], b["q"], lam if mode == "vol_esp" else lam * LAM_SCALING))]
    elif mode == "pharm":
        channels = [(1.0, K.pharm_channel(pa_, pb, ma, mb, a["ptype"], b["ptype"], _xyz(a, "v"), _xyz(b, "v")))]
    elif mode == "vol_color":
        (mp, p), (mr, r) = ref["pharm"], fit["pharm"]
        channels = [(1 - weight, K.shape_channel(pa_, pb, ma, mb, alpha)), (weight, K.pharm_channel(_xyz(p), _xyz(r), mp, mr, p["ptype"], r["ptype"]))]
    else:  # shape and the agreement of potentials are searched as one objective
        channels = [(1 - weight, K.shape_channel(pa_, pb, ma, mb, alpha))]
        (ms, s), (mz, z) = ref["surface"], fit["surface"]
        bonus = K.esp_score(((_xyz(s), s["q"], ms), (_xyz(z), z["q"], mz)), ((pa_, a["q"], a["radius"], ma), (pb, b["q"], b["radius"], mb)), probe, lam, weight)

    penalty = None
    if avoid is not None:
        (mv, v), (mf, f) = ref[avoid], fit["atoms"]
        spots, own = _xyz(v), _xyz(f)

        def penalty(q, t):
            return tuple(avoid_weight * x for x in K.clash(spots, mv, own, mf, avoid_min_dist, q, t))

    score = K.channel_score(channels, similarity, penalty, bonus)
    if coarse:
        q, t = K.best_poses(score, q, t, coarse)
    return K.optimise(score, q, t, steps, lr)


def align(pairs: DataFrame, mode: str = "vol", *, alpha: float | None = None, lam: float | None = None, num_repeats: int | None = None, max_num_steps: int | None = None, lr: float = 0.1, weight: float = 0.5, probe: float = 1.0, similarity: str = "tanimoto", trans_init: bool = False, coarse: int | None = None, avoid: str | None = None, avoid_min_dist: float = 2.0, avoid_weight: float = 1.0) -> DataFrame:
    """Best pose of every pair (ref_id, fit_id, ref_<column>, fit_<column>), as score, quaternion and shift."""
    name = canonical(mode)
    alpha = SHAPE_ALPHA if alpha is None else alpha
    lam = {"vol_esp": 0.1, "surf_esp": 0.3, "vol_and_surf_esp": 0.001}.get(name) if lam is None else lam
    spec = resolve(name, alpha, lam)
    options = {"alpha": alpha, "lam": lam, "seeds": num_repeats or spec.seeds, "steps": spec.steps if max_num_steps is None else max_num_steps, "lr": lr, "weight": weight, "probe": probe}
    options |= {"similarity": similarity, "trans_init": trans_init, "coarse": coarse, "avoid": avoid, "avoid_min_dist": avoid_min_dist, "avoid_weight": avoid_weight}
    columns = list(dict.fromkeys([*_needs(name), *([avoid, "atoms"] if avoid else [])]))

    def run(batches):
        for batch in batches:
            sides = [{c: _cloud(batch.column(f"{side}_{c}"), FIELDS[c]) for c in columns} for side in ("ref", "fit")]
            work = options["seeds"] * (10 if coarse else 1) * max(s.shape[1] for s in (sides[0][c][0] for c in columns)) * max(s.shape[1] for s in (sides[1][c][0] for c in columns))
            if name == "vol_and_surf_esp":  # its slopes hold three numbers for each surface point and atom
                work *= 3
            step = max(1, CHUNK // (8 * work))
            order = np.arange(len(batch))
            if name == "pharm":  # rows of alike many typed pairs together, as a chunk is as wide as its fullest row
                (ma, a), (mb, b) = (side["pharm"] for side in sides)
                order = K.meetings(a["ptype"], b["ptype"], ma, mb).argsort(kind="stable")
                step = max(1, step // 3)  # the listed pairs of a chunk then stay in a core's cache
            for at in range(0, len(batch), step):
                rows = order[at : at + step]
                part = [{c: (m[rows], {k: v[rows] for k, v in f.items()}) for c, (m, f) in side.items()} for side in sides]
                score, q, t = align_arrays(name, *part, **options)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("ref_id", "fit_id")), pa.array(score), *(pa.array(q[:, i].copy()) for i in range(4)), *(pa.array(t[:, i].copy()) for i in range(3))], names=[c.split()[0] for c in POSE.split(", ")])

    return pairs.select("ref_id", "fit_id", *[f"{s}_{c}" for s in ("ref", "fit") for c in columns]).mapInArrow(run, POSE)


def spread(rows: DataFrame, key: str = "mol_id") -> DataFrame:
    """Enough partitions for all cores: a few files of molecules are days of alignment. Larger scans stay as they are."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(2 * n, key)


def align_panel(panel: DataFrame, library: DataFrame, mode: str = "vol", **options) -> DataFrame:
    """Every panel molecule against every library molecule. The work is spread by molecule, not by the scan's files."""
    more = [options["avoid"], "atoms"] if options.get("avoid") else []
    return align(panel_pairs(panel, spread(library), list(dict.fromkeys([*_needs(canonical(mode)), *more]))), mode, **options)


def align_preset(pairs: DataFrame, refs: DataFrame, fits: DataFrame, mode: str = "vol", center: bool = False, **options) -> DataFrame:
    """Best pose of each listed pair (ref_id, fit_id) of molecules from two tables, with its 4 x 4 transform.

    A pair is listed once; the molecules meet it by equi-joins, so a table of any size is dealt by molecule. ``center``
    moves each molecule to the mean of its own heavy atoms first, and the pose is between the centered ones.
    """
    more = [options["avoid"], "atoms"] if options.get("avoid") else []
    columns = list(dict.fromkeys([*_needs(canonical(mode)), *more]))
    return with_transform(align(molecules.paired(pairs, refs, fits, tuple(columns), center), mode, **options))


def with_transform(poses: DataFrame) -> DataFrame:
    return poses.withColumn("transform", transform_matrix([F.col(c) for c in ("qw", "qx", "qy", "qz")], [F.col(c) for c in ("tx", "ty", "tz")]))


def screen_aligned(panel: DataFrame, library: DataFrame, mode: str = "vol", k: int = 1000, **options) -> DataFrame:
    """Aligned screening: (query_id, rank, score, id, transform). Transforms are built for the survivors only."""
    poses = align_panel(panel, library, mode, **options)
    packed = poses.withColumn("pose", F.struct("qw", "qx", "qy", "qz", "tx", "ty", "tz"))
    sound = packed.where(F.col("score").isNotNull() & ~F.isnan("score"))
    place = F.row_number().over(Window.partitionBy("ref_id").orderBy(F.col("score").desc(), F.col("fit_id").asc()))
    kept = sound.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("ref_id").alias("query_id"), "rank", "score", F.col("fit_id").alias("id"), "pose.*")
    return with_transform(kept).select("query_id", "rank", "score", "id", "transform")
