"""Evaluation of generated molecules: per-row properties, failures kept as rows, and metrics over the whole set."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapelake.constants import LAM_SCALING, SHAPE_ALPHA
from shapelake.functions.similarity import tanimoto
from shapelake.operators import alignment, overlap, profiles, scoring, surfaces
from shapelake.operators.clouds import over_pairs

#: Properties of an unconditional evaluation; ``i`` numbers the samples. Those of later evaluations follow.
UNCONDITIONAL = "i long, is_valid boolean, is_valid_post_opt boolean, is_graph_consistent boolean, smiles string, smiles_post_opt string, molblock string, molblock_post_opt string, strain_energy double, rmsd double, SA_score double, QED double, logP double, fsp3 double, SA_score_post_opt double, QED_post_opt double, logP_post_opt double, fsp3_post_opt double, error string"


def fractions(samples: DataFrame) -> DataFrame:
    """Shares of all samples that are valid, valid after relaxation, and of one graph throughout."""
    def share(flag: str) -> Column:
        return F.try_divide(F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")), F.count("*"))

    return samples.agg(share("is_valid").alias("frac_valid"), share("is_valid_post_opt").alias("frac_valid_post_opt"), share("is_graph_consistent").alias("frac_consistent"))


def unique_fraction(samples: DataFrame, key: str = "smiles", flag: str = "is_valid") -> DataFrame:
    """Distinct keys over valid samples; 0 when none is valid."""
    n = F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int"))
    return samples.agg(F.coalesce(F.try_divide(F.countDistinct(key), n), F.lit(0.0)).alias("frac_unique"))


def with_failures(inputs: DataFrame, results: DataFrame, key: str = "i") -> DataFrame:
    """Every input's row, those without a result with NULL properties and an error."""
    found = results.withColumn("_there", F.lit(True))
    out = inputs.select(key).join(found, key, "left")
    error = F.when(F.col("_there").isNull(), F.lit("no result"))
    own = F.coalesce(F.col("error"), error) if "error" in results.columns else error
    return out.withColumn("error", own).drop("_there")


def evaluate(samples: DataFrame, one: Callable[[dict], dict], schema: str | T.StructType, key: str = "i") -> DataFrame:
    """``one(row) -> properties`` for each sample, in Arrow batches; what raises becomes a row with its error."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = kind.names

    def run(frames: Iterable):
        import pandas as pd

        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    rows.append({key: row[key], **one(row)})
                except Exception as e:  # a sample's failure is a result
                    rows.append({key: row[key], "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names).astype(object)

    return samples.mapInPandas(run, kind)


# ---------------------------------------------------------------- diversity


def bit_tanimoto(a: Column, b: Column) -> Column:
    """Of two fingerprints in one long each; NULL where neither has a bit."""
    return F.try_divide(F.bit_count(a.bitwiseAND(b)).cast("double"), F.bit_count(a.bitwiseOR(b)).cast("double"))


def similarity_matrix(prints: DataFrame, key: str = "mol_id", group: str | None = None) -> DataFrame:
    """(i, j, similarity) of unordered pairs, of one group where given. The output is a square by definition."""
    on = [group] if group else []
    a = prints.select(*on, F.col(key).alias("i"), F.col("bits").alias("_a"))
    b = prints.select(*on, F.col(key).alias("j"), F.col("bits").alias("_b"))
    pairs = (a.join(b, on) if on else a.crossJoin(b)).where("i < j")
    return pairs.select(*on, "i", "j", bit_tanimoto(F.col("_a"), F.col("_b")).alias("similarity"))


def diversity(prints: DataFrame, key: str = "mol_id", group: str | None = None, block: int = 1024) -> DataFrame:
    """Mean of 1 - similarity over unordered pairs, and their number; NULL for fewer than two.

    Rows are dealt to blocks of about ``block`` by a hash, and each pair of blocks is one task's group, whose pairs are
    counted as bits and never become rows. A row goes to as many groups as its group of fingerprints has blocks.
    """
    on = [group] if group else []
    rows = prints.where("bits is not null").select(*on, "bits", F.xxhash64(key).alias("_h"))
    sizes = rows.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    rows = rows.join(sizes, on) if on else rows.crossJoin(F.broadcast(sizes))  # one row without groups
    own = rows.withColumn("_own", F.pmod("_h", F.col("_blocks")).cast("int"))
    each = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    dealt = each.select(*on, "bits", "_own", low.alias("_low"), high.alias("_high"))
    kind = prints.schema[group].dataType.simpleString() if group else ""

    def run(table: pa.Table) -> pa.Table:
        bits, own, first = table.column("bits").to_numpy(), table.column("_own").to_numpy(), table.column("_low")[0].as_py()
        a = bits[own == first]
        b = bits[own != first] if table.column("_high")[0].as_py() != first else a
        total, n = 0.0, 0
        for i in range(len(a)):  # one row against a whole block
            other = a[i + 1 :] if b is a else b
            either = np.bitwise_count((a[i] | other).view(np.uint64)).astype(float)
            alike = np.bitwise_count((a[i] & other).view(np.uint64))
            real = either > 0
            total, n = total + float((1 - alike[real] / either[real]).sum()), n + int(real.sum())
        pairs = len(a) * (len(a) - 1) // 2 if b is a else len(a) * len(b)
        return pa.table({**({group: table.column(group).slice(0, 1)} if group else {}), "total": [total], "real": pa.array([n], pa.int64()), "pairs": pa.array([pairs], pa.int64())})

    parts = dealt.groupBy(*on, "_low", "_high").applyInArrow(run, ", ".join([*([f"{group} {kind}"] if group else []), "total double, real long, pairs long"]))
    found = parts.groupBy(*on).agg(F.try_divide(F.sum("total"), F.sum("real")).alias("diversity"), F.sum("pairs").alias("n_pairs"))
    return found.where("n_pairs > 0") if on else found


def diversity_to(prints: DataFrame, target: DataFrame) -> DataFrame:
    """Mean of 1 - similarity to the one target fingerprint, over those that have a similarity."""
    return prints.crossJoin(F.broadcast(target.limit(1).select(F.col("bits").alias("_t")))).agg(F.avg(1 - bit_tanimoto(F.col("bits"), F.col("_t"))).alias("diversity"))


# ---------------------------------------------------------------- against profiles


def _named(scores: DataFrame, name: str, key: str) -> DataFrame:
    return scores.select(F.col("fit_id").alias(key), F.col("score").alias(name))


def conditional(target: DataFrame, generated: DataFrame, key: str = "mol_id", aligned: bool = False, lam: float = 0.3 * LAM_SCALING, **options) -> DataFrame:
    """Generated molecules against the one profile they were asked for: similarity of surface, potential and features.

    As posed, or with ``aligned`` at each mode's best pose. Every generated molecule has a row; the scores of one that
    cannot be scored are NULL.
    """
    if aligned:
        scores = {n: alignment.align_panel(target, generated, m, **options) for n, m in (("sim_surf_target_aligned", "surf"), ("sim_esp_target_aligned", "surf_esp"), ("sim_pharm_target_aligned", "pharm"))}
    else:
        scores = {"sim_surf_target": scoring.shape(target, generated, "surface"), "sim_esp_target": scoring.esp(target, generated, lam, "surface"), "sim_pharm_target": scoring.pharm(target, generated)}
    out = generated.select(key)
    for name, found in scores.items():
        out = out.join(_named(found, name, key), key, "left")
    return out


def paired_variants(first: DataFrame, second: DataFrame, columns: tuple[str, ...] = ("surface", "pharm"), key: str = "mol_id") -> DataFrame:
    """Two profiles of each molecule side by side: (ref_id, fit_id, ref_<c>, fit_<c>), the ids equal."""
    sides = [rows.select(F.col(key).alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s, rows in (("ref", first), ("fit", second))]
    return sides[0].join(sides[1], F.col("ref_id") == F.col("fit_id"))


def consistency(first: DataFrame, second: DataFrame, key: str = "mol_id", lam: float = 0.3 * LAM_SCALING) -> DataFrame:
    """Each molecule's profile against another profile of itself (regenerated or relaxed), in one pass over the pairs."""
    pairs = paired_variants(first, second, key=key)
    terms = {"surf": ("surface", overlap.gauss(SHAPE_ALPHA)), "esp": ("surface", overlap.esp_gauss(SHAPE_ALPHA, lam)), "pharm": ("pharm", overlap.pharm_term())}
    sums = over_pairs(
        pairs, {"surface": [*scoring.XYZ, "q"], "pharm": scoring.DIRECTED},
        lambda a, b: {n: overlap.total(term, a[c], b[c]) for n, (c, term) in terms.items()}, lambda a: {n: overlap.own_total(term, a[c]) for n, (c, term) in terms.items()},
        [f"{side}{n}" for n in terms for side in ("", "ref_", "fit_")],
    )
    return sums.select(F.col("ref_id").alias(key), *[tanimoto(F.col(n), F.col(f"ref_{n}"), F.col(f"fit_{n}")).alias(f"sim_{n}_consistent") for n in terms])


def resampled_scores(rows: DataFrame, samples: int = 5, per_atom: int = 4, probe: float = 1.2) -> DataFrame:
    """(mol_id, ref_id, fit_id, score): shape scores between ``samples`` random surfaces of each molecule, seeded by number.

    A molecule's samples are few by definition, and so are their pairs.
    """
    drawn = None
    for n in range(samples):
        points = surfaces.exposed(rows, per_atom, probe, random_seed=n).groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("atom", "idx", "p"))).alias("own"))
        one = points.select("mol_id", F.lit(n).cast("long").alias("n"), F.transform("own", lambda s: s["p"]).alias("surface"))
        drawn = one if drawn is None else drawn.unionByName(one)
    ref, fit = (drawn.select("mol_id", F.col("n").alias(f"{s}_id"), F.col("surface").alias(f"{s}_surface")) for s in ("ref", "fit"))
    return scoring.shape_of_pairs(ref.join(fit, "mol_id").where("ref_id < fit_id"), "surface", keep="mol_id long").select("mol_id", "ref_id", "fit_id", "score")


def evaluate_all(target: DataFrame | None, generated: DataFrame, variants: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per molecule with every score that applies: against the target, posed, and against its own variants."""
    out = generated.select("mol_id") if target is None else conditional(target, generated)
    for name, other in (variants or {}).items():
        own = consistency(generated, other)
        out = out.join(own.select("mol_id", *[F.col(c).alias(f"{c}_{name}") for c in own.columns if c != "mol_id"]), "mol_id", "left")
    return out


# ---------------------------------------------------------------- objectives


def objective_of_conformers(target: DataFrame, conformers: DataFrame, key: str, lam: float = 0.3, **options) -> DataFrame:
    """Each conformer is aligned to the target by surface and potential; features are scored at that pose; of each ``key``
    the conformer with the greatest sum counts: (key, esp, pharm, score)."""
    poses = alignment.align_panel(target, conformers, "surf_esp", lam=lam, **options)
    moved = conformers.join(poses.withColumnRenamed("fit_id", "mol_id"), "mol_id")
    moved = profiles.transform(moved, [F.col(c) for c in ("qw", "qx", "qy", "qz")], [F.col(c) for c in ("tx", "ty", "tz")], ("pharm",))
    features = scoring.pharm(target, moved).select(F.col("fit_id").alias("mol_id"), F.col("score").alias("pharm"))
    scored = moved.select(key, "mol_id", F.round("score", 6).alias("esp")).join(features, "mol_id").select(key, "esp", F.round("pharm", 6).alias("pharm"))
    return best_conformer(scored, key, ["esp", "pharm"])



def memoised(requests: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``compute`` on distinct non-NULL keys, joined back: each key is worked on once, every request gets its row."""
    return requests.join(compute(requests.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")


def best_conformer(scored: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """For each key the conformer with the greatest sum of parts: those parts and the sum."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    best = scored.where(total.isNotNull()).withColumn("_total", total).groupBy(key).agg(F.max(F.struct("_total", *parts)).alias("best"))
    return best.select(key, *[F.col(f"best.{p}").alias(p) for p in parts], F.col("best._total").alias("score"))


def objective(requests: DataFrame, scored: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Best score of each requested key; -1 for those that failed."""
    best = scored.groupBy(key).agg(F.max(score).alias("score"))
    return requests.join(best, key, "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))


def stride_shard(rows: DataFrame, ordinal: str, task: int, tasks: int) -> DataFrame:
    """The rows that one of several jobs takes."""
    return rows.where(F.pmod(F.col(ordinal), F.lit(tasks)) == task)


def resample_bound(scores: DataFrame, group: str) -> DataFrame:
    """Mean of all pairwise scores of a group's resampled profiles."""
    return scores.groupBy(group).agg(F.avg("score").alias("upper_bound"), F.count("*").alias("n_pairs"))


def group_scores(rows: DataFrame, group: str, kind: str = "long") -> DataFrame:
    """(group, ref_id, fit_id, score): shape scores of all unordered pairs of a group's profiles, resampled ones of one
    reference and so few by nature. A pair is scored in its row, and means are partial before they shuffle."""
    ref, fit = (rows.select(group, F.col("mol_id").alias(f"{s}_id"), F.col("atoms").alias(f"{s}_atoms")) for s in ("ref", "fit"))
    return scoring.shape_of_pairs(ref.join(fit, group).where("ref_id < fit_id"), keep=f"{group} {kind}")


def lower_bound(scores: DataFrame, group: str, item: str, seed: int) -> DataFrame:
    """The score against one member drawn by a seeded hash, the same whatever the partitions."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), item), item))
    return scores.withColumn("_place", place).where("_place = 1").select(group, item, F.col("score").alias("lower_bound"))


def mean_field(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Fragments merged: the mean of a value at each point."""
    return rows.groupBy(*key).agg(F.avg(value).alias(value))


def union_with_id(parts: list[DataFrame], ids: list[str] | None = None) -> DataFrame:
    """Files collated by column name, missing columns NULL, each row with its file's id where wanted."""
    marked = [p.withColumn("file_id", F.lit(i)) for p, i in zip(parts, ids, strict=True)] if ids else parts
    out = marked[0]
    for p in marked[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def summary_and_rows(samples: DataFrame, prints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The two exports of an evaluation: one row of global metrics, and the samples by number."""
    whole = fractions(samples).crossJoin(unique_fraction(samples))
    if prints is not None:
        whole = whole.crossJoin(diversity(prints))
    return whole, samples.orderBy("i")
