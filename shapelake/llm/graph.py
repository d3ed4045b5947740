"""Links among items that share bucket keys, and the components they form, without listing all pairs of a bucket.

A bucket elects a hub, and every member is compared with it, so a bucket of n members costs n - 1 comparisons. What
that leaves open is settled exactly:

* small buckets compare all their pairs;
* a larger bucket whose members are not yet in one component compares them with a second hub, the member nearest to
  what most members hold;
* then each remaining pair of different components that can still be linked is compared: the two must differ from
  that center in common elements, and prefix filtering over those finds such pairs by an equi-join.

So the components are those of all links between members of a common bucket. Nothing is collected to the driver but
counts. Members that are alike but not alike enough, such as copies of a short paragraph with one word changed in
each, meet only where their changes meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelake.llm.common import Scratch, frugal, join_counted, map_batches

SMALL = 4


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, label) for every end of the links (a, b); the label is the component's smallest node.

    Each round takes the smallest label among neighbours, then the label's own label, until nothing changes.
    """
    both = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}_edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}_0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        new = scratch.save(lower.join(jump, "low").select("node", F.least("low", "next").alias("new"), "label"), f"{name}_{step}")
        changed = new.where("new <> label").limit(1).count()
        scratch.drop(f"{name}_{step - 1}")
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            scratch.drop(f"{name}_edges")
            return labels


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Of two sorted sets of keys with weights."""
    total = float(wa.sum() + wb.sum())
    if total == 0:
        return 1.0
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    hit = b[at] == a if len(b) else np.zeros(len(a), dtype=bool)
    both = float(np.minimum(wa[hit], wb[at[hit]]).sum())
    return both / (total - both)


def pair_scores(sets: DataFrame):
    """A scorer of pairs (a, b) from sets (node, keys, weights): exact weighted Jaccard similarity."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = []
        for ka, wa, kb, wb in zip(*(batch.column(c).to_pylist() for c in ("ka", "wa", "kb", "wb")), strict=True):
            got.append(weighted_jaccard(np.frombuffer(ka, np.uint64), np.frombuffer(wa, np.float32), np.frombuffer(kb, np.uint64), np.frombuffer(wb, np.float32)))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got, pa.float64())], names=["a", "b", "similarity"])

    def score(pairs: DataFrame) -> DataFrame:
        kind = pairs.schema["a"].dataType.simpleString()
        left = sets.select(F.col("node").alias("a"), F.col("keys").alias("ka"), F.col("weights").alias("wa"))
        right = sets.select(F.col("node").alias("b"), F.col("keys").alias("kb"), F.col("weights").alias("wb"))
        return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "ka", "wa", "kb", "wb"), rows, f"a {kind}, b {kind}, similarity double")

    return score


def _pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    joined = left.withColumnRenamed("node", "x").join(right.withColumnRenamed("node", "y"), on).where("x <> y")
    return joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


# ---------------------------------------------------------------- differences from a center


def difference(x: tuple[np.ndarray, np.ndarray], h: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys on which two weighted sets differ, and by how much."""
    keys = np.union1d(x[0], h[0])
    off = np.zeros(len(keys), dtype=np.float64)
    off[np.searchsorted(keys, x[0])] += x[1]
    off[np.searchsorted(keys, h[0])] -= h[1]
    off = np.abs(off)
    return keys[off > 1e-9], off[off > 1e-9]


def _decoded(keys: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, np.uint64), np.frombuffer(weights, np.float32)


def centers(rows: DataFrame, sets: DataFrame, most: int = 15) -> DataFrame:
    """(key, ck, cw): what the majority of up to ``most`` members of each bucket hold.

    Any set would do as a reference, so taking it from a few members costs no exactness; a typical one prunes best.
    """
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
    few = rows.select("key", "node").withColumn("place", place).where(F.col("place") <= most).join(sets, "node").select("key", "keys", "weights")

    def run(table: pa.Table) -> pa.Table:
        own = [_decoded(k, w) for k, w in zip(table.column("keys").to_pylist(), table.column("weights").to_pylist(), strict=True)]
        keys, at, n = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True, return_counts=True)
        mean = np.bincount(at, np.concatenate([w for _, w in own]), minlength=len(keys)) / n
        held = 2 * n > len(own)
        return pa.table({"key": pa.array([table.column("key")[0].as_py()], pa.int64()), "ck": pa.array([keys[held].tobytes()], pa.binary()), "cw": pa.array([mean[held].astype(np.float32).tobytes()], pa.binary())})

    return few.groupBy("key").applyInArrow(run, "key long, ck binary, cw binary")


def differences(rows: DataFrame, around: DataFrame, sets: DataFrame, tau: float) -> DataFrame:
    """(key, node, elements, ws, total, excess) of rows (key, node): the difference from the bucket's center.

    total is its weight; excess is total - tau * the member's own weight.
    """
    kind = rows.schema["node"].dataType.simpleString()

    @frugal
    def run(batches):
        for batch in batches:
            keys, weights, totals, excess = [], [], [], []
            for ka, wa, kb, wb in zip(*(batch.column(c).to_pylist() for c in ("keys", "weights", "ck", "cw")), strict=True):
                own = _decoded(ka, wa)
                k, w = difference(own, _decoded(kb, wb))
                keys.append(k.view(np.int64)), weights.append(w)
                totals.append(float(w.sum())), excess.append(float(w.sum()) - tau * float(own[1].sum()))
            offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, d), *x]))) for d, x in ((np.int64, keys), (np.float64, weights))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), *lists, pa.array(totals, pa.float64()), pa.array(excess, pa.float64())], names=["key", "node", "elements", "ws", "total", "excess"])

    joined = rows.join(around, "key").join(sets, "node").select("key", "node", "keys", "weights", "ck", "cw")
    return joined.mapInArrow(run, f"key long, node {kind}, elements array<long>, ws array<double>, total double, excess double")


def undecided_pairs(scratch: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """(a, b): a superset of the pairs of one bucket and different components that can still be linked.

    rows: (key, node, label, elements, ws, total, excess, low, low_label), low being the bucket's least excess.

    With D the difference from any center, |a - b| >= |D_a| + |D_b| - 2 * (what both share), so a link asks D_a and
    D_b to share at least (excess_a + excess_b) / 2; and where that is not above zero, the two are linked for sure.
    The latter pairs are both linked to the member of least excess, so they are in one component already. All others
    differ from the center in common elements: ordered from rare to frequent, the elements up to a tail that weighs
    less than the bound must meet (prefix filtering), and what many copies have in common stays in the tail.
    """
    flat = rows.select("key", "node", "label", "total", "excess", "low", "low_label", F.inline(F.arrays_zip(F.col("elements").alias("element"), F.col("ws").alias("w"))))
    common = flat.groupBy("key", "element").agg(F.count("*").alias("df"), F.min("label").alias("one"), F.max("label").alias("other"))
    shared = flat.join(common.where("one <> other").select("key", "element", "df"), ["key", "element"])
    before = Window.partitionBy("key", "node").orderBy("df", "element").rowsBetween(Window.unboundedPreceding, -1)
    # elements that meet no other component's come first, as the rarest: their weight is spent, the rest is the tail
    tail = F.sum("w").over(Window.partitionBy("key", "node")) - F.coalesce(F.sum("w").over(before), F.lit(0.0)) + 1e-6
    ranked = scratch.save(shared.withColumn("tail", tail).select("key", "element", "node", "label", "tail", "excess", "low", "low_label"), f"{name}_ranked")
    far = ranked.where("excess > 0")

    def side(rows: DataFrame, n: str) -> DataFrame:
        return rows.select("key", "element", F.col("node").alias(f"x{n}"), F.col("label").alias(f"l{n}"), F.col("excess").alias(f"e{n}"), F.col("tail").alias(f"t{n}"))

    # at the first element that a pair has in common, both tails must still hold what it has to share
    enough = "least(t1, t2) >= (e1 + e2) / 2"
    lesser, greater = side(far.where("tail >= excess"), "1"), side(far.where("tail >= excess / 2"), "2")
    both = lesser.join(greater, ["key", "element"]).where(f"l1 <> l2 and (e1 < e2 or e1 = e2 and x1 < x2) and {enough}")
    outside, inside = side(far.where("label <> low_label and tail >= (excess + low) / 2"), "1"), side(ranked.where("excess <= 0 and tail >= (excess - low) / 2"), "2")
    across = outside.join(inside, ["key", "element"]).where(enough)
    both, across = (p.select(F.col("x1").alias("x"), F.col("x2").alias("y")) for p in (both, across))
    return both.unionByName(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


# ---------------------------------------------------------------- components of a bucketed similarity join


def link_components(scratch: Scratch, members: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Components of the links among members (node, key) of common buckets, and the scored pairs (a, b, similarity).

    sets: (node, keys, weights) of every member, as ``pair_scores`` takes them. Members must be distinct and all their
    buckets must have two members at least.
    """
    score = pair_scores(sets)
    counts = scratch.save(members.groupBy("key").agg(F.count("*").alias("n")).withColumn("size", F.col("n")), "counts")
    sized = scratch.save(join_counted(members, counts, "key", members.count()).withColumnRenamed("size", "n"), "sized")
    small, large = sized.where(F.col("n") <= SMALL).select("key", "node"), sized.where(F.col("n") > SMALL).select("key", "node")
    # one member of each key, by a hash, so that a node's buckets differ in their hubs
    hubs = large.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node")).alias("hub"))
    to_hub = large.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    known = {"scored": scratch.save(score(_pairs(small, small, ["key"]).unionByName(to_hub).distinct()), "scored_1")}
    known["labels"] = components(scratch, known["scored"].where(F.col("similarity") >= threshold), "round_1")

    def undecided(rows: DataFrame, name: str) -> DataFrame | None:
        """Rows (key, node, ...) of buckets with more than one component, with the label; None if there are none."""
        now = rows.join(known["labels"], "node", "left").withColumn("label", F.coalesce("label", "node"))
        split = now.groupBy("key").agg(F.min("label").alias("_one"), F.max("label").alias("_other")).where("_one <> _other").select("key")
        saved = scratch.save(now.join(split, "key"), name)
        return saved if saved.limit(1).count() else None

    def compare(pairs: DataFrame, name: str) -> None:
        fresh = scratch.save(score(pairs.distinct().join(known["scored"].select("a", "b"), ["a", "b"], "left_anti")), f"scored_{name}")
        known["scored"] = known["scored"].unionByName(fresh)
        links = fresh.where(F.col("similarity") >= threshold)
        if links.limit(1).count() == 0:
            return
        # only components meet now: the links become edges between labels, few against all links so far
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
        new = ends.join(known["labels"], "node", "left_anti").select("node", F.col("node").alias("label"))
        every = scratch.save(known["labels"].unionByName(new), f"every_{name}")
        edges = links.join(every.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(every.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        edges = edges.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        merged = components(scratch, edges, f"round_{name}").select(F.col("node").alias("label"), F.col("label").alias("to"))
        known["labels"] = every.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label"))

    def done() -> tuple[DataFrame, DataFrame]:
        labels = scratch.save(known["labels"], "labels")
        scratch.drop("counts", "sized", "open_2", "centers", "apart", "least", "open_3", "last_ranked")
        return labels, known["scored"]

    rows = undecided(large, "open_2")
    if rows is None:
        return done()
    # a second hub: of all members the one of least excess over its bucket's center
    apart = scratch.save(differences(rows.select("key", "node"), scratch.save(centers(rows, sets), "centers"), sets, (1 - threshold) / (1 + threshold)), "apart")
    least = scratch.save(apart.groupBy("key").agg(F.min_by("node", F.struct("excess", "node")).alias("hub"), F.min("excess").alias("low")), "least")
    named = rows.select("key", "node", "label").join(least.join(rows.select("key", F.col("node").alias("hub"), F.col("label").alias("hub_label")), ["key", "hub"]), "key")
    compare(named.where("label <> hub_label").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")), "2")
    rows = undecided(apart, "open_3")
    if rows is not None:
        hub_labels = least.join(known["labels"].withColumnRenamed("node", "hub"), "hub", "left").select("key", "low", F.coalesce("label", "hub").alias("low_label"))
        compare(undecided_pairs(scratch, rows.join(hub_labels, "key"), "last"), "3")
    return done()


def shared_keys(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The rows (node, key) whose key at least two different nodes have. ``rows``: a written table.

    Keys are counted before anything is gathered, and hot ones are not dealt by hash.
    """
    counts = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
    many = scratch.save(counts.where("low <> high").select("key", "n"), "many")
    return join_counted(rows, many, "key", rows.count()).select("node", "key").distinct()
