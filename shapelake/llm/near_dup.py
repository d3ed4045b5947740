"""MinHash near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles are runs of five words (blank-delimited, lower case). A shingle weighs tf * idf with
   idf = 1 + ``DAMPING`` * ln(1 / share) / ln(1 / ``RARE``), share being the part of all documents that hold it and
   ``RARE`` its least value that counts: whatever is rarer weighs 1 + ``DAMPING``. The frequent shingles are few (at
   most a document's mean number of shingles, over ``RARE``) and their document frequencies are counted exactly, so a
   weight depends on shares alone and means the same at every size of corpus. It is damped, so that a large group of
   near copies, whose shared shingles are frequent, is not torn apart by its few rare ones (README has figures).
2. Each text gets ``BANDS * ROWS`` consistent weighted samples: with r, c ~ Gamma(2, 1) and b uniform for a shingle
   and a sample, t = floor(ln w / r + b) and the sample is the shingle with the least ln c - r (t - b + 1), and its t.
   Two texts share a sample with the probability of their weighted Jaccard similarity.
3. Samples are banded; texts that share a band are verified by exact weighted Jaccard similarity of at least 0.8,
   and the links' components are the classes. Exact copies count as one text throughout.

At 0.8 one band agrees with probability 0.41, so 14 bands of 4 miss a pair with probability 0.0006.

Defined cases: null and empty texts are exact copies of each other; texts under five words have one shingle, all
their words; very long texts are shingled whole; a class is named by its smallest doc_id, and of rows that tie for its
place the one with the least digest, and then any of those equal in id and text, stays; a null doc_id takes part, but represents its class only if no row has an id; repeated rows fall in one
class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.llm.common import Scratch, as_long, bitmap_of, frugal, join_counted, maybe_in, mix, ngrams, odd_multipliers, text_rows, word_hashes
from shapelake.llm.graph import link_components, shared_keys, weighted_jaccard  # noqa: F401

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
RARE = 1e-3
DAMPING = 0.1
POOL_BITS = 16
CHUNK = 5


# ---------------------------------------------------------------- weights


def shingles(text: str) -> np.ndarray:
    return ngrams(word_hashes(text), SHINGLE)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each occurs."""
    own = np.sort(shingles(text))
    if len(own) == 0:
        return own, np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[starts], np.diff(np.append(starts, len(own)))


def candidates(texts: DataFrame, documents: int, rare: float = RARE) -> np.ndarray:
    """Sorted shingles that hold every one of document frequency ``rare * documents`` or more.

    A chunk of texts reports what at least half that share of its documents hold. A frequent shingle goes unreported
    in fewer than half as many documents as it needs, so its reports add up to the other half. That bounds the rest:
    at most a document's mean number of shingles, times 2 / ``rare``, can have so many. Chunks have ``CHUNK / rare``
    documents or more, so that a share of them is several; small partitions are read together for that.
    """
    least = int(np.ceil(CHUNK / rare))

    @frugal
    def run(batches):
        held: list[np.ndarray] = []
        ready = None  # the last full chunk waits, so that a short rest can join it

        def settle() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            return keys[starts], np.diff(np.append(starts, len(keys))).astype(np.int32)

        def out(keys, count, documents):
            enough = 2 * count >= rare * documents
            return pa.RecordBatch.from_arrays([as_long(keys[enough]), pa.array(count[enough], pa.int64())], names=["key", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(counted(text or "")[0])
                if len(held) == least:
                    if ready is not None:
                        yield out(*ready, least)
                    ready = settle()
        n, rest = len(held), settle() if held else None
        if ready is None and rest is not None:
            yield out(*rest, n)
        elif ready is not None and rest is None:
            yield out(*ready, least)
        elif ready is not None:
            keys, at = np.unique(np.concatenate([ready[0], rest[0]]), return_inverse=True)
            yield out(keys, np.bincount(at, np.concatenate([ready[1], rest[1]])).astype(np.int64), n + least)

    large = texts.select("text").coalesce(max(1, documents // least))
    reported = large.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = reported.where(2 * F.col("n") >= rare * documents).select("key").toArrow().column("key")
    return np.sort(found.to_numpy().view(np.uint64))


def document_frequencies(texts: DataFrame, documents: int, rare: float = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, how many documents hold each) of those in at least ``rare`` of all documents. Exact at any size."""
    wanted = candidates(texts, documents, rare)
    if len(wanted) == 0:
        return wanted, np.zeros(0, dtype=np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    @frugal
    def run(batches):
        total = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = counted(text or "")[0]
                total[positions(own, shared.value)[1]] += 1  # distinct, so no place comes twice
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["at", "n"])

    got = texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") >= rare * documents).toArrow()
    shared.unpersist()
    at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(at)
    return wanted[at[order]], n[order]


def positions(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the keys the sorted table holds, where)."""
    if len(table) == 0:
        return np.zeros(len(keys), dtype=bool), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    hit = table[at] == keys
    return hit, at[hit]


def idf_table(frequent: tuple[np.ndarray, np.ndarray], documents: int, rare: float = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(frequent shingles, float32 idf of each)."""
    keys, df = frequent
    share = np.clip(df / max(documents, 1), rare, 1.0)
    return keys, (1 + DAMPING * np.log(share) / np.log(rare)).astype(np.float32)


def weigh(keys: np.ndarray, counts: np.ndarray, idf: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.full(len(keys), np.float32(1 + DAMPING))
    hit, at = positions(keys, idf[0])
    out[hit] = idf[1][at]
    return counts * out


# ---------------------------------------------------------------- samples


class Sampler:
    """Draws are read from a fixed pool by a hash of (shingle, sample), so that every worker sees the same."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 1 << POOL_BITS
        r, self.b = rng.gamma(2.0, 1.0, n), rng.random(n, dtype=np.float32)
        self.r, self.over_r = r.astype(np.float32), (1 / r).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.by = odd_multipliers(samples, seed + 1)

    def __call__(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit value per sample: the chosen shingle with its t."""
        best, chosen = np.full(len(self.by), np.inf, dtype=np.float32), np.zeros(len(self.by), dtype=np.uint64)
        ln_w = np.log(weights).astype(np.float32)
        column = np.arange(len(self.by))
        for at in range(0, len(keys), 512):
            own, lw = keys[at : at + 512], ln_w[at : at + 512, None]
            draw = ((own[:, None] * self.by[None, :]) >> np.uint64(64 - POOL_BITS)).view(np.int64)
            b = self.b.take(draw, mode="clip")
            t = self.over_r.take(draw, mode="clip")
            t *= lw
            t += b
            np.floor(t, out=t)
            a = t - b
            a += 1
            a *= self.r.take(draw, mode="clip")
            np.subtract(self.ln_c.take(draw, mode="clip"), a, out=a)
            low = a.argmin(axis=0)
            least = a[low, column]
            better = least < best
            value = mix(own[low] ^ mix(t[low, column].astype(np.int64).astype(np.uint64)))
            best, chosen = np.where(better, least, best), np.where(better, value, chosen)
        return chosen


def bands(samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key per band, for one (samples,) or many (n, samples) signatures."""
    table = samples.reshape(*samples.shape[:-1], -1, rows)
    key = np.broadcast_to(np.arange(1, table.shape[-2] + 1, dtype=np.uint64), table.shape[:-1])
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + table[..., i])
    return key


# ---------------------------------------------------------------- Spark


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, digest): null texts count as empty, and the digest's 16 bytes stand for the text."""
    own = text_rows(docs, id_col, text_col)
    return own.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, digest, class_id (smallest doc_id of the class) and whether it is an exact copy."""
    scratch = scratch or Scratch(docs.sparkSession, "near_dup")
    spark, texts = docs.sparkSession, keyed(docs, id_col, text_col)
    n = docs.count()
    idf = spark.sparkContext.broadcast(idf_table(document_frequencies(texts, n), n))

    @frugal
    def sign(batches):
        sampler = Sampler()
        for batch in batches:
            keys = []
            for text in batch.column("text").to_pylist():
                own, counts = counted(text)
                keys.append(bands(sampler(own, weigh(own, counts, idf.value))).view(np.int64) if len(own) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), lists], names=["doc_id", "digest", "keys"])

    signed = scratch.save(texts.select("doc_id", "digest", "text").mapInArrow(sign, "doc_id long, digest binary, keys array<long>"), "signed")
    # exact copies have equal keys: one of them speaks for all
    distinct = signed.select("digest", "keys").dropDuplicates(["digest"])
    banded = scratch.save(distinct.select(F.col("digest").alias("node"), F.explode("keys").alias("key")), "banded")
    members = scratch.save(shared_keys(scratch, banded), "members")

    wanted = scratch.save(members.select("node").distinct().join(signed.groupBy(F.col("digest").alias("node")).agg(F.min("doc_id").alias("doc_id")), "node"), "wanted")
    sets = scratch.save(shingle_sets(texts, wanted, idf), "sets")
    labels, _ = link_components(scratch, members, sets, threshold)
    rows = signed.select("doc_id", "digest").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    rows = scratch.save(rows, "labelled")
    scratch.drop("signed", "banded", "many", "members", "wanted", "sets", "labels")
    idf.unpersist()
    heads = scratch.save(rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.count("*").alias("n")), "heads")
    return join_counted(rows, heads, "label", n).select("doc_id", "digest", "label", "class_id", "class_size")


def shingle_sets(texts: DataFrame, wanted: DataFrame, idf) -> DataFrame:
    """(node, keys, weights) of the wanted (node, doc_id) texts. A bitmap keeps all other texts out of the shuffle."""
    bitmap = bitmap_of(wanted.select("node"), "node")
    near = texts.where(maybe_in(texts.sparkSession, F.col("digest"), bitmap))
    chosen = near.join(wanted.withColumnRenamed("node", "digest").withColumnRenamed("doc_id", "first"), "digest").where(F.col("doc_id").eqNullSafe(F.col("first")))

    @frugal
    def run(batches):
        for batch in batches:
            made = [counted(t) for t in batch.column("text").to_pylist()]
            weights = [weigh(k, c, idf.value).astype(np.float32) if len(k) else np.zeros(0, np.float32) for k, c in made]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([k.tobytes() for k, _ in made], pa.binary()), pa.array([w.tobytes() for w in weights], pa.binary())], names=["node", "keys", "weights"])

    return chosen.select("digest", "text").mapInArrow(run, "node binary, keys binary, weights binary").dropDuplicates(["node"])


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each class left (the smallest id, then text), all columns kept.

    Only rows that may have to go (a bitmap's answer) meet the list of those that do go.
    """
    scratch = Scratch(docs.sparkSession, "near_dup")
    found = scratch.save(classes(docs, threshold, id_col, text_col, scratch).where("class_size > 1"), "classes")
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("digest").alias("kept"))
    fate = found.select("digest", "label", "class_id").distinct().join(heads, "label")
    fate = scratch.save(fate.select(F.col("digest").alias("_digest"), F.col("label").alias("_label"), F.col("class_id").alias("_class"), (F.col("digest") == F.col("kept")).alias("_kept")), "fate")
    # the row rides along as one struct, so no name of its columns can clash
    own = docs.select(F.struct("*").alias("_row"), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))).alias("_digest"))
    asked = own.withColumn("_maybe", maybe_in(docs.sparkSession, F.col("_digest"), bitmap_of(fate, "_digest")))
    sure = asked.where(~F.col("_maybe")).select("_row.*")
    joined = asked.where("_maybe").join(fate, "_digest", "left")
    single = joined.where(F.col("_label").isNull()).select("_row.*")
    chosen = joined.where(F.col("_kept") & F.col("_row").getField(id_col).cast("long").eqNullSafe(F.col("_class"))).dropDuplicates(["_label"]).select("_row.*")
    return sure.unionByName(single).unionByName(chosen)
