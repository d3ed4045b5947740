"""Quality by importance resampling: how much likelier a text is under a target model than under the raw one.

Two hashed n-gram models (one word and two words) are counted: the raw one over all documents, the target one over
all rows labelled good that are not held out. Their buckets are a power of two that grows with the square root of the
corpus, as the number of distinct words does by Heaps' law: ``2^BITS`` up to ``BASE_BYTES`` of text, and twice as many
for every four times as much. So a task's counts, and what it sends, stay bounded by the buckets, and the whole table
of ratios fits an executor (256 MB at 100 TB). A document's log weight is the log of the ratio of its two likelihoods, the sum over its n-grams of log p_target - log p_raw. Adding Gumbel noise
that a hash of the row gives, the k greatest keys are a sample without replacement in proportion to the weights.
k is a share of all rows; its threshold is found exactly by histograms of the keys, never by gathering rows.

Defined cases: null and empty texts have log weight 0; very long texts are counted whole, and their weights, sums of
many terms, are great either way; repeated rows get equal keys; all rows tied with the k-th key are selected, so
the sample can be longer than k by the ties; documents with contradicting labels are not in the target; an empty table
gives an empty result; without rows labelled good every log weight is 0; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.llm.common import Scratch, bitmap_of, frugal, held_out, maybe_in, ngrams, text_rows, texts_of, word_hashes

BITS, BASE_BYTES = 16, 1 << 27
CHUNK = 1 << 20
FILL, GRAM_BYTES = 32, 3  # a word of six bytes makes two n-grams
SHARE = 0.8


def bits_for(text_bytes: int) -> int:
    """log2 of the number of buckets for so much text."""
    times = max(1, -(-text_bytes // BASE_BYTES))
    return BITS + ((times - 1).bit_length() + 1) // 2


def buckets(text: str, bits: int = BITS) -> np.ndarray:
    """Bucket of every word and of every pair of neighbouring words."""
    h = word_hashes(text)
    return (np.concatenate([ngrams(h, 1), ngrams(h, 2) if len(h) > 1 else h[:0]]) >> np.uint64(64 - bits)).astype(np.int64)


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def good_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows labelled good and never otherwise, none of them held out. A bitmap keeps the other texts out of the shuffle.

    The labels grow with the corpus, so they are never broadcast: the join is the same one at every size.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    good = y.groupBy("doc_id").agg(F.min("y").alias("y")).where("y = 1").select("doc_id")
    near = text_rows(docs, id_col, text_col).where(maybe_in(docs.sparkSession, F.col("doc_id"), bitmap_of(good, "doc_id")))
    return near.join(good.hint("merge"), "doc_id")


def counts(texts: DataFrame, bits: int, total_bytes: int) -> DataFrame:
    """(bucket, n): n-grams per bucket over all texts.

    A task adds up all its texts before it sends anything, and has ``FILL`` n-grams or more for each bucket (small
    partitions are read together for that), so what is sent stays in proportion to the corpus as the buckets grow.
    """

    @frugal
    def run(batches):
        total, held, size = np.zeros(1 << bits, dtype=np.int64), [], 0
        for batch in batches:
            for text in texts_of(batch):
                held.append(buckets(text, bits))
                size += len(held[-1])
                if size > CHUNK:
                    total += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << bits)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    large = texts.select("text").coalesce(max(1, total_bytes // (FILL * GRAM_BYTES << bits)))
    return large.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratio(target: DataFrame, raw: DataFrame, bits: int, scratch: Scratch) -> np.ndarray:
    """log p_target - log p_raw per bucket. The target is smoothed towards the raw model, so unseen buckets say little.

    A bucket without target n-grams has one value whatever its raw count, so only the others come to the driver.
    """
    size, zero = 1 << bits, F.lit(0).cast("long")
    both = target.select("bucket", F.col("n").alias("t"), zero.alias("r")).unionByName(raw.select("bucket", zero.alias("t"), F.col("n").alias("r")))
    both = scratch.save(both.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("r").alias("r")), "counts")
    n_target, n_raw = both.agg(F.sum("t"), F.sum("r")).first()
    if not n_target or not n_raw:
        return np.zeros(size, dtype=np.float32)
    p_raw = (F.col("r") + 1.0) / float(n_raw + size)
    value = F.log((F.col("t") + float(size) * p_raw) / float(n_target + size)) - F.log(p_raw)
    out = np.full(size, np.log(size / (n_target + size)), dtype=np.float32)
    for batch in both.where("t > 0").select(F.col("bucket").cast("int").alias("bucket"), value.cast("float").alias("value")).toArrow().to_batches():
        out[batch.column("bucket").to_numpy()] = batch.column("value").to_numpy()
    scratch.drop("counts")
    return out


def log_weights(texts: list[str], ratio: np.ndarray) -> np.ndarray:
    out, bits = np.zeros(len(texts)), len(ratio).bit_length() - 1
    for i, text in enumerate(texts):
        own = ratio[buckets(text, bits)]
        out[i] = own.sum(dtype=np.float64)
    return out


def gumbel(row_hash: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise from 64-bit hashes."""
    u = ((row_hash.astype(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def top_threshold(keys: DataFrame, k: int, fan: int = 4096) -> int | None:
    """The k-th greatest value of the long column ``key``, by narrowing histograms of at most ``fan`` bins each."""
    if k <= 0:
        return None
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return None
    left = k  # how many of the wanted ones lie at or under ``high``
    while low < high:
        step = max(1, -(-(high - low + 1) // fan))
        bin_of = F.expr(f"(key - {low}L) div {step}L")  # whole numbers: keys lie within 2^61
        rows = keys.where(F.col("key").between(low, high)).groupBy(bin_of.alias("bin")).count().collect()
        for row in sorted(rows, key=lambda r: -r["bin"]):
            if left <= row["count"]:
                low, high = low + row["bin"] * step, min(high, low + (row["bin"] + 1) * step - 1)
                break
            left -= row["count"]
        else:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, log_weight, key and selected."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "importance")
    own = text_rows(docs, id_col, text_col)
    size = text_bytes(own)
    bits = bits_for(size)
    ratio = spark.sparkContext.broadcast(log_ratio(counts(good_texts(docs, labels, id_col, text_col), bits, size), counts(own, bits, size), bits, scratch))

    @frugal
    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            weight = log_weights(texts, ratio.value)
            key = weight + gumbel(batch.column("row").to_numpy().view(np.uint64))
            whole = np.round(np.clip(key, -1e6, 1e6) * 2**40).astype(np.int64)  # exact order, exact histograms
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight), pa.array(whole)], names=["doc_id", "log_weight", "key"])

    rows = own.withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    scored = scratch.save(rows.mapInArrow(run, "doc_id long, log_weight double, key long"), "scored")
    n = scored.count()
    cut = top_threshold(scored.select("key"), int(np.ceil(share * n)))
    return scored.select("doc_id", "log_weight", (F.col("key") / 2.0**40).alias("key"), (F.col("key") >= cut if cut is not None else F.lit(False)).alias("selected"))
