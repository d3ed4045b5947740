"""Pieces that the corpus operators share: scratch tables, word hashing, Arrow maps, a key pre-filter."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK64 = (1 << 64) - 1
#: Share of labelled rows that the trained operators never learn from: crc32(doc_id as text) % 5 == 0.
HOLDOUT_MOD = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch tables


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only a local session may go without: it gets one in /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/shapelake-shared"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be closed when the interpreter ends
        pass


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long: batches to Python hold fewer rows than Spark's default, unless the session set its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive any executor.

    ``drop`` removes one as soon as nothing lazy refers to it; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


# ---------------------------------------------------------------- Arrow maps


def release() -> None:
    """Give freed memory back: Python workers are used again by later stages, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass


def frugal(run):
    """A map over batches that gives memory back when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            release()

    return wrapped


def map_batches(df: DataFrame, fn, schema: str | T.StructType, finish=None) -> DataFrame:
    """``fn(batch) -> batch | list of batches | None`` for each Arrow batch; ``finish()`` at the end of a task."""

    @frugal
    def run(batches):
        for batch in batches:
            out = fn(batch)
            yield from [] if out is None else [out] if isinstance(out, pa.RecordBatch) else out
        if finish is not None and (out := finish()) is not None:
            yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, keep_fn, column: str = "text") -> DataFrame:
    """Rows for which ``keep_fn(list of texts) -> bool array`` holds; every column passes through untouched."""

    @frugal
    def run(batches):
        for batch in batches:
            mask = keep_fn(texts_of(batch, column))
            yield batch.filter(pa.array(np.asarray(mask, dtype=bool)))

    return df.mapInArrow(run, df.schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts of a batch; a null text counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, under fixed names, whatever else the table holds."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees. A null doc_id hashes as the empty string."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HOLDOUT_MOD) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled rows (doc_id, text, y), none of them held out, chosen by a hash of doc_id.

    A document with contradicting labels is not used; of several texts with one doc_id the least counts. The chosen
    ids are at most ``bound`` rows, so that side is safe to broadcast; the texts are read in one scan.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    y = y.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_high")).where("y = _high").select("doc_id", "y")
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = text_rows(docs).join(F.broadcast(y), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def within_bytes(rows: DataFrame, most: int, column: str = "text") -> DataFrame:
    """Of a bounded sample, the rows by a hash of doc_id whose texts together stay within ``most`` bytes; one at least."""
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    sized = rows.withColumn("_n", F.row_number().over(order)).withColumn("_b", F.sum(F.octet_length(column).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return sized.where((F.col("_b") <= most) | (F.col("_n") == 1)).drop("_n", "_b")


# ---------------------------------------------------------------- joins with hot keys


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, total: int, parts: int = 256) -> DataFrame:
    """Inner join of rows (many a key) with keyed (one row a key, ``n`` its number of rows, of ``total`` in all).

    Keys with more than one in ``parts`` of all rows, so fewer than ``parts`` of them, are broadcast; the others are
    dealt by hash, and none of those can fill a task. Both inputs are read twice: pass written tables.
    """
    hot = F.col("n") * parts > total
    heavy, light = keyed.where(hot).drop("n"), keyed.where(~hot).drop("n")
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


# ---------------------------------------------------------------- hashing


class Memo(dict):
    """word -> 64-bit hash, kept per worker; emptied when it holds too many words."""

    def __init__(self, make=xxhash.xxh64_intdigest, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.make(word)
        return value

    def __reduce__(self):  # ship the rule, not the words
        return type(self), (self.make, self.most)


_rng = np.random.default_rng(2_718_281)
#: A random value per byte, and the powers by which places within a text weigh (with their inverses modulo 2^64).
LETTER = _rng.integers(0, 2**64, size=256, dtype=np.uint64)
_P = int(_rng.integers(0, 2**63)) * 2 + 1
_POWERS = [np.cumprod(np.append(np.uint64(1), np.full(1 << 14, x, dtype=np.uint64))) for x in (_P, pow(_P, -1, 1 << 64))]
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
PIECE = 1 << 20


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the blank-delimited words of a text's bytes.

    A word's hash is the sum of its letters' values times a power of its place in the word, mixed with its length;
    prefix sums over the text give all of them at once. Long texts go by pieces that end at a blank.
    """
    if len(raw) > PIECE:
        at = max((raw.rfind(b, 0, PIECE) for b in (b" ", b"\n", b"\t")), default=-1)
        at = at if at > 0 else min((i for b in (b" ", b"\n", b"\t") if (i := raw.find(b, PIECE)) >= 0), default=len(raw))
        if at < len(raw):
            parts, base = [], 0
            while base < len(raw):  # one level deep, whatever the length
                end = len(raw) if len(raw) - base <= PIECE else max(raw.rfind(b, base, base + PIECE) for b in (b" ", b"\n", b"\t"))
                if end <= base:
                    end = min((i for b in (b" ", b"\n", b"\t") if (i := raw.find(b, base + PIECE)) >= 0), default=len(raw))
                starts, ends, h = _spans(raw[base:end])
                parts.append((starts + base, ends + base, h))
                base = end if end == len(raw) else end + 1
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _spans(raw)


def powers(n: int) -> np.ndarray:
    """The first n powers by which places weigh."""
    while len(_POWERS[0]) < n:
        for i, whole in enumerate(_POWERS):  # twice as many: P^(m + k) = P^m * P^k
            _POWERS[i] = np.concatenate([whole, whole[1:] * whole[-1]])
    return _POWERS[0][:n]


def _spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    b = np.frombuffer(raw, dtype=np.uint8)
    blank = np.ones(n + 2, dtype=np.int8)
    blank[1:-1] = BLANK[b]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    weight = powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(LETTER[b] * weight[:n], out=prefix[1:])
    return starts, ends, mix((prefix[ends] - prefix[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64))


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text in lower case, in order."""
    return word_spans(lowered(text))[2]


def hashes(words: list[str], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; a shorter, non-empty sequence is one run."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return mix(out + np.uint64(n))


def odd_multipliers(count: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))


def long_lists(offsets, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, dtype=np.int32)), as_long(values))


# ---------------------------------------------------------------- key pre-filter


def bitmap_of(keys: DataFrame, column: str, least: int = 1 << 16, most: int = 1 << 27) -> tuple[int, bytes]:
    """A bitmap over hashed long keys with 16 bits a key, never above ``most`` bits (16 MB).

    It only spares work: a key outside it is surely absent, and whoever uses it settles the rest by a join.
    """
    n = keys.count()
    bits = least
    while bits < min(most, 16 * n):
        bits *= 2
    slot = F.pmod(F.xxhash64(column), F.lit(bits)) + 1  # Spark numbers positions from 1
    rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    whole = bytearray(bits // 8)
    for row in rows:  # at most bits / 32768 rows
        at = (row["part"] - 1) * 4096
        whole[at : at + 4096] = row["bits"][: len(whole) - at]
    return bits, bytes(whole)


def maybe_in(spark: SparkSession, slot_key: Column, bitmap: tuple[int, bytes]) -> Column:
    """True for every key of the bitmap and for a few others. Only the key column goes to Python."""
    bits, raw = bitmap
    shared = spark.sparkContext.broadcast(raw)

    @F.arrow_udf("boolean")
    def test(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False).astype(np.int64)
        table = np.frombuffer(shared.value, dtype=np.uint8)
        return pa.array((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return test(F.pmod(F.xxhash64(slot_key), F.lit(bits)))
