"""Best-fit packing of tokenised documents into sequences, with certified bin counts.

1. Each document becomes its token ids and an end mark; longer ones are cut into full sequences, with the shorter
   piece first.
2. Each block of pieces is packed by best-fit decreasing. Dual-feasible functions give a lower bound on the block's
   bins; a block that meets it is certified and done.
3. Blocks with a gap give their least filled bins to an exchange, are regrouped, and the documents are packed again;
   a group takes the new packing only if it needs fewer bins. Rounds go on while they save bins, ``rounds`` at most.
4. What remains open is reported: each block's bound, and the bound on all bins from the whole histogram of lengths,
   stand beside the number of sequences (``certificate``).

Every piece of the search is bounded: blocks hold at most ``BLOCK`` pieces, whatever the size of the corpus.

Defined cases: a null or empty text is the end mark alone; very long texts are tokenised whole and cut; equal pieces
are packed in the order of doc_id, piece and ids; repeated rows are packed once each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.common import Scratch, frugal, map_batches, text_rows, texts_of

CAPACITY = 2048
END_MARK = 0
BLOCK = 100_000
#: Splits text into the runs that are encoded one by one (the published pattern of this vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}


# ---------------------------------------------------------------- tokens


@lru_cache(maxsize=2)
def encoder(ranks_file: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(enc, text: str) -> np.ndarray:
    """The document's ids and the end mark. A special token's string in the text is that token."""
    ids = enc.encode(text, allowed_special="all") if "<|" in text else enc.encode_ordinary(text)
    ids.append(END_MARK)
    return np.array(ids, dtype="<u4")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, after a shorter first one where the length asks for it."""
    first = length % capacity
    starts = [0] * bool(first) + list(range(first, length, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length], strict=True)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def tokenise(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document. The vocabulary file (under 1 MB) is read here and sent to the executors."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, out = encoder(ranks.value), []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            ids = token_ids(enc, text)
            out += [(doc, i, start, n, zlib.crc32(ids[start : start + n].tobytes())) for i, (start, n) in enumerate(cut(len(ids), capacity))]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 5, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(text_rows(docs, id_col, text_col), rows, PIECES)


# ---------------------------------------------------------------- one block


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. ``room`` keeps, as bits, which gap sizes are open."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = room >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = open_bins[gap].pop()
            if not open_bins[gap]:
                room ^= 1 << gap
        else:
            gap, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > n:
            open_bins[gap - n].append(b)
            room |= 1 << (gap - n)
    return bins, offsets, used


def histogram(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    return np.bincount(lengths, minlength=capacity + 1)


def lower_bound(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of ``count[n]`` items of each length n needs, by two families of dual-feasible functions."""
    sizes = np.arange(capacity + 1)
    count = count.astype(np.float64)
    best = int(np.ceil((count * sizes).sum() / capacity))
    for k in range(1, capacity // 2 + 1):  # sizes over C - k count whole, those under k not at all
        if count[k] or count[capacity - k]:
            value = np.where(sizes > capacity - k, capacity, np.where(sizes < k, 0, sizes))
            best = max(best, int(np.ceil((count * value).sum() / capacity - 1e-9)))
    for k in range(1, 41):  # rounds (k + 1) x / C down, but for whole numbers
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes / capacity, (scaled // capacity) / k)
        best = max(best, int(np.ceil((count * value).sum() - 1e-9)))
    return best


def _worst_bins(bins: np.ndarray, lengths: np.ndarray, used: int, gap: int, share: float) -> np.ndarray:
    """Which bins to release: the least filled ones, at least ``share`` of all and several for each bin of the gap."""
    fill = np.bincount(bins, lengths, minlength=used)
    return np.argsort(fill, kind="stable")[: max(int(used * share), min(used, 8 * gap))]


# ---------------------------------------------------------------- all blocks


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {k: table.column(k).to_numpy() for k in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset") if k in table.column_names}


def _sorted(table: pa.Table) -> pa.Table:
    """One order whatever way the rows came, so that a task that runs again packs the same."""
    return table.sort_by([(k, "ascending") for k in ("doc_id", "piece", "length", "ids_crc32", "start")])


def _result(table: pa.Table, sequence: np.ndarray, offset: np.ndarray, opened: np.ndarray, bound: int) -> pa.RecordBatch:
    table = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
    for name, column in (("sequence_id", pa.array(sequence)), ("offset", pa.array(offset)), ("released", pa.array(opened)), ("bound", pa.array(np.full(len(table), bound), pa.int64()))):
        table = table.append_column(name, column)
    return table.combine_chunks().to_batches()[0]


STAGE = PACKED + ", released boolean, bound long"


def first_round(pieces: DataFrame, share: float, capacity: int = CAPACITY) -> DataFrame:
    """Packs each scanned partition in blocks. Sequence ids join the partition and a counter, so they never meet."""

    @frugal
    def run(batches):
        base = TaskContext.get().partitionId() << 34
        state = {"next": 0}

        def close(held):
            table = _sorted(pa.Table.from_batches(held))
            length = table.column("length").to_numpy()
            bins, offsets, used = best_fit_decreasing(length, capacity)
            bound = lower_bound(histogram(length, capacity), capacity)
            opened = np.zeros(used, dtype=bool)
            if used > bound:
                opened[_worst_bins(bins, length, used, used - bound, share)] = True
                full = np.bincount(bins, length, minlength=used) == capacity
                opened &= ~full
            out = _result(table, base + state["next"] + bins, offsets, opened[bins], bound)
            state["next"] += used
            return out

        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                held.append(batch.slice(at, BLOCK))
                n += len(held[-1])
                if n >= BLOCK:
                    yield close(held)
                    held, n = [], 0
        if n:
            yield close(held)

    return pieces.mapInArrow(run, STAGE)


def exchange(released: DataFrame, number: int, groups: int, share: float, capacity: int = CAPACITY) -> DataFrame:
    """Whole bins move to ``groups`` new groups; each packs its documents again and keeps the better packing."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        length, old = table.column("length").to_numpy(), table.column("sequence_id").to_numpy()
        names, old_bins = np.unique(old, return_inverse=True)
        bins, offsets, used = best_fit_decreasing(length, capacity)
        bound = lower_bound(histogram(length, capacity), capacity)
        if used < len(names):
            base = (number << 56) | (int(table.column("group")[0].as_py()) << 28)
            sequence = base + bins
        else:
            bins, offsets, used, sequence = old_bins, table.column("offset").to_numpy(), len(names), old
        opened = np.zeros(used, dtype=bool)
        if used > bound:
            opened[_worst_bins(bins, length, used, used - bound, share)] = True
        return pa.Table.from_batches([_result(table, sequence, offsets, opened[bins], bound)])

    dealt = released.drop("released", "bound").withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, STAGE)


def pack(docs: DataFrame, ranks_path: str, rounds: int = 8, share: float = 0.4, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there, and the bound on the bins of its block."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(tokenise(docs, ranks_path, capacity, id_col, text_col), "pieces")
    whole = pieces.where(F.col("length") == capacity)  # these are sequences by themselves
    alone = whole.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("bound"))
    done = [scratch.save(alone, "whole")]
    now = scratch.save(first_round(pieces.where(F.col("length") < capacity), share, capacity), "round0")

    def size(rows: DataFrame) -> tuple[int, int]:
        return rows.agg(F.count("*"), F.countDistinct("sequence_id")).first()

    for number in range(1, rounds + 1):
        released = now.where("released")
        n, before = size(released)
        if n == 0:
            break
        done.append(now.where(~F.col("released")))
        now = scratch.save(exchange(released, number, max(1, -(-n // (BLOCK // 2))), share, capacity), f"round{number}")
        if size(now)[1] == before:  # nothing was saved
            break
    done.append(now)
    names = [c.split()[0] for c in PACKED.split(", ")]
    out = done[0].select(*names, F.col("bound").alias("block_bound"))
    for part in done[1:]:
        out = out.unionByName(part.select(*names, F.col("bound").alias("block_bound")))
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences used, and the bound over the whole histogram of lengths (at most ``capacity`` rows)."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for row in packed.groupBy("length").count().collect():
        count[row["length"]] = row["count"]
    bound = lower_bound(count, capacity)
    return packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.lit(bound).cast("long").alias("bound"))


def certified(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packing with its certificate beside every piece: the gap is ``sequences - bound``."""
    return packed.crossJoin(F.broadcast(certificate(packed, capacity)))
