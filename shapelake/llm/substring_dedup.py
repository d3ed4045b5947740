"""Substring dedup: paragraphs by MinHash banding, and shorter cuts of them by content.

1. Paragraphs are lines. Those of ``LEAST`` words or more get a MinHash signature over five-word shingles, banded
   for a recall of at least ``RECALL`` at similarity 0.8 (``tune_bands``). Colliding paragraphs are verified by exact
   Jaccard similarity, and links form components; of each component the first occurrence stays.
2. A passage set into the middle of a line shares no whole paragraph. So texts are also cut at places chosen by their
   words, whatever the lines (where the hash of two neighbouring words is least within four places), which fall alike in every copy.
   Cuts are short, so a similarity of 0.8 over shingles leaves only equal ones: they collide on one band, a hash of
   all their words. In a document, cuts that stand elsewhere earlier and lie within ``JOIN`` words of each other (a
   line break or a changed word may part them) go if they have ``LEAST`` words together.

"First" is by a hash of the row (doc_id and text), so that it does not depend on partitions or order. An occurrence
is one long: 44 bits of the row's hash and the ordinal modulo 2^20. A removal names the cut's own hash too, which is
checked when it is applied, so that neither rows with the same 44 bits nor ordinals 2^20 apart lose anything else;
equal cuts of one document exactly 2^20 ordinals apart count as one.

Lines under ``LEAST`` words are not compared as paragraphs; their words are covered by the cuts, which ignore lines.

Defined cases: null and empty texts have no paragraphs and stay as they are; very long texts are cut whole; exact copies of a document lose all but
the paragraphs too short to count; rows that agree in doc_id and text are one document; an empty table gives an empty
result; other columns are ignored (``remove_from`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.llm.common import Scratch, as_long, bitmap_of, frugal, join_counted, long_lists, lowered, maybe_in, mix, ngrams, odd_multipliers, powers, text_rows, word_spans
from shapelake.llm.graph import link_components, shared_keys
from shapelake.llm.near_dup import bands

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.995
ROWS = 3
LEAST = 18  # words that a removed span has at least
JOIN = 24  # words that may part two cuts of a span
RADIUS = 4  # a cut's pair of words has the least hash among so many places on either side
LONGEST = 64  # words of a cut
ORDINAL_BITS = 20


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` values that catches pairs at the threshold with this probability."""
    count = 1
    while 1 - (1 - threshold**rows) ** count < recall:
        count += 1
    return count


BY = odd_multipliers(tune_bands() * ROWS, 31)


class Cuts:
    """A text's lines and cuts, found again in the same way whenever they are needed."""

    def __init__(self, text: str):
        self.text, raw = text, lowered(text)
        starts, _, self.hash = word_spans(raw)
        breaks = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
        self.line_of = np.searchsorted(breaks, starts)
        self.per_line = np.bincount(self.line_of, minlength=len(breaks) + 1)
        self.line_start = np.concatenate([[0], np.cumsum(self.per_line)])
        n = int(self.line_start[-1])
        self.start = self._starts(n)
        self.end = np.append(self.start[1:], n)
        length = self.end - self.start
        within = np.arange(n) - np.repeat(self.start, length)
        if n:
            power = np.cumprod(np.full(LONGEST, 0xD6E8FEB86659FD93, dtype=np.uint64))
            self.key = mix(np.add.reduceat(mix(self.hash) * power[within], self.start) + length.astype(np.uint64))
        else:
            self.key = np.zeros(0, dtype=np.uint64)

    def _starts(self, n: int) -> np.ndarray:
        if n == 0:
            return np.zeros(0, dtype=np.int64)
        least = np.uint64(2**64 - 1)
        pair = np.full(n, least)
        pair[:-1] = mix(self.hash[:-1] * np.uint64(3) + self.hash[1:])
        cut = pair < least
        for shift in range(1, min(RADIUS, n - 1) + 1):  # strictly least to the left, at most as great to the right
            cut[shift:] &= pair[:-shift] > pair[shift:]
            cut[:-shift] &= pair[shift:] >= pair[:-shift]
        cut[0] = True
        starts = np.flatnonzero(cut)
        gaps = np.diff(np.append(starts, n))
        if gaps.max() > LONGEST:
            starts = np.concatenate([np.arange(a, a + g, LONGEST) for a, g in zip(starts.tolist(), gaps.tolist(), strict=True)])
        return starts

    def paragraphs(self) -> np.ndarray:
        """Ordinals of the lines that are long enough to be compared."""
        return np.flatnonzero(self.per_line >= LEAST)

    def line_keys(self) -> np.ndarray:
        """A hash of each line's words in order; 0 for a line without any."""
        out = np.zeros(len(self.per_line), dtype=np.uint64)
        full = np.flatnonzero(self.per_line)
        if len(full):
            within = np.arange(len(self.hash)) - self.line_start[self.line_of]
            sums = np.add.reduceat(mix(self.hash) * powers(int(self.per_line.max()))[within], self.line_start[full])
            out[full] = mix(sums + self.per_line[full].astype(np.uint64))
        return out

    def line_shingles(self, i: int) -> np.ndarray:
        return np.unique(ngrams(self.hash[self.line_start[i] : self.line_start[i + 1]], SHINGLE))

    def signatures(self, chosen: np.ndarray) -> np.ndarray:
        """(lines, samples) MinHash values of some paragraphs."""
        grams = ngrams(self.hash, SHINGLE)
        spans = [(int(self.line_start[i]), int(self.line_start[i + 1]) - SHINGLE + 1) for i in chosen]
        at = np.concatenate([np.arange(a, b) for a, b in spans])
        starts = np.concatenate([[0], np.cumsum([b - a for a, b in spans])[:-1]])
        own = grams[at]
        return np.stack([np.minimum.reduceat(mix_cheap(own * m), starts) for m in BY], axis=1)

    def without(self, lines: set[int], cuts: np.ndarray) -> tuple[str, int]:
        """The text without some lines and without some cuts (a mask); and how many words went."""
        gone = np.repeat(cuts, self.end - self.start) if len(cuts) else np.zeros(0, dtype=bool)
        out, removed = [], 0
        for i, line in enumerate(self.text.split("\n")):
            own = gone[self.line_start[i] : self.line_start[i + 1]]
            if i in lines or (len(own) and own.all()):
                removed += len(own)
            elif not own.any():
                out.append(line)
            else:
                removed += int(own.sum())
                words = line.encode("utf-8", "surrogatepass").split()  # blanks as in the hashes
                out.append(b" ".join([w for w, g in zip(words, own.tolist(), strict=True) if not g]).decode("utf-8", "surrogatepass"))
        return "\n".join(out), removed


def mix_cheap(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(29))


def occurrences(rid: int, ordinals: np.ndarray) -> np.ndarray:
    """One value per (row, ordinal)."""
    base = np.uint64((rid & (1 << 64) - 1) >> ORDINAL_BITS << ORDINAL_BITS)
    return base | (ordinals & ((1 << ORDINAL_BITS) - 1)).astype(np.uint64)


def owner(occurrence: str) -> Column:
    return F.shiftright(occurrence, ORDINAL_BITS)


# ---------------------------------------------------------------- Spark


def rowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = text_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return own.withColumn("rid", F.xxhash64("doc_id", "text"))


UNITS = "kind byte, key long, occurrence long, keys array<long>"


def units(rows: DataFrame) -> DataFrame:
    """Every cut (kind 0: key, occurrence) and every long line (kind 1: key, occurrence, band keys)."""

    @frugal
    def run(batches):
        for batch in batches:
            kinds, keys, places, offsets, values = [], [], [], [0], []
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = Cuts(text)
                n, lines = len(own.key), own.paragraphs()
                if n:
                    kinds.append(np.zeros(n, np.int8)), keys.append(own.key), places.append(occurrences(rid, np.arange(n)))
                    offsets += [offsets[-1]] * n
                if len(lines):
                    table = own.signatures(lines)
                    kinds.append(np.ones(len(lines), np.int8))
                    keys.append(own.line_keys()[lines])
                    places.append(occurrences(rid, lines))
                    values.append(bands(table, ROWS).ravel())
                    offsets += [offsets[-1] + (k + 1) * tune_bands() for k in range(len(lines))]
                if sum(map(len, keys)) > 200_000:
                    yield _unit_batch(kinds, keys, places, offsets, values)
                    kinds, keys, places, offsets, values = [], [], [], [0], []
            if keys:
                yield _unit_batch(kinds, keys, places, offsets, values)

    return rows.select("rid", "text").mapInArrow(run, UNITS)


def _unit_batch(kinds, keys, places, offsets, values) -> pa.RecordBatch:
    lists = long_lists(offsets, np.concatenate([np.zeros(0, np.uint64), *values]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), as_long(np.concatenate(keys)), as_long(np.concatenate(places)), lists], names=["kind", "key", "occurrence", "keys"])


def repeated(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Of rows (key, occurrence) of a written table, all but each key's first. Hot keys are not dealt by hash."""
    counts = rows.groupBy("key").agg(F.min("occurrence").alias("first"), F.max("occurrence").alias("last"), F.count("*").alias("n"))
    firsts = scratch.save(counts.where("first <> last").select("key", "first", "n"), "firsts")
    return join_counted(rows, firsts, "key", rows.count()).where("occurrence <> first").select("key", "occurrence")


def line_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, keys, weights) of the wanted lines (node, occurrence): their shingles, each of weight one."""
    lists = wanted.groupBy(owner("occurrence").alias("owner")).agg(F.collect_list(F.struct("node", F.expr(f"cast(occurrence & {(1 << ORDINAL_BITS) - 1} as int) as line"))).alias("lines"))
    chosen = owners(rows, lists, "lines")[0].select("text", "lines")

    @frugal
    def run(batches):
        for batch in batches:
            nodes, keys = [], []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                own = Cuts(text)
                line_keys = own.line_keys()
                for x in lines:
                    for i in range(x["line"], len(own.per_line), 1 << ORDINAL_BITS):
                        if own.per_line[i] >= LEAST and int(line_keys[i]) == x["node"] & (1 << 64) - 1:
                            nodes.append(x["node"]), keys.append(own.line_shingles(i))
                            break
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([np.ones(len(k), np.float32).tobytes() for k in keys], pa.binary())], names=["node", "keys", "weights"])

    return chosen.mapInArrow(run, "node long, keys binary, weights binary").dropDuplicates(["node"])


def owners(rows: DataFrame, lists: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows that some list names, with the list; and all others. A bitmap keeps most of the latter out of the shuffle."""
    asked = rows.withColumn("owner", owner("rid")).withColumn("maybe", maybe_in(rows.sparkSession, F.col("owner"), bitmap_of(lists, "owner")))
    joined = asked.where("maybe").join(lists, "owner", "left")
    rest = asked.where("not maybe").select(*rows.columns).unionByName(joined.where(F.col(column).isNull()).select(*rows.columns))
    return joined.where(F.col(column).isNotNull()).select(*rows.columns, column), rest


def removals(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(owner, gone): for a row, the cuts (kind 0) and lines (kind 1) that stand elsewhere first, with their keys."""
    found = scratch.save(units(rows), "units")
    cuts = repeated(scratch, found.where("kind = 0").select("key", "occurrence"))
    lines = found.where("kind = 1")
    distinct = lines.groupBy("key").agg(F.min("occurrence").alias("occurrence"), F.first("keys").alias("keys"))
    banded = scratch.save(distinct.select(F.col("key").alias("node"), F.explode("keys").alias("key")), "banded")
    members = scratch.save(shared_keys(scratch, banded), "members")
    scratch.drop("banded", "many")
    wanted = lines.select(F.col("key").alias("node"), "occurrence").join(members.select("node").distinct(), "node").groupBy("node").agg(F.min("occurrence").alias("occurrence"))
    sets = scratch.save(line_sets(rows, scratch.save(wanted, "wanted")), "sets")
    labels, _ = link_components(scratch, members, sets, THRESHOLD)
    clustered = lines.select("key", "occurrence").join(labels.select(F.col("node").alias("key"), "label"), "key")
    firsts = clustered.groupBy("label").agg(F.min("occurrence").alias("first"))
    near = clustered.join(firsts, "label").where("occurrence <> first").select("key", "occurrence")
    both = cuts.withColumn("kind", F.lit(0)).unionByName(near.withColumn("kind", F.lit(1)))
    low = F.expr(f"cast(occurrence & {(1 << ORDINAL_BITS) - 1} as int)")
    gone = scratch.save(both.groupBy(owner("occurrence").alias("owner")).agg(F.collect_list(F.struct("kind", low.alias("at"), "key")).alias("gone")), "gone")
    scratch.drop("units", "firsts", "members", "wanted", "sets", "labels")
    return gone


def apply(text: str, gone: list[dict]) -> tuple[str, int]:
    """The text without what is named, as far as it is really there: whole lines, and groups of cuts of ``LEAST`` words."""
    own = Cuts(text)
    lines, mask, line_keys = set(), np.zeros(len(own.key), dtype=bool), own.line_keys()
    for x in gone:
        key = x["key"] & (1 << 64) - 1
        if x["kind"]:
            lines |= {i for i in range(x["at"], len(own.per_line), 1 << ORDINAL_BITS) if own.per_line[i] >= LEAST and int(line_keys[i]) == key}
        else:
            at = np.arange(x["at"], len(mask), 1 << ORDINAL_BITS)
            mask[at[own.key[at] == np.uint64(key)]] = True
    at = np.flatnonzero(mask)
    if len(at):
        group = np.cumsum(np.concatenate([[0], own.start[at[1:]] - own.end[at[:-1]] > JOIN]).astype(np.int64))
        words = np.bincount(group, own.end[at] - own.start[at])
        mask[at[words[group] < LEAST]] = False
    return own.without(lines, mask)


def _apply_batches(columns: list[str], text_at: str, gone_at: str, count_at: str | None):
    @frugal
    def run(batches):
        for batch in batches:
            made = [apply(t or "", gone) for t, gone in zip(batch.column(text_at).to_pylist(), batch.column(gone_at).to_pylist(), strict=True)]
            out = {c: batch.column(c) for c in columns}
            out[text_at] = pa.array([t for t, _ in made], pa.string())
            if count_at:
                out[count_at] = pa.array([n for _, n in made], pa.int64())
            elif "n_chars" in out and pa.types.is_integer(out["n_chars"].type):
                out["n_chars"] = pa.array([len(t) for t, _ in made], out["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text without the repeated spans, and removed_words."""
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    rows = rowed(docs, id_col, text_col)
    touched, rest = owners(rows, removals(rows, scratch), "gone")
    touched = touched.select("doc_id", "text", F.lit(0).cast("long").alias("removed_words"), "gone")
    cut = touched.mapInArrow(_apply_batches(["doc_id", "text", "removed_words"], "text", "gone", "removed_words"), "doc_id long, text string, removed_words long")
    return cut.unionByName(rest.select("doc_id", "text", F.lit(0).cast("long").alias("removed_words")))


def remove_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with the repeated spans cut out of their texts; n_chars follows the text."""
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    gone = removals(rowed(docs, id_col, text_col), scratch)
    # the row rides along as one struct, so no name of its columns can clash
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("rid"))
    touched, rest = owners(rows, gone, "gone")
    name = "gone"
    while name in docs.columns:
        name += "_"
    cut = touched.select("row.*", F.col("gone").alias(name)).mapInArrow(_apply_batches(docs.columns, text_col, name, None), docs.schema)
    return cut.unionByName(rest.select("row.*"))
