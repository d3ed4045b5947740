"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The corpus's most frequent words are compiled into a minimal acyclic automaton, which shares prefixes and suffixes.
Each transition carries the number of words it passes over, so that a walk adds up to the word's rank, and the rank
points at the word's ids. The automaton is a few flat arrays in one file image, which workers memory-map; a batch's
words walk it together, one byte a step. Words it does not hold are merged exactly, pair by pair.

A text is split at blanks first: no word of the vocabulary's pattern spans one. Special tokens' strings in a text are
those tokens, as in the tokenizers library. What is a letter, how letters compose and what their lower case is differ
between Unicode versions; so a text with any character outside ``PLAIN``, on which all agree, is normalised and split
into words by the tokenizers library's own classes, and only then looked up and merged here. Texts are decoded from
their ids.

Defined cases: a null or empty text has no ids and decodes to the empty string; very long texts and words are encoded
whole; equal words have equal ids; repeated rows get equal results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import tempfile
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.llm.common import Scratch, frugal, map_batches, text_rows, texts_of

SUFFIX = "</w>"
#: The characters that the vocabulary's pattern takes for blanks (Unicode White_Space).
BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
BLANKS = regex.compile(f"[{BLANK}]+")
#: str.split() also splits at these, which the pattern does not.
EXTRA = regex.compile("[\x1c-\x1f]")

#: Latin, Greek, Cyrillic, punctuation, kana, Chinese and Korean as assigned long ago.
PLAIN = regex.compile("[\x00-\u02af\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20a0-\u20ac\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")

#: The vocabulary's own pattern.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next unused one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """The vocabulary file's content: merges, ids and special tokens."""

    def __init__(self, source: bytes):
        self.source = source
        whole = json.loads(source)
        self.ids: dict[str, int] = whole["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in whole["model"]["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): i for i, (a, b) in enumerate(merges)}
        self.joined = [self.ids[a + b] for a, b in merges]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.rules = json.dumps({**whole, "added_tokens": [], "model": {**whole["model"], "vocab": {}, "merges": []}})
        self._library = None
        self.byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.tokens.update({i: t for t, i in self.special.items()})
        size = max(self.tokens, default=-1) + 1
        self.own_ints = list(range(size))  # one object an id, however often it occurs
        self.numbers, self.token_at = [str(i) for i in range(size)], [self.tokens.get(i, "") for i in range(size)]
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.first = [self.ids[letter] for letter in byte_letters()]
        self.last = [self.ids[letter + SUFFIX] for letter in byte_letters()]
        self.first_of, self.last_of, self.joined_of = (np.array(x, dtype=np.int64) for x in (self.first, self.last, self.joined))
        self.table_keys, self.table_ranks = np.full(1 << 18, -1, dtype=np.int64), np.zeros(1 << 18, dtype=np.int64)
        for (a, b), i in self.rank.items():
            at = ((a << 16 | b) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - 18)
            while self.table_keys[at] >= 0:
                at = (at + 1) & ((1 << 18) - 1)
            self.table_keys[at], self.table_ranks[at] = a << 16 | b, i

    def library_words(self, text: str) -> list[str]:
        """The words of a text by the tokenizers library's normaliser and pattern. Bytes that are no text stay surrogates."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.rules)
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8", "surrogatepass") for w, _ in found]

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the lowest-ranked adjacent pair, leftmost first, is joined until none is left."""
        raw = word.encode("utf-8", "surrogatepass")
        if not raw:
            return []
        own = [self.first[b] for b in raw[:-1]]
        own.append(self.last[raw[-1]])
        if len(own) > 200:
            return self._merge_long(own)
        rank, joined, none = self.rank.get, self.joined, len(self.joined)
        ranks = [rank(p, none) for p in zip(own, own[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            own[i : i + 2] = [joined[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((own[i - 1], own[i]), none)
            if i < len(ranks):
                ranks[i] = rank((own[i], own[i + 1]), none)
        return own

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Ids of many words: all of them take their next merge together, on flat arrays."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[list[int]] = [[]] * len(raw)
        usual = [i for i, r in enumerate(raw) if 0 < len(r) <= 200]
        for i, r in enumerate(raw):
            if len(r) > 200:
                out[i] = self.merge(words[i])
        if not usual:
            return out
        length = np.fromiter((len(raw[i]) for i in usual), dtype=np.int64, count=len(usual))
        letters = np.frombuffer(b"".join([raw[i] for i in usual]), dtype=np.uint8)
        ends = np.cumsum(length)
        own = self.first_of[letters]
        own[ends - 1] = self.last_of[letters[ends - 1]]
        none = len(self.joined)
        ranks = np.full(len(own), none, dtype=np.int64)
        ranks[:-1] = self.ranks_of(own[:-1], own[1:])
        ranks[ends - 1] = none  # a pair never spans two words
        number = np.array(usual)
        while len(number):
            starts = np.cumsum(length) - length
            low = np.minimum.reduceat(ranks, starts)
            live = low < none
            if not live.all():
                kept = np.repeat(live, length)
                flat = list(map(self.own_ints.__getitem__, own[~kept].tolist()))
                at = 0
                for i, n in zip(number[~live].tolist(), length[~live].tolist(), strict=True):
                    out[i] = flat[at : at + n]
                    at += n
                own, ranks, number, length, low = own[kept], ranks[kept], number[live], length[live], low[live]
                if not len(number):
                    break
                starts = np.cumsum(length) - length
            of = np.repeat(np.arange(len(number)), length)
            hits = np.flatnonzero(ranks == low[of])
            place = hits[np.concatenate([[True], of[hits[1:]] != of[hits[:-1]]])]  # leftmost in each word
            own[place] = self.joined_of[low]
            kept = np.ones(len(own), dtype=bool)
            kept[place + 1] = False
            own, ranks = own[kept], ranks[kept]
            place = place - np.arange(len(place))  # one symbol went in each word before
            length = length - 1
            ends = np.cumsum(length)
            starts = ends - length
            right = place < ends - 1
            ranks[place] = none
            ranks[place[right]] = self.ranks_of(own[place[right]], own[place[right] + 1])
            left = place[place > starts]
            ranks[left - 1] = self.ranks_of(own[left - 1], own[left])
        return out

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, the number of merges where there is none, from an open-addressed table."""
        key = a << 16 | b
        at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 18)).astype(np.int64)
        found = self.table_keys[at]
        out = np.where(found == key, self.table_ranks[at], len(self.joined))
        more = np.flatnonzero((found != key) & (found >= 0))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << 18) - 1)
            found = self.table_keys[at[more]]
            hit = found == key[more]
            out[more[hit]] = self.table_ranks[at[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out

    def _merge_long(self, own: list[int]) -> list[int]:
        """The same with a queue, for words of any length in n log n."""
        n = len(own)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(self.rank[p], i, p) for i, p in enumerate(zip(own, own[1:], strict=False)) if p in self.rank]
        heapq.heapify(queue)
        while queue:
            low, i, pair = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or (own[i], own[j]) != pair:
                continue
            own[i], alive[j], after[i] = self.joined[low], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (own[a], own[b]) in self.rank:
                    heapq.heappush(queue, (self.rank[own[a], own[b]], a, (own[a], own[b])))
        return [p for p, live in zip(own, alive, strict=True) if live]


def plain(text: str) -> bool:
    """Whether every character is one on which all Unicode versions agree."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return PLAIN.fullmatch(text) is not None
    return True


def normalise(text: str) -> str:
    """Canonical composition, then lower case letter by letter (so a capital sigma never turns into a final one)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def chunks(text: str) -> list[str]:
    """The blank-delimited parts of a normalised text."""
    return text.split() if EXTRA.search(text) is None else [c for c in BLANKS.split(text) if c]


def words_of(chunk: str) -> list[str]:
    """The words of a chunk. Letters alone (general category L, as in the pattern) are one word."""
    return [chunk] if chunk.isalpha() else WORDS.findall(chunk)


# ---------------------------------------------------------------- automaton


def compile_words(words: list[str], vocabulary: Vocabulary) -> bytes:
    """The automaton of some words as one file image. Built from sorted words; equal suffixes become one state."""
    known = sorted({w.encode() for w in words if w and "\0" not in w and len(w.encode()) <= 64})
    states: list[tuple[bool, tuple]] = []  # (final, ((byte, state), ...))
    register: dict[tuple, int] = {}

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states along the last word
    last = b""
    for word in known:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for i in range(len(last), same, -1):
            path[i - 1][1].append((last[i - 1], settle(path.pop())))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1].append((last[i - 1], settle(path.pop())))
    root = settle(path[0])
    below = np.zeros(len(states), dtype=np.int64)  # words that end at or after a state; children settle first
    keys, targets, passed = [], [], []
    for s, (final, edges) in enumerate(states):
        over = int(final)
        for byte, t in edges:
            keys.append(s << 8 | byte), targets.append(t), passed.append(over)
            over += int(below[t])
        below[s] = over
    ids = [vocabulary.merge(w.decode()) for w in known]
    ends = np.cumsum([0, *map(len, ids)])
    arrays = [np.array(keys), np.array(targets), np.array(passed), np.array([f for f, _ in states]), ends, np.array([i for own in ids for i in own])]
    arrays = [np.ascontiguousarray(a, dtype=np.int64) for a in arrays]
    head = np.array([root, *(len(a) for a in arrays)], dtype=np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


class Automaton:
    """The arrays of a file image, memory-mapped. The file has no name: it goes when the worker ends."""

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, dtype=np.int64, count=7)
        self.root, at, arrays = int(head[0]), 56, []
        for n in head[1:]:
            arrays.append(np.frombuffer(self.map, dtype=np.int64, count=int(n), offset=at))
            at += 8 * int(n)
        self.keys, self.targets, self.passed, self.final, self.ends, self.ids = arrays

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 where it is not held. All words take a step together."""
        if not words or len(self.keys) == 0:
            return np.full(len(words), -1)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = min(64, int(length.max()))
        letters = np.array([w[:width] for w in words], dtype=f"S{width}").view(np.uint8).reshape(len(words), width)
        state, rank = np.full(len(words), self.root), np.zeros(len(words), dtype=np.int64)
        live = (length <= 64) & (length > 0)  # a zero byte leads nowhere, as no word held has one
        for step in range(width):
            rows = np.flatnonzero(live & (length > step))
            if len(rows) == 0:
                break
            key = state[rows] << 8 | letters[rows, step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live[rows[~hit]] = False
            rows, at = rows[hit], at[hit]
            state[rows], rank[rows] = self.targets[at], rank[rows] + self.passed[at]
        live &= self.final[state].astype(bool)
        return np.where(live, rank, -1)

    def word_ids(self, ranks: np.ndarray, ints: list[int]) -> list[list[int]]:
        """The ids of the words of some ranks, read from the map in one go; ``ints`` holds the number i at place i."""
        start, length = self.ends[ranks], self.ends[ranks + 1] - self.ends[ranks]
        to = np.cumsum(length)
        flat = self.ids[np.repeat(start - to + length, length) + np.arange(int(length.sum()))].tolist()
        flat = list(map(ints.__getitem__, flat))
        return [flat[b - n : b] for b, n in zip(to.tolist(), length.tolist(), strict=True)]


# ---------------------------------------------------------------- texts


class Coder:
    """Encodes texts and decodes ids. Keeps what it found for recent blank-delimited chunks."""

    def __init__(self, source: bytes, image: bytes | None = None, most: int = 200_000):
        self.vocabulary, self.automaton, self.most = Vocabulary(source), Automaton(image) if image else None, most
        self.ids_of: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}  # those of the last generation, taken over again when met
        self.merged = self.found = 0

    def _ids(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of some distinct words: one walk for all of them, merging for those that are not held."""
        ranks = self.automaton.ranks([w.encode("utf-8", "surrogatepass") for w in words]) if self.automaton else np.full(len(words), -1)
        held = ranks >= 0
        seen, unseen = ([w for w, h in zip(words, held.tolist(), strict=True) if h == kind] for kind in (True, False))
        ids = dict(zip(seen, self.automaton.word_ids(ranks[held], self.vocabulary.own_ints), strict=True)) if seen else {}
        ids.update(zip(unseen, self.vocabulary.merge_all(unseen), strict=True))
        self.found, self.merged = self.found + len(seen), self.merged + len(unseen)
        return ids

    def _learn(self, fresh: list[str]) -> None:
        split = [words_of(c) for c in fresh]
        ids = self._ids(list(dict.fromkeys(chain.from_iterable(split))))
        self.ids_of.update(zip(fresh, [ids[own[0]] if len(own) == 1 else [i for w in own for i in ids[w]] for own in split], strict=True))

    def _prepare(self, every: set[str]) -> None:
        """Sees to it that all these chunks are known. What was met lately outlives a change of generation."""
        if len(self.ids_of) + len(every) > self.most:
            self.older, self.ids_of = self.ids_of, {}
        fresh = every.difference(self.ids_of)  # of a dict, this looks up each of ``every``; of its keys, it walks the dict
        new = fresh.difference(self.older)
        self.ids_of.update((c, self.older[c]) for c in fresh - new)
        gc.disable()  # nothing here is cyclic, and full collections would walk every word each time
        try:
            self._learn(list(new))
        finally:
            gc.enable()

    def _unusual(self, text: str) -> list[int]:
        """The ids of a text that holds special tokens or characters outside PLAIN."""
        cut, out = self.vocabulary.special_cut, []
        for k, part in enumerate(cut.split(text) if cut else [text]):
            if k % 2:  # special tokens stand at odd places
                out.append(self.vocabulary.special[part])
            elif part:
                words = [w for c in chunks(normalise(part)) for w in words_of(c)] if plain(part) else self.vocabulary.library_words(part)
                ids = self._ids(list(dict.fromkeys(words)))
                out += [i for w in words for i in ids[w]]
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        split = [chunks(normalise(t)) if "<|" not in t and plain(t) else None for t in texts]
        self._prepare(set().union(*(own for own in split if own is not None)))
        known = self.ids_of.__getitem__
        return [list(chain.from_iterable(map(known, own))) if own is not None else self._unusual(t) for t, own in zip(texts, split, strict=True)]

    def written(self, ids: list[int]) -> str:
        """Decimal ids joined by blanks."""
        return " ".join(map(self.vocabulary.numbers.__getitem__, ids))

    def decoded(self, ids: list[int]) -> str:
        """The text of the vocabulary's own ids: tokens joined by blanks, as the vocabulary file names no decoder."""
        return " ".join(map(self.vocabulary.token_at.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the vocabulary file names no decoder. Unknown ids are skipped."""
        return " ".join(self.vocabulary.tokens[i] for i in ids if i in self.vocabulary.tokens)


@lru_cache(maxsize=2)
def _coder(source: bytes, image: bytes) -> Coder:
    return Coder(source, image)


# ---------------------------------------------------------------- Spark


def frequent_words(docs: DataFrame, most: int = 131_072, flush: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """The most frequent words of all texts, ``most`` at most; words of equal count go in or stay out together.

    Tasks count before they shuffle. The count to reach is found from a histogram, so only chosen words are collected.
    """

    @frugal
    def run(batches):
        counted: Counter = Counter()

        def emit():
            words: dict[str, int] = {}
            for chunk, n in counted.items():
                for word in words_of(chunk):
                    words[word] = words.get(word, 0) + n
            counted.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in texts_of(batch):
                counted.update(chunks(normalise(text)))
                if len(counted) >= flush:
                    yield emit()
        yield emit()

    scratch = Scratch(docs.sparkSession, "bpe")
    found = text_rows(docs, id_col, text_col).select("text").mapInArrow(run, "word string, n long")
    counted = scratch.save(found.groupBy("word").agg(F.sum("n").alias("n")), "counted")
    # how many words have each count, counts of 1024 and more in steps of a thousandth: under 40,000 rows at any size
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log(F.col("n") / 1024) * 1000)).cast("long")
    left, least = most, None
    for row in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        if row["words"] > left:
            break
        left, least = left - row["words"], row["n"]
    words = [] if least is None else [r["word"] for r in counted.where(F.col("n") >= least).select("word").collect()]
    scratch.drop("counted")
    return sorted(words)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, ids array<int>, decoded string"


def _shared(docs: DataFrame, vocabulary_path: str, most: int, id_col: str, text_col: str):
    with open(vocabulary_path, "rb") as f:
        source = f.read()
    image = compile_words(frequent_words(docs, most, id_col=id_col, text_col=text_col), Vocabulary(source))
    return docs.sparkSession.sparkContext.broadcast((source, image))


def digests(docs: DataFrame, vocabulary_path: str, most: int = 131_072, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text, for each document."""
    shared = _shared(docs, vocabulary_path, most, id_col, text_col)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, texts, out = _coder(*shared.value), texts_of(batch), []
        for at in range(0, len(texts), 512):
            for ids in coder.encode_all(texts[at : at + 512]):
                out.append((len(ids), hashlib.sha256(coder.written(ids).encode()).hexdigest(), hashlib.sha256(coder.decoded(ids).encode()).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, type=t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.string()], strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(text_rows(docs, id_col, text_col), rows, SCHEMA)


def encode_docs(docs: DataFrame, vocabulary_path: str, most: int = 131_072, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves and the decoded text of each document."""
    shared = _shared(docs, vocabulary_path, most, id_col, text_col)

    def rows(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        coder, texts, ids = _coder(*shared.value), texts_of(batch), batch.column("doc_id")
        out = []
        for at in range(0, len(texts), 512):
            got = coder.encode_all(texts[at : at + 512])
            out.append(pa.RecordBatch.from_arrays([ids.slice(at, len(got)), pa.array(got, pa.list_(pa.int32())), pa.array(map(coder.decoded, got), pa.string())], names=["doc_id", "ids", "decoded"]))
        return out

    return map_batches(text_rows(docs, id_col, text_col), rows, ENCODED)
