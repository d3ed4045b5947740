"""License scans: fuzzy search for short notices.

A text becomes its words (ASCII lower case; see ``TABLE``) joined by single spaces, and all places below are characters
of that string. A notice of m characters may hold k = m // ``PER_CHARS`` edits. It is split into k + 1 pieces: by the
pigeonhole principle one of them stands in any match unedited, so exact searches for the pieces find every candidate
start, up to k characters away. The regex library's bounded-error matching then verifies the window around each
candidate and gives the span with the fewest edits. Candidates are worked on one by one, so adjacent notices are all
found and the time is linear in the text. Where notices overlap, those with the fewest edits explain the place.
Phrases that identify a license outright are counted exactly.

Defined cases: null and empty texts have no words, no labels and score 0; very long texts are searched whole; of equally
good spans the first one counts, and overlapping notices with equal edits all do; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shapelake.llm.common import map_batches, text_rows, texts_of

#: Fixed by the contract: phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices, as words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "released under the bsd license": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache",
    "spdx license identifier gpl 3 0": "gpl",
    "eclipse public license version 2 0": "epl",
    "all rights reserved": "proprietary",
}
#: Lower-cases A-Z; every other ASCII byte that is no digit or a-z separates words, and all bytes above belong to them.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


PER_CHARS = 12


def edits_allowed(notice: str, per_chars: int = PER_CHARS) -> int:
    return len(notice) // per_chars


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their places."""
    cuts = [i * len(notice) // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def places(needle: str, text: str) -> list[int]:
    """Every place of a needle, overlapping ones too."""
    out, at = [], text.find(needle)
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + 1)
    return out


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES, per_chars: int = PER_CHARS):
        self.notices, self.phrases, self.per_chars = notices, phrases, per_chars
        self.seeds: dict[str, list[tuple[int, int]]] = {}
        self.plans = []
        for i, (notice, label) in enumerate(notices.items()):
            k = edits_allowed(notice, per_chars)
            self.plans.append((notice, label, k))
            for at, piece in pieces(notice, k):
                self.seeds.setdefault(piece, []).append((i, at))
        self.needles = [(f" {p} ", label) for p, label in phrases.items()]

    def __reduce__(self):
        return type(self), (self.notices, self.phrases, self.per_chars)

    @lru_cache(maxsize=None)  # noqa: B019  one scanner lives as long as its worker
    def pattern(self, i: int) -> regex.Pattern:
        notice, _, k = self.plans[i]
        return regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}")

    def words(self, text: str) -> str:
        """The words, each between single spaces."""
        return f" {b' '.join(text.encode('utf-8', 'surrogatepass').translate(TABLE).split()).decode('utf-8', 'surrogatepass')} "

    def base(self, padded: str) -> list[tuple[int, str]]:
        """(first word, label) of every place of a phrase."""
        found, words, last = [], 0, 0
        for at, label in sorted((at, label) for needle, label in self.needles for at in places(needle, padded)):
            words += padded.count(" ", last, at)  # from the place before, so the text is counted through once
            last = at
            found.append((words, label))
        return found

    def candidates(self, padded: str) -> dict[int, list[int]]:
        """notice -> sorted places where it may start, give or take its edits."""
        near: dict[int, set[int]] = {}
        for seed, uses in self.seeds.items():
            for at in places(seed, padded):
                for i, offset in uses:
                    near.setdefault(i, set()).add(at - offset)
        return {i: sorted(own) for i, own in near.items()}

    def verified(self, padded: str, i: int, starts: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the best match around each group of candidate starts that lie within 2k of its first."""
        notice, _, k = self.plans[i]
        found, n = set(), 0
        while n < len(starts):
            first = last = starts[n]
            while n < len(starts) and starts[n] <= first + 2 * k:
                last = starts[n]
                n += 1
            exact = padded.find(notice, max(first, 0), last + len(notice))
            if exact >= 0:
                found.add((exact, exact + len(notice), 0))
                continue
            # a match begins within k of its candidate and ends within k of where the notice would end
            m = self.pattern(i).search(padded, max(0, first - k), last + len(notice) + k)
            if m:
                found.add((m.start(), m.end(), sum(m.fuzzy_counts)))
        return sorted(found)

    def fuzzy(self, padded: str) -> list[tuple[int, int, str, int, str]]:
        """(start, end, label, edits, notice) of verified notices."""
        found = [(a, b, self.plans[i][1], edits, self.plans[i][0]) for i, starts in self.candidates(padded).items() for a, b, edits in self.verified(padded, i, starts)]
        return unexplained(found)


def unexplained(found: list[tuple[int, int, str, int, str]]) -> list[tuple[int, int, str, int, str]]:
    """The spans that overlap no span of fewer edits, in order of place. One sweep for each number of edits."""
    out: list[tuple[int, int, str, int, str]] = []
    starts: list[int] = []  # spans of fewer edits, merged
    ends: list[int] = []
    for edits in sorted({f[3] for f in found}):
        level = sorted(f for f in found if f[3] == edits)
        for f in level:
            at = bisect_left(starts, f[1]) - 1  # the last merged span that begins before this one ends
            if at < 0 or ends[at] <= f[0]:
                out.append(f)
        merged: list[list[int]] = []
        for a, b in sorted([*zip(starts, ends, strict=True), *((f[0], f[1]) for f in level)]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        starts, ends = [m[0] for m in merged], [m[1] for m in merged]
    return sorted(out)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,edits:int>>"
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())])


def scan_text(scanner: Scanner, text: str) -> dict:
    padded = scanner.words(text)
    base, fuzzy = scanner.base(padded), scanner.fuzzy(padded)
    own, closeness = {label for _, label in base}, [1 - edits / len(notice) for *_, edits, notice in fuzzy]
    return {
        "n_words": padded.count(" ") - 1 if padded.strip(" ") else 0, "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {f[2] for f in fuzzy})), "score": max([1.0 * bool(base), *closeness]),
        "spans": [{"start": a, "end": b, "label": label, "edits": edits} for a, b, label, edits, _ in fuzzy],
    }


def scan(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: exact phrases, labels with the fuzzy ones, the best match and the spans of notices."""
    scanner = scanner or Scanner()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [scan_text(scanner, t) for t in texts_of(batch)]
        types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(SPAN)}
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([m[k] for m in made], type=t) for k, t in types.items())], names=["doc_id", *types])

    return map_batches(text_rows(docs, id_col, text_col), rows, SCHEMA)
