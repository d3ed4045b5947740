"""Quality, license, media, BPE, packing: against brute force, libraries and exact round trips."""

from __future__ import annotations

import hashlib
import io
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shapelake.llm import bpe, license_scan, media, packing, quality

SF = "/root/testdata/sf0.001"
RANKS, BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# ---------------------------------------------------------------- quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)]


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "a b c", "a b c a b c", "ä # | x\n\nä # | x\n \n", "x\x0by\x1cz", "one two three four one two three one two"])
def test_counts_by_hand(text):
    assert quality.statistics(text)[0] == plain_counts(text)


def test_counts_and_verdicts(spark, texts):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.learn(docs, labels)
    for r in quality.score_docs(docs, forest).collect():
        if len(texts[r["doc_id"]]) < 4000:
            assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == plain_counts(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in quality.filter_docs(docs, forest).collect()}
    assert kept == {r["doc_id"] for r in quality.score_docs(docs, forest).where("kept").collect()}


def test_forest_is_monotonic_and_flat_scoring_matches_walking():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.3 * rng.random(600) > 0.6) ^ (rng.random(600) < 0.1)).astype(float)
    forest = quality.fit_forest(x, y, {0: 1, 1: -1}, trees=30, depth=3)
    grid = np.linspace(0, 1, 50)
    for f, sign in ((0, 1), (1, -1)):
        for base in rng.random((20, 3)):
            rows = np.tile(base, (50, 1))
            rows[:, f] = grid
            assert np.all(sign * np.diff(forest.margin(rows)) >= -1e-12)

    def walk(row, k):
        while forest.left[k] != k:
            k = forest.left[k] if row[forest.feature[k]] <= forest.threshold[k] else forest.right[k]
        return forest.value[k]

    assert np.allclose(forest.margin(x), [forest.bias + sum(walk(row, k) for k in forest.roots) for row in x])
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.85


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = {r["doc_id"]: r["score"] for r in quality.score_docs(docs, quality.learn(docs, labels)).collect()}
    held = [(scored[r["doc_id"]] >= 0.5, r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95


# ---------------------------------------------------------------- license


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)


@pytest.mark.parametrize("text", ["", "MIT License", "mit-license! MIT\nlicense", "The Apache\x7fLicense and the general public license", "Ämit license", "mit licenses", "mit license mit license"])
def test_phrases(text):
    n, found = plain_base(text)
    got = license_scan.scan_text(license_scan.Scanner(), text)
    assert (got["n_words"], got["n_base"]) == (n, len(found))
    assert (got["first_word"], got["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
    assert got["base_labels"] == ",".join(sorted({x for _, x in found}))


def edits_at(notice, text):
    """For each end in the text, the fewest edits of the notice against anything that ends there (dynamic programming)."""
    row = np.arange(len(notice) + 1)
    out = [row[-1]]
    for c in text:
        new = np.zeros_like(row)
        for i, p in enumerate(notice):
            new[i + 1] = min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1)
        row = new
        out.append(row[-1])
    return np.array(out)


def edited(rng, notice, n):
    text = list(notice)
    for _ in range(n):
        i = rng.randrange(1, len(text) - 1)
        text[i] = rng.choice(["", "x", text[i] + "q", text[i] + "\u65e5", "\U0001f600", "\u00e9" + text[i]])
    return "".join(text)


def test_fuzzy_notices_against_a_search_of_the_whole_text():
    scanner, rng = license_scan.Scanner(), random.Random(3)
    filler = "the of and stone river under permission software version granted public \u65e5\u672c".split()
    for _ in range(25):
        parts = []
        for _ in range(rng.randrange(1, 4)):  # notices side by side, some a few words apart
            notice = rng.choice(list(license_scan.NOTICES))
            parts += [edited(rng, notice, rng.randrange(0, license_scan.edits_allowed(notice) + 1)), *rng.choices(filler, k=rng.choice([0, 0, 5]))]
        padded = scanner.words(" ".join([*rng.choices(filler, k=8), *parts, *rng.choices(filler, k=8)]))
        near = scanner.candidates(padded)
        for i, (notice, _, k) in enumerate(scanner.plans):
            cost, found = edits_at(notice, padded), scanner.verified(padded, i, near.get(i, []))
            for a, b, edits in found:
                assert edits == cost[max(0, b - k) : b + k + 1].min() and b - a <= len(notice) + k
            for end in np.flatnonzero(cost <= k):
                assert any(abs(end - b) <= 2 * k for _, b, _ in found), (notice, padded[:end])


@pytest.mark.parametrize("letter", ["x", "\u00e9", "\u65e5", "\U0001f600"])
def test_edits_are_characters(letter):
    notice = "permission to use copy modify and or distribute this software for any purpose"
    k = license_scan.edits_allowed(notice)
    cuts = [at + 3 for at, _ in license_scan.pieces(notice, k)[1:]]
    text = "".join(letter * (i in cuts) + c for i, c in enumerate(notice))
    got = license_scan.scan_text(license_scan.Scanner(), f"{letter} word {text} end")
    assert got["labels"] == "isc" and got["spans"][0]["edits"] == k
    span, padded = got["spans"][0], license_scan.Scanner().words(f"{letter} word {text} end")
    assert padded[span["start"] : span["end"]] == text


def test_adjacent_notices_and_time():
    scanner = license_scan.Scanner()
    got = license_scan.scan_text(scanner, "all rights resorved and all rights reserved x")
    assert [(x["label"], x["edits"]) for x in got["spans"]] == [("proprietary", 1), ("proprietary", 0)]
    began = time.time()
    got = license_scan.scan_text(scanner, "all rights resorved released under the mit license " * 10_000)
    assert len(got["spans"]) == 20_000 and got["n_base"] == 10_000 and got["last_word"] == 8 * 10_000 - 2
    assert time.time() - began < 15


def test_only_the_closest_notices_explain_a_place():
    found = [(0, 10, "a", 1, ""), (5, 15, "b", 0, ""), (14, 30, "c", 2, ""), (30, 40, "d", 2, ""), (35, 50, "e", 2, ""), (100, 110, "f", 3, "")]
    brute = sorted(f for f in found if not any(g[3] < f[3] and g[0] < f[1] and f[0] < g[1] for g in found))
    assert license_scan.unexplained(found) == brute
    rng = random.Random(1)
    for _ in range(200):
        found = [(a := rng.randrange(100), a + rng.randrange(1, 20), "x", rng.randrange(4), str(i)) for i in range(rng.randrange(30))]
        assert license_scan.unexplained(found) == sorted(f for f in found if not any(g[3] < f[3] and g[0] < f[1] and f[0] < g[1] for g in found))


def test_license_table(spark, texts):
    for r in license_scan.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        n, found = plain_base(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (n, len(found)) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


# ---------------------------------------------------------------- media


@pytest.mark.parametrize("form,shape", [("ppm", (5, 7, 3)), ("bmp", (5, 7, 3)), ("bmp", (3, 4, 3)), ("pgm", (4, 9))])
def test_images_round_trip(form, shape):
    pixels = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert np.array_equal(media.decode(media.encode(pixels, form)), pixels)


def test_samples_fill_the_range():
    assert media.decode(b"P2 3 1 15 0 7 15 ").tolist() == [[0, 119, 255]]
    assert media.decode(b"P5 2 1 1\n\x00\x01").tolist() == [[0, 255]]
    assert media.decode(b"P5 2 1 1023\n\x00\x00\x03\xff").tolist() == [[0, 65535]]


def test_resizing_and_hashes_by_brute_force():
    rng = np.random.default_rng(7)
    for rows, cols, height, width in ((5, 7, 3, 4), (32, 32, 8, 9), (3, 2, 8, 9), (17, 1, 8, 9)):
        image = rng.integers(0, 256, (rows, cols)).astype(float)
        fine = np.kron(image, np.ones((height, width)))  # every target pixel now covers whole cells
        want = fine.reshape(height, rows, width, cols).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(image, height, width), want)
        small = np.kron(image, np.ones((8, 9))).reshape(8, rows, 9, cols).mean(axis=(1, 3))
        bits = "".join(str(int(small[r, c + 1] > small[r, c] + 1e-9)) for r in range(8) for c in range(8))
        assert media.difference_hash(image) == f"{int(bits, 2):016x}"


def test_other_netpbm_forms():
    assert media.decode(b"P2\n# note\n2 2\n255\n0 1\n2 3\n").tolist() == [[0, 1], [2, 3]]
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 2 1 65535\n" + bytes([1, 0, 0, 2])).tolist() == [[256, 2]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_by_brute_force():
    image = np.random.default_rng(2).random((7, 5))
    fine = np.kron(image, np.ones((8, 9)))  # 56 x 45 divides into 8 x 9
    assert np.allclose(media.area_resize(image, 8, 9), fine.reshape(8, 7, 9, 5).mean(axis=(1, 3)))


def test_tiles_and_hash(spark, make):
    image = np.tile(np.arange(70.0), (40, 1))
    found = media.tiles(image, 32)
    assert len(found) == 6 and np.array_equal(np.load(io.BytesIO(found[-1][2])), image[32:, 64:])
    assert media.difference_hash(image) == "ff" * 8
    assert media.tile_rows(media.store(make(["a" * 1000]))).count() == 2


def test_media_columns(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in media.describe(media.store(docs)).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


# ---------------------------------------------------------------- BPE

HARD = ["", " ", "<|endoftext|>a<|startoftext|> B", "ΑΣ ΟΔΟΣ", "'S 'LL I'VE don't", "a\x00b\x1cc\x85d e", "İstanbul ﬁ ½ ²", "x" * 3000 + "ab" * 800, "<|endoftext", "é é", "日本語 テキスト 123", "😀👍🏽 ok", "a b　c"]


def test_encoder_equals_the_library(texts):
    library, source = Tokenizer.from_file(WORDS), open(WORDS, "rb").read()
    words = sorted({w for t in list(texts.values())[:60] for c in bpe.chunks(bpe.normalise(t)) for w in bpe.WORDS.findall(c)})
    image = bpe.compile_words(words[::2], bpe.Vocabulary(source))
    for coder in (bpe.Coder(source, image), bpe.Coder(source), bpe.Coder(source, image, most=50)):
        sample = HARD + list(texts.values())
        for text, ids in zip(sample, coder.encode_all(sample), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids == want and coder.written(ids) == " ".join(map(str, want)) and coder.decoded(ids) == library.decode(want, skip_special_tokens=False) == coder.decode(want)


def test_every_character():
    """Each code point alone, within a word and before a mark; then random mixes."""
    library, coder, rng = Tokenizer.from_file(WORDS), bpe.Coder(open(WORDS, "rb").read()), random.Random(4)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and i not in range(0x20000, 0xE0000) and i < 0xF0000]
    lines = [f"a{c}b {c} A{c}\u0301 {c}\u0c3c" for c in points]
    lines += ["".join(rng.choices(points, k=12)) for _ in range(4000)] + [f"it{c}s <|endoftext|> {c}" for c in rng.choices(points, k=500)]
    lines += [f"a{c}b {c}{c}A" for c in points if bpe.plain(c)]  # all by the fast way
    for at in range(0, len(lines), 20_000):
        part = lines[at : at + 20_000]
        for line, ids, want in zip(part, coder.encode_all(part), library.encode_batch(part, add_special_tokens=False), strict=True):
            assert ids == want.ids, [hex(ord(c)) for c in line]


def test_automaton_is_minimal_and_exact():
    source = open(WORDS, "rb").read()
    vocabulary = bpe.Vocabulary(source)
    words = ["tap", "taps", "top", "tops", "ähre", "x"]
    automaton = bpe.Automaton(bpe.compile_words(words, vocabulary))
    ranks = automaton.ranks([w.encode() for w in (*words, "ta", "tapsi", "", "y", "a\0", "q" * 90)])
    assert sorted(ranks[:6].tolist()) == list(range(6)) and (ranks[6:] == -1).all()
    assert automaton.word_ids(np.array(ranks[:6]), vocabulary.own_ints) == [vocabulary.merge(w) for w in words]
    ends = {w[i:] for w in words for i in range(len(w.encode()) + 1)}
    assert len(automaton.final) <= len(ends)
    assert bpe.Automaton(bpe.compile_words([], vocabulary)).ranks([b"a"]).tolist() == [-1]


def test_long_words_merge_alike():
    vocabulary = bpe.Vocabulary(open(WORDS, "rb").read())
    rng = random.Random(1)
    for _ in range(20):
        word = "".join(rng.choices("aeionrst", k=150))
        raw = word.encode()
        own = [vocabulary.first[b] for b in raw[:-1]] + [vocabulary.last[raw[-1]]]
        assert vocabulary._merge_long(own) == vocabulary.merge(word)


def test_bpe_table(spark, texts):
    library, docs = Tokenizer.from_file(WORDS), spark.read.parquet(f"{SF}/documents.parquet")
    for r in bpe.digests(docs, WORDS, 500).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_docs(docs, WORDS, 100).where("size(ids) > 0").count() > 0


# ---------------------------------------------------------------- packing


def test_tokens_equal_the_library(texts):
    library, enc = Tokenizer.from_file(BYTES), packing.encoder(open(RANKS, "rb").read())
    for text in HARD + ["a <|endoftext|>  b"] + list(texts.values()):
        assert packing.token_ids(enc, text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_tokens_of_every_character():
    library, enc = Tokenizer.from_file(BYTES), packing.encoder(open(RANKS, "rb").read())
    lines = [f"a{chr(i)}b {chr(i)} 1{chr(i)}  {chr(i)}" for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(lines), 10_000):
        part = lines[at : at + 10_000]
        for line, want in zip(part, library.encode_batch(part, add_special_tokens=False), strict=True):
            assert packing.token_ids(enc, line).tolist() == [*want.ids, 0], [hex(ord(c)) for c in line]


def test_certificate_is_beside_every_piece(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(300)], "doc_id long, text string").repartition(3)
    rows = packing.certified(packing.pack(docs, RANKS)).collect()
    used = len({r["sequence_id"] for r in rows})
    assert all(r["sequences"] == used and r["bound"] <= used and r["block_bound"] >= 1 for r in rows)


def test_cuts():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def test_bounds_never_exceed_the_optimum():
    def optimum(items, capacity):
        best = len(items)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[i] <= capacity:
                    bins[b] += items[i]
                    place(i + 1, bins)
                    bins[b] -= items[i]
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return best

    rng = np.random.default_rng(4)
    for _ in range(40):
        items = np.sort(rng.integers(1, 21, 8))[::-1]
        best = optimum(items.tolist(), 20)
        bound = packing.lower_bound(packing.histogram(items, 20), 20)
        _, _, used = packing.best_fit_decreasing(items, 20)
        assert bound <= best <= used
    assert packing.lower_bound(packing.histogram(np.full(7, 11), 20), 20) == 7
    assert packing.lower_bound(packing.histogram(np.full(9, 7), 20), 20) == 5


def test_packing_table(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    packed = packing.pack(docs, RANKS).persist()
    rows, enc = packed.collect(), packing.encoder(open(RANKS, "rb").read())
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, own in by_doc.items():
        ids = packing.token_ids(enc, texts[doc])
        own.sort(key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == packing.cut(len(ids))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    proof = packing.certificate(packed).first()
    assert proof["sequences"] == len(bins) and proof["bound"] <= proof["sequences"] <= proof["bound"] + 3
