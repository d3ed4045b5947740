"""Near-duplicates, substring dedup and the components under them, against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from shapelake.llm import near_dup, substring_dedup
from shapelake.llm.common import Scratch, mix, word_hashes, word_spans
from shapelake.llm.graph import components, link_components, shared_keys

SF = "/root/testdata/sf0.001"


def union(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_word_hashes_tell_words_apart():
    text = "The quick  brown\tfox\n the  QUICK x"
    starts, ends, _ = word_spans(text.encode())
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == text.split()
    h = word_hashes(text)
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 5
    assert len(word_hashes("")) == 0 and len(word_hashes(" \n")) == 0
    long = "ab cd\n" * 400_000
    assert len(word_hashes(long)) == 800_000 and len(np.unique(word_hashes(long))) == 2
    one = "x" * (1 << 21) + " y"
    assert len(word_hashes(one)) == 2


def test_components(spark):
    rng = random.Random(1)
    edges = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(200)} | {(i, i + 1) for i in range(400, 440)}
    got = {r["node"]: r["label"] for r in components(Scratch(spark, "t"), spark.createDataFrame(list(edges), "a long, b long"), "c").collect()}
    assert got == union(edges, {n for e in edges for n in e})


def link_case(spark, sets, keys, weights=None):
    """Components by link_components and by brute force, and how many pairs were compared and were possible."""
    weights = weights or {i: [1.0] * len(own) for i, own in sets.items()}
    members = spark.createDataFrame([(n, k) for k, own in keys.items() for n in own], "node long, key long")
    rows = []
    for n, own in sets.items():
        order = np.argsort(np.array(own, dtype=np.uint64))
        rows.append((n, np.array(own, dtype=np.uint64)[order].tobytes(), np.array(weights[n], dtype=np.float32)[order].tobytes()))
    table = spark.createDataFrame(rows, "node long, keys binary, weights binary")
    scratch = Scratch(spark, "t")
    labels, scored = link_components(scratch, shared_keys(scratch, members), table, 0.8)
    got = {r["node"]: r["label"] for r in labels.collect()}

    def similar(a, b):
        x, y = (dict(zip(sets[i], weights[i], strict=True)) for i in (a, b))
        both = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
        return both / (sum(x.values()) + sum(y.values()) - both)

    edges = {(a, b) for own in keys.values() for a in own for b in own if a < b and similar(a, b) >= 0.8}
    want = union(edges, sets)
    assert {n: got.get(n, n) for n in want} == want
    return scored.count(), sum(len(o) * (len(o) - 1) // 2 for o in keys.values())


@pytest.mark.parametrize("seed", range(4))
def test_links_of_buckets_lose_nothing(spark, seed):
    """Copies of one set with a few elements changed, chained copies of copies, and strangers, in large buckets."""
    rng = random.Random(seed)
    base = list(range(1, 37))
    sets, weights = {}, {}
    for i in range(120):
        own = list(base if i < 60 or i % 3 else sets[rng.randrange(i)])
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = 1000 + rng.randrange(60 if i % 2 else 10**6)
        sets[i] = sorted(set(own))[: rng.randrange(30, 40)]
        weights[i] = [1.0 + (k % 5) / 4 for k in sets[i]]
    keys = {0: set(range(90)), 1: set(range(70, 120)), **{10 + j: {i for i in range(120) if i % 11 == j} for j in range(11)}}
    link_case(spark, sets, keys)
    link_case(spark, sets, keys, weights)


def test_copies_with_one_change_each_cost_no_square(spark):
    """400 paragraphs that share a bucket, none similar enough to another."""
    rng = random.Random(3)
    sets = {}
    for i in range(400):
        at = rng.randrange(32)
        sets[i] = sorted({k for k in range(1, 37) if not at < k <= at + 5} | {10_000 + 10 * i + j for j in range(5)})
    compared, possible = link_case(spark, sets, {0: set(range(400))})
    assert compared < possible / 10


def test_consistent_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    keys = mix(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = np.sort(keys[:320]), np.sort(keys[80:])
    weight = dict(zip(keys.tolist(), (1 + rng.random(400) * 4).tolist(), strict=True))
    wa, wb = (np.array([weight[int(k)] for k in s]) for s in (a, b))
    wb = wb * 1.3
    sampler = near_dup.Sampler(4096)
    share = (sampler(a, wa) == sampler(b, wb)).mean()
    exact = near_dup.weighted_jaccard(a, wa, b, wb)
    brute = sum(min(weight[int(k)], 1.3 * weight[int(k)]) for k in set(a.tolist()) & set(b.tolist())) / (sum(weight[int(k)] for k in set(a.tolist()) - set(b.tolist())) + sum(1.3 * weight[int(k)] for k in b.tolist()))
    assert exact == pytest.approx(brute) and abs(share - exact) < 0.03


def variants(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(1, changes + 1)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(words))
    return out


def brute_classes(texts):
    df = Counter(k for t in texts for k in np.unique(near_dup.shingles(t)).tolist())
    n = len(texts)
    sets = []
    for t in texts:
        keys, counts = near_dup.counted(t)
        idf = np.array([1 + near_dup.DAMPING * np.log(n / df[int(k)]) / np.log(max(n, 2)) for k in keys])
        sets.append((keys, counts * idf))
    inverse = defaultdict(list)
    for i, (keys, _) in enumerate(sets):
        for k in keys.tolist():
            inverse[k].append(i)
    pairs = {(a, b) for own in inverse.values() if len(own) < 400 for x, a in enumerate(own) for b in own[x + 1 :]}
    scores = {p: near_dup.weighted_jaccard(*sets[p[0]], *sets[p[1]]) for p in pairs}
    return union([p for p, s in scores.items() if s >= 0.8] + [(a, b) for a in range(n) for b in range(a) if texts[a] == texts[b]], range(n)), scores


def test_classes_equal_brute_force(spark, make):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    texts = variants(rng, base, 60, 5) + [" ".join(rng.choices(words, k=rng.randrange(30, 120))) for _ in range(60)]
    texts += texts[60:80] + variants(rng, texts[70].split(), 3, 1) + ["", "", "one two", "one two", "one two three"]
    want, scores = brute_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(make(texts).repartition(5)).collect()}
    # a pair at the threshold's edge may fall either way: the sketch's document frequencies may exceed the true ones
    clear = all(abs(s - 0.8) > 0.004 for s in scores.values())
    differ = [i for i in want if got[i] != want[i]]
    assert not differ or (not clear and len(differ) <= 2)
    left = near_dup.deduplicate(make(texts))
    assert left.count() == len(set(got.values()))


def test_hot_group_costs_no_square(spark, make):
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = variants(rng, base, 400, 2) + [" ".join(base)] * 300
    out = near_dup.classes(make(texts))
    assert {r["class_id"] for r in out.collect()} == {0}


# ---------------------------------------------------------------- substrings


def test_bands_reach_their_recall():
    assert 1 - (1 - 0.8**3) ** substring_dedup.tune_bands() >= substring_dedup.RECALL
    assert substring_dedup.tune_bands(0.8, 0.9, 3) < substring_dedup.tune_bands()


def prose(rng, n):
    return [rng.choice(["stone", "river", "under", "walk", "quiet", "green"]) + str(rng.randrange(3000)) for _ in range(n)]


def test_cuts_fall_alike_inside_other_text():
    rng = random.Random(2)
    passage = prose(rng, 80)
    one, two = substring_dedup.Cuts(" ".join(prose(rng, 33) + passage + prose(rng, 20))), substring_dedup.Cuts("start " + " ".join(passage) + "\nend")
    shared = set(one.key.tolist()) & set(two.key.tolist())
    assert sum(int(e - s) for k, s, e in zip(one.key.tolist(), one.start, one.end, strict=True) if k in shared) >= 50
    repeat = substring_dedup.Cuts("edon, " * 1000)
    assert (repeat.end - repeat.start).max() <= substring_dedup.LONGEST
    assert len(substring_dedup.Cuts("").key) == 0 and substring_dedup.Cuts("a\n\nb").per_line.tolist() == [1, 0, 1]


def windows(texts, n):
    seen = defaultdict(set)
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(i)
    return {k for k, v in seen.items() if len(v) > 1}


def test_passages_go_and_clean_texts_stay(spark, make):
    rng = random.Random(9)
    passages = [prose(rng, 60) for _ in range(4)]
    texts = {}
    for i in range(60):
        words = prose(rng, 200)
        if i < 24:
            at = rng.randrange(20, 180)
            words[at:at] = passages[i % 4]
        lines = " ".join(words[:90]) + "\n" + " ".join(words[90:])
        texts[i] = lines
    near = texts[50].split("\n")
    texts[60] = " ".join(prose(rng, 40)) + "\n" + near[1].replace(near[1].split()[40], "other")  # a paragraph with one word changed
    out = {r["doc_id"]: r for r in substring_dedup.clean(make([texts[i] for i in range(61)])).collect()}
    assert windows(texts, 50) and not windows({i: r["text"] for i, r in out.items()}, 30)
    for k in range(4):  # one copy of each passage stays whole
        assert sum(" ".join(passages[k]) in out[i]["text"].replace("\n", " ") for i in range(24)) == 1
    assert all(out[i]["text"] == texts[i] and out[i]["removed_words"] == 0 for i in range(24, 60) if i != 50)
    assert {out[50]["removed_words"], out[60]["removed_words"]} == {0, len(near[1].split())}
    words = {i: len(texts[i].split()) for i in texts}
    assert all(words[i] - len(out[i]["text"].split()) == out[i]["removed_words"] for i in texts)


def test_every_repeated_window_of_the_table_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = substring_dedup.remove_from(docs)
    after = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and after.keys() == before.keys()
    assert windows(before, 50) and not windows({i: r["text"] for i, r in after.items()}, 50)
    repeated = windows(before, 5)
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"])
        if r["text"] != before[i]:  # what changed did hold repeats
            w = before[i].split()
            assert any(tuple(w[k : k + 5]) in repeated for k in range(len(w) - 4)) or len(set(w)) < len(w)


def test_meeting_owners_remove_nothing_else():
    text = " ".join(f"u{i}" for i in range(60))
    own = substring_dedup.Cuts(text)
    wrong = [{"kind": 0, "at": i, "key": 12345} for i in range(len(own.key))] + [{"kind": 1, "at": 0, "key": 99}]
    assert substring_dedup.apply(text, wrong) == (text, 0)
    key = int(np.uint64(own.line_keys()[0]).astype(np.int64))
    assert substring_dedup.apply(text, [{"kind": 1, "at": 0, "key": key}]) == ("", 60)


def test_recall_against_all_pairs(spark):
    """Every pair of different texts with weighted similarity of 0.8 or more, found by an inverted index over a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    first: dict[str, int] = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    own = {i: near_dup.counted(t) for t, i in first.items()}
    df = Counter(k for t in rows.values() for k in near_dup.counted(t)[0].tolist())
    keys = np.array(sorted(k for k, n in df.items() if n >= near_dup.RARE * len(rows)), dtype=np.uint64)
    idf = near_dup.idf_table((keys, np.array([df[int(k)] for k in keys])), len(rows))
    weights = {i: near_dup.weigh(k, c, idf) for i, (k, c) in own.items()}
    holders = defaultdict(list)
    for i, (k, _) in own.items():
        for x in k.tolist():
            holders[x].append(i)
    shared = Counter((a, b) for x in holders.values() for n, a in enumerate(x) for b in x[n + 1 :])
    near = [(a, b) for a, b in shared if near_dup.weighted_jaccard(own[a][0], weights[a], own[b][0], weights[b]) >= near_dup.THRESHOLD]
    classes = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    recall = np.mean([classes[a] == classes[b] for a, b in near])
    print(len(near), recall)
    assert len(near) >= 10 and recall >= 0.9
    assert all(classes[i] == classes[first[t]] for i, t in rows.items())
    truth = union(near, first.values())
    merged = {i: truth[first[t]] for i, t in rows.items()}
    assert all(merged[classes[i]] == merged[i] for i in rows)  # and nothing else is joined
