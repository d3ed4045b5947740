"""Each operator does the whole of its job at every size: bands, models, tiles."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np

from shapelake.llm import importance, media, near_dup, queries


def test_bands_rarely_miss_a_pair_at_the_threshold():
    assert (1 - near_dup.THRESHOLD**near_dup.ROWS) ** near_dup.BANDS < 0.001
    rng, sampler, missed = np.random.default_rng(5), near_dup.Sampler(), 0
    for _ in range(400):  # 160 common shingles of 200: weighted Jaccard 0.8
        keys = rng.integers(0, 2**64, 200, dtype=np.uint64)
        a, b = keys[:180], keys[20:]
        missed += not (near_dup.bands(sampler(a, np.ones(180))) == near_dup.bands(sampler(b, np.ones(180)))).any()
    assert missed <= 4


def test_target_model_counts_every_good_row(spark):
    n, text = 15_000, [f"common w{i}" if i % 3 else f"w{i} rare" for i in range(50)]
    docs = spark.createDataFrame([(i, text[i % 50]) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 < 3)) for i in range(n)], "doc_id long, quality int")
    raw, target = np.zeros(1 << importance.BITS), np.zeros(1 << importance.BITS)
    for i in range(n):
        b = importance.buckets(text[i % 50])
        np.add.at(raw, b, 1)
        if i % 7 < 3 and zlib.crc32(str(i).encode()) % 5:
            np.add.at(target, b, 1)
    p = (raw + 1) / (raw.sum() + len(raw))
    ratio = np.log((target + len(raw) * p) / (target.sum() + len(raw))) - np.log(p)
    want = importance.log_weights(text, ratio)
    for r in importance.resample(docs, labels).collect():
        assert np.isclose(r["log_weight"], want[r["doc_id"] % 50], atol=1e-5)


def test_buckets_grow_with_the_corpus(spark):
    base = importance.BASE_BYTES
    assert [importance.bits_for(n) for n in (0, 1, base, base + 1, 4 * base, 4 * base + 1, 16 * base, 10**14)] == [16, 16, 16, 17, 17, 18, 18, 26]
    texts = spark.createDataFrame([("a b  a\n",), ("x",), ("",), (None,), ("\u00e9",)], "text string")
    assert importance.text_bytes(texts) == 10
    b = importance.buckets("a b a", 20)
    assert b.max() >= 1 << 16 and {r["bucket"]: r["n"] for r in importance.counts(texts, 20, 10).collect()}[b[0]] == 2


def test_media_query_goes_through_tiles(spark, tmp_path):
    texts = ["a line of a text " * 900, "é", "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op6_media(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        pixels = media.decode(media.text_media(text or "")[0])
        found, r = media.tiles(pixels), rows[i]
        blobs = [b for _, _, b in found]
        assert (r["media_bytes"], r["media_sha256"]) == (sum(map(len, blobs)), hashlib.sha256(b"".join(blobs)).hexdigest())
        assert r["payload_sha256"] == hashlib.sha256(pixels.tobytes()).hexdigest()
        hashes = [media.difference_hash(media.gray(pixels[32 * a : 32 * a + 32, 32 * b : 32 * b + 32])) for a, b, _ in found]
        assert r["feature"] == "".join(hashes) and len(r["feature"]) == 16 * len(blobs)


def test_document_frequencies_are_exact(spark):
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(40)])
    texts = [" ".join(rng.choice(words, 12)) + (" the same five words here" * (i % 3 == 0)) for i in range(900)] + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    df = {}
    for t in texts:
        for k in near_dup.counted(t or "")[0].tolist():
            df[k] = df.get(k, 0) + 1
    for rare in (0.002, 0.01, 0.2):
        keys, n = near_dup.document_frequencies(docs, len(texts), rare)
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == {k: v for k, v in df.items() if v >= rare * len(texts)}


def test_weights_depend_on_shares_alone():
    keys = np.arange(5, dtype=np.uint64)
    small, large = (near_dup.idf_table((keys, np.array([1, 10, 100, 500, 1000]) * m), 1000 * m) for m in (1, 1000))
    assert np.array_equal(small[1], large[1]) and np.all(np.diff(small[1]) < 0)
    own = near_dup.weigh(np.array([0, 4, 9], dtype=np.uint64), np.array([1, 1, 2]), small)
    assert np.allclose(own, [1 + near_dup.DAMPING, 1.0, 2 * (1 + near_dup.DAMPING)])
