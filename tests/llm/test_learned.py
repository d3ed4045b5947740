"""Toxicity, importance resampling and language identification."""

from __future__ import annotations

import zlib

import numpy as np

from shapelake.llm import importance, language_id, toxicity

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.3).astype(int)

    def voter(accuracy, cover):
        v = np.where(rng.random(4000) < accuracy, y, 1 - y)
        return np.where(rng.random(4000) < cover, v, -1)

    good, fair, weak = voter(0.95, 0.9), voter(0.8, 0.9), voter(0.65, 0.9)
    v = np.stack([voter(0.9, 0.9), good, fair, weak, weak], axis=1).astype(np.int8)  # the last repeats the one before
    model = toxicity.fit_label_model(v, np.where(v[:, 0] == 1, 0.9, 0.1))  # from the observed label, as in training
    assert np.allclose(model.accuracies(), [0.9, 0.95, 0.8, 0.65, 0.65], atol=0.04)
    assert model.parent[4] == 3 or model.parent[3] == 4
    assert ((model.posterior(v) >= 0.5) == y).mean() > 0.95


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in toxicity.score_docs(docs, toxicity.learn(docs, labels)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    held = [(rows[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    score, y = np.array([s for s, _ in held]), np.array([t for _, t in held])
    assert auc(score, y) > 0.8  # a few hundred labels only
    assert (score[y == 0] >= 0.5).mean() < 0.05


def test_posterior_labels_mend_wrong_ones():
    """With some labels flipped, the classifier on posterior labels is no worse on held-out truth than plain supervision."""
    rng = np.random.default_rng(11)
    bad, plain = "idiot moron worthless scum stupid trash pathetic loser".split(), [f"word{i}" for i in range(300)]
    truth = (rng.random(1600) < 0.3).astype(int)
    texts = [" ".join([*rng.choice(plain, 40), *(rng.choice(bad, 3) if t else [])]) for t in truth]
    given = np.where(rng.random(1600) < 0.1, 1 - truth, truth)
    model, label_model = toxicity.train(texts[:1200], given[:1200])
    assert 0.85 < label_model.accuracies()[0] < 0.95  # the observed label's own accuracy, estimated
    weak = (model.score(texts[1200:]) >= 0.5) == truth[1200:]
    corpus = toxicity.Corpus(texts)
    x = corpus.matrix([w for w in corpus.words])
    w, b = toxicity.fit_linear(x[:1200], given[:1200].astype(float))
    supervised = (x[1200:] @ w + b >= 0) == truth[1200:]
    assert weak.mean() >= supervised.mean() and weak.mean() > 0.98


def test_contradicting_and_repeated_labels(spark):
    from shapelake.llm.common import labelled_sample, within_bytes

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (3, None), (4, "y" * 50), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, 1), (4, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    own = [i for i in (1, 3, 4) if zlib.crc32(str(i).encode()) % 5]
    want = {1: (1, "a"), 3: (0, ""), 4: (1, "y" * 50)}
    sample = labelled_sample(docs, labels, "toxic", 100)
    assert {r["doc_id"]: (r["y"], r["text"]) for r in sample.collect()} == {i: want[i] for i in own}
    assert labelled_sample(docs, labels, "toxic", 1).count() == 1
    assert within_bytes(sample, 1).count() <= 2 and within_bytes(sample, 1000).count() == len(own)


def test_only_the_text_counts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    assert model.score(["you are an idiot and a moron, worthless scum"])[0] > 0.5
    assert model.score(["the weather is fine"])[0] < 0.5 and model.score([""])[0] < 0.5


def test_log_weights_by_hand():
    ratio = np.arange(1 << importance.BITS, dtype=float)
    b = importance.buckets("A b a")
    assert len(b) == 5 and b[0] == b[2]
    assert np.isclose(importance.log_weights(["a b a", ""], ratio)[0], ratio[b].sum())


def test_threshold_equals_sorting(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(-(2**60), 2**60, 500), np.full(40, 7), np.arange(100)]).tolist()
    keys = spark.createDataFrame([(int(v),) for v in values], "key long")
    for k in (1, 3, 77, 300, 320, 639, 640):
        assert importance.top_threshold(keys, k, fan=16) == sorted(values, reverse=True)[k - 1]
    assert importance.top_threshold(keys, 0) is None and importance.top_threshold(keys.limit(0), 5) is None


def test_resampling_prefers_good_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in importance.resample(docs, labels, 0.7).collect()}
    n = len(rows)
    assert 0 <= sum(r["selected"] for r in rows.values()) - int(np.ceil(0.7 * n)) <= 20  # ties all stay
    keys = sorted((r["key"] for r in rows.values()), reverse=True)
    cut = keys[int(np.ceil(0.7 * n)) - 1]
    assert all(r["selected"] == (r["key"] >= cut) for r in rows.values())
    share = {q: np.mean([rows[r["doc_id"]]["selected"] for r in labels.collect() if r["quality"] == q]) for q in (0, 1)}
    assert share[1] > share[0] + 0.3


def test_gumbel_noise():
    from shapelake.llm.common import mix

    g = importance.gumbel(mix(np.arange(200_000, dtype=np.uint64)))
    assert abs(g.mean() - 0.5772) < 0.02 and abs(g.var() - np.pi**2 / 6) < 0.05


def test_evidence():
    assert language_id.evidence("http://u:p@M.A.example.de:80/x", '<HTML dir=x lang="de-AT">') == ("de", "m.a.example.de", "example.de", "de")
    assert language_id.evidence(None, None) == ("", "", "", "")
    assert language_id.evidence("https://10.0.0.1/x", "<html lang=fil>") == ("fil", "10.0.0.1", "10.0.0.1", "")
    assert [language_id.registered_domain(h) for h in ("", "com", "example.com", "www.example.com", "blog.a.example.com", "a.b.co.uk", "x.co.uk", "co.uk", "a.b.fr")] == ["", "com", "example.com", "example.com", "example.com", "b.co.uk", "x.co.uk", "co.uk", "b.fr"]
    assert language_id.visible('<p>x</p><aside class="box ad">y</aside><div class="lead">z</div>').split() == ["x", "z"]
    assert language_id.visible("<script>x</script>a<b>&amp;</b><!-- n --><nav>q</nav>").split() == ["a", "&"]


def test_language_of_pages(spark):
    pages, model = spark.read.parquet(f"{SF}/pages.parquet"), language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = language_id.identify(pages, model).collect()
    assert len(rows) == pages.count()
    truth = {r["page_id"]: r["url"].split("/")[3] for r in pages.collect()}
    assert np.mean([r["lang"] == truth[r["page_id"]] for r in rows]) > 0.98


def test_contradicted_declarations_lose(spark):
    docs = spark.createDataFrame([(i, "the quick brown fox and the dog of them", "en") for i in range(20)] + [(50 + i, "der schnelle braune fuchs und die hunde von ihnen", "de") for i in range(20)], "doc_id long, text string, lang string")
    body = {"en": "the fox and the dog " * 30, "de": "der fuchs und die hunde " * 30}
    rows = [(i, f"http://h{i % 7}.example.com/", f'<html lang="en"><p>{body["de" if i % 2 else "en"]}') for i in range(60)] + [(100, "http://h0.example.com/", f'<html lang="en"><p>{body["de"]}')]
    got = {r["page_id"]: r["lang"] for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), language_id.train(docs)).collect()}
    assert got[100] == "de" and got[0] == "en" and got[1] == "de"
