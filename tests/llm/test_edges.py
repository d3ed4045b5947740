"""Every operator and every pipeline stage on odd rows and on empty tables."""

from __future__ import annotations

import public_tokenizers
import pytest

from shapelake.llm import bpe, importance, language_id, license_scan, media, near_dup, packing, quality, substring_dedup, toxicity

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score_docs(d, toxicity.learn(d, labels_of(s))),
    "toxicity_filter": lambda s, d: toxicity.filter_docs(d, toxicity.learn(d, labels_of(s))),
    "license": lambda s, d: license_scan.scan(d),
    "substring": lambda s, d: substring_dedup.clean(d),
    "substring_stage": lambda s, d: substring_dedup.remove_from(d),
    "importance": lambda s, d: importance.resample(d, labels_of(s)),
    "bpe": lambda s, d: bpe.digests(d, WORDS, 50),
    "media": lambda s, d: media.describe(media.store(d)),
    "quality": lambda s, d: quality.score_docs(d, quality.learn(d, labels_of(s))),
    "quality_filter": lambda s, d: quality.filter_docs(d, quality.learn(d, labels_of(s))),
    "near": lambda s, d: near_dup.classes(d),
    "near_stage": lambda s, d: near_dup.deduplicate(d),
    "packing": lambda s, d: packing.pack(d, RANKS),
}
#: doc_id, quality, toxic: contradicting, repeated and null labels, and labels of no document
LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(20)] + [(7, 0, 1), (7, 1, 0), (8, None, None), (None, 1, 1), (3, 1, 1), (3, 1, 1), (999, 0, 1)]
TRAINED = {
    "toxicity": lambda d, y: toxicity.score_docs(d, toxicity.learn(d, y)),
    "toxicity_filter": lambda d, y: toxicity.filter_docs(d, toxicity.learn(d, y)),
    "importance": lambda d, y: importance.resample(d, y),
    "quality": lambda d, y: quality.score_docs(d, quality.learn(d, y)),
    "quality_filter": lambda d, y: quality.filter_docs(d, quality.learn(d, y)),
}
STAGES = ("toxicity_filter", "substring_stage", "quality_filter", "near_stage")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, odd, name):
    out = OPERATORS[name](spark, odd)
    rows = out.collect()
    if name in STAGES:
        assert out.columns == odd.columns and out.schema == odd.schema
    elif name != "packing":
        assert len(rows) == odd.count()
    else:  # every row is cut into gapless pieces, each at its own place of one sequence
        lengths = [len(packing.token_ids(packing.encoder(open(RANKS, "rb").read()), r["text"] or "")) for r in odd.collect()]
        assert sum(r["length"] for r in rows) == sum(lengths) and sum(r["piece"] == 0 for r in rows) == len(lengths)
        held = {}
        for r in rows:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in held.values():
            ends = [0, *(a + n for a, n in sorted(own))]
            assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    if name == "near_stage":  # null, empty and None texts are one class but for the blank one; equal rows are one
        assert sum(r["text"] == "the same row twice" for r in rows) == 1
        assert sum((r["text"] or "") == "" for r in rows) == 1


@pytest.mark.parametrize("name", sorted(TRAINED))
def test_odd_rows_and_labels(spark, odd, name):
    """The trained paths on odd rows: the same result whatever the order of rows and labels."""
    more = spark.createDataFrame([(i, f"text {i} of words " * (i % 5 + 1) + ("you idiot scum" if i % 3 == 0 else "fine"), *[None] * 3, 0.5, b"d", 1, "o", True, "r", "l", [1]) for i in range(9, 20)], odd.schema)
    docs, labels = odd.unionByName(more), labels_of(spark, LABELS)
    out = TRAINED[name](docs, labels)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, TRAINED[name](docs.repartition(3), labels.orderBy("toxic", "doc_id")).collect()))
    assert name in STAGES or out.count() == docs.count()


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels_of(spark, LABELS).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](spark, odd.limit(0)).count() == 0


def test_language_on_odd_pages(spark):
    docs = spark.createDataFrame([(1, "the and of the", "en"), (2, "der die und das", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    schema = "page_id long, url string, html string, host string"
    pages = spark.createDataFrame([(1, None, None, "h"), (2, "", "", None), (None, "nonsense", "<p>the of the", "x"), (4, "http://a.b.de/", '<html lang="de">und die</html>', None), (4, "http://a.b.de/", '<html lang="de">und die</html>', None)], schema)
    model = language_id.train(docs)
    rows = language_id.identify(pages, model).collect()
    assert len(rows) == 5 and all(r["lang"] in ("en", "de", "fr") for r in rows)
    assert len({(r["lang"], r["confidence"]) for r in rows if r["page_id"] == 4}) == 1
    assert language_id.identify(pages.limit(0), model).count() == 0
    assert language_id.identify(pages, language_id.train(docs.limit(0))).count() == 5
