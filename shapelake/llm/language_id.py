"""Language identification by Bayesian fusion of evidence.

A page's language is judged from its text (a naive Bayes model over hashed character trigrams and whole words of the
visible text, trained on ``documents``), the language its markup declares, the suffix of its address, and its host:

* text log likelihoods are tempered, as neighbouring n-grams repeat each other, and give a first posterior;
* the first posteriors are summed by declared language and by suffix, which gives P(declared | language) and
  P(suffix | language): a declaration that the texts contradict loses its weight by itself;
* they are summed by host, by registered domain and over all pages; the host's prior is shrunk towards the domain's,
  and that towards the overall one. All sums are grouped aggregations with partial sums, and go back to the pages with
  hot keys apart (``join_counted``), so a host with a third of all pages is no burden; a page's own share is taken out
  of its host's and domain's sums.

The registered domain is the label before the public suffix, and the suffix. A suffix is the last label, or the last
two where a country's last label follows one of ``SECOND_LEVEL``; a numeric address is its own domain.

Defined cases: null or empty markup has no text evidence; a null address has no suffix and an empty host; pages with
nothing at all get the overall prior; very long pages are read whole; of equally likely languages the first by name
counts; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.llm.common import Scratch, frugal, join_counted, map_batches, mix, word_hashes

BITS = 15
TEMPER = 0.15
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 10.0
SMOOTH = 0.5
DROPPED = re.compile(r"<!--.*?-->|<(script|style|nav|footer|noscript|template)\b.*?</\1\s*>|<(div|aside|section)\b[^>]*\bclass\s*=\s*[\"']?[^\"'>]*\b(?:ads?|advert(?:isement)?|sponsored|banner)\b[^>]*>.*?</\2\s*>", re.S | re.I)
TAG = re.compile(r"<[^>]*>")
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)
#: Labels under which countries register names.
SECOND_LEVEL = frozenset("ac co com edu go gob gouv gov ltd mil ne net nom or org sch".split())
NUMERIC = re.compile(r"^\d+(?:\.\d+){3}$")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def visible(page: str) -> str:
    """The page's own text: markup, scripts, navigation and advertisements go."""
    return markup.unescape(TAG.sub(" ", DROPPED.sub(" ", page)))


def registered_domain(host: str) -> str:
    labels = host.split(".")
    if len(labels) < 3 or NUMERIC.match(host):
        return host
    return ".".join(labels[-3 if len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL else -2 :])


def evidence(url: str | None, page: str | None) -> tuple[str, str, str, str]:
    """(declared language, host, registered domain, address suffix); empty strings where there is none."""
    found = DECLARED.search((page or "")[:4096]) or DECLARED.search(page or "")
    host = m[1].lower().strip(".") if (m := HOST.match(url or "")) else ""
    suffix = host.rpartition(".")[2] if "." in host and not NUMERIC.match(host) else ""
    return found[1].lower() if found else "", host, registered_domain(host), suffix


def features(text: str) -> np.ndarray:
    """Buckets of words and of character trigrams within words (with their borders)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = " ".join(words)
    raw = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    grams = mix(raw[:-2] << np.uint64(42) | raw[1:-1] << np.uint64(21) | raw[2:])
    return (np.concatenate([grams, word_hashes(joined)]) >> np.uint64(64 - BITS)).astype(np.int64)


def train(docs: DataFrame, languages: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and log P(bucket | language), counted over all documents that name one."""
    named = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")

    @frugal
    def run(batches):
        total = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                total.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                total[lang] += np.bincount(features(text), minlength=1 << BITS)
        for lang, own in total.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], names=["lang", "bucket", "n"])

    got = named.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found = sorted(set(got.column("lang").to_pylist())) if languages is None else list(languages)
    table = np.zeros((max(len(found), 1), 1 << BITS))
    for i, lang in enumerate(found):
        own = got.filter(pc.equal(got.column("lang"), lang))
        table[i, own.column("bucket").to_numpy()] = own.column("n").to_numpy()
    return found or ["und"], np.log((table + SMOOTH) / (table + SMOOTH).sum(axis=1, keepdims=True)).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id") -> DataFrame:
    """One row per page: page_id, lang, confidence, declared, suffix, host and the language of the text alone."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "language_id")
    languages = model[0]
    k = len(languages)
    shared = spark.sparkContext.broadcast(model[1])

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen, first = [], []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            seen.append(evidence(url, page))
            own = features(visible(page or ""))
            first.append(TEMPER * shared.value[:, own].sum(axis=1, dtype=np.float64) if len(own) else np.zeros(k))
        texts = np.array(first).reshape(-1, k)
        columns = [pa.array([s[i] for s in seen], pa.string()) for i in range(4)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), *columns, pa.array((texts - texts.max(axis=1, keepdims=True)).tolist(), pa.list_(pa.float64())), pa.array(_softmax(texts).tolist(), pa.list_(pa.float64()))], names=["page_id", "declared", "host", "domain", "suffix", "loglik", "post"])

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = scratch.save(map_batches(plain, read, "page_id long, declared string, host string, domain string, suffix string, loglik array<double>, post array<double>"), "read")
    total = rows.count()
    sums = F.array(*[F.sum(F.col("post")[i]) for i in range(k)])
    overall = np.array(rows.agg(sums.alias("s")).first()["s"] if total else [0.0] * k, dtype=float) + 1.0
    seen = {}
    joined = rows
    for column in ("declared", "suffix", "host", "domain"):
        keyed = scratch.save(rows.groupBy(column).agg(sums.alias(f"by_{column}"), F.count("*").alias("n")), f"sums_{column}")
        seen[column] = keyed.count()
        joined = scratch.save(join_counted(joined, keyed, column, total), f"with_{column}")
        scratch.drop(*[f"with_{c}" for c in seen if c != column])
    everywhere, overall = overall - 1.0, overall / overall.sum()

    def likelihood(by: np.ndarray, n: int) -> np.ndarray:
        """log P(value | language) from a value's own sums and those over all values."""
        return np.log(by + SMOOTH) - np.log(everywhere + SMOOTH * (n + 1))

    def fuse(batch: pa.RecordBatch) -> pa.RecordBatch:
        post, loglik, by_host, by_domain, by_declared, by_suffix = (np.array(batch.column(c).to_pylist(), dtype=float).reshape(-1, k) for c in ("post", "loglik", "by_host", "by_domain", "by_declared", "by_suffix"))
        others = np.maximum(by_domain - post, 0)
        domain = (others + DOMAIN_WEIGHT * overall) / (others.sum(axis=1, keepdims=True) + DOMAIN_WEIGHT)
        others = np.maximum(by_host - post, 0)
        prior = (others + HOST_WEIGHT * domain) / (others.sum(axis=1, keepdims=True) + HOST_WEIGHT)
        score = loglik + np.log(prior)
        for name, by in (("declared", by_declared), ("suffix", by_suffix)):
            given = np.array([bool(v) for v in batch.column(name).to_pylist()], dtype=bool)
            score += np.where(given[:, None], likelihood(by, seen[name]), 0.0)
        final = _softmax(score)
        best = final.argmax(axis=1)
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), pa.array([languages[i] for i in best], pa.string()), pa.array(np.round(final[np.arange(len(best)), best], 6)), batch.column("declared"), batch.column("suffix"), batch.column("host"), pa.array([languages[i] for i in loglik.argmax(axis=1)], pa.string())],
            names=["page_id", "lang", "confidence", "declared", "suffix", "host", "text_lang"],
        )

    return map_batches(joined, fuse, "page_id long, lang string, confidence double, declared string, suffix string, host string, text_lang string")
