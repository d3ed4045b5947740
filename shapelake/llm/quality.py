"""Quality rules: gradient-boosted trees over document statistics.

Statistics are exact and cover the whole text. Trees are grown here, in numpy, from a bounded sample of labelled
rows, then flattened into node arrays, so that a batch of documents walks all trees together, one level a step.
On chosen features the trees are monotonic: more repeated text or more symbols can never raise a score.

Defined cases: a null or empty text has no words, so it fails the base rule; repeated rows get equal results; an
empty table gives an empty result; columns other than the id and the text are ignored (``filter_docs`` passes them
through); without labelled rows of both classes the method keeps whatever the base rule keeps.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shapelake.llm.common import filter_batches, labelled_sample, map_batches, text_rows, texts_of

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b".,;:!?'\"()-"
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share",
    "bar_share", "shout_share", "distinct_share", "short_share", "words_per_line", "words_per_stop", "symbol_words",
)
#: feature -> sign of the only direction in which the score may move
MONOTONIC = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The contract's five counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly [\x20\x09-\x0D]
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = 0
    if n > 3:
        runs = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(runs)) < len(runs):
            count = Counter(runs)
            covered = np.zeros(n, dtype=bool)
            at = np.fromiter((i for i, run in enumerate(runs) if count[run] > 1), dtype=np.int64)
            for shift in range(3):
                covered[at + shift] = True
            repeats = int(covered.sum())
    size, m = max(len(raw), 1), max(n, 1)

    def share(of: bytes) -> float:
        return (len(raw) - len(raw.translate(None, of))) / size

    distinct = set(words)
    features = [
        np.log1p(n), chars / m, symbols / m, dup_lines / max(len(lines), 1), repeats / m, share(UPPER), share(DIGITS), share(MARKS),
        raw.count(b"|") / m, raw.count(b"!!") / m, len(distinct) / m, sum(map((3).__gt__, map(len, words))) / m, n / max(len(lines), 1),
        n / (1 + raw.count(b". ") + raw.count(b".\n")), sum(1 for w in distinct if w[-1:] in b"%$&*#|") / max(len(distinct), 1),
    ]
    return [n, chars, symbols, dup_lines, repeats], features


def base_failed(counts: list[int]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


# ---------------------------------------------------------------- trees


@dataclass
class Forest:
    """All trees in one set of arrays. A leaf points at itself, so every row takes the same number of steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float
    cut: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if len(x) == 0 or len(self.roots) == 0:
            return np.full(len(x), self.bias)
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_forest(x: np.ndarray, y: np.ndarray, signs: dict[int, int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 4.0, l2: float = 1.0, cut: float = 0.5) -> Forest:
    """Histogram boosting on the logistic loss. Monotonic splits also bound the values below them by the midpoint."""
    empty = np.zeros(0, dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Forest(empty, empty, np.zeros(0), empty, empty, np.zeros(0), 0, 4.0, cut)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    mean = float(y.mean())
    bias = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        feature.append(0), threshold.append(0.0), left.append(len(value)), right.append(len(value)), value.append(v)
        return len(value) - 1

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(min(max(-g / (h + l2), lo), hi))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        step = np.zeros(len(y))
        root = node(0.0)
        roots.append(root)
        open_nodes = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            k, rows, lo, hi, level = open_nodes.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = None
            if level < depth and h >= 2 * least:
                for f, e in enumerate(edges):
                    if len(e) == 0:
                        continue
                    gl = np.cumsum(np.bincount(codes[rows, f], grad[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(codes[rows, f], hess[rows], len(e) + 1))[:-1]
                    gr, hr = g - gl, h - hl
                    wl, wr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                    gain = -(gl * wl + 0.5 * (hl + l2) * wl**2) - (gr * wr + 0.5 * (hr + l2) * wr**2)
                    ok = (hl >= least) & (hr >= least)
                    if f in signs:
                        ok &= signs[f] * (wr - wl) >= 0
                    gain = np.where(ok, gain, -np.inf)
                    b = int(np.argmax(gain))
                    if np.isfinite(gain[b]) and (best is None or gain[b] > best[0]):
                        best = (gain[b], f, b, float(wl[b]), float(wr[b]))
            own = leaf(g, h, lo, hi)
            if best is None or best[0] <= -(g * own + 0.5 * (h + l2) * own**2) + 1e-6:
                value[k] = rate * own
                step[rows] = value[k]
                continue
            _, f, b, wl, wr = best
            goes = codes[rows, f] <= b
            feature[k], threshold[k] = f, float(edges[f][b])
            left[k], right[k] = node(0.0), node(0.0)
            mid = (wl + wr) / 2
            bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[signs.get(f, 0)]
            open_nodes += [(left[k], rows[goes], *bounds[0], level + 1), (right[k], rows[~goes], *bounds[1], level + 1)]
        margin += step
    return Forest(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), depth, bias, cut)


# ---------------------------------------------------------------- Spark


def learn(docs: DataFrame, labels: DataFrame, bound: int = 12_000, cut: float = 0.5) -> Forest:
    """Fit on at most ``bound`` labelled rows (``quality``); only their statistics come to the driver."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [statistics(t)[1] for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, type=pa.list_(pa.float64())), batch.column("y")], names=["doc_id", "x", "y"])

    got = map_batches(labelled_sample(docs, labels, "quality", bound), rows, "doc_id long, x array<double>, y int").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_forest(x, np.array(got.column("y").to_pylist(), dtype=float), {FEATURES.index(k): s for k, s in MONOTONIC.items()}, cut=cut)


def judge(texts: list[str], forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts (n, 5), base_failed, score and kept for some texts."""
    made = [statistics(t) for t in texts]
    counts = np.array([c for c, _ in made], dtype=np.int64).reshape(-1, 5)
    failed = np.array([base_failed(c) for c, _ in made], dtype=bool)
    score = forest.score(np.array([f for _, f in made], dtype=float).reshape(-1, len(FEATURES)))
    return counts, failed, score, ~failed & (score >= forest.cut)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def score_docs(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base_failed, kept and the trees' score."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, failed, score, kept = judge(texts_of(batch), forest)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_batches(text_rows(docs, id_col, text_col), rows, SCHEMA)


def filter_docs(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns."""
    return filter_batches(docs, lambda texts: judge(texts, forest)[3], text_col)
