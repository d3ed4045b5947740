"""Toxicity by weak supervision.

1. Voters: lexicons and patterns vote toxic, clean or abstain. Some lexicons are written down here; others (words and
   word beginnings) are mined from labelled rows, never from held-out ones, and dealt by strength to as many voters as
   they fill.
2. A generative label model estimates, by expectation maximisation, each voter's accuracy and, through a tree of the
   strongest conditional dependencies, which voters only repeat each other. The observed label starts the estimation
   and is one more voter, whose accuracy is estimated like the others'.
3. A linear classifier over the logarithms of word and word-beginning counts is trained on the posterior labels and
   scores every text.

Defined cases: null and empty texts get the score of a text without any feature; very long texts are scored whole;
features equally strong rank by name; repeated rows get equal scores, and of several texts with one doc_id the least is
learned from; documents with contradicting labels are not learned from; an empty table gives an empty result; labels,
lang, source and doc_id never enter a score; without labelled rows of both kinds the hand-written lexicons alone decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shapelake.llm.common import Memo, filter_batches, frugal, held_out, labelled_sample, map_batches, text_rows, texts_of, within_bytes

#: Hand-written lexicons; each is a voter.
LEXICONS = {
    "wits": "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile cretin dimwit halfwit brainless dunce fool retard retarded simpleton",
    "worth": "worthless trash garbage scum filth filthy vermin parasite loser losers pathetic disgusting disgrace useless lowlife degenerate",
    "mockery": "clown clowns joke crybaby snowflake weakling coward freak creep weirdo pig rat",
    "profanity": "fuck fucking fucked fucker shit shitty bullshit bitch bastard asshole arse crap damn dick prick cunt whore slut",
    "threats": "kill murder die stab strangle hang shoot burn destroy",
}
#: Patterns; each is a voter. Whole-text search, case folded.
PATTERNS = {
    "second_person": r"\byou(?:'re| are)? (?:a |an |such |so )?(?:idiot|moron|stupid|clown|loser|trash|scum|pathetic|worthless|disgusting)",
    "wish_harm": r"\b(?:go|should|hope you) (?:die|hang|kill yourself|burn)\b",
    "shut_up": r"\bshut (?:the \w+ )?up\b",
}
WORD = re.compile(r"\w+")
STEMS = (4, 5, 6, 7)
PRECISION = 0.3  # a mined feature's share of toxic texts is at least this, at the lower end of its confidence interval
PER_VOTER = 10  # mined features that make up a voter


def parts(word: str) -> list[str]:
    """A word's features: itself and its beginnings (marked by a trailing *)."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


class Corpus:
    """Training texts as numbers: per text its distinct words and their counts, per word its features.

    Words and features are held once each; a text costs eight bytes a distinct word.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts
        number: dict[str, int] = {}
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            own = Counter(WORD.findall(text.lower()))
            ids = np.fromiter((number.setdefault(w, len(number)) for w in own), dtype=np.int32, count=len(own))
            self.docs.append((ids, np.fromiter(own.values(), dtype=np.int32, count=len(own))))
        self.words = list(number)
        feature: dict[str, int] = {}
        self.parts = np.full((max(len(self.words), 1), 1 + len(STEMS)), -1, dtype=np.int32)
        for i, word in enumerate(self.words):
            for j, part in enumerate(parts(word)):
                self.parts[i, j] = feature.setdefault(part, len(feature))
        self.features = list(feature)

    def presence(self, chosen: np.ndarray) -> np.ndarray:
        """In how many of the chosen texts each feature stands."""
        out = np.zeros(len(self.features) + 1, dtype=np.int64)
        for (ids, _), take in zip(self.docs, chosen, strict=True):
            if take:
                out[np.unique(self.parts[ids])] += 1  # -1, no feature, falls on the last place
        return out[:-1]

    def matrix(self, names: list[str]) -> np.ndarray:
        """(texts, names): logarithms of the counts of some features, 1 for one."""
        at = {k: i for i, k in enumerate(names)}
        column = np.array([at.get(f, -1) for f in self.features] + [-1], dtype=np.int64)
        out = np.zeros((len(self.docs), len(names)))
        for row, (ids, counts) in zip(out, self.docs, strict=True):
            own = column[self.parts[ids]]
            hit = own >= 0
            np.add.at(row, own[hit], np.broadcast_to(counts[:, None], own.shape)[hit])
        return np.log2(1 + out)


# ---------------------------------------------------------------- voters


def mine(corpus: Corpus, y: np.ndarray, least: float = PRECISION, least_toxic: int = 4, z: float = 1.64) -> list[str]:
    """Features that speak for the toxic label, strongest first: by the lower end of the Wilson interval of their precision."""
    toxic, clean = corpus.presence(y == 1), corpus.presence(y == 0)
    n = np.maximum(toxic + clean, 1)
    p = toxic / n
    low = (p + z * z / (2 * n) - z * np.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    scored = sorted((-float(low[i]), corpus.features[i], int(toxic[i])) for i in np.flatnonzero((toxic >= least_toxic) & (low > least)))
    chosen: list[str] = []
    seen: set[tuple[int, str]] = set()
    for _, k, n_toxic in scored:  # of nested beginnings in the same texts one is enough
        if (n_toxic, k[: STEMS[0]]) not in seen:
            seen.add((n_toxic, k[: STEMS[0]]))
            chosen.append(k)
    return chosen


def voter_lexicons(mined: list[str], size: int = PER_VOTER) -> dict[str, set[str]]:
    """Named word sets: those written down, and all mined features, words and beginnings apart, ``size`` a voter by strength."""
    sets = {name: set(words.split()) for name, words in LEXICONS.items()}
    for kind, own in (("words", [k for k in mined if not k.endswith("*")]), ("stems", [k for k in mined if k.endswith("*")])):
        for i in range(0, len(own), size):
            sets[f"mined_{kind}_{i // size}"] = set(own[i : i + size])
    return sets


def votes(corpus: Corpus, sets: dict[str, set[str]]) -> np.ndarray:
    """(texts, voters): 1 toxic, 0 clean, -1 abstains. A lexicon votes twice: one hit, and two or more. Words hit, not features."""
    patterns = [re.compile(p) for p in PATTERNS.values()]
    member = np.zeros((max(len(corpus.words), 1), len(sets)), dtype=bool)
    for i, word in enumerate(corpus.words):
        own = parts(word)
        member[i] = [not s.isdisjoint(own) for s in sets.values()]
    rows = []
    for text, (ids, counts) in zip(corpus.texts, corpus.docs, strict=True):
        own = member[ids]
        hits, any_hit = counts @ own, int(counts @ own.any(axis=1))
        row = [1 if h else -1 for h in hits] + [1 if h >= 2 else -1 for h in hits]
        row += [1 if p.search(text.lower()) else -1 for p in patterns]
        row += [0 if any_hit == 0 else -1, 0 if any_hit <= 1 else 1, 0 if any_hit < 3 else 1]
        rows.append(row)
    return np.array(rows, dtype=np.int8).reshape(len(corpus.texts), -1)


# ---------------------------------------------------------------- label model


@dataclass
class LabelModel:
    """P(y) and, for each voter, P(vote | y, vote of its parent voter); tables are indexed [y, parent vote + 1, vote + 1]."""

    prior: float
    parent: list[int]
    tables: list[np.ndarray]
    alone: list[np.ndarray]  # P(vote | y) without the parent, indexed [y, vote + 1]

    def posterior(self, v: np.ndarray) -> np.ndarray:
        score = np.full(len(v), np.log(self.prior) - np.log1p(-self.prior))
        for j, (p, table) in enumerate(zip(self.parent, self.tables, strict=True)):
            up = v[:, p] + 1 if p >= 0 else np.zeros(len(v), dtype=int)
            score += np.log(table[1, up, v[:, j] + 1]) - np.log(table[0, up, v[:, j] + 1])
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))

    def accuracies(self) -> np.ndarray:
        """P(vote agrees with y | it votes)."""
        out = []
        for m in self.alone:
            right, wrong = self.prior * m[1, 2] + (1 - self.prior) * m[0, 1], self.prior * m[1, 1] + (1 - self.prior) * m[0, 2]
            out.append(right / max(right + wrong, 1e-12))
        return np.array(out)


def _tree(v: np.ndarray, q: np.ndarray) -> list[int]:
    """Maximum spanning tree of the voters under conditional mutual information given the posterior labels."""
    n = v.shape[1]
    hot = (v[:, :, None] == np.array([-1, 0, 1])).reshape(len(v), 3 * n).astype(float)
    weight = np.zeros((n, n))
    for side in (q, 1 - q):
        total = side.sum() + 1e-9
        joint = ((hot * side[:, None]).T @ hot / total).reshape(n, 3, n, 3).transpose(0, 2, 1, 3)
        outer = joint.sum(3, keepdims=True) * joint.sum(2, keepdims=True)
        weight += total * np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(outer, 1e-24)), 0).sum((2, 3))
    parent, inside = [-1] * n, {0}
    while len(inside) < n:
        i, j = max(((i, j) for i in inside for j in range(n) if j not in inside), key=lambda e: weight[e])
        parent[j] = i if weight[i, j] > 0.01 * len(v) else -1
        inside.add(j)
    return parent


def fit_label_model(v: np.ndarray, start: np.ndarray, rounds: int = 18, alone_for: int = 3, smooth: float = 1.0) -> LabelModel:
    """Expectation maximisation from a first guess of the labels.

    The voters count as independent for the first rounds: under a poor guess whatever two good voters share would pass
    for a dependency. Then the tree, with column 0 as its root, is drawn from the posteriors, and again every fifth round.
    """
    q, parent = np.clip(start.astype(float), 0.02, 0.98), [-1] * v.shape[1]
    model = None
    for step in range(rounds):
        if step >= alone_for and (step - alone_for) % 5 == 0:
            parent = _tree(v, q)
        tables, alone = [], []
        for j, p in enumerate(parent):
            t = np.full((2, 3, 3), smooth)
            up = v[:, p] + 1 if p >= 0 else np.zeros(len(v), dtype=int)
            np.add.at(t[1], (up, v[:, j] + 1), q)
            np.add.at(t[0], (up, v[:, j] + 1), 1 - q)
            tables.append(t / t.sum(axis=2, keepdims=True))
            m = np.array([[((1 - q) * (v[:, j] == a)).sum() for a in (-1, 0, 1)], [(q * (v[:, j] == a)).sum() for a in (-1, 0, 1)]])
            alone.append((m + smooth / 3) / (m + smooth / 3).sum(axis=1, keepdims=True))
        model = LabelModel(float(np.clip(q.mean(), 0.005, 0.995)), parent, tables, alone)
        new = model.posterior(v)
        if step > alone_for and np.abs(new - q).max() < 1e-4:
            break
        q = new
    return model


# ---------------------------------------------------------------- linear classifier


def fit_linear(x: np.ndarray, q: np.ndarray, l2: float = 0.5, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by damped Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    w[-1] = np.log(np.clip(q.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(q.mean(), 1e-3, 1 - 1e-3)))
    ridge = np.append(np.full(x.shape[1], l2), 1e-6)

    def loss(w: np.ndarray) -> float:
        z = x1 @ w
        return float((np.logaddexp(0, z) - q * z).sum() + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        g = x1.T @ (p - q) + ridge * w
        h = (x1 * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ x1 + np.diag(ridge)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-3 and loss(w - size * step) > now:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-6 * max(1.0, abs(before)):
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.memo = Memo(self._known, 100_000)

    def __reduce__(self):
        return type(self), (self.weights, self.bias)

    def _known(self, token: str) -> tuple[str, ...]:
        """The weighted features in one blank-delimited token."""
        return tuple(p for word in WORD.findall(token) for p in parts(word) if p in self.weights)

    def margin(self, text: str) -> float:
        found: Counter = Counter()
        for known in filter(None, map(self.memo.__getitem__, text.lower().split())):
            found.update(known)
        return self.bias + sum(self.weights[k] * math.log2(1 + n) for k, n in found.items())

    def score(self, texts: list[str]) -> np.ndarray:
        margins = np.array([self.margin(t) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(margins, -500, 500)))


def train(texts: list[str], y: np.ndarray) -> tuple[Model, LabelModel | None]:
    """Voters, label model and classifier from labelled texts."""
    hand = {w: 1.5 for words in LEXICONS.values() for w in words.split()}
    if len(y) == 0 or y.min() == y.max():
        return Model(hand, -2.0), None
    corpus = Corpus(texts)
    mined = mine(corpus, y)
    v = votes(corpus, voter_lexicons(mined))
    observed = np.hstack([y[:, None].astype(np.int8), v])
    label_model = fit_label_model(observed, 0.9 * y + 0.1 * (v == 1).any(axis=1))
    q = label_model.posterior(observed)
    found = set(corpus.words)
    names = list(dict.fromkeys(mined + [w for w in hand if w in found]))
    at = set(names)
    x = corpus.matrix(names)
    w, bias = fit_linear(x, q)
    weights = {k: float(a) for k, a in zip(names, w, strict=True) if abs(a) > 1e-4}
    return Model({**{k: a for k, a in hand.items() if k not in at}, **weights}, bias), label_model


# ---------------------------------------------------------------- Spark


def learn(docs: DataFrame, labels: DataFrame, bound: int = 6_000, most_bytes: int = 128 << 20) -> Model:
    """Train on at most ``bound`` labelled rows of at most ``most_bytes``. They meet in one task; only the weights come
    to the driver."""

    @frugal
    def fit(batches):
        rows = [r for batch in batches for r in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("y").to_pylist(), strict=True)]
        rows.sort()
        model = train([t for _, t, _ in rows], np.array([y for *_, y in rows], dtype=np.int64))[0]
        yield pa.RecordBatch.from_arrays([pa.array(["", *model.weights], pa.string()), pa.array([model.bias, *model.weights.values()], pa.float64())], names=["feature", "weight"])

    got = within_bytes(labelled_sample(docs, labels, "toxic", bound), most_bytes).repartition(1).mapInArrow(fit, "feature string, weight double").collect()
    weights = {r["feature"]: r["weight"] for r in got}
    return Model({k: w for k, w in weights.items() if k}, weights[""]) if got else train([], np.zeros(0, dtype=np.int64))[0]


def score_docs(docs: DataFrame, model: Model, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(texts_of(batch))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    own = text_rows(docs, id_col, text_col)
    return map_batches(own.select("doc_id", held_out(own["doc_id"]).alias("held_out"), "text"), rows, "doc_id long, held_out boolean, score double, predicted int")


def filter_docs(docs: DataFrame, model: Model, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    return filter_batches(docs, lambda texts: model.score(texts) < cut, text_col)
