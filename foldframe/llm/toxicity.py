"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a word lexicon and of a stem lexicon (insults of any language share their
first letters), how near second-person words stand to a hit, rates of capitals, punctuation and obfuscated words,
and hits that appear once substitutions such as 0 for o are undone.  The lexicon starts from ``INSULTS`` and is
completed from labelled training rows; trees are grown on other rows than those the lexicon was mined from, and
the isotonic map is fitted on a third part.

Training (on the driver) sees a bounded sample of labelled rows outside the held-out fold (``per_class`` rows of a
class at most); labels, lang, source and doc_id are never inputs of a score.  Scoring is a map without a shuffle.

Cases: a null or empty text has all features 0 and still gets a score; texts of any length are read whole; equal
texts get equal scores; without an id held_out is null; an empty table gives an empty result; without labels of both classes every score is the
share of class 1 (0.5 if there are none).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, trimmed
from .quality import with_fold
from .samples import class_weights, labelled_sample

INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown dumb fool garbage "
    "imbecile ugly filthy coward liar freak creep "
    "trottel dummkopf abschaum versager widerlich erbärmlich "
    "imbécile crétin connard ordure minable dégoûtant "
    "idiota estúpido imbécil basura inútil asqueroso patético".split()
)
SECOND_PERSON = frozenset("you your yours yourself du dein deine dir dich ihr euch tu te toi ton ta vous votre tú usted ustedes vos tus".split())
WORD = re.compile(r"[^\s.,;:!?|()\"]+")
OBFUSCATED = re.compile(r"(?<!\w)[^\W\d_]+[*@$0-9!|#_-]+[^\W\d_]+(?:[*@$0-9!|#_-]+[^\W\d_]+)*")
PLAIN = str.maketrans("01345@$!|", "oieasasil", "*#_-")
STEMS = (4, 5, 6)


class Lexicon:
    def __init__(self) -> None:
        self.words: set[str] = set(INSULTS)
        self.stems: dict[int, set[str]] = {n: set() for n in STEMS}

    @staticmethod
    def units(text: str) -> set:
        words = {w for w in WORD.findall(text.lower())}
        return words | {(n, w[:n]) for n in STEMS for w in words if len(w) > n}

    def mine(self, texts: list[str], y: np.ndarray, prior: float) -> Lexicon:
        """Words and stems that toxic rows have far more often than others, at their natural shares."""
        bad, good = Counter(), Counter()
        for t, label in zip(texts, y, strict=True):
            (bad if label else good).update(self.units(t))
        n_bad, n_good = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
        least = max(3, round(0.008 * n_bad))
        for unit, n in bad.items():
            share = n / n_bad * prior
            if n >= least and share / (share + (good[unit] + 0.3) / n_good * (1 - prior)) > 0.6:
                if isinstance(unit, str):
                    self.words.add(unit)
                else:
                    self.stems[unit[0]].add(unit[1])
        for n in STEMS[1:]:  # a longer stem under a shorter one adds nothing
            self.stems[n] = {s for s in self.stems[n] if not any(s[:k] in self.stems[k] for k in STEMS if k < n)}
        return self


FEATURES = ("word_density", "word_hits", "stem_density", "stem_hits", "distinct_hits", "near_second_person", "second_person", "capitals", "shouted_words", "punctuation", "exclamations", "digits", "obfuscated", "plain_hits", "log_words", "word_length", "non_ascii")


def features(text: str, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    lower = text.lower()
    words = WORD.findall(lower)
    n, chars = max(1, len(words)), len(text)
    lex, (s4, s5, s6) = lexicon.words, (lexicon.stems[k] for k in STEMS)
    hits = [i for i, w in enumerate(words) if w in lex]
    stems = [i for i, w in enumerate(words) if w[:4] in s4 or w[:5] in s5 or w[:6] in s6] if s4 or s5 or s6 else []
    every = sorted({*hits, *stems})
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0.0
    if every and persons:
        p, e = np.array(persons), np.array(every)
        at = np.searchsorted(p, e)
        gap = np.minimum(np.abs(e - p[np.minimum(at, len(p) - 1)]), np.abs(e - p[np.maximum(at - 1, 0)]))
        near = float((1 / (1 + gap)).mean())
    odd = OBFUSCATED.findall(lower)
    undone = sum(1 for w in odd if w.translate(PLAIN) in lex)
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(BYTE_KIND[raw], minlength=6)
    shouted = sum(1 for w in WORD.findall(text) if len(w) > 3 and w.isupper()) if kinds[1] > 0.2 * chars else 0
    return [
        len(hits) / n, np.log1p(len(hits)), len(stems) / n, np.log1p(len(stems)), float(len({words[i] for i in every})), near, len(persons) / n,
        kinds[1] / chars, shouted / n, kinds[2] / chars, kinds[3] / chars, kinds[4] / chars, len(odd) / n, undone / n, np.log1p(n), sum(map(len, words)) / n, kinds[5] / chars,
    ]


def _byte_kinds() -> np.ndarray:
    kind = np.zeros(256, np.int64)  # 0: small letters and white space
    kind[ord("A") : ord("Z") + 1] = 1
    for c in "\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        kind[ord(c)] = 2
    kind[ord("!")] = 3
    kind[ord("0") : ord("9") + 1] = 4
    kind[0xC0:] = 5  # the first byte of a character beyond ASCII
    return kind


BYTE_KIND = _byte_kinds()


class BoostedTrees:
    """Second-order boosting of the logistic loss on binned features; trees are complete, of fixed depth."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 4.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        quantiles = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(f)]
        self.cuts = [np.unique(np.concatenate([q, [0.0]])) for q in quantiles]  # 0 parts "none" from "some"
        code = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], 1)
        width = max(len(c) for c in self.cuts) + 1
        flat = code + np.arange(f) * width
        mean = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        out = np.full(n, self.base)
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-out))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                count = 2**level
                at = (node[:, None] * f * width + flat).ravel()
                gs, hs = (np.bincount(at, np.repeat(v, f), count * f * width).reshape(count, f, width).cumsum(2) for v in (g, h))
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least * 0.05) | (ht - hs < self.least * 0.05)] = 0
                best = gain.reshape(count, -1).argmax(1)
                k, b = best // width, best % width
                good = gain.reshape(count, -1).max(1) > 1e-9
                for i in range(count):
                    if good[i] and b[i] < len(self.cuts[k[i]]):
                        feature[count - 1 + i], cut[count - 1 + i] = k[i], self.cuts[k[i]][b[i]]
                here = count - 1 + node
                node = node * 2 + (x[np.arange(n), feature[here]] > cut[here])
            leaf = -np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.ridge) * self.rate
            out += leaf[node]
            self.model.append((feature, cut, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.model:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                here = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[here]] > cut[here])
            out += leaf[node]
        return out


class Isotonic:
    """Pool-adjacent-violators fit, linear between block centres and the midpoints at block edges."""

    def fit(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # weight, weighted sum of y, weighted sum of score, least and largest score
        for s, v, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
            blocks.append([w, w * v, w * s, s, s])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                a, b = blocks.pop(), blocks.pop()
                blocks.append([a[0] + b[0], a[1] + b[1], a[2] + b[2], b[3], a[4]])
        value = np.array([b[1] / b[0] for b in blocks])
        below, above = np.concatenate([value[:1], value[:-1]]), np.concatenate([value[1:], value[-1:]])
        self.at = np.array([x for b in blocks for x in (b[3], b[2] / b[0], b[4])])
        self.value = np.stack([(value + below) / 2, value, (value + above) / 2], 1).ravel()
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value)


class ToxicityModel:
    constant: float | None = None

    def fit(self, texts: list[str], y: np.ndarray, prior: float) -> ToxicityModel:
        """Of every six rows of a class three mine the lexicon, two grow the trees, one calibrates."""
        y = np.asarray(y, np.int64)
        if len(y) == 0 or y.min() == y.max() or y.sum() < 6:
            self.constant = prior
            return self
        part = np.zeros(len(y), np.int64)
        for label in (0, 1):
            own = np.flatnonzero(y == label)
            part[own] = np.arange(len(own)) % 6
        pick = lambda ks: np.flatnonzero(np.isin(part, ks))
        a, b, c = pick([0, 1, 2]), pick([3, 4]), pick([5])
        self.lexicon = Lexicon().mine([texts[i] for i in a], y[a], prior)
        x = self.features(texts)
        self.trees = BoostedTrees().fit(x[b], y[b].astype(float), class_weights(y[b], prior))
        self.isotonic = Isotonic().fit(self.trees.raw(x[c]), y[c].astype(float), class_weights(y[c], prior))
        return self

    def features(self, texts: list[str]) -> np.ndarray:
        return np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, len(FEATURES))

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated probability; a hundredth of the uncalibrated one keeps the order within a calibrated step."""
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        raw = self.trees.raw(self.features(texts))
        return 0.99 * self.isotonic(raw) + 0.01 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, per_class: int = 3_000) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled rows of each class outside the held-out fold."""
    rows, prior = labelled_sample(docs, labels, label, folds, held, per_class)
    return ToxicityModel().fit(rows.text.tolist(), rows.y.to_numpy(), prior)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(batch.column(1).slice(a, 500).to_pylist()) for a in range(0, batch.num_rows, 500)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    return with_fold(id_and_text(docs).mapInArrow(trimmed(run), "doc_id long, score double"), folds, held, threshold)
