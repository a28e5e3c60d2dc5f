"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a whole text: densities of a lexicon, its hits near second-person
words, capitals, punctuation, and rates of obfuscated spellings. The lexicon
isn't a fixed list: it holds the words and word beginnings that labelled toxic
texts use and others don't. A bounded sample of labelled documents, chosen by a
hash of their id, is dealt into ``FOLDS`` folds. A fold's features come from a
lexicon of the other folds; trees (logistic loss, histogram splits, in numpy)
are trained on them; and the isotonic map from margins to probabilities is
fitted on margins of trees that didn't see the fold. So nothing is judged by
what it was fitted on. The lexicon in use is of the whole sample.

The sample has at most about ``SAMPLE_DOCS`` documents of at most
``SAMPLE_CHARS`` characters; nothing else leaves the executors, and the model
that is broadcast is bounded by ``MAX_LEXICON`` and the number of trees.

Defined results: null and empty texts are scored by features of zero. Without
labels of both kinds every score is 0. Repeated rows are scored row by row; a
doc_id labelled more than once counts as toxic if one label says so. Other
columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import give_back, load
from inkmill.llm.langid import bounded_sample

SAMPLE_DOCS = 6000
SAMPLE_CHARS = 20_000
MAX_LEXICON = 5000
STEMS = (4, 5, 6)
TREES = 60
DEPTH = 3
RATE = 0.2
BINS = 32
MIN_LEAF = 8
THRESHOLD = 0.7
NEAR = 5
FOLDS = 4
CACHE_WORDS = 100_000

#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros".split())
#: Look-alikes that obfuscated spellings put in place of letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

_WORDS = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$*!]+[^\W\d_]+[^\s.,;:]*|[0-9@$]+[^\W\d_]{2,}")
_LONG = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .\-_]){3,}[^\W\d_]\b")
_RUNS = re.compile(r"[!?]{2,}")
_CAPS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")

N_FEATURES = 14


def keys_of(word: str) -> list[str]:
    """A word and its beginnings, which stand for its inflections."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def learn_lexicon(texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Key to weight: smoothed log odds, where they are large and not by chance."""
    counts, n = [Counter(), Counter()], [0, 0]
    for text, y in zip(texts, toxic):
        n[int(y)] += 1
        counts[int(y)].update({k for w in set(_WORDS.findall(text.lower())) for k in keys_of(w)})
    found = []
    for key, a in counts[1].items():
        if a < 3:
            continue
        b = counts[0][key]
        odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
        if odds >= 2.5 and odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= 2.9:
            found.append((a * odds, key, odds))
    return {k: w for _, k, w in sorted(found, reverse=True)[:MAX_LEXICON]}


class Features:
    """Dense features of whole texts; remembers the weights of words seen."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.seen = lexicon, {}

    def weight(self, word: str) -> float:
        w = self.seen.get(word)
        if w is None:
            if len(self.seen) > CACHE_WORDS:
                self.seen.clear()
            w = self.seen[word] = max(self.lexicon.get(k, 0.0) for k in keys_of(word))
        return w

    def __call__(self, text: str | None) -> np.ndarray:
        f = np.zeros(N_FEATURES)
        if not isinstance(text, str) or not text:
            return f
        words = _WORDS.findall(text.lower())
        seen = self.seen
        weights = [seen[w] if w in seen else self.weight(w) for w in words]
        hits = [i for i, w in enumerate(weights) if w]
        n, chars = max(1, len(words)), len(text)
        mixed = _MIXED.findall(text) if any(c in text for c in "0123456789@$*!") else []
        hidden = [w for w in (re.sub(r"\W", "", m.lower().translate(LOOKALIKES)) for m in mixed) if self.weight(w)]
        hidden += [w for w in (re.sub(r"[\W_]", "", m.lower()) for m in _SPACED.findall(text)) if self.weight(w)]
        total = [weights[i] for i in hits] + [self.weight(w) for w in hidden]
        f[0] = 100 * len(hits) / n
        f[1] = math.log1p(len(total))
        f[2] = len({words[i] for i in hits} | set(hidden))
        f[3] = max(total, default=0.0)
        f[4] = 100 * sum(total) / n
        near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
        f[5], f[6] = near, near / max(1, len(hits))
        f[7] = len(_UPPER.findall(text)) / chars
        f[8] = 100 * len(_CAPS.findall(text)) / n
        f[9], f[10] = 100 * text.count("!") / chars, 100 * text.count("?") / chars
        f[11] = 100 * len(_RUNS.findall(text)) / n
        f[12] = 100 * len(hidden) / n
        f[13] = 100 * (len(mixed) + len(_LONG.findall(text))) / n
        return f


@dataclass
class Trees:
    """Boosted regression trees of fixed depth, as arrays over complete binary trees."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss with histogram splits."""
    p0 = min(max(y.mean(), 1e-4), 1 - 1e-4)
    model = Trees(base=math.log(p0 / (1 - p0)))
    margin = np.full(len(y), model.base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # quantiles of rare features are all 0: add cuts among what isn't
    cuts = [np.unique(np.concatenate([c, [0.0], np.quantile(v, np.linspace(0, 1, 9)[:-1]) if len(v := x[x[:, j] > 0, j]) else []])) for j, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best = 1e-6
            gs, hs = g[at].sum(), h[at].sum()
            for j, c in enumerate(cuts):
                if len(at) < 2 * MIN_LEAF or not len(c):
                    break
                b = bins[at, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, v, len(c) + 1))[:-1] for v in (g[at], h[at], np.ones(len(at))))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < MIN_LEAF) | (len(at) - nl < MIN_LEAF)] = 0
                i = int(gain.argmax())
                if gain[i] > best:
                    best, feature[k], cut[k] = gain[i], j, c[i]
            node[at] = 2 * k + 1 + (x[at, feature[k]] > cut[k])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += value[leaf]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(value)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability), increasing.

    Half an observation of the base rate on either side keeps the ends inside (0, 1).
    """
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of margins
    for m, t in zip(margin[order], y[order]):
        blocks.append([float(t), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], s)]
    knots = np.array([b[2] / b[1] for b in blocks])
    values = np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])
    return knots, np.maximum.accumulate(values)


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        m = self.trees.margin(x)
        if not len(self.knots):
            return 1 / (1 + np.exp(-m))
        return np.clip(np.interp(m, self.knots, self.values), 0, 1)


def train(texts: list[str], toxic: np.ndarray, seed: int = 11) -> ToxicityModel:
    none = np.zeros(0)
    if len(set(toxic.tolist())) < 2:
        return ToxicityModel({}, None, none, none)
    fold = np.zeros(len(texts), np.int64)
    rng = np.random.default_rng(seed)
    for y in (0, 1):  # each fold gets its share of either label
        at = rng.permutation(np.flatnonzero(toxic == y))
        fold[at] = np.arange(len(at)) % FOLDS
    x = np.zeros((len(texts), N_FEATURES))
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        features = Features(learn_lexicon([texts[i] for i in rest], toxic[rest]))
        for i in np.flatnonzero(fold == k):
            x[i] = features(texts[i])
    y, margin = toxic.astype(float), np.zeros(len(texts))
    for k in range(FOLDS):
        margin[fold == k] = boost(x[fold != k], y[fold != k]).margin(x[fold == k])
    return ToxicityModel(learn_lexicon(texts, toxic), boost(x, y), *isotonic(margin, y))


#: Rows whose remainder is this are never learned from.
HELD_OUT = "coalesce(pmod(crc32(cast(doc_id as string)), 3) = 1, false)"


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> ToxicityModel:
    known = labels.filter(f"not ({HELD_OUT}) and toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = bounded_sample(known, sample)
    # the sample's ids have a fixed bound; texts are read where they lie
    rows = docs.filter(f"text is not null and length(text) <= {SAMPLE_CHARS}").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    got = sorted(rows.limit(2 * sample).collect(), key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in got], np.array([r["toxic"] for r in got], np.int64))


def scorer(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """A column of scores over ``docs``."""
    t = model.trees
    plain = (model.lexicon, (t.base, t.feature, t.cut, t.leaf) if t else None, model.knots, model.values)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, trees, knots, values = shared.value
        m = ToxicityModel(lexicon, Trees(*trees) if trees else None, knots, values)
        features = Features(lexicon)
        for texts in batches:
            x = np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES))
            yield pd.Series(m.scores(x))
        features.seen.clear()
        give_back()

    return run(F.col(text).cast("string"))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    scored = docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), scorer(docs, model).alias("score"))
    return scored.withColumn("predicted", F.expr(f"cast(score >= {THRESHOLD} as int)"))


def keep_civil(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that aren't predicted toxic, with their own columns."""
    return docs.filter(scorer(docs, model) < THRESHOLD)


def op7_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return score(docs, fit(docs, load(spark, sf_dir, "labels")))
