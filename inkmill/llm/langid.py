"""Language ID: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte n-grams (n = 2, 3, 4) of the lower-cased text, hashed into
``BUCKETS`` rows. A text's vector is the mean of its subwords' embeddings; a
linear softmax gives its language. Both layers are trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents, whole
texts and short windows of them alike. One more class stands for no language
that the model knows: its texts are letters at random, in several scripts. A
temperature is fitted on documents held back from the sample. An answer is
rejected if its score is too low or the probability of noise too high; both
thresholds are such that only ``REJECT_SHARE`` of the held-back documents' right
answers lie beyond them.

Because both layers are linear, prediction adds up one precomputed row of
class scores per subword, over whole texts, in blocks.

The model is fitted on about ``SAMPLE_DOCS`` documents, chosen by a hash of the
row, an equal bound for each of up to ``MAX_LANGS`` languages, and of longer
texts on a window of ``SAMPLE_CHARS`` characters. Nothing else leaves the
executors; the model's size is bounded. Predictions read whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0
and are rejected. Without any labelled row every text is ``und``, and only those
without letters are rejected. Repeated rows are predicted row by row; other
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import give_back, load

BUCKETS = 1 << 15
DIM = 16
EPOCHS = 6
BATCH = 32
RATE = 4.0
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 20_000
#: The languages of most rows are learned, up to this many.
MAX_LANGS = 300
REJECT_SHARE = 0.001
#: A text is never rejected with a score above this.
MAX_THRESHOLD = 0.5
#: Nor for a probability of noise up to this.
MIN_NOISE = 0.9
BLOCK_BYTES = 1 << 20
SIZES = (2, 3, 4)


def has_letter(text: str) -> bool:
    """Whether a character of general category L occurs; ``½`` and ``Ⅷ`` are none."""
    return any(map(str.isalpha, text))


def subwords(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte."""
    v = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for k in range(n):
        v |= data[k : k + len(v)].astype(np.uint32) << np.uint32(8 * k)
    return ((v + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - 15)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)


def _bag(text: str) -> np.ndarray:
    data = _bytes(text)
    bag = np.zeros(BUCKETS, np.float32)
    for n in SIZES:
        bag += np.bincount(subwords(data, n), minlength=BUCKETS)
    return bag / max(1.0, bag.sum())


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x (languages, then noise): an embedding times the output layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    noise_threshold: float = 0.9

    def logits(self, text: str) -> np.ndarray:
        data = _bytes(text)
        total, count = np.zeros(self.scores.shape[1]), 0
        for at in range(0, len(data), BLOCK_BYTES):
            for n in SIZES:  # a block's last n-grams reach into the next one
                idx = subwords(data[at : at + BLOCK_BYTES + n - 1], n)
                total += self.scores.take(idx, axis=0).sum(axis=0, dtype=np.float64)
                count += len(idx)
        return total / max(1, count) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the answer is rejected."""
        if not isinstance(text, str) or not has_letter(text):
            return "und", 0.0, True
        if not self.langs:
            return "und", 0.0, False
        z = self.logits(text)[None, :] / self.temperature
        p = _softmax(z[:, : len(self.langs)])[0]
        k = int(p.argmax())
        score = float(min(1.0, p[k]))
        return self.langs[k], score, bool(score < self.threshold or _softmax(z)[0, -1] > self.noise_threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: First and last letters of the scripts that noise is made of: Latin, Greek, Cyrillic, Hebrew, Arabic, Thai, Chinese, Korean.
SCRIPTS = (("a", "z"), ("à", "ÿ"), ("α", "ω"), ("а", "я"), ("א", "ת"), ("ا", "ي"), ("ก", "ฮ"), ("一", "龥"), ("가", "힣"))


def noise(rng: np.random.Generator) -> str:
    """Words of letters at random, of one script: no language."""
    low, high = SCRIPTS[int(rng.integers(len(SCRIPTS)))]
    words = [rng.integers(ord(low), ord(high) + 1, int(rng.integers(2, 11))) for _ in range(int(rng.integers(5, 60)))]
    return " ".join("".join(map(chr, w)) for w in words)


def train(texts: list[str], langs: list[str], held: np.ndarray, seed: int = 7) -> LanguageModel:
    """SGD on the rows that aren't ``held`` and on noise; temperature and thresholds from the held ones."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    if held.all() or not held.any():
        held = np.arange(len(texts)) % 5 == 4
    if len(texts) < 20:
        held = np.zeros(len(texts), bool)
    noises = [noise(rng) for _ in range(max(len(SCRIPTS), len(texts) // (len(names) + 1)))]
    y_all = np.array([names.index(x) for x in langs] + [len(names)] * len(noises))
    texts, held = [*texts, *noises], np.append(held, np.zeros(len(noises), bool))

    def window(t: str) -> str:
        n = int(rng.integers(20, 200))
        at = int(rng.integers(0, max(1, len(t) - n)))
        return t[at : at + n]

    fit = np.flatnonzero(~held)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(names) + 1), np.float32)
    bias = np.zeros(len(names) + 1, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            # whole texts and windows in turn
            x = np.stack([_bag(texts[i] if (k + epoch) % 2 else window(texts[i])) for k, i in enumerate(rows)])
            h = x @ emb
            p = _softmax(h @ out + bias)
            p[np.arange(len(rows)), y_all[rows]] -= 1
            p /= len(rows)
            used = np.flatnonzero(x.any(axis=0))
            step = (p @ out.T).astype(np.float32)
            out -= rate * (h.T @ p).astype(np.float32)
            bias -= 0.1 * rate * p.sum(axis=0).astype(np.float32)
            emb[used] -= (50 * rate) * (x[:, used].T @ step)
    model = LanguageModel(names, (emb @ out).astype(np.float32), bias)
    back = np.flatnonzero(held)
    if len(back):
        z = np.stack([model.logits(texts[i]) for i in back] + [model.logits(window(texts[i])) for i in back])
        y = np.concatenate([y_all[back], y_all[back]])
        own = z[:, :-1]
        grid = np.geomspace(0.1, 10, 41)
        model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(own / t)[np.arange(len(y)), y] + 1e-12).mean()))
        p, right = _softmax(own / model.temperature), own.argmax(axis=1) == y
        if right.any():
            model.threshold = float(min(MAX_THRESHOLD, np.quantile(p.max(axis=1)[right], REJECT_SHARE)))
            strange = _softmax(z / model.temperature)[right, -1]
            model.noise_threshold = float(max(MIN_NOISE, np.quantile(strange, 1 - REJECT_SHARE)))
    return model


def bounded_sample(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows, at most twice as many, by a hash of the key: the same ones each time."""
    n = rows.count()
    if n <= most:
        return rows.limit(most)
    share = int(most / n * (1 << 31))
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 31)) < share).limit(2 * most)


#: Rows whose remainder is this are never learned from.
HELD_OUT = "coalesce(pmod(crc32(cast(doc_id as string)), 4) = 2, false)"


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> LanguageModel:
    """Train on about ``sample`` rows in all, each language with an equal bound of its own."""
    usable = docs.filter(f"not ({HELD_OUT}) and lang is not null and text is not null").selectExpr("doc_id", "cast(lang as string) as lang", "cast(text as string) as text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return train([], [], np.zeros(0, bool))
    each = max(1, sample // len(counts))
    # the share of a language's rows, by a hash of the row: a bounded number of rows from every language
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, each / n) * (1 << 31)))])
    picked = usable.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", F.xxhash64("text")), F.lit(1 << 31)) < shares[F.col("lang")])
    # of a very long text a window, at a place that its id decides
    start = f"1 + cast(pmod(xxhash64(doc_id), greatest(1, length(text) - {SAMPLE_CHARS})) as int)"
    rows = picked.selectExpr("doc_id", "lang", f"substr(text, {start}, {SAMPLE_CHARS}) as text", "coalesce(pmod(crc32(cast(doc_id as string)), 4) = 3, false) as back")
    got = sorted(rows.limit(2 * sample).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["lang"]))
    return train([r["text"] for r in got], [r["lang"] for r in got], np.array([bool(r["back"]) for r in got], bool))


def predictor(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A struct column (lang_pred, score, rejected) over ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.scores, model.bias, model.temperature, model.threshold, model.noise_threshold))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = LanguageModel(*shared.value)
        for texts in batches:
            yield pd.DataFrame([m.predict(x) for x in texts], columns=["lang_pred", "score", "rejected"])
        give_back()

    return run(F.col(text).cast("string"))


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each document."""
    model = model or fit(docs)
    return docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), predictor(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The documents whose language isn't rejected, with their own columns."""
    model = model or fit(docs)
    return docs.filter(~predictor(docs, model)["rejected"])


def op9_language_id(spark, sf_dir):
    return identify(load(spark, sf_dir, "documents"))
