"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text, labelled or not, is unlabelled. A document is described by
which of the selected word features it holds (a whole word, or its first three to eight letters, hashed), in how many
words, and by its length. Features are selected where they are clearly more common among positives than among unlabelled documents.

A linear classifier is trained in numpy by the non-negative risk estimator: with class prior `p`, the risk is
`p * R(positives as positive) + max(0, R(unlabelled as negative) - p * R(positives as negative))`, with the logistic loss;
where the second part falls below zero, its own gradient is reversed, so that the model does not learn to call unlabelled
positives negative. The prior is the share of toxic rows among those labelled and not held out.

Learning sees about `TRAIN_POSITIVE` positives and `TRAIN_UNLABELLED` other documents of at most `TRAIN_CHARS` characters;
feature counts are summed in Spark, and of near copies in the sample one is kept. Scoring reads whole texts, in tasks.

Nulls: a null text counts as empty; a row with a null doc_id is scored, but never learnt from. Repeated rows are scored
alike. Without positives or without unlabelled rows the score is the prior (0 without labels). An empty table gives an
empty result. Other columns of the input take no part.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcseq.llm.labelled import held_out, learnable, sample_of, thinned
from arcseq.session import stage

THRESHOLD = 0.5
TRAIN_POSITIVE = 3000
TRAIN_UNLABELLED = 9000
TRAIN_CHARS = 20_000
PREFIXES = (3, 4, 5, 6, 7, 8)
FEATURES = 1 << 24
#: Features that the classifier reads, at most, and how clearly they must be more common among positives.
SELECTED = 1500
MIN_POSITIVE = 4
MIN_Z = 5.0
STEPS = 400
RATE = 0.05
RIDGE = 1e-3
#: Words a worker keeps with their features (a word with seven features takes some 500 bytes).
CACHE_WORDS = 200_000
CHUNK_BYTES = 4 << 20
#: Words of a window by which copies in the sample are told.
WINDOW = 6
MARKS = string.punctuation + "¿¡«»“”„‘’…–—"

_caches: dict = {}


def word_features(word: str) -> tuple[int, ...]:
    w = word.lower().strip(MARKS)
    if not w:
        return ()
    return (zlib.crc32(w.encode()) % FEATURES, *(zlib.crc32(w[:k].encode(), k) % FEATURES for k in PREFIXES if len(w) > k))


def chunked(texts: pa.Array):
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    total = np.cumsum(pc.binary_length(texts).to_numpy())
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK_BYTES, "right")))
        yield texts.slice(a, b - a)
        a = b


def held(texts: pa.Array, known: dict, features_of) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, feature, distinct words with it) of every pair that occurs, and the words of each doc; `known` keeps what a word has."""
    split = pc.ascii_split_whitespace(texts)
    found = split.flatten().dictionary_encode()
    per_doc = pc.list_value_length(split).to_numpy().astype(np.int64)
    if len(known) > CACHE_WORDS:
        known.clear()
    rows = []
    for w in found.dictionary.to_pylist():
        f = known.get(w)
        if f is None:
            f = known[w] = features_of(w)
        rows.append(f)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(size.sum()))
    at = found.indices.to_numpy() if len(found) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    some = size[at] > 0
    pair = np.unique((doc[some] << 32) | at[some])
    doc, at = pair >> 32, pair & 0xFFFFFFFF
    n = size[at]
    ends = np.cumsum(n)
    take = np.repeat((np.cumsum(size) - size)[at] - (ends - n), n) + np.arange(int(n.sum()))
    both, times = np.unique((np.repeat(doc, n) << 32) | flat[take], return_counts=True)
    return both >> 32, both & 0xFFFFFFFF, times, per_doc


def signature(text: str) -> int:
    """The smallest hash of the text's word windows: equal for copies, and for most near copies."""
    words = text.split()
    return min(zlib.crc32(" ".join(words[k : k + WINDOW]).encode()) for k in range(max(1, len(words) - WINDOW + 1)))


def once(sample: DataFrame) -> DataFrame:
    """One text of each group of near copies: a group must not weigh as much as it has copies."""

    def read(batches):
        for b in batches:
            signs = [signature(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(signs, pa.int64())], names=["doc_id", "text", "sign"])

    signed = sample.select("doc_id", "text").mapInArrow(read, "doc_id long, text string, sign long")
    return signed.groupBy("sign").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("first.*")


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature -> documents of `sample` (text) that hold it."""

    def count(batches):
        known = _caches.setdefault("all", {})
        for b in batches:
            for texts in chunked(b.column(0)):
                _, feature, _, _ = held(texts, known, word_features)
                f, n = np.unique(feature, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n)], names=["feature", "n"])

    return sample.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def select_features(positive: DataFrame, unlabelled: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    p = feature_counts(positive).where(F.col("n") >= MIN_POSITIVE).withColumnRenamed("n", "p")
    joined = p.join(feature_counts(unlabelled).withColumnRenamed("n", "u"), "feature", "left")
    a, b = F.col("p") / n_p, (F.coalesce("u", F.lit(0)) + 1) / (n_u + 1)
    z = (a - b) / F.sqrt(b * (1 - b) * (1 / n_p + 1 / n_u))
    top = joined.select("feature", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(SELECTED)
    return np.sort(np.array([r["feature"] for r in top.collect()], np.int64))


def _cache_of(selected: np.ndarray) -> tuple[dict, callable]:
    """Words of this worker with the numbers of the selected features that they have."""
    key = zlib.crc32(selected.tobytes())
    if key not in _caches:
        _caches.clear()
        _caches[key] = {}
    number = {int(f): k for k, f in enumerate(selected)}
    return _caches[key], lambda w: tuple(number[f] for f in word_features(w) if f in number)


class Evidence:
    """Entries (doc, column, value) of documents: for each feature held, one for holding it, one for holding it in several
    words, and one that grows with the document's length; with each document's log length and log number of features."""

    def __init__(self, doc: np.ndarray, feature: np.ndarray, times: np.ndarray, words: np.ndarray, n: int):
        self.length = np.log1p(words.astype(float)) - 5
        self.hits = np.log1p(np.bincount(doc, minlength=len(words)))
        some = times > 1
        self.doc = np.concatenate([doc, doc[some], doc])
        self.column = np.concatenate([feature, n + feature[some], 2 * n + feature])
        self.value = np.concatenate([np.ones(len(doc) + int(some.sum())), self.length[doc]])
        self.n = n

    def __len__(self) -> int:
        return len(self.length)

    def logit(self, w: np.ndarray) -> np.ndarray:
        own = np.bincount(self.doc, weights=w[self.column] * self.value, minlength=len(self))
        return own + w[-3] * self.length + w[-2] * self.hits + w[-1]

    def gradient(self, slope: np.ndarray) -> np.ndarray:
        own = np.bincount(self.column, weights=slope[self.doc] * self.value, minlength=3 * self.n)
        return np.concatenate([own, [slope @ self.length, slope @ self.hits, slope.sum()]])


def described(sample: DataFrame, selected: np.ndarray) -> Evidence:
    """The evidence of a bounded sample, on the driver."""

    def read(batches):
        known, features_of = _cache_of(selected)
        for b in batches:
            for texts in chunked(b.column(0)):
                doc, feature, times, words = held(texts, known, features_of)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                both = np.stack([feature, np.minimum(times, 2)], axis=1).astype("<u2")
                own = [both[cut[k] : cut[k + 1]].tobytes() for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(words)], names=["features", "words"])

    rows = sample.select("text").mapInArrow(read, "features binary, words long").collect()
    size = np.array([len(r[0]) // 4 for r in rows], np.int64)
    flat = np.frombuffer(b"".join(r[0] for r in rows), "<u2").astype(np.int64).reshape(-1, 2)
    return Evidence(np.repeat(np.arange(len(rows)), size), flat[:, 0], flat[:, 1], np.array([r[1] for r in rows], np.int64), len(selected))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(positive: Evidence, unlabelled: Evidence, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative positive-unlabelled risk."""
    w = np.zeros(3 * positive.n + 3)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        zp, zu = positive.logit(w), unlabelled.logit(w)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_negative = unlabelled.gradient(sigmoid(zu) / len(unlabelled)) - prior * positive.gradient(sigmoid(zp) / len(positive))
        if negative >= 0:
            g = prior * positive.gradient(-sigmoid(-zp) / len(positive)) + as_negative
        else:
            g = -as_negative
        g[:-1] += RIDGE * w[:-1] * prior
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray | None, float]:
    """(selected features, weights, prior); no weights where there is nothing to learn from."""
    told = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    n, toxic = told.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = toxic / n if n else 0.0
    positive = stage(once(sample_of(docs, labels, "toxic", 1, TRAIN_POSITIVE, TRAIN_CHARS)), "toxic-positive")
    unlabelled = stage(once(thinned(learnable(docs, TRAIN_CHARS), docs.count(), TRAIN_UNLABELLED)), "toxic-unlabelled")
    n_p, n_u = positive.count(), unlabelled.count()
    if not (n_p and n_u and 0 < prior < 1):
        return np.zeros(0, np.int64), None, prior
    selected = select_features(positive, unlabelled, n_p, n_u)
    return selected, fit(described(positive, selected), described(unlabelled, selected), prior), prior


def scored(docs: DataFrame, model) -> DataFrame:
    selected, weights, prior = model

    def read(batches):
        known, features_of = _cache_of(selected)
        for b in batches:
            parts = [np.zeros(0)]
            for texts in chunked(b.column(1)):
                if weights is None:
                    parts.append(np.full(len(texts), prior))
                    continue
                parts.append(sigmoid(Evidence(*held(texts, known, features_of), len(selected)).logit(weights)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest of every document: held_out, score, predicted."""
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
