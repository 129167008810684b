"""Document quality from a linear-chain conditional random field over lines.

Each line is described by a few measures of its bytes and words, cut into bins; a line's evidence adds the weights of its
own bins and of those of the line before and after. Two labels (bad, good) follow each other along the document with
transition weights. The forward-backward pass gives each line's probability of being good, and a document's score is the
mean of these weighted by line length (plus one, so that empty lines and texts have a score).

The weights are learnt by gradient steps on the conditional likelihood, in numpy on the driver, from a bounded sample of
labelled documents (about `TRAIN_DOCS` of each label, of at most `TRAIN_CHARS` characters and `TRAIN_LINES` lines); lines take
the label of their document. Scoring reads whole texts, in tasks.

Nulls: a null text counts as empty; a null doc_id is held out or not like the empty text and never matches a label.
Repeated rows are scored alike. Where a label is missing, the score is the share of label 1 in the sample (0.5 without any
labels). An empty table gives an empty result. Other columns of the input take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcseq.llm.labelled import held_out, sample_of

THRESHOLD = 0.3
TRAIN_DOCS = 2000
TRAIN_CHARS = 20_000
TRAIN_LINES = 100
STEPS = 200
RATE = 0.1
RIDGE = 0.005
CHUNK_BYTES = 4 << 20

#: Byte classes: 0 white space, 1 lower-case letter, 2 capital, 3 digit, 4 symbol, 5 bang or question mark, 6 sentence mark, 7 other mark, 8 beyond ASCII.
KIND = np.full(256, 7, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[97:123] = 1
KIND[65:91] = 2
KIND[48:58] = 3
KIND[list(b"#*$%&|<>~^=_{}[]\\@+")] = 4
KIND[list(b"!?")] = 5
KIND[list(b".,;:")] = 6
KIND[128:] = 8
#: Bin edges of shares, of log lengths, and of mean word lengths.
SHARES = np.array([1e-9, 0.01, 0.03, 0.08, 0.2, 0.5])
LENGTHS = np.log1p([0, 4, 12, 30, 80, 200, 600])
WORD_LENGTHS = np.array([1.0, 2.5, 3.5, 4.5, 6.0, 8.0, 12.0])
BINS = 8
MEASURES = 14


def line_bins(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of every line and measure, bytes of every line, lines of every text)."""
    per_doc = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    n = len(ends)
    kind = KIND[raw]
    line = np.repeat(np.arange(n), sizes + 1)
    counts = np.bincount(line * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)
    black = kind > 0
    opens = np.flatnonzero(black & ~np.concatenate([[False], black[:-1]]))
    closes = np.flatnonzero(black & ~np.concatenate([black[1:], [False]])) + 1
    word_line = line[opens]
    words = np.bincount(word_line, minlength=n).astype(float)
    marks = np.bincount(word_line, weights=np.isin(kind[closes - 1], (4, 5)), minlength=n)
    # A word's hash: its bytes, each mixed with its place in the word; the empty sum of no word needs no care.
    within = np.arange(len(raw)) - np.repeat(np.concatenate([[0], opens]), np.diff(np.concatenate([[0], opens, [len(raw)]])))
    mixed = (raw.astype(np.uint64) + np.uint64(1)) * (within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    mixed ^= mixed >> np.uint64(29)
    mixed[~black] = 0
    hashes = np.add.reduceat(mixed, opens) if len(opens) else np.zeros(0, np.uint64)
    same = np.zeros(len(opens), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])
    repeats = np.bincount(word_line, weights=same, minlength=n)
    order = np.lexsort((hashes, word_line))
    again = np.zeros(len(opens), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (word_line[order][1:] == word_line[order][:-1])
    doubled = np.bincount(word_line[order], weights=again, minlength=n)
    total, full, letters = np.maximum(sizes, 1), np.maximum(words, 1), np.maximum(counts[:, 1] + counts[:, 2], 1)
    shares = [counts[:, 2] / letters, *(counts[:, k] / total for k in (3, 4, 5, 6, 7, 8)), marks / full, repeats / full, doubled / full]
    out = np.zeros((n, MEASURES), np.uint8)
    for k, s in enumerate(shares):
        out[:, k] = np.searchsorted(SHARES, s, "left")
    out[:, 10] = np.searchsorted(LENGTHS, np.log1p(sizes), "left")
    out[:, 11] = np.searchsorted(WORD_LENGTHS, counts[:, 1:].sum(axis=1) / full, "left")
    out[:, 12] = np.searchsorted(LENGTHS, np.log1p(words), "left")
    out[:, 13] = np.repeat(np.minimum(per_doc, BINS) - 1, per_doc)
    return out, sizes, per_doc


def columns(bins: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Weights that each line's evidence adds: of its own bins, and of those of the line before and the line after."""
    own = bins.astype(np.int64) + np.arange(MEASURES) * BINS
    block = MEASURES * BINS
    ends = np.cumsum(per_doc)
    before, after = np.roll(own, 1, axis=0) + block, np.roll(own, -1, axis=0) + 2 * block
    before[ends - per_doc] = 3 * block
    after[ends - 1] = 3 * block + 1
    return np.concatenate([own, before, after], axis=1)


WEIGHTS = 3 * MEASURES * BINS + 2


class Chains:
    """Lines of many documents, walked step by step over all documents that are long enough."""

    def __init__(self, per_doc: np.ndarray):
        self.order = np.argsort(-per_doc, kind="stable")
        sizes = per_doc[self.order]
        first = (np.cumsum(per_doc) - per_doc)[self.order]
        alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
        self.steps = [first[:k] + t for t, k in enumerate(alive)]

    def walk(self, good: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of good for each line, expected transitions summed, log normaliser) for log odds `good`."""
        n = len(good)
        bound = np.clip(good, -40, 40)
        weight = np.stack([np.exp(-np.maximum(bound, 0)), np.exp(np.minimum(bound, 0))], axis=1)
        move = np.exp(trans - trans.max())
        alpha, beta, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
        for t, at in enumerate(self.steps):
            a = weight[at] if t == 0 else (alpha[self.steps[t - 1][: len(at)]] @ move) * weight[at]
            s = a.sum(axis=1)
            scale[at] = s
            alpha[at] = a / s[:, None]
        pairs = np.zeros((2, 2))
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            prev = self.steps[t - 1][: len(at)]
            back = weight[at] * beta[at] / scale[at][:, None]
            pairs += (alpha[prev].T @ back) * move
            beta[prev] = back @ move.T
        log_z = np.log(scale).sum() + np.maximum(bound, 0).sum() + trans.max() * (n - len(self.order))
        both = alpha * beta
        return both[:, 1] / both.sum(axis=1), pairs, log_z


def fit(bins: np.ndarray, per_doc: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transition weights) from documents whose lines all have the document's label."""
    cols, chains = columns(bins, per_doc), Chains(per_doc)
    y = np.repeat(label, per_doc).astype(float)
    inner = (per_doc - 1).astype(float)
    seen = np.diag([inner[label == 0].sum(), inner[label == 1].sum()])
    w, trans = np.zeros(WEIGHTS), np.zeros((2, 2))
    theta_m = [np.zeros(WEIGHTS), np.zeros((2, 2))]
    theta_v = [np.zeros(WEIGHTS), np.zeros((2, 2))]
    docs = len(per_doc)
    for step in range(1, STEPS + 1):
        p, pairs, _ = chains.walk(w[cols].sum(axis=1), trans)
        g = np.bincount(cols.ravel(), weights=np.repeat(y - p, cols.shape[1]), minlength=WEIGHTS) / docs - RIDGE * w / 10
        grads = [g, (seen - pairs) / docs - RIDGE * trans]
        for k, (theta, grad) in enumerate(zip((w, trans), grads, strict=True)):
            theta_m[k] = 0.9 * theta_m[k] + 0.1 * grad
            theta_v[k] = 0.99 * theta_v[k] + 0.01 * grad**2
            theta += RATE * (theta_m[k] / (1 - 0.9**step)) / (np.sqrt(theta_v[k] / (1 - 0.99**step)) + 1e-8)
    return w, trans


def chunks(texts: pa.Array) -> Iterator[list[bytes]]:
    """Texts as bytes, some megabytes at a time; a null is an empty text."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK_BYTES, "right")))
        yield [t or b"" for t in texts.slice(a, b - a).cast(pa.binary()).to_pylist()]
        a = b


def scores(texts: list[bytes], w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    bins, sizes, per_doc = line_bins(texts)
    p, _, _ = Chains(per_doc).walk(w[columns(bins, per_doc)].sum(axis=1), trans)
    first = np.cumsum(per_doc) - per_doc
    return np.clip(np.add.reduceat(p * (sizes + 1), first) / np.add.reduceat(sizes + 1.0, first), 0.0, 1.0)


def _sampled(docs: DataFrame, labels: DataFrame, value: int) -> list[bytes]:
    rows = sample_of(docs, labels, "quality", value, TRAIN_DOCS, TRAIN_CHARS)
    kept = rows.where(F.size(F.split("text", "\n")) <= TRAIN_LINES)

    def described(batches):
        for b in batches:
            for own in chunks(b.column(0)):
                bins, _, per_doc = line_bins(own)
                ends = np.cumsum(per_doc)
                yield pa.RecordBatch.from_arrays([pa.array([bins[e - k : e].tobytes() for e, k in zip(ends, per_doc, strict=True)])], names=["bins"])

    return [r[0] for r in kept.select("text").mapInArrow(described, "bins binary").collect()]  # about TRAIN_DOCS rows


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float | None]:
    """(weights, transition weights, share of label 1 where there is but one label to learn from)."""
    found = [_sampled(docs, labels, v) for v in (0, 1)]
    if not all(found):
        n = len(found[0]) + len(found[1])
        return np.zeros(WEIGHTS), np.zeros((2, 2)), len(found[1]) / n if n else 0.5
    rows = found[0] + found[1]
    per_doc = np.array([len(r) // MEASURES for r in rows])
    bins = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, MEASURES)
    label = np.repeat([0, 1], [len(found[0]), len(found[1])])
    return *fit(bins, per_doc, label), None


def scored(docs: DataFrame, model, *carry: str) -> DataFrame:
    """doc_id, the columns named, and score of every row."""
    w, trans, share = model

    def read(batches):
        for b in batches:
            parts = [np.full(len(own), share) if share is not None else scores(own, w, trans) for own in chunks(b.column(0))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate([np.zeros(0), *parts]))], names=[*b.schema.names[1:], "score"])

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(read, f"{kinds}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest of every document: held_out, score, predicted."""
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier predicts to be good, with their own columns; rows pass through the scoring tasks whole,
    so no join has to bring verdict and row together."""
    w, trans, share = train(docs, labels)
    at = docs.columns.index("text")
    name = "score"
    while name in docs.columns:
        name += "_"

    def read(batches):
        for b in batches:
            texts = b.column(at).cast(pa.string())
            parts = [np.full(len(own), share) if share is not None else scores(own, w, trans) for own in chunks(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *parts]))], names=[*b.schema.names, name])

    scored_rows = docs.mapInArrow(read, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
    return scored_rows.where(F.col(name) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
