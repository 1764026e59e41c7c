"""Quality classifier: supervised subword embeddings.

Words and character n-grams of a document's UTF-8 bytes are hashed to rows of learned embedding tables; a
document is the mean of its rows, a softmax over two outputs gives the score. Training is numpy stochastic
gradient descent on the driver over a bounded sample of labelled rows (`per_class`, `max_chars`). Once trained,
output weight difference and embeddings fold into one number per row, so that scoring is a lookup and a mean.

Null and empty texts are scored by their boundary n-grams alone; without rows of both labels in the training
folds the score is the share of label 1 (0.5 without any); repeated rows get equal scores; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.llm.common import labelled_sample, prefix_hash, remainder, slices, span_hash, text_column, utf8_of, word_bounds

NGRAMS = (3, 4)
BITS = 16
PAD = b"\0\0\0\0"
#: Odd multipliers of the n-gram hash, one per byte of the n-gram.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each between paddings, and the start of each region."""
    buf = np.frombuffer(b"".join(PAD + t + PAD for t in texts), np.uint8)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 2 * len(PAD) for t in texts[:-1]], out=starts[1:])
    return buf, starts


def ngram_rows(buf: np.ndarray, n: int, block: int) -> np.ndarray:
    """Table row of the n-gram at each byte (the last n - 1 read as padding)."""
    b = np.concatenate([buf, np.zeros(n - 1, np.uint8)]).astype(np.uint32)
    m = len(buf)
    h = b[:m] * MULTIPLIERS[0]
    for i in range(1, n):
        h = (h ^ (h >> np.uint32(15))) + b[i : i + m] * MULTIPLIERS[i]
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32) + (block << BITS)


def word_rows(buf: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner (index of the region) and table row of each word and of each pair of neighbouring words.

    Of a pair only the pattern counts, so that stuttering junk of unseen words is learned: a word like the one
    before has one row, any other pair the next row of the block after the words'.
    """
    s, e = word_bounds(buf)
    owner = np.searchsorted(starts, s, "right") - 1
    h = span_hash(prefix_hash(buf), s, e)
    inner = owner[1:] == owner[:-1]
    pairs = np.where(h[1:] == h[:-1], 0, 1)[inner] + ((block + 1) << BITS)
    return np.concatenate([owner, owner[1:][inner]]), np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) + (block << BITS), pairs])


@dataclass
class Model:
    weights: np.ndarray  # one per table row: embedding times output difference
    bias: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        buf, starts = packed(texts)
        total = np.zeros(len(texts))
        count = np.zeros(len(texts))
        size = np.diff(np.append(starts, len(buf)))
        for block, n in enumerate(NGRAMS):
            total += np.add.reduceat(self.weights[ngram_rows(buf, n, block)].astype(np.float64), starts)
            count += size
        owner, rows = word_rows(buf, starts, len(NGRAMS))
        total += np.bincount(owner, self.weights[rows], len(texts))
        count += np.bincount(owner, minlength=len(texts))
        return total / count + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.margins(texts), -30, 30))), 9)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of one document and the share of each."""
    buf, starts = packed([text])
    rows = np.concatenate([ngram_rows(buf, n, block) for block, n in enumerate(NGRAMS)] + [word_rows(buf, starts, len(NGRAMS))[1]])
    rows, count = np.unique(rows, return_counts=True)
    return rows, (count / count.sum()).astype(np.float32)


def train(sample: list[tuple[str, int]], dim: int = 8, epochs: int = 6, rate: float = 0.5, prior: float | None = None, seed: int = 7) -> Model:
    """Gradient descent, one document a step; a step on the embeddings is scaled by the document's own feature mass."""
    y = np.array([label for _, label in sample], np.int64)
    size = ((len(NGRAMS) + 1) << BITS) + 2
    if len(set(y)) < 2:
        share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.zeros(2)
    docs = [features(t.encode("utf-8", "surrogatepass")) for t, _ in sample]
    weight = np.array([0.5 / np.mean(y == 0), 0.5 / np.mean(y == 1)])
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rows, share = docs[i]
            hidden = share @ embed[rows]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = p.copy()
            g[y[i]] -= 1
            step = rate * (1 - done / steps) * weight[y[i]]
            back = g @ out
            out -= (step * np.outer(g, hidden)).astype(np.float32)
            bias -= 0.1 * step * g
            embed[rows] -= (step / float(share @ share)) * np.outer(share, back).astype(np.float32)
            done += 1
    model = Model((embed @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))
    return calibrated(model, sample, prior)


def calibrated(model: Model, sample: list[tuple[str, int]], prior: float | None) -> Model:
    """Scale and shift of the margin by logistic regression on the sample, shifted to the prior share of label 1."""
    y = np.array([label for _, label in sample], float)
    m = np.concatenate([model.margins([t.encode("utf-8", "surrogatepass")]) for t, _ in sample])
    share = y.mean() if prior is None else prior
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    x = np.stack([m, np.ones_like(m)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hess, x.T @ (w * (y - p)) - 1e-3 * (beta - [1.0, 0.0])), -5, 5)
    return Model((model.weights * beta[0]).astype(np.float32), float(model.bias * beta[0] + beta[1]))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1000, max_chars: int = 20000) -> Model:
    """Fit on at most per_class whole texts of each label, rows with remainder 2 held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & (remainder("doc_id", 4) != 2)).agg(F.avg(F.col("quality").cast("double")).alias("p")).first().p
    sample = labelled_sample(docs, labels, "quality", per_class, max_chars, remainder("doc_id", 4) == 2)
    return train(sample, prior=None if known is None else float(np.clip(known, 0.02, 0.98)))


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs and score; whole texts, in Arrow batches."""
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            score = pa.array(model.scores(utf8_of(part.column("text"))))
            yield pa.RecordBatch.from_arrays([*part.columns, score], [*names, "score"])

    return docs.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit_quality(docs, labels, **fit)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return with_score(plain, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """The rows of docs that the classifier does not reject, all columns as they were."""
    model = fit_quality(docs, labels, **fit)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(model.scores(utf8_of(part.column("text"))) >= threshold))

    return docs.select(*names).mapInArrow(run, docs.schema)
