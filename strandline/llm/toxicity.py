"""Toxicity: a support vector machine on a gapped-subsequence string kernel with Nyström landmarks.

Strings are words (runs without white space). Two words are alike as far as they share subsequences of four
letters, each occurrence weighing DECAY to the power of its span (at most SPAN bytes, so that inserted and
missing characters are tolerated); the kernel is normalised by the lengths. Landmarks are training words; the
Nyström map is the kernel against them, whitened. Training rows are sentences that carry their document's
label; a toxic document's sentence is represented by its witness, the word that the machine so far takes for the
worst (multiple-instance training), and documents whose witness never looks toxic count as label noise.
A linear machine over the map folds into one weight per subsequence, so that scoring a word is a sum of lookups.
A document is judged by its worst word's decision and by the logarithm of how many words look toxic, through a
logistic curve fitted on the same sample.

Null and empty texts have no word and get the curve's value for a kernel of zero; without both labels in the
training folds every score is the share of label 1; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import labelled_sample, prefix_hash, remainder, slices, span_hash, text_column, utf8_of, word_bounds

LETTERS = 4
SPAN = 7
DECAY = 0.7
LANDMARKS = 96
#: A word looks toxic from this decision on.
BAD = 0.25
#: Letter codes of bytes: a to z in either case 1 to 26, trailing bytes of other letters 27 to 30 by their last two
#: bits, the mark before each word 31, all others 0 (a gap).
MARK = 1
CODE = np.zeros(256, np.int32)
CODE[ord("a") : ord("z") + 1] = CODE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
CODE[0x80:0xC0] = 27 + np.arange(0x40) % 4
CODE[MARK] = 31
RADIX = 32
#: Offsets of the letters after the first, for every way to place them within SPAN.
OFFSETS = [c for last in range(LETTERS - 1, SPAN) for c in [(*m, last) for m in combinations(range(1, last), LETTERS - 2)]]


def norm(length: np.ndarray) -> np.ndarray:
    """Root of the self-kernel of a word whose subsequences all differ; 1 for words too short to have any."""
    total = sum(DECAY ** (2 * (o[-1] + 1)) * np.maximum(length - o[-1], 0) for o in OFFSETS)
    return np.sqrt(np.maximum(total, DECAY ** (2 * LETTERS)))


def occurrences(code: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For every placement: start positions, subsequence numbers, weight. room: bytes from here to the word's end."""
    n = len(code)
    for o in OFFSETS:
        m = n - o[-1]
        if m <= 0:
            continue
        at = np.flatnonzero((room[:m] > o[-1]) & (code[:m] > 0) & (code[o[0] : o[0] + m] > 0) & (code[o[1] : o[1] + m] > 0) & (code[o[2] : o[2] + m] > 0))
        yield at, ((code[at] * RADIX + code[at + o[0]]) * RADIX + code[at + o[1]]) * RADIX + code[at + o[2]], DECAY ** (o[-1] + 1)


def laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all words in a row, each after a mark, room to each word's end, each byte's word, lengths."""
    mark = bytes([MARK])
    length = np.array([len(w) + 1 for w in words], np.int64)
    code = CODE[np.frombuffer(mark + mark.join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), length)
    return code, np.cumsum(length)[owner] - np.arange(len(code)), owner, length


def kernel(words: list[bytes], landmarks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised kernel of words against landmarks; the landmarks' subsequences and their weights."""
    code, room, owner, length = laid_out(landmarks)
    parts = [(owner[at], number, w) for at, number, w in occurrences(code, room)]
    known, slot = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    phi = np.zeros((len(known), len(landmarks)))
    np.add.at(phi, (slot, np.concatenate([p[0] for p in parts])), np.concatenate([np.full(len(p[0]), p[2]) for p in parts]))
    phi /= norm(length)
    code, room, owner, length = laid_out(words)
    out = np.zeros((len(words), len(landmarks)))
    for at, number, w in occurrences(code, room):
        slot = np.searchsorted(known, number)
        hit = (slot < len(known)) & (known[np.minimum(slot, len(known) - 1)] == number)
        np.add.at(out, owner[at[hit]], w * phi[slot[hit]])
    return out / norm(length)[:, None], known, phi


@dataclass
class Machine:
    weights: np.ndarray  # one per subsequence number
    bias: float
    slope: float
    slope_count: float
    shift: float

    def decide(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        code, room, owner, length = laid_out(words)
        total = np.zeros(len(words))
        for at, number, w in occurrences(code, room):
            got = self.weights[number]
            hit = np.flatnonzero(got)
            total += w * np.bincount(owner[at[hit]], got[hit], len(words))
        return total / norm(length) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Each document's worst word through the curve; every distinct word of the texts is decided once."""
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64)])
        s, e = word_bounds(buf)
        worst, bad = np.full(len(texts), self.bias), np.zeros(len(texts))
        if len(s):
            _, first, back = np.unique(span_hash(prefix_hash(buf), s, e), return_index=True, return_inverse=True)
            blob = buf.tobytes()
            value = self.decide([blob[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())])
            owner = np.searchsorted(starts, s, "right") - 1
            np.maximum.at(worst, owner, value[back])
            bad = np.bincount(owner, value[back] > BAD, len(texts))
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * worst + self.slope_count * np.log1p(bad) + self.shift, -30, 30))), 9)


def sentences(text: str) -> list[list[bytes]]:
    return [x for x in ([w.encode("utf-8", "surrogatepass").lower() for w in s.split()] for s in re.split(r"(?<=[.!?])\s+|\n+", text)) if x]


def linear_machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared hinge loss under weights, by Newton steps over the rows inside the margin."""
    x = np.concatenate([z, np.ones((len(z), 1))], 1)
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    loss = lambda b: float((weight * np.maximum(1 - y * (x @ b), 0) ** 2).sum() + b @ ridge @ b)
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        inside = 1 - y * (x @ beta) > 0
        xi, wi = x[inside], weight[inside]
        want = np.linalg.solve((xi * wi[:, None]).T @ xi + ridge, xi.T @ (wi * y[inside]))
        step, now = 1.0, loss(beta)
        while step > 1e-4 and loss(beta + step * (want - beta)) > now:
            step /= 2
        if step <= 1e-4 or np.abs(want - beta).max() < 1e-8:
            break
        beta = beta + step * (want - beta)
    return beta[:-1], float(beta[-1])


def train(sample: list[tuple[str, int]], rounds: int = 5, negatives: int = 15000, prior: float | None = None, seed: int = 11) -> Machine:
    table = np.zeros(RADIX**LETTERS, np.float32)
    y = np.array([label for _, label in sample], float)
    share = float(np.clip(y.mean() if prior is None and len(y) else prior or 0.5, 0.005, 0.995))
    constant = Machine(table, 0.0, 0.0, 0.0, float(np.log(share / (1 - share))))
    if len(set(y)) < 2:
        return constant
    bare = lambda w: w.strip(b".,;:!?\"'()")
    split = [[[x for x in map(bare, s) if len(x) >= LETTERS] for s in sentences(t)] for t, _ in sample]
    bags = [sorted({w for s in doc for w in s}) for doc in split]
    stems = lambda w: {w, w[:4] + b"~", w[:5] + b"~", w[:6] + b"~"}
    counts = [Counter(), Counter()]
    for bag, label in zip(bags, y):
        counts[int(label)].update({x for w in bag for x in stems(w)})
    n_clean, n_toxic = int(len(y) - y.sum()), int(y.sum())

    def odds(w: bytes) -> float:
        """Lower bound of the log odds that a document with this word, or with its beginning, is toxic."""
        return max(np.log((counts[1][x] + 0.1) / n_toxic * n_clean / (counts[0][x] + 0.5)) - 1.64 * np.sqrt(1 / (counts[1][x] + 0.1) + 1 / (counts[0][x] + 0.5)) for x in stems(w))

    clean = sorted({w for bag, label in zip(bags, y) if not label for w in bag})
    suspects = sorted({w for bag, label in zip(bags, y) if label for w in bag})
    value = {w: odds(w) - 0.5 for w in suspects}
    ranked, stem_count = [], Counter()
    for w in sorted((w for w in suspects if value[w] > 0), key=lambda w: (-value[w], -counts[1][w], w)):
        stem_count[w[:3]] += 1
        if stem_count[w[:3]] <= 4:
            ranked.append(w)
    rng = np.random.default_rng(seed)
    others = [clean[i] for i in rng.permutation(len(clean))[:negatives]]
    if not ranked or not others:
        return constant
    every = sorted({*clean, *suspects})
    frequent = sorted(clean, key=lambda w: (-counts[0][w], w))[:300]
    hard: list[bytes] = []
    for _ in range(rounds):
        witness = [max(s, key=lambda w: (value[w], w)) for doc, label in zip(split, y) if label for s in doc if s]
        good = [w for w in witness if value[w] > 0]
        if not good:
            return constant
        third = LANDMARKS // 3
        landmarks = list(dict.fromkeys(ranked[:third] + others[:third] + hard[:third]))
        square, _, _ = kernel(landmarks, landmarks)
        eigen, vector = np.linalg.eigh((square + square.T) / 2)
        white = vector[:, eigen > 1e-6] / np.sqrt(eigen[eigen > 1e-6])
        words = good + others + frequent + hard
        often = np.array([counts[0][w] for w in others + frequent], float)
        weight = np.concatenate([np.full(len(good), 1 / len(good)), 4 * often / often.sum(), np.full(len(hard), 2 / max(1, len(hard)))])
        k, known, phi = kernel(words, landmarks)
        w, b = linear_machine(k @ white, np.array([1.0] * len(good) + [-1.0] * (len(words) - len(good))), weight)
        table[:] = 0
        table[known] = phi @ (white @ w)
        machine = Machine(table, b, 1.0, 0.0, 0.0)
        value = dict(zip(every, machine.decide(every).tolist()))
        hard = sorted({*hard, *[w for w in sorted(clean, key=lambda w: (-value[w], w))[:400] if counts[0][w] / n_clean > 0.2 * counts[1][w] / n_toxic and value[w] > -1]}, key=lambda w: (-value[w], w))
    value_of = value.__getitem__
    top = np.array([max((value_of(w) for w in bag), default=machine.bias) for bag in bags])
    bad = np.array([sum(value_of(w) > BAD for s in doc for w in s) for doc in split], float)
    x = np.stack([top, np.log1p(bad), np.ones_like(top)], 1)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    loss = lambda b: float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ b))).sum() + 0.01 * ((b[:2] - 1) ** 2).sum())
    beta = np.array([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 2e-2 * np.eye(3)
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - 0.02 * np.array([beta[0] - 1, beta[1] - 1, 0.0]))
        while np.abs(step).max() > 1e-6 and loss(beta + step) > loss(beta):
            step = step / 2
        beta = beta + step
    return Machine(table, machine.bias, *(float(b) for b in beta))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 700, max_chars: int = 20000) -> Machine:
    """Fit on at most per_class whole texts of each label, rows with remainder 0 held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & (remainder("doc_id", 5) != 0)).agg(F.avg(F.col("toxic").cast("double")).alias("p")).first().p
    return train(labelled_sample(docs, labels, "toxic", per_class, max_chars, remainder("doc_id", 5) == 0), prior=known)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    machine = fit_toxicity(docs, labels, **fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(machine.scores(utf8_of(part.column("text"))))], ["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return plain.mapInArrow(run, "doc_id long, score double").select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
