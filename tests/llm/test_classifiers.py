"""The two classifiers against naive versions of their features, and their fitting samples."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality, toxicity
from strandline.llm.common import labelled_sample

TEXTS = ["", "a", "two two words, two", "Ünïcode and\ttabs  x", "stutter stutter stutter stutter", "a b a b a b"]


def word_hash(word):
    """The polynomial hash of a word's bytes, in whole numbers."""
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    h = (sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(word)) + len(word)) & mask
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = ((h ^ (h >> shift)) * factor) & mask
    return h ^ (h >> 33)


def naive_margin(model, text):
    padded, rows = bytes(4) + text + bytes(4), []
    for block, n in enumerate(quality.NGRAMS):
        for i in range(len(padded)):
            gram = (padded + bytes(8))[i : i + n]
            h = gram[0] * int(quality.MULTIPLIERS[0]) & 0xFFFFFFFF
            for k in range(1, n):
                h = ((h ^ (h >> 15)) + gram[k] * int(quality.MULTIPLIERS[k])) & 0xFFFFFFFF
            rows.append((h * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - quality.BITS) | block << quality.BITS)
    words = text.split()
    last = len(quality.NGRAMS)
    rows += [(word_hash(w) >> (64 - quality.BITS)) + (last << quality.BITS) for w in words]
    rows += [(0 if a == b else 1) + ((last + 1) << quality.BITS) for a, b in zip(words, words[1:])]
    return float(np.mean([model.weights[r] for r in rows])) + model.bias


def test_quality_margin_is_the_mean_of_the_rows():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=((len(quality.NGRAMS) + 1) << quality.BITS) + 2).astype(np.float32), 0.25)
    texts = [t.encode() for t in TEXTS]
    assert np.allclose(model.margins(texts), [naive_margin(model, t) for t in texts], atol=1e-5)


def subsequences(word):
    code, phi = [int(toxicity.CODE[b]) for b in bytes([toxicity.MARK]) + word], defaultdict(float)
    for at in combinations(range(len(code)), toxicity.LETTERS):
        if at[-1] - at[0] < toxicity.SPAN and all(code[i] for i in at):
            phi[tuple(code[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
    return phi


def test_string_kernel_equals_all_subsequences():
    words = [b"idiot", b"id-iot", b"i.d.i.o.t", b"stupid", b"aaaaaaa", "Trottel".encode(), "blöd".encode(), b"ab"]
    size = lambda w: float(toxicity.norm(np.array([len(w) + 1]))[0])
    phi = [subsequences(w) for w in words]
    want = [[sum(v * b.get(k, 0.0) for k, v in a.items()) / size(words[i]) / size(words[j]) for j, b in enumerate(phi)] for i, a in enumerate(phi)]
    assert np.allclose(toxicity.kernel(words, words)[0], want, atol=1e-6)


@pytest.mark.parametrize("copies", [1, 60])
def test_repeated_rows_do_not_crowd_out_a_class(spark, copies):
    rows = [(1, f"copy {i}") for i in range(copies)] + [(i, f"text {i}") for i in range(2, 40)] + [(None, "no id"), (50, None), (51, ""), (52, "x" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 53)] + [(1, 1)] * 9 + [(None, 1)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 10, 100, F.lit(False))
    assert len(got) == 20 and sorted(y for _, y in got) == [0] * 10 + [1] * 10 and len({t for t, _ in got}) == 20
    assert got == labelled_sample(docs.repartition(5), labels, "quality", 10, 100, F.lit(False))
