"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import simhash, vantage


def brute_alike(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in (a, b)))
    return Fraction(len(x & y), len(x | y)) >= Fraction(4, 5)


def brute_kept(texts):
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if brute_alike(texts[a], texts[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_stage_drops_texts_of_a_few_edited_words(spark):
    rng = random.Random(5)
    texts = [None, "", "one two", "One  two", "one three", " \n"]
    for size in (9, 60, 200, 3000):
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [" ".join(words), *(edited(rng, words, n) for n in (1, size // 90, size // 50, size // 40, size // 20))]
    chain = [f"c{i}" for i in range(400)]  # neighbours are alike, the ends are not
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 300, 8)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute_kept(texts)
    got = [r.doc_id for r in simhash.keep_one(table).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(texts) - 40


def test_every_row_is_a_document_of_its_own(spark):
    rows = [(None, "a b", 1), (None, "a b", 1), (3, "a b", 1), (3, "a b", 1), (2, "a b", 1), (2, "nothing like it", 2), (2, "nothing like it", 2), (4, "c", 3), (None, "d", 4), (None, "d", 4), (None, None, 5), (9, "", 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, t int").withColumn("c1", F.lit(1)).withColumn("Doc", F.lit(2)).repartition(3)
    out = simhash.keep_one(table)
    assert out.columns == table.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "d"), (2, "a b"), (2, "nothing like it"), (4, "c"), (9, "")]
    assert simhash.keep_one(table.limit(0)).count() == 0


def test_a_large_group_of_copies_keeps_one_of_what_is_alike(spark, monkeypatch):
    """Copies with one to twenty words of 150 edited; many shards and leaves."""
    monkeypatch.setattr(vantage, "SHARD", 100)
    monkeypatch.setattr(vantage, "BRUTE", 16)
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [" ".join(base)] + [edited(rng, base, 1 + i % 20) for i in range(300)] + [" ".join(f"v{rng.randrange(9999)}" for _ in range(100)) for _ in range(200)]
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    want = brute_kept(texts)
    assert want <= got and len(got - want) <= 0.02 * (len(texts) - len(want))


@pytest.mark.parametrize("size", [16, 4096])
def test_fingerprint_search_misses_few_similar_pairs(monkeypatch, size):
    """Pairs of a similarity of 0.8 to 0.85: the radius and the trees together."""
    monkeypatch.setattr(vantage, "BRUTE", size)
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(300)]
    near = [np.concatenate([s[: 400 - k], rng.integers(0, 1 << 63, k).astype(np.uint64)]) for s, k in zip(sets, rng.integers(33, 45, 300))]
    fps = np.frombuffer(b"".join(simhash.wide_fingerprint(np.unique(x)) for x in sets + near), np.uint64).reshape(-1, simhash.WORDS)
    found = set()
    for g in range(len(simhash.WIDE.groups)):
        a, b, _, more = vantage.strangers(simhash.WIDE, g, fps, np.arange(600), 5, rng)
        found |= set(zip(a.tolist(), b.tolist()))
        assert not len(more)
    assert {a - b for a, b in found} == {300} and len(found) >= 0.95 * 300


@pytest.mark.parametrize("words", [1, 3])
def test_dense_leaves_and_other_groups_lose_no_link(monkeypatch, words):
    """Pivots, splits by other groups, and links of clusters against all pairs."""
    for name, value in (("BRUTE", 8), ("WIDE", 24), ("PIVOTS", 2)):
        monkeypatch.setattr(vantage, name, value)
    rng = np.random.default_rng(words)
    space = vantage.Space(words, 8 * words - 4, vantage.groups_of(words, 4), 1)
    assert space.exact
    centres = rng.integers(0, 1 << 64, (12, words), dtype=np.uint64)
    flips = rng.random((600, words * 64)) < rng.choice([0.02, 0.06, 0.5], (600, 1))
    fps = centres[rng.integers(0, 12, 600)] ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    a, b, _ = space.pairs(fps, fps)
    labels = [vantage.cluster(space, g, fps, rng) for g in range(len(space.groups))]
    every = vantage.settled(600, np.concatenate([np.arange(600)] * len(labels)), np.concatenate(labels))
    assert (every == vantage.settled(600, a, b)).all() and len(np.unique(every)) < 500


def test_a_pair_is_found_by_itself_whatever_the_size_of_its_leaf():
    """70000 fingerprints that agree in the first group: a pair that no other group vouches for meets all the same, and one that none vouches for meets nowhere."""
    rng = np.random.default_rng(8)
    space, n = simhash.WIDE, 70000
    fps = rng.integers(0, 1 << 64, (n, simhash.WORDS), dtype=np.uint64)
    word, mask = space.groups[0]
    fps[:, word] &= ~np.uint64(mask)
    fps[1] = fps[0]
    for w, m in space.groups[1:]:
        bit = np.uint64(m & -m)
        fps[1, w] ^= bit | bit << np.uint64(1)
    assert np.bitwise_count(fps[0] ^ fps[1]).sum() <= space.radius
    met = [set(part[part < 2].tolist()) for part in vantage.leaves(space, 0, fps, rng)]
    assert {0, 1} in met
    few = fps[:2].copy()
    assert len(vantage.strangers(space, 0, few, np.arange(2), 5, rng)[0]) == 1
    few[1, word] ^= np.uint64(mask & -mask) * np.uint64(3)
    assert [len(vantage.strangers(space, g, few, np.arange(2), 5, rng)[0]) for g in range(len(space.groups))] == [0] * len(space.groups)
