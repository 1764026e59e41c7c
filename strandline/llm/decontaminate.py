"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters, digits and bytes of other alphabets, ASCII letters in lower case; shingles are WIDTH
words (an item of fewer words is one shingle). A document's windows have each item's own number of words; a document
with fewer words than the item is one window as a whole. A window
is fingerprinted twice (64 bits, shingles weighted as below and all alike) where it holds a shingle of the
benchmark; a window without any cannot be similar. Fingerprints are looked up in an index of BLOCKS groups of bits,
each probed with all values within RADIUS // BLOCKS bits, so that every item within RADIUS is found; of the windows
found the exact similarity decides: the sum over shingles of the smaller count over that of the larger, weighted or
all alike, whichever is more, SIMILARITY or more. A shingle weighs one over the number of distinct texts of the
whole benchmark that hold it, one outside it; so a hot item's near copies match by the shingles all alike.

Items come in blocks of at most BLOCK_WORDS words, each broadcast to one pass over the documents. Null and empty
texts and items match nothing; repeated rows match alike; items that share an item_id each match under it; an
empty benchmark leaves all documents clean; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import mix, prefix_hash, slices, span_hash, stored, text_column, utf8_of

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
BLOCK_WORDS = 2_000_000
#: Bytes of words, ASCII letters in lower case; zero separates.
LETTER = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 0x80 or chr(_c).isalnum():
        LETTER[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every word."""
    buf = LETTER[np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)]
    begin = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    edge = np.diff(np.concatenate([[False], buf > 0, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return np.searchsorted(begin, start, "right") - 1, span_hash(prefix_hash(buf), start, end)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` words from each word on."""
    n = len(words) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mix(words[j : j + n] + np.uint64(j))
    return mix(h)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """Minus one or one for each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1


def packed_bits(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def repeated_shingles(benchmark: DataFrame) -> DataFrame:
    """(h, n) of every shingle that n > 1 distinct texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for text in utf8_of(part.column("text")):
                words = word_hashes([text])[1]
                if len(words):
                    h = np.unique(shingles(words, min(WIDTH, len(words))))
                    same = xxhash.xxh3_128_digest(words.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([same] * len(h), pa.binary())], ["h", "content"])

    every = benchmark.select(text_column(benchmark).alias("text")).mapInArrow(run, "h long, content binary").distinct()
    return every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


class Benchmark:
    """One block of items: shingle weights, fingerprints, and the index over their bit groups.

    held_by: (h, n) of the block's shingles that more than one distinct text of the benchmark holds; None if the block is the whole.
    """

    def __init__(self, items: list[tuple[int, bytes]], held_by: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, self.counts, self.length, self.width = [], [], [], []
        held: Counter = Counter()
        seen: set[bytes] = set()
        for item, text in items:
            words = word_hashes([text])[1]
            if len(words):
                width = min(WIDTH, len(words))
                count = Counter(shingles(words, width).tolist())
                self.ids.append(item), self.counts.append(count), self.length.append(len(words)), self.width.append(width)
                if words.tobytes() not in seen:
                    seen.add(words.tobytes())
                    held.update(count.keys())
        if held_by is not None:
            held = Counter(dict.fromkeys(held, 1) | dict(zip(*(x.tolist() for x in held_by))))
        self.weight = {h: 1 / n for h, n in held.items()}
        self.items_of: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, count in enumerate(self.counts):
            for h in count:
                self.items_of[self.width[i]][h].append(i)
        self.known = {w: np.array(sorted(m), np.uint64) for w, m in self.items_of.items()}
        self.items_of = {w: dict(m) for w, m in self.items_of.items()}
        self.marks = {}
        for w, known in self.known.items():
            self.marks[w] = np.zeros(1 << 20, bool)
            self.marks[w][known >> np.uint64(44)] = True
        self.prints, self.index = zip(*(self._indexed(weight) for weight in (self.weight, dict.fromkeys(self.weight, 1.0))))

    def _indexed(self, weight: dict[int, float]) -> tuple[np.ndarray, dict[tuple[int, int, int, int], np.ndarray]]:
        """The items' fingerprints, and the items by (words, width, block of bits, value of the block): windows only meet items of their own length."""
        votes = [sum(n * weight[h] * bits_of(np.array([h], np.uint64))[0] for h, n in count.items()) for count in self.counts]
        prints = packed_bits(np.array(votes)) if votes else np.zeros(0, np.uint64)
        size, near = 64 // BLOCKS, RADIUS // BLOCKS
        flips = [sum(1 << b for b in c) for r in range(near + 1) for c in combinations(range(size), r)]
        # an item stands under every value that its block is within the share of the radius of
        index: dict[tuple[int, int, int, int], list[int]] = defaultdict(list)
        for i, f in enumerate(prints.tolist()):
            for b in range(BLOCKS):
                for x in flips:
                    index[self.length[i], self.width[i], b, (f >> (b * size)) & ((1 << size) - 1) ^ x].append(i)
        return prints, {k: np.array(i, np.int32) for k, i in index.items()}

    def near(self, kind: int, prints: np.ndarray, n: int, width: int) -> Iterator[tuple[int, int]]:
        """(window, item) with fingerprints of the kind (0 weighted, 1 all alike) within RADIUS, of the items of n words."""
        size = 64 // BLOCKS
        for k, f in enumerate(prints.tolist()):
            got = [self.index[kind].get((n, width, b, (f >> (b * size)) & ((1 << size) - 1))) for b in range(BLOCKS)]
            got = [x for x in got if x is not None]
            if got:
                found = np.unique(np.concatenate(got))
                for i in found[np.bitwise_count(self.prints[kind][found] ^ prints[k]) <= RADIUS].tolist():
                    yield k, i

    def similarity(self, window: np.ndarray, item: int) -> float:
        mine, theirs = Counter(window.tolist()), self.counts[item]
        low = high = 0.0
        both = either = 0
        for h in mine.keys() | theirs.keys():
            w = self.weight.get(h, 1.0)
            x, y = mine.get(h, 0), theirs.get(h, 0)
            low += w * min(x, y)
            high += w * max(x, y)
            both += min(x, y)
            either += max(x, y)
        return max(low / high, both / either)

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of one document's similar windows, the best for each item."""
        best: dict[int, tuple[float, int]] = {}
        for width, known in self.known.items():
            h = shingles(words, width)
            some = np.flatnonzero(self.marks[width][h >> np.uint64(44)])
            hit = some[known[np.minimum(np.searchsorted(known, h[some]), len(known) - 1)] == h[some]]
            if not len(hit):
                continue
            lengths: dict[int, set[int]] = defaultdict(set)
            for p, x in zip(hit.tolist(), h[hit].tolist()):
                for n in {self.length[i] for i in self.items_of[width][x]}:
                    m = n - width + 1  # shingles of the window; it may start up to m - 1 before the hit
                    lengths[n].update(range(max(0, p - m + 1), min(p, max(0, len(h) - m)) + 1))
            for n, starts in lengths.items():
                m, at = min(n - width + 1, len(h)), np.array(sorted(starts))
                for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    for lo in range(0, len(run), 4096):
                        part = run[lo : lo + 4096]
                        mine = h[part[0] : part[-1] + m]
                        weight = np.array([self.weight.get(x, 1.0) for x in mine.tolist()])
                        bits = bits_of(mine)
                        near: set[tuple[int, int]] = set()
                        for kind, votes in enumerate((bits * weight[:, None], bits)):
                            total = np.concatenate([np.zeros((1, 64)), np.cumsum(votes, 0)])
                            near.update(self.near(kind, packed_bits(total[m:] - total[:-m]), n, width))
                        for k, i in sorted(near):
                            s = self.similarity(mine[k : k + m], i)
                            if s >= SIMILARITY and s > best.get(i, (0.0, 0))[0]:
                                best[i] = (s, int(part[0]) + k)
        for i, (s, start) in sorted(best.items()):
            yield self.ids[i], round(s, 6), start, min(self.length[i], len(words))


_built: dict[str, Benchmark] = {}


def built(key: str, block: tuple) -> Benchmark:
    """The index of a block, made once a worker: workers are used again for the tasks that follow."""
    if key not in _built:
        _built.clear()
        _built[key] = Benchmark(*block)
    return _built[key]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items, at most BLOCK_WORDS words (or one item) at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), text_column(benchmark).alias("text")).toLocalIterator():
        text = r.text.encode("utf-8", "surrogatepass")
        if block and size + len(text) // 2 > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.item_id, text))
        size += len(text) // 2
    if block:
        yield block


def weighed_blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, bytes]], tuple[np.ndarray, np.ndarray] | None]]:
    """The blocks, each with what Benchmark must know of the others: (h, n) of its shingles that are repeated anywhere."""
    blocks = item_blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        yield from [(first, None)] if first else []
        return
    spark = benchmark.sparkSession
    repeated = stored(repeated_shingles(benchmark))
    for block in chain([first, second], blocks):
        words = [w for w in (word_hashes([t])[1] for _, t in block) if len(w)]
        mine = spark.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingles(w, min(WIDTH, len(w))) for w in words)])))

        def run(batches: Iterator[pa.RecordBatch], mine=mine) -> Iterator[pa.RecordBatch]:
            for part in batches:
                yield part.filter(pa.array(np.isin(part.column("h").to_numpy().view(np.uint64), mine.value)))

        got = repeated.mapInArrow(run, "h long, n long").toArrow()  # at most a row a word of the block
        yield block, (got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy())


SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long, contaminated boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words, contaminated: the best window of each document and item that match."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    found = None
    for block in weighed_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            known = built(key, shared.value)
            for piece in slices(batches):
                ids, texts = piece.column("doc_id").to_pylist(), utf8_of(piece.column("text"))
                owner, words = word_hashes(texts)
                lows = np.searchsorted(owner, np.arange(len(texts) + 1))
                rows = [(ids[i], *m, True) for i in range(len(texts)) for m in known.matches(words[lows[i] : lows[i + 1]])]
                if rows:
                    names = [x.split()[0] for x in SCHEMA.split(", ")]
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        part = plain.mapInArrow(run, SCHEMA)
        found = part if found is None else stored(found.union(part))
    return spark.createDataFrame([], SCHEMA) if found is None else found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that match no item."""
    spark = docs.sparkSession
    names = docs.columns
    kept = docs
    for block in weighed_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            known = built(key, shared.value)
            for piece in slices(batches):
                owner, words = word_hashes(utf8_of(piece.column("text")))
                lows = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                yield piece.filter(pa.array([not any(known.matches(words[lows[i] : lows[i + 1]])) for i in range(piece.num_rows)], pa.bool_()))

        kept = kept.select(*names).mapInArrow(run, docs.schema)
    return kept
