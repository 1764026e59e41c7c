"""SimHash near-duplicates: fingerprints, linked by vantage-point trees (see `vantage`).

op8's rule: 64 bits of the shingles of four words, repeats included; fingerprints of 4 or fewer differing bits are
linked. Four groups of 16 bits lose no such pair.

The pipeline's rule (keep_one): texts whose sets of five-word shingles share SIMILARITY or more. Candidates are
fingerprints of WORDS words over the distinct shingles, within WIDE's radius by trees over 16 groups of bits; the exact
sets decide. At a similarity of just SIMILARITY a pair of equal sizes differs in 78 of the 512 bits, give or take 8, so
that the radius of 92 finds 96 of 100 such pairs and nearly all that are more alike; a group is found whole as
soon as some of its pairs are.

Null and empty texts and those without words have fingerprint zero and are linked like any other; repeated rows
have distance zero; in op8 a null doc_id takes part but is nobody's smallest id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import small
from strandline.llm import vantage
from strandline.llm.common import mix, slices, stored, text_column, unused, utf8_of
from strandline.llm.components import components

SEED = 42
NEAR_WIDTH = 5
SIMILARITY = 0.8
WORDS = 8
WIDE = vantage.Space(WORDS, 92, vantage.groups_of(4, 4), 1)
#: Candidates of a node in the first round, and how many times as many in each that follows.
FEW, MORE = 4, 16
SALTS = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: A fingerprint is hot from this many rows on, and from one HOT_KEYS-th of all rows on: so at most HOT_KEYS are.
HOT_ROWS, HOT_KEYS = 500, 1000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hash of each `width` words from each word on; of fewer words one of them all, of none none."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    hash_of = xxhash.xxh64_intdigest
    ends = (start + size)[width - 1 :].tolist()
    return np.array([hash_of(joined[a:b], SEED) for a, b in zip(start.tolist(), ends)], np.uint64)


def _contents(text: bytes) -> bytes:
    """16 bytes that name a text's words."""
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()))


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of one text's word shingles as a signed integer."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for every row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([fingerprint(t, width) for t in utf8_of(part.column("text"))], pa.int64())], ["doc_id", "fp"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, "doc_id long, fp long"))


SPACE = vantage.Space(1, 4, vantage.groups_of(1, 4), 1)


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    rows = fingerprints(docs)
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n"))
    roots = components(vantage.links(distinct.select(F.col("fp").alias("id"), "fp"), SPACE))
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "smallest")
    least = linked.groupBy("root").agg(F.min("smallest").alias("component"))
    named = linked.join(least, "root").select("fp", "component")
    every = stored(distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "smallest").alias("component_id"), "n"))
    least_n = max(HOT_ROWS, rows.count() // HOT_KEYS + 1)
    hot = F.broadcast(every.filter(F.col("n") >= least_n).select("fp", "component_id"))  # at most HOT_KEYS rows
    cold = rows.join(hot.select("fp"), "fp", "left_anti").join(every.filter(F.col("n") < least_n).select("fp", "component_id"), "fp")
    return rows.join(hot, "fp").select("doc_id", "fp", "component_id").union(cold.select("doc_id", "fp", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """WORDS words of SimHash of distinct shingles, each word from hashes of its own."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(shingles), 255):
        each = mix(shingles[at : at + 255, None] + SALTS)
        ones += np.add.reduce(np.unpackbits(each.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").tobytes()


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sorted sets of shingles share SIMILARITY of all that either has, or more; empty ones are alike."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok) for pairs (a, b) by the exact similarity of their sets (id, shingles)."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ok = [similar(x, y) for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(decide, "a long, b long, ok boolean")


def similar_links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of all nodes (id, fp) that have a similar one; sets_of gives (id, shingles) for some ids.

    Round by round each node that has unlinked strangers within WIDE's radius is compared exactly with the FEW nearest of
    them, then with MORE times as many, until no candidate is left that was neither linked nor refuted: nodes that
    are linked already are not compared again, so that a large group of copies needs few comparisons a node.
    """
    open_, most = nodes.withColumn("root", F.col("id")), FEW
    sets = linked = refuted = roots = None
    while True:
        asked = stored(vantage.nearest_strangers(open_, WIDE, most))
        if sets is None:
            busy = stored(asked.select(F.col("a").alias("id")).union(asked.select("b")).filter("id is not null").distinct())
            sets = stored(sets_of(busy))
            open_ = stored(nodes.join(busy, "id", "left_semi"))
        pairs = asked.filter("b is not null")
        if refuted is not None:
            pairs = pairs.join(refuted, ["a", "b"], "left_anti")
        told = stored(verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets))
        new, no = told.filter("ok").select("a", "b"), told.filter("not ok").select("a", "b")
        both_ways = no.union(no.select("b", "a"))
        refuted = both_ways if refuted is None else refuted.union(both_ways)
        linked = new if linked is None else linked.union(new)
        if not new.isEmpty():
            roots = components(linked)
        elif asked.filter("b is null").isEmpty():
            break
        nodes_left = open_.select("id", "fp")
        open_ = nodes_left.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "fp", F.coalesce("root", "id").alias("root")) if roots is not None else nodes_left.withColumn("root", F.col("id"))
        most *= MORE
    return linked.limit(0).select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each group of texts that similar ones link: that with the smallest doc_id, then text hash.

    Texts are similar if their sets of NEAR_WIDTH-word shingles share SIMILARITY or more (texts of equal words always, those
    without words among themselves). Every row is a document of its own, whatever its doc_id, a null one counting as the
    largest; of rows that repeat doc_id and text one stays.
    """
    doc, t, odd_doc, odd_t, goes = unused(docs, "doc", "t", "odd_doc", "odd_t", "goes")
    text = text_column(docs)
    order = F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            every = [_contents(x) for x in utf8_of(part.column("text"))]
            fps = [wide_fingerprint(np.unique(shingle_hashes(x, NEAR_WIDTH))) for x in utf8_of(part.column("text"))]
            halves = np.frombuffer(b"".join(every), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), part.column("doc"), part.column("t"), pa.array(fps, pa.binary())], ["c1", "c2", "doc", "t", "fp"])

    rows = stored(docs.select(order.alias("doc"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(prints, "c1 long, c2 long, doc long, t long, fp binary"))
    best = F.min(F.struct("doc", "t"))
    contents = stored(rows.groupBy("c1", "c2").agg(best.alias("best"), F.min("fp").alias("fp")).withColumn("id", F.monotonically_increasing_id()))

    def sets_of(some: DataFrame) -> DataFrame:
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                sets = [np.unique(shingle_hashes(x, NEAR_WIDTH)).tobytes() for x in utf8_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

        first = contents.join(some, "id", "left_semi").select("id", F.col("best.doc").alias("d"), F.col("best.t").alias("h"))
        plain = docs.select(order.alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))
        found = plain.join(small(first, some.count()), (F.col("doc") == F.col("d")) & (F.col("t") == F.col("h"))).mapInArrow(packed, "id long, shingles binary")
        return found.groupBy("id").agg(F.min("shingles").alias("shingles"))

    roots = similar_links(contents.select("id", "fp"), sets_of)
    rooted = stored(contents.join(roots, contents.id == roots.node, "left").select("c1", "c2", "best", F.coalesce("root", "id").alias("root")))
    stay = stored(rooted.groupBy("root").agg(F.min("best").alias("stays")))
    named = stored(rooted.join(stay, "root").select(F.col("c1").alias("x1"), F.col("c2").alias("x2"), "stays", (F.col("best") == F.col("stays")).alias("mine")))
    judged = rows.groupBy("c1", "c2", "doc", "t").agg(F.count(F.lit(1)).alias("n")).join(named, (F.col("c1") == F.col("x1")) & (F.col("c2") == F.col("x2")))
    odd = stored(judged.withColumn("goes", ~F.col("mine") | (F.struct("doc", "t") != F.col("stays"))).filter("goes or n > 1").select("doc", "t", "goes"))
    # equal doc_id and equal text hash are equal rows to the decision
    odd = small(odd.groupBy(F.col("doc").alias(odd_doc), F.col("t").alias(odd_t)).agg(F.min("goes").alias(goes)), odd.count())
    keyed = docs.withColumn(doc, order).withColumn(t, F.xxhash64(text))
    told = keyed.join(odd, (keyed[doc] == odd[odd_doc]) & (keyed[t] == odd[odd_t]), "left")
    once = told.filter(told[goes].isNull()).select(*docs.columns)
    return once.unionByName(told.filter(~told[goes]).dropDuplicates([doc, t]).select(*docs.columns))
