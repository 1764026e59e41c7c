"""Substring dedup by sliding sentence spans.

A sentence ends at . ! ? or a line break; it is cut further at , ; : so that a long one is a span by itself. From
each sentence on, a span is the shortest run of at least RUN consecutive sentences with at least WORDS words, and
(with `fewest` below RUN, as op5's query has it) the shortest of at least `fewest` as well, so that a passage of one
or two long sentences is found too; their bytes are hashed. Spans meet by hash; the first is that with the smallest (doc_id, place), and every sentence that
a later one covers is removed, with what follows it up to the next sentence.

Hashes (96 bits) travel packed: each task keeps the first of equal spans that it has read, so that a passage that a
third of all documents share reaches its part once a task, and later ones are decided at once. Parts and shards are
sized by the input, shards dealt by row. Null texts are empty; a row is known by (doc_id, hash of id and text), so
that rows of one doc_id with other texts, or without a doc_id, are documents of their own, ordered by that hash after
the doc_id (a null one counts as the largest number); rows that repeat both keep the same sentences; texts of fewer
than `fewest` sentences or WORDS words hold no span and stay; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, from_bytes, gram_hash, gram_prefix, prefix_hash, slices, span_hash, stored, text_column, to_bytes, utf8_of

RUN = 3
WORDS = 12
SHARD_BYTES = 6 << 20
PART_BYTES = 8 << 20
HELD = 1 << 20
LAST = np.iinfo(np.int64).max
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?,;:\n"]] = True


def sentence_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts with line breaks between; owner, start and end of each sentence, and each text's start."""
    blob = b"".join(t + b"\n" for t in texts)
    buf = np.frombuffer(blob, np.uint8)
    begin = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    ink = np.flatnonzero(~SPACE[buf] & ~ENDS[buf])
    if not len(ink):
        return blob, *(np.zeros(0, np.int64) for _ in range(3)), begin
    which = np.cumsum(ENDS[buf])[ink]
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    start = ink[first]
    end = ink[np.append(first[1:], len(ink)) - 1] + 1
    return blob, np.searchsorted(begin, start, "right") - 1, start, end, begin


def spans(texts: list[bytes], fewest: int = RUN) -> tuple[np.ndarray, ...]:
    """(owner, first sentence within its text, number of sentences, kind: 0 of RUN or 1 of `fewest`, start, end) of every span; places in bytes of sentence_spans()."""
    blob, owner, start, end, _ = sentence_spans(texts)
    n = len(start)
    if not n:
        return (np.zeros(0, np.int64),) * 6
    gap = SPACE[np.frombuffer(blob, np.uint8)]
    words_before = np.concatenate([[0], np.cumsum(~gap & np.concatenate([[True], gap[:-1]]))])
    upto = words_before[end]
    have = words_before[start]  # a sentence may start inside a word ("a,b"): then that word counts for it too
    enough = np.searchsorted(upto, have + WORDS, "left")
    runs = [np.maximum(np.arange(n) + k - 1, enough) for k in (RUN, fewest)]
    i, last, kind = np.tile(np.arange(n), 2), np.concatenate(runs), np.repeat([0, 1], n)
    ok = (last < n) & np.concatenate([np.ones(n, bool), runs[1] < runs[0]])
    ok[ok] = owner[last[ok]] == owner[i[ok]]
    i, last, kind = i[ok], last[ok], kind[ok]
    base = np.searchsorted(owner, owner, "left")
    return owner[i], i - base[i], last - i + 1, kind, start[i], end[last]


def hashed(texts: list[bytes], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the spans' bytes."""
    buf = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    return span_hash(prefix_hash(buf), start, end), (gram_hash(gram_prefix(buf), start, end) >> np.uint64(32)).astype(np.uint32)


#: What travels of a span: its hash, the row that holds it, and its place (first sentence, and in the last bit its kind).
FIELDS = {"h": np.uint64, "g": np.uint32, "doc": np.int64, "row": np.int64, "at": np.uint32}


def _later(h: np.ndarray, g: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (hash, doc, row, place), and which in that order are not the first of their hash."""
    by = np.lexsort((at, row, doc, g, h))
    same = np.concatenate([[False], (h[by][1:] == h[by][:-1]) & (g[by][1:] == g[by][:-1])])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    return by, same & ((row[by] != row[by][first]) | (doc[by] != doc[by][first]) | (at[by] != at[by][first]))


def _packed(shards: int, row: np.ndarray, at: np.ndarray) -> tuple[list[int], list[bytes]]:
    """(row, place) pairs by shard."""
    shard = row % shards
    by = np.argsort(shard, kind="stable")
    who, cuts = np.unique(shard[by], return_index=True)
    pairs = np.stack([row, at.astype(np.int64)], 1)[by]
    return who.tolist(), [to_bytes(x) for x in np.split(pairs, cuts[1:])] if len(who) else []


def removed_sentences(docs: DataFrame, fewest: int = RUN) -> DataFrame:
    """doc_id, text, n_sentences, n_removed, n_spans, kept (the remaining text) for every row of docs."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // SHARD_BYTES) + 1
    parts = -(-total // PART_BYTES) + 1
    plain = plain.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("shard", F.pmod("row", F.lit(shards)).cast("int"))
    kinds = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("gone", pa.binary()), *[(c, pa.binary()) for c in FIELDS]])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            every = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            by, late = _later(*every)
            every = [x[by] for x in every]
            for k, rows in zip(*_packed(shards, every[3][late], every[4][late])):
                yield pa.RecordBatch.from_pydict({"part": [-1], "shard": [k], "gone": [rows], **{c: [None] for c in FIELDS}}, kinds)
            every = [x[~late] for x in every]
            part = ((every[0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            for lo, hi in zip(cuts := np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), [*cuts[1:], len(part)]):
                yield pa.RecordBatch.from_pydict({"part": [int(part[lo])], "shard": [0], "gone": [None], **{c: [to_bytes(x[lo:hi])] for c, x in zip(FIELDS, every)}}, kinds)

        for piece in slices(batches):
            texts = utf8_of(piece.column("text"))
            owner, at, _, kind, start, end = spans(texts, fewest)
            if len(owner):
                place = (2 * at + kind).astype(np.uint32)
                held.append((*hashed(texts, start, end), piece.column("doc_id").fill_null(LAST).to_numpy()[owner], piece.column("row").to_numpy()[owner], place))
            if sum(len(x[0]) for x in held) >= HELD:
                yield from flush()
        yield from flush()

    def meet(group: pa.Table) -> pa.Table:
        every = [np.concatenate([from_bytes(x, t) for x in group.column(c).to_pylist()]) for c, t in FIELDS.items()]
        by, late = _later(*every)
        who, gone = _packed(shards, every[3][by][late], every[4][by][late])
        return pa.table({"shard": pa.array(who, pa.int32()), "gone": pa.array(gone, pa.binary())})

    def cut(group: pa.Table, known: pa.Table) -> pa.Table:
        gone_at = np.concatenate([from_bytes(x, np.int64).reshape(-1, 2) for x in known.column("gone").to_pylist()] or [np.zeros((0, 2), np.int64)])
        gone_at = gone_at[np.argsort(gone_at[:, 0], kind="stable")]
        out = []
        for row, text in zip(group.column("row").to_pylist(), group.column("text").cast(pa.binary()).to_pylist()):
            _, _, start, _, _ = sentence_spans([text])
            mine = gone_at[np.searchsorted(gone_at[:, 0], row, "left") : np.searchsorted(gone_at[:, 0], row, "right"), 1]
            kept, upto, runs, n_gone = [], 0, 0, 0
            if len(mine):
                _, at, n, kind, _, _ = spans([text], fewest)
                take = np.isin(2 * at + kind, mine)
                edge = np.zeros(len(start) + 1, np.int64)
                np.add.at(edge, at[take], 1)
                np.add.at(edge, at[take] + n[take], -1)
                gone = np.cumsum(edge)[:-1] > 0
                n_gone = int(gone.sum())
                first, last = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]])), np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]]))
                for a, b in zip(first.tolist(), last.tolist()):
                    kept.append(text[upto : start[a]])
                    upto = int(start[b + 1]) if b + 1 < len(start) else len(text)
                    runs += 1
            kept.append(text[upto:])
            rest = b"".join(kept)
            out.append((len(start), n_gone, runs, len(text) - len(rest), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "surrogatepass")))
        names = ("n_sentences", "n_removed", "n_spans", "removed_bytes", "kept_sha256", "kept")
        return pa.table({"doc_id": group.column("doc_id"), **{k: pa.array(c, t) for k, c, t in zip(names, zip(*out) if out else [[]] * 6, [pa.int64()] * 4 + [pa.string()] * 2)}})

    found = stored(plain.mapInArrow(gather, ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in kinds)))
    decided = found.filter("part >= 0").groupBy("part").applyInArrow(meet, "shard int, gone binary").union(found.filter("part < 0").select("shard", "gone"))
    return plain.groupBy("shard").cogroup(decided.groupBy("shard")).applyInArrow(cut, "doc_id long, n_sentences long, n_removed long, n_spans long, removed_bytes long, kept_sha256 string, kept string")


def remove_spans(docs: DataFrame, fewest: int = RUN) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_spans, removed_bytes, kept_sha256 for every row of docs."""
    return removed_sentences(docs, fewest).drop("kept")
