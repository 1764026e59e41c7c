"""Helpers shared by the corpus operators: shared storage, text batches, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.lineage import settle, stored  # noqa: F401

#: Bytes of text that one vectorised step works on; it bounds a worker's memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write a small frame of an iteration to the shared folder, so that lineage ends here."""
    return settle(df)


def text_column(df: DataFrame, name: str = "text") -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in have:
            name = "_" + name
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about `most` bytes of text; a longer single row stands alone."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        at, total = 0, 0
        for i, n in enumerate(lengths):
            if i > at and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        if at < batch.num_rows:
            yield batch.slice(at)


def utf8_of(column: pa.Array) -> list[bytes]:
    """The rows' UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i < n."""
    global _POW, _INV
    if len(_POW) < n:
        m = max(n, 1 << 20)
        _POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, _BASE, np.uint64)]))
        _INV = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, _BASE_INV, np.uint64)]))
    return _POW[:n], _INV[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, one longer than buf."""
    pow_, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pow_[: len(buf)], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of buf[start:end], the same wherever these bytes stand."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number, zeros after the end."""
    w = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        w[:-shift] = (w[:-shift] << np.uint64(8 * shift)) | w[shift:]
    return w[: len(buf)]


def gram_prefix(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums over the mixed eight-byte strings from each byte on, one longer than buf."""
    pow_, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(mix(words_at(buf) + np.uint64(_BASE)) * pow_[: len(buf)], out=out[1:])
    return out


def gram_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second hash of buf[start:end] (eight bytes or more), from the eight-byte strings within it."""
    return span_hash(prefix, start, end - 7)


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def to_bytes(x: np.ndarray) -> bytes:
    """An array's bytes, each place of the numbers by itself, compressed."""
    return squeezed(np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def from_bytes(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(unsqueezed(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


#: For each byte: whether it separates words (space, tab to carriage return, and the padding byte).
SPACE = np.zeros(256, bool)
SPACE[[0x00, 0x20, *range(0x09, 0x0E)]] = True


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not separators."""
    edge = np.diff(np.concatenate([[False], ~SPACE[buf], [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null ids read as 'null'."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, fold: Column) -> list[tuple[str, int]]:
    """At most per_class texts of each label outside the held-out fold, in hash order of doc_id, none empty or longer than max_chars.

    A bounded sample for fitting: 2 * per_class texts of max_chars characters reach the driver at most. A doc_id counts
    once, however often it stands in either table: with the largest of its labels and the text of the least hash.
    """
    known = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).filter(~fold)
    short = docs.select("doc_id", text_column(docs).alias("text")).filter(f"length(text) between 1 and {max_chars}").withColumn("t", F.xxhash64("text"))
    rows = stored(known.join(short.groupBy("doc_id").agg(F.min("t").alias("t")), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "y", "t"))
    ids = [tuple(r) for y in (0, 1) for r in rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not ids:
        return []
    keys = docs.sparkSession.createDataFrame(ids, "id long, y int, least long")
    texts = short.join(F.broadcast(keys), (short.doc_id.cast("long") == keys.id) & (short.t == keys.least)).groupBy("id", "y").agg(F.min("text").alias("text"))
    return [(r.text, r.y) for r in texts.orderBy("id").collect()]


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's 0-based place in the global order: range partitions, and the counts of those before."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    before, rows = 0, []
    for p, n in sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect()):  # one row a partition
        rows.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_p long, _before long")
    return ranged.join(F.broadcast(offsets), part == offsets["_p"]).withColumn(name, F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_before")
