"""Nearest neighbours by vantage-point trees, one a shard.

A shard is a run of at most SHARD vectors of one input partition, so that building moves no rows. Inner nodes hold
a vantage point and, for either side, the range of distances from it; a side is left out if the triangle
inequality, its slack multiplied by `factor`, shows it beyond the best k so far. Factor 1 is exact; larger factors
prune more and may miss. The trees are written as a table; queries come in blocks of at most BLOCK_BYTES of vectors,
each broadcast to one pass over all trees.

Vectors that are null, zero, or hold null or non-finite components neither ask nor answer. Vectors are compared
with those of as many components only. A vec_id asks once: rows repeated under it ask with the least of their vectors
(of the longest, if they differ in length). They are not each other's neighbours, and each counts as a candidate.
Ties go to the smaller vec_id. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import positions, stored

SHARD = 8192
LEAF = 128
BLOCK_BYTES = 32 << 20
#: Queries that go through a tree together; it bounds a worker's memory.
TOGETHER = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances, components added in order."""
    total = np.zeros((len(queries), len(points)))
    for j in range(points.shape[1]):
        d = queries[:, j, None] - points[None, :, j]
        total += d * d
    return np.sqrt(total)


def build(x: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, nodes (start, end, vantage, inner, outer; -1 in a leaf) and ranges (inner low, high, outer low, high)."""
    rng = np.random.default_rng(seed)
    order = np.arange(len(x))
    nodes: list[list[int]] = []
    ranges: list[tuple[float, float, float, float]] = []

    def grow(start: int, end: int) -> int:
        me = len(nodes)
        nodes.append([start, end, -1, -1, -1])
        ranges.append((0.0, 0.0, 0.0, 0.0))
        if end - start <= LEAF:
            return me
        part = order[start:end]
        few = part[rng.integers(0, len(part), 8)]
        spread = [np.var(distances(x[part[rng.integers(0, len(part), 64)]], x[[v]])) for v in few]
        vantage = int(few[int(np.argmax(spread))])
        d = distances(x[part], x[[vantage]])[0]
        by = np.argsort(d, kind="stable")
        half = len(part) // 2
        if d[by[0]] == d[by[-1]]:
            return me
        order[start:end] = part[by]
        ranges[me] = (d[by[0]], d[by[half - 1]], d[by[half]], d[by[-1]])
        nodes[me][2:] = [vantage, grow(start, start + half), grow(start + half, end)]
        return me

    grow(0, len(x))
    return order, np.array(nodes, np.int64), np.array(ranges)


class Search:
    """The best k of a block of queries over trees shown one after another."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.ids, self.q, self.k, self.factor = ids, queries, k, factor
        self.best = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def leaf(self, x: np.ndarray, ids: np.ndarray, active: np.ndarray) -> None:
        for at in range(0, len(ids), 4 * LEAF):
            points, names = x[at : at + 4 * LEAF], ids[at : at + 4 * LEAF]
            d = distances(points, self.q[active])
            d[names[None, :] == self.ids[active, None]] = np.inf
            better = (d <= self.best[active, -1, None]).any(1)
            rows = active[better]
            if len(rows):
                dist = np.concatenate([self.best[rows], d[better]], 1)
                who = np.concatenate([self.who[rows], np.where(np.isinf(d[better]), np.iinfo(np.int64).max, names[None, :])], 1)
                take = np.lexsort((who, dist), axis=-1)[:, : self.k]
                self.best[rows] = np.take_along_axis(dist, take, 1)
                self.who[rows] = np.take_along_axis(who, take, 1)

    def tree(self, x: np.ndarray, ids: np.ndarray, order: np.ndarray, nodes: np.ndarray, ranges: np.ndarray) -> None:
        def visit(node: int, active: np.ndarray) -> None:
            if not len(active):
                return
            start, end, vantage, inner, outer = nodes[node]
            if inner < 0:
                self.leaf(x[order[start:end]], ids[order[start:end]], active)
                return
            d = distances(x[[vantage]], self.q[active])[:, 0]
            low_in, high_in, low_out, high_out = ranges[node]
            gap_in = np.maximum(np.maximum(d - high_in, low_in - d), 0)
            gap_out = np.maximum(np.maximum(d - high_out, low_out - d), 0)
            near_in = gap_in <= gap_out

            def go(child: int, mask: np.ndarray, gap: np.ndarray) -> None:
                visit(child, active[mask & (gap * self.factor <= self.best[active, -1] * (1 + 1e-9))])

            go(inner, near_in, gap_in)
            go(outer, ~near_in, gap_out)
            go(outer, near_in, gap_out)
            go(inner, ~near_in, gap_in)

        for at in range(0, len(self.ids), TOGETHER):
            visit(0, np.arange(at, min(at + TOGETHER, len(self.ids))))


def build_index(vectors: DataFrame) -> DataFrame:
    """One row a tree: dim, n, and the ids, vectors and tree as bytes; written to the shared folder."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count: dict[int, int] = {}

        def close(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held[dim]])
            x = np.concatenate([v for _, v in held.pop(dim)])
            count[dim] = 0
            order, nodes, ranges = build(x)
            cells = [dim, len(ids), ids.tobytes(), x.tobytes(), order.tobytes(), nodes.tobytes(), ranges.tobytes()]
            return pa.RecordBatch.from_pydict({k: [c] for k, c in zip(["dim", "n", "ids", "x", "ordering", "nodes", "ranges"], cells)}, pa.schema([("dim", pa.int64()), ("n", pa.int64()), *[(k, pa.binary()) for k in ("ids", "x", "ordering", "nodes", "ranges")]]))

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                part = whole.slice(at, 2048)
                ids = part.column("vec_id").to_numpy()
                lists = part.column("v")
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.values.to_numpy(zero_copy_only=False)
                first = lists.offsets.to_numpy()[:-1]
                for dim in np.unique(size).tolist():
                    rows = np.flatnonzero(size == dim)
                    x = flat[first[rows][:, None] + np.arange(dim)]
                    held.setdefault(dim, []).append((ids[rows], x))
                    count[dim] = count.get(dim, 0) + len(rows)
                    if count[dim] >= SHARD:
                        yield close(dim)
        for dim in list(held):
            yield close(dim)

    return stored(usable(vectors).mapInArrow(trees, "dim long, n long, ids binary, x binary, ordering binary, nodes binary, ranges binary"))


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score for queries (vec_id, v), a block at a time."""
    spark = index.sparkSession
    asked = stored(queries.groupBy("vec_id").agg(F.max(F.struct(F.size("v").alias("n"), F.transform("v", lambda x: -x).alias("v"))).alias("m")).select("vec_id", F.transform("m.v", lambda x: -x).alias("v")))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("widest")).first()
    most = max(1, BLOCK_BYTES // (8 * (size.widest or 1)))
    blocks = -(-size.n // most)
    if blocks > 1:
        asked = stored(positions(asked, [F.col("vec_id")], "place").select("vec_id", "v", F.floor(F.col("place") / most).alias("block")), "block")
    found = []
    for at in range(blocks):
        page = (asked.filter(F.col("block") == at) if blocks > 1 else asked).select("vec_id", "v").collect()  # BLOCK_BYTES at most
        block: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(r.v) for r in page}:
            rows = [r for r in page if len(r.v) == dim]
            block[dim] = (np.array([r.vec_id for r in rows], np.int64), np.array([r.v for r in rows], float))
        shared = spark.sparkContext.broadcast(block)

        def answer(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            running = {dim: Search(ids, q, k, factor) for dim, (ids, q) in shared.value.items()}
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    if (dim := row["dim"].as_py()) in running:
                        get = lambda c, t: np.frombuffer(row[c].as_buffer(), t)  # noqa: B023, E731
                        running[dim].tree(get("x", float).reshape(-1, dim), get("ids", np.int64), get("ordering", np.int64), get("nodes", np.int64).reshape(-1, 5), get("ranges", float).reshape(-1, 4))
            for s in running.values():
                hit = np.isfinite(s.best)
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(s.ids, hit.sum(1)), "vec_id": s.who[hit], "score": s.best[hit]})

        found.append(stored(index.mapInArrow(answer, "query_id long, vec_id long, score double")) if blocks > 1 else index.mapInArrow(answer, "query_id long, vec_id long, score double"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0) -> DataFrame:
    """The k nearest of each vector whose vec_id is divisible by `every`."""
    return search_index(build_index(vectors), usable(vectors.filter(F.col("vec_id") % every == 0)), k, factor)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
