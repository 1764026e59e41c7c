"""Connected components over edge tables, by hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import SMALL_ROWS
from strandline.llm.common import cut, stored


def settled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes the least node that links (a, b) lead to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)  # a whole cluster follows where one of its nodes goes
        label = label[label]
        if (label == before).all():
            return label


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    a, b = held.column("a").to_numpy(), held.column("b").to_numpy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    yield pa.RecordBatch.from_pydict({"node": nodes, "root": nodes[settled(len(nodes), at[: len(a)], at[len(a) :])]})


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (a, b) of longs; root is the component's smallest node.

    Up to SMALL_ROWS edges, counted, one task settles them. Beyond, edges point from the larger node to the smaller. A
    round hooks all parents of a node to its smallest, then moves every edge to its parent's parent; it ends when all
    edges lead straight to roots. A node of many children is only ever the many side of a join against a written table of
    one row a node, which adaptive execution can split. Edges that hold a null take no part, nor do those of a node with
    itself; no edges give no rows; repeated edges count once; extra columns are ignored.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e)
    if e.count() <= SMALL_ROWS:
        return stored(e.coalesce(1).mapInArrow(_in_one_task, "node long, root long"))
    for _ in range(most_rounds):
        least = cut(e.groupBy("a").agg(F.min("b").alias("m")))
        both = e.join(least, "a")
        hooked = cut(both.select("a", F.col("m").alias("b")).union(both.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        up = cut(hooked.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("up")))
        jumped = hooked.join(up, "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().cast("int").alias("moved"))
        e = cut(jumped.groupBy("a", "b").agg(F.max("moved").alias("moved")))
        state = e.agg(F.sum("moved").alias("moved"), F.count("*").alias("n"), F.count_distinct("a").alias("nodes")).first()
        e = e.select("a", "b")
        if not state.moved and state.n == state.nodes:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
