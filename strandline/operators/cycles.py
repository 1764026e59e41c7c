"""Strongly connected components by trimming, forward colours and backward closure, all as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import settle, small
from strandline.functions.top import first
from strandline.operators.traversal import callable_ids
from strandline.session import GraphSession


def _trim(e: DataFrame) -> DataFrame:
    """Without edges of nodes that lack a way in or a way out, which are in no cycle."""
    n = e.count()
    while True:
        targets, sources = (small(e.select(F.col(a).alias(b)).distinct(), n) for a, b in (("t", "s"), ("s", "t")))
        e = settle(e.join(targets, "s", "left_semi").join(sources, "t", "left_semi").select("s", "t"))
        now = e.count()
        if now == n or now == 0:
            return e
        n = now


def _spread(e: DataFrame, colour: DataFrame) -> DataFrame:
    """The least node that reaches each node, by repeated relaxation of (id, c) along e."""
    mark, n = None, colour.count()
    while True:
        offered = e.join(small(colour, n), colour.id == e.s).select(F.col("t").alias("id"), "c")
        new = settle(colour.union(offered).groupBy("id").agg(F.min("c").alias("c")))
        now = new.agg(F.sum(F.xxhash64("id", "c").cast("decimal(38,0)"))).first()[0]
        if now == mark:
            return new
        colour, mark = new, now


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) of nodes in components of two or more; a component is named by its least id."""
    spark = edges.sparkSession
    ids = nodes.select("id")
    e = edges.select(F.col("source").alias("s"), F.col("target").alias("t")).filter("s <> t").distinct()
    e = e.join(ids.select(F.col("id").alias("s")), "s", "left_semi").join(ids.select(F.col("id").alias("t")), "t", "left_semi").select("s", "t")
    e = settle(e)
    found: DataFrame | None = None
    while True:
        e = _trim(e)
        if e.isEmpty():
            break
        every = settle(e.select(F.col("s").alias("id")).union(e.select("t")).distinct())
        colour = _spread(e, every.withColumn("c", F.col("id")))
        # within one colour, what reaches its root backwards is the root's component
        n = colour.count()
        named = e.join(small(colour.select(F.col("id").alias("s"), F.col("c").alias("cs")), n), "s").join(small(colour.select(F.col("id").alias("t"), F.col("c").alias("ct")), n), "t").filter("cs = ct")
        inner = settle(named.select("s", "t", F.col("cs").alias("c")))
        done = settle(colour.filter("id = c").select("id", "c"))
        frontier, rows = done, done.count()
        total = rows
        while True:
            back = inner.join(small(frontier, rows), (inner.t == frontier.id) & (inner.c == frontier.c)).select(F.col("s").alias("id"), inner.c).distinct()
            frontier = settle(back.join(small(done, total), ["id", "c"], "left_anti"))
            rows = frontier.count()
            if rows == 0:
                break
            total += rows
            done = done.union(frontier)
        done = settle(done)
        size = done.groupBy("c").count().filter("count > 1")
        part = done.join(size, "c").select("id", F.col("c").alias("component"))
        found = settle(part if found is None else found.union(part))
        gone = done.select("id")
        e = settle(inner.select("s", "t").join(gone.select(F.col("id").alias("s")), "s", "left_anti").join(gone.select(F.col("id").alias("t")), "t", "left_anti").select("s", "t"))
    if found is None:
        return spark.createDataFrame([], "id string, component string")
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    return found.join(least, "component").select("id", F.col("least").alias("component"))


def find_cycles(g: GraphSession, edge_kinds: Sequence[str] | None = None, include_dynamic: bool = False, min_size: int = 2, limit: int | None = 100) -> DataFrame:
    """(component, size, members) of the cycles among callables, largest first; self-calls are apart."""
    kinds = list(edge_kinds or ["CALLS", *["DYNAMIC_DISPATCH"] * include_dynamic])
    c = components(g.steps_of(*kinds), callable_ids(g))
    sized = c.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("members"))
    return sized.filter(F.col("size") >= max(2, min_size)).transform(first, limit, F.desc("size"), "component")


def self_calls(g: GraphSession, edge_kinds: Sequence[str] = ("CALLS",)) -> DataFrame:
    e = g.edges_of(*edge_kinds).filter("source = target").select(F.col("source").alias("id")).distinct()
    return e.join(callable_ids(g), "id")


def cycle_sample(g: GraphSession, component: DataFrame, edge_kinds: Sequence[str] = ("CALLS",)) -> list[str]:
    """A shortest closed walk through the least member of one component (rows id): the walk's ids, first equal to last."""
    ids = component.select("id").persist(StorageLevel.MEMORY_AND_DISK)
    e = g.edges_of(*edge_kinds).join(ids, F.col("source") == ids.id, "left_semi").join(ids, F.col("target") == ids.id, "left_semi").select("source", "target").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    start = ids.agg(F.min("id")).first()[0]
    paths = g.spark.createDataFrame([([start],)], "path array<string>")
    seen = g.spark.createDataFrame([(start,)], "id string")
    while True:
        step = paths.join(e, F.element_at("path", -1) == e.source).select("path", "target")
        closed = step.filter(F.col("target") == start).select(F.array_append("path", F.col("target")).alias("path")).orderBy("path").first()
        if closed:
            return closed.path
        fresh = step.join(seen, step.target == seen.id, "left_anti").groupBy("target").agg(F.min("path").alias("path"))
        paths = fresh.select(F.array_append("path", F.col("target")).alias("path")).persist(StorageLevel.MEMORY_AND_DISK)
        if paths.isEmpty():
            return []
        seen = seen.union(fresh.select("target"))
