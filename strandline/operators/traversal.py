"""Bounded traversal: breadth-first closures over DataFrames, paths, neighbourhoods and hierarchy.

A closure runs level by level: the frontier joins the edges, rows are reduced to one a node by a fixed tie-break
(edge kind, then neighbour), and an anti-join takes out what was reached before, so that a node appears once, at
its least depth. All starts of a multi-source closure travel together, keyed by root. Each level is written to the
checkpoint folder, so that plans stay flat however deep the closure, and survive the loss of executors.
A frontier is broadcast while its counted rows are few; beyond that the join shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import settle, small
from strandline.functions.top import first
from strandline.session import CALLABLE_KINDS, TYPE_KINDS, GraphSession

#: The edge kinds that a neighbourhood follows unless told otherwise (all but EMITS).
SUBGRAPH_KINDS = ("CALLS", "DYNAMIC_DISPATCH", "ADVISES", "DECLARED_IN", "CONTAINS", "IMPLEMENTS", "EXTENDS", "IMPORTS", "ANNOTATED_WITH", "REFERENCES", "REFLECTS", "INJECTS", "ROUTES")
PAYLOAD = ("kind", "line", "resolved", "confidence")


def edge_kind_policy(dynamic: bool = True, advice: bool = False, events: bool = True) -> list[str]:
    """The edge kinds that count as calls."""
    return ["CALLS", *["DYNAMIC_DISPATCH"] * dynamic, *["ADVISES"] * advice, *["EMITS"] * events]


def resolve(g: GraphSession, symbol: str) -> str | None:
    """A node's id, by id or else by qualified name (first by kind, id)."""
    row = g.nodes.filter((F.col("id") == symbol) | (F.col("qualified_name") == symbol)).orderBy((F.col("id") == symbol).desc(), "kind", "id").select("id").first()
    return row.id if row else None


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst, payload): along the edges, against them, or both ways."""
    out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), *PAYLOAD)
    back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"), *PAYLOAD)
    return {"out": out, "in": back}.get(direction) or out.union(back)


def bfs(steps: DataFrame, starts: DataFrame, max_depth: int, keep_start: bool = False) -> DataFrame:
    """(root, id, depth, via, kind, line, resolved, confidence) of all nodes within max_depth of the starts (root, id)."""
    starts = settle(starts.select("root", "id").distinct())
    void = [F.lit(None).cast(t).alias(c) for c, t in zip(("via", *PAYLOAD), ("string", "string", "int", "boolean", "double"))]
    zero = starts.select("root", "id", F.lit(0).alias("depth"), *void)
    frontier, levels, seen = starts, [zero], starts
    n = total = starts.count()
    for depth in range(1, max_depth + 1):
        reached = steps.join(small(frontier, n), steps.src == frontier.id).select("root", F.col("dst").alias("id"), F.struct("kind", F.col("src").alias("via"), "line", "resolved", "confidence").alias("e"))
        best = reached.groupBy("root", "id").agg(F.min_by("e", F.struct("e.kind", "e.via")).alias("e"))
        level = best.join(small(seen, total), ["root", "id"], "left_anti").select("root", "id", F.lit(depth).alias("depth"), "e.via", *[f"e.{c}" for c in PAYLOAD])
        level = settle(level)
        n = level.count()
        total += n
        if n == 0:
            break
        levels.append(level)
        frontier = level.select("root", "id")
        seen = seen.union(frontier)
    found = levels[0] if keep_start else levels[0].limit(0)
    for level in levels[1:]:
        found = found.union(level)
    return found


def _start(g: GraphSession, symbol: str) -> DataFrame:
    at = resolve(g, symbol)
    return g.spark.createDataFrame([(at, at)] if at else [], "root string, id string")


def _closure(g: GraphSession, symbol: str, direction: str, max_depth: int, limit: int, dynamic: bool, advice: bool, events: bool) -> DataFrame:
    steps = oriented(g.steps_of(*edge_kind_policy(dynamic, advice, events)), direction)
    found = bfs(steps, _start(g, symbol), max_depth)
    named = found.join(g.nodes.select("id", F.col("kind").alias("node_kind"), "qualified_name"), "id")
    return named.select("id", "node_kind", "qualified_name", "depth", F.col("kind").alias("edge_kind"), "via", "line", "resolved", "confidence").transform(first, limit, "depth", "id")


def get_callers(g: GraphSession, symbol: str, max_depth: int = 10, limit: int | None = 100, include_dynamic: bool = True, include_advice: bool = False, include_events: bool = True) -> DataFrame:
    """Who reaches the symbol by calls, each once at its least depth, the symbol itself left out."""
    return _closure(g, symbol, "in", max_depth, limit, include_dynamic, include_advice, include_events)


def get_callees(g: GraphSession, symbol: str, max_depth: int = 10, limit: int | None = 100, include_dynamic: bool = True, include_advice: bool = False, include_events: bool = True) -> DataFrame:
    """What the symbol reaches by calls, mirrored."""
    return _closure(g, symbol, "out", max_depth, limit, include_dynamic, include_advice, include_events)


def _direct(g: GraphSession, symbol: str, near: str, far: str, limit: int, **kinds: bool) -> DataFrame:
    at = resolve(g, symbol)
    e = g.edges_of(*edge_kind_policy(**kinds)).filter(F.col(near) == at)
    n = g.nodes.select("id", F.col("kind").alias("node_kind"), "qualified_name")
    return e.join(n, e[far] == n.id).select("id", "node_kind", "qualified_name", e.kind.alias("edge_kind"), "line", "resolved", "confidence").transform(first, limit, "edge_kind", "id")


def get_callers_direct(g: GraphSession, symbol: str, limit: int | None = 100, dynamic: bool = True, advice: bool = False, events: bool = True) -> DataFrame:
    """One row for each incoming edge; a caller may come once a kind, and the symbol may call itself."""
    return _direct(g, symbol, "target", "source", limit, dynamic=dynamic, advice=advice, events=events)


def get_callees_direct(g: GraphSession, symbol: str, limit: int | None = 100, dynamic: bool = True, advice: bool = False, events: bool = True) -> DataFrame:
    return _direct(g, symbol, "source", "target", limit, dynamic=dynamic, advice=advice, events=events)


def trace_execution(g: GraphSession, symbol: str, max_depth: int = 10, limit: int | None = 200, include_dynamic: bool = True, include_advice: bool = True) -> DataFrame:
    """What runs when the symbol does: calls, dispatches, and the advice that intercepts any of them.

    Each step comes once at its least depth; the limit applies after that; the root is never a step.
    """
    calls = g.steps_of(*edge_kind_policy(include_dynamic, False, False))
    steps = oriented(calls, "out")
    if include_advice:
        steps = steps.union(oriented(g.steps_of("ADVISES"), "in").withColumn("kind", F.lit("INTERCEPT")))
    found = bfs(steps, _start(g, symbol), max_depth)
    return found.join(g.nodes.select("id", "qualified_name"), "id").select("id", "qualified_name", "depth", F.col("kind").alias("edge_kind"), "via").transform(first, limit, "depth", "id")


def get_subgraph(g: GraphSession, symbol: str, radius: int = 2, edge_kinds: Sequence[str] = SUBGRAPH_KINDS, limit: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes by depth and id, the edges between them): the neighbourhood over edges taken either way, each node once."""
    some = g.steps_of(*edge_kinds)
    found = bfs(oriented(some, "both"), _start(g, symbol), radius, keep_start=True)
    nodes = found.join(g.nodes.select("id", F.col("kind").alias("node_kind"), "qualified_name", "file_path"), "id").select("id", "node_kind", "qualified_name", "file_path", "depth").transform(first, limit, "depth", "id")
    ids = settle(nodes.select("id"))
    edges = some.join(ids, some.source == ids.id, "left_semi").join(ids, some.target == ids.id, "left_semi")
    return nodes, edges.select("source", "target", "kind", "line").transform(first, limit, "source", "target", "kind")


def find_implementations(g: GraphSession, symbol: str, max_depth: int = 10, limit: int | None = 100) -> DataFrame:
    """Types that extend or implement the symbol, directly or not."""
    found = bfs(oriented(g.steps_of("EXTENDS", "IMPLEMENTS"), "in"), _start(g, symbol), max_depth)
    n = g.nodes.filter(F.col("kind").isin(*TYPE_KINDS)).select("id", F.col("kind").alias("node_kind"), "qualified_name")
    return found.join(n, "id").select("id", "node_kind", "qualified_name", "depth", F.col("kind").alias("relation")).transform(first, limit, "depth", "qualified_name", "id")


def ancestors(g: GraphSession, max_depth: int = 10) -> DataFrame:
    """(type, ancestor, depth): the closure of EXTENDS and IMPLEMENTS over all types at once."""
    steps = oriented(g.steps_of("EXTENDS", "IMPLEMENTS"), "out")
    starts = steps.select(F.col("src").alias("root"), F.col("src").alias("id"))
    return bfs(steps, starts, max_depth).filter("root <> id").select(F.col("root").alias("type"), F.col("id").alias("ancestor"), "depth")


def subtypes_of(g: GraphSession, symbol: str, max_depth: int = 10) -> DataFrame:
    """(type, depth) below a type."""
    return bfs(oriented(g.steps_of("EXTENDS", "IMPLEMENTS"), "in"), _start(g, symbol), max_depth).select(F.col("id").alias("type"), "depth")


def find_inherited(g: GraphSession, type_symbol: str, member: str, max_depth: int = 10) -> DataFrame:
    """All members of that name in the nearest ancestor that has one (ties of ancestors: by id)."""
    up = bfs(oriented(g.steps_of("EXTENDS", "IMPLEMENTS"), "out"), _start(g, type_symbol), max_depth)
    held = g.edges_of("CONTAINS").select(F.col("source").alias("owner"), F.col("target").alias("member"))
    named = g.nodes.filter(F.col("name") == member).select(F.col("id").alias("member"))
    found = settle(up.join(held, up.id == held.owner).join(named, "member").select("member", "owner", "depth"))
    nearest = found.agg(F.min_by("owner", F.struct("depth", "owner")).alias("owner"))
    return found.join(F.broadcast(nearest), "owner").select("member", "owner", "depth").orderBy("member")


def trace_path(g: GraphSession, source: str, target: str, max_depth: int = 10, limit: int | None = 10, include_dynamic: bool = True, include_advice: bool = False, include_events: bool = True) -> DataFrame:
    """Up to `limit` simple paths, shortest first, ties by the ids along them: (path_no, depth, path).

    Only nodes from which the target is reached within the hops left are extended, by one reverse closure.
    """
    a, b = resolve(g, source), resolve(g, target)
    kinds = edge_kind_policy(include_dynamic, include_advice, include_events)
    empty = g.spark.createDataFrame([], "path_no int, depth int, path array<string>")
    if a is None or b is None:
        return empty
    steps = g.steps_of(*kinds).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    back = bfs(oriented(g.steps_of(*kinds), "in"), _start(g, b), max_depth, keep_start=True).select(F.col("id").alias("dst"), F.col("depth").alias("left"))
    useful = settle(steps.join(back, "dst"))
    paths = g.spark.createDataFrame([([a],)], "path array<string>")
    done = []
    for depth in range(1, max_depth + 1):
        at = paths.withColumn("at", F.element_at("path", -1)).filter(F.col("at") != b)
        nxt = at.join(useful, at["at"] == useful.src).filter((F.col("left") <= max_depth - depth) & ~F.array_contains("path", F.col("dst")))
        paths = settle(nxt.select(F.array_append("path", F.col("dst")).alias("path")))
        if paths.isEmpty():
            break
        hit = paths.filter(F.element_at("path", -1) == b).select(F.lit(depth).alias("depth"), "path").transform(first, limit, "path")
        done.append(hit)
        if limit is not None and sum(h.count() for h in done) >= limit:
            break
    if not done:
        return empty
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    top = found.transform(first, limit, "depth", "path")
    numbered = top.agg(F.sort_array(F.collect_list(F.struct("depth", "path"))).alias("p")).select(F.posexplode("p").alias("i", "p"))
    return numbered.select((F.col("i") + 1).alias("path_no"), "p.depth", "p.path")


def callable_ids(g: GraphSession) -> DataFrame:
    return g.nodes.filter(F.col("kind").isin(*CALLABLE_KINDS)).select("id")
