"""Shaping results: token budgets and pages, compact references, diagrams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from strandline.functions.top import first
from strandline.operators.traversal import get_subgraph, resolve
from strandline.session import GraphSession

# What a diagram shows unless told otherwise.
EXPORT_EDGE_KINDS = ("CALLS", "DYNAMIC_DISPATCH", "ADVISES", "ROUTES", "INJECTS", "REFLECTS")
EXPORT_NODE_KINDS = ("class", "interface", "method", "constructor", "module", "file", "aspect")
CHARS_PER_TOKEN = 4


def estimate_tokens(df: DataFrame) -> Column:
    """A row's cost: its JSON's length over four, rounded up."""
    return F.ceil(F.length(F.to_json(F.struct(*[df[c] for c in df.columns]), {"ignoreNullFields": "false"})) / CHARS_PER_TOKEN).cast("long")


def apply_budget(df: DataFrame, order: Sequence[str], max_tokens: int | None = None, cursor: int = 0) -> DataFrame:
    """The page of df from cursor on that fits the budget, at least one row; with position, tokens so far, total and next cursor.

    Columns named with a minus before them order from the largest down. Pages are cut from result lists that a limit has bounded already; the running sum is over that list.
    """
    w = Window.orderBy(*[F.col(c.removeprefix("-")).desc() if c.startswith("-") else F.col(c) for c in order])
    placed = df.withColumn("tokens", estimate_tokens(df)).withColumn("position", F.row_number().over(w) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    page = placed.filter(F.col("position") >= cursor).withColumn("used", F.sum("tokens").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))
    if max_tokens:
        page = page.filter((F.col("used") <= max_tokens) | (F.col("position") == cursor))
    last = F.max("position").over(Window.partitionBy())
    return page.withColumn("next_cursor", F.when(last + 1 < F.col("total"), last + 1))


def page_meta(page: DataFrame) -> DataFrame:
    """(returned, total, next_cursor, truncated, hint) of a page of apply_budget()."""
    got = page.agg(F.count(F.lit(1)).alias("returned"), F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.max("next_cursor").alias("next_cursor"))
    more = F.col("next_cursor").isNotNull()
    return got.select("*", more.alias("truncated"), F.when(more, F.format_string("%d of %d rows; go on with cursor %d, or ask for less", "returned", "total", "next_cursor")).alias("hint"))


def compactify(df: DataFrame) -> DataFrame:
    """Structs that are symbol references (id, qualifiedName, kind) become their qualified names, at any depth."""
    def shrink(c: Column, t) -> Column:
        if isinstance(t, ArrayType):
            return F.transform(c, lambda x: shrink(x, t.elementType))
        if isinstance(t, StructType):
            names = set(t.names)
            if {"id", "qualifiedName", "kind"} <= names:
                return c["qualifiedName"]
            return F.when(c.isNotNull(), F.struct(*[shrink(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        return c

    return df.select(*[shrink(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def export_graph(g: GraphSession, symbol: str | None = None, radius: int = 2, edge_kinds: Sequence[str] = EXPORT_EDGE_KINDS, fmt: str = "mermaid", direction: str = "LR", limit: int | None = 200) -> DataFrame:
    """(line_no, line) of a Mermaid or DOT diagram; nodes are numbered in the order of their labels."""
    if symbol is not None:
        if resolve(g, symbol) is None:
            return g.spark.createDataFrame([], "line_no long, line string")
        nodes, edges = get_subgraph(g, symbol, radius, edge_kinds, limit)
        nodes = nodes.select("id", "qualified_name")
    else:
        nodes = g.nodes.filter(F.col("kind").isin(*EXPORT_NODE_KINDS)).transform(first, limit, "qualified_name", "id").select("id", "qualified_name")
        edges = g.edges_of(*edge_kinds).transform(first, None if limit is None else limit * 10, "source", "target", "kind")
    lines = nodes.join(g.nodes.select("id", "start_line"), "id")
    label = F.concat("qualified_name", F.when(F.col("start_line").isNotNull(), F.concat(F.lit(":"), (F.col("start_line") + 1).cast("string"))).otherwise(""))
    safe = F.regexp_replace(F.regexp_replace(label, r'(["\\])', r"\\$1"), "\n", " ")
    numbered = lines.select("id", safe.alias("label"), (F.row_number().over(Window.orderBy("qualified_name", "id")) - 1).alias("n"))  # at most `limit` rows
    a, b = numbered.select(F.col("id").alias("source"), F.col("n").alias("a")), numbered.select(F.col("id").alias("target"), F.col("n").alias("b"))
    pairs = edges.select("source", "target", "kind").distinct().join(a, "source").join(b, "target")
    if fmt == "mermaid":
        head, foot = [f"graph {direction}"], []
        node, edge = F.format_string('  n%d["%s"]', "n", "label"), F.format_string("  n%d -->|%s| n%d", "a", "kind", "b")
    else:
        head, foot = ["digraph graph_export {", f"  rankdir={direction};"], ["}"]
        node, edge = F.format_string('  n%d [label="%s", shape=box];', "n", "label"), F.format_string('  n%d -> n%d [label="%s"];', "a", "b", "kind")
    zero = F.lit(0)
    parts = g.spark.createDataFrame([(0, i, 0, "", x) for i, x in enumerate(head)] + [(3, i, 0, "", x) for i, x in enumerate(foot)], "part int, x int, y int, k string, line string")
    parts = parts.union(numbered.select(F.lit(1), "n", zero, F.lit(""), node)).union(pairs.select(F.lit(2), "a", "b", "kind", edge))
    return parts.select((F.row_number().over(Window.orderBy("part", "x", "y", "k"))).cast("long").alias("line_no"), "line")
