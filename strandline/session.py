"""A labelled property graph: two relations, their keys, and the checks that hold on any of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds of nodes and edges that the data model knows.
NODE_KINDS = ("file", "package", "module", "class", "interface", "enum", "annotation_type", "annotation", "aspect", "method", "constructor", "field", "import", "external_symbol", "unknown_symbol")
EDGE_KINDS = ("CALLS", "DYNAMIC_DISPATCH", "ADVISES", "DECLARED_IN", "CONTAINS", "IMPLEMENTS", "EXTENDS", "IMPORTS", "ANNOTATED_WITH", "REFERENCES", "REFLECTS", "INJECTS", "ROUTES", "EMITS")
CALLABLE_KINDS = ("method", "constructor")
TYPE_KINDS = ("class", "interface", "enum", "annotation_type", "aspect")
ENTRY_POINT_KINDS = ("http", "messaging", "scheduler", "event", "cli", "test", "route")
CONTROL_FLOW_KINDS = ("branch", "loop", "exception", "predicate")

#: Typed columns that operators read; a relation that lacks one gets nulls.
NODE_COLUMNS = {"id": "string", "kind": "string", "qualified_name": "string", "name": "string", "file_path": "string", "start_line": "int", "end_line": "int", "entry_point": "boolean", "entry_point_kind": "string", "advice_kind": "string", "proxy": "string"}
EDGE_COLUMNS = {"source": "string", "target": "string", "kind": "string", "line": "int", "resolved": "boolean", "confidence": "double", "reason": "string", "channel": "string", "http_method": "string", "path": "string", "arguments": "string", "decorator": "boolean"}


def _typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()], *[c for c in df.columns if c not in columns])


@dataclass
class GraphSession:
    """Nodes keyed by id and edges keyed by (source, target, kind)."""

    nodes: DataFrame
    edges: DataFrame
    crawled_at: int | None = None  # microseconds since 1970

    def __post_init__(self) -> None:
        self.nodes = _typed(self.nodes, NODE_COLUMNS)
        self.edges = _typed(self.edges, EDGE_COLUMNS)

    @property
    def spark(self):
        return self.nodes.sparkSession

    def persist(self) -> GraphSession:
        self.nodes = self.nodes.persist(StorageLevel.MEMORY_AND_DISK)
        self.edges = self.edges.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def edges_of(self, *kinds: str) -> DataFrame:
        return self.edges.filter(F.col("kind").isin(*kinds))

    def steps_of(self, *kinds: str) -> DataFrame:
        """edges_of, for what reads them again and again."""
        return self.edges_of(*kinds)

    def sql(self, query: str) -> DataFrame:
        """A SQL query over the tables nodes and edges; only a query is taken, nothing that writes."""
        if not re.match(r"\s*(SELECT|WITH|FROM|VALUES)\b", query, re.IGNORECASE):
            raise ValueError("only SELECT queries")
        return self.spark.sql(f"WITH nodes AS (SELECT * FROM {{nodes}}), edges AS (SELECT * FROM {{edges}}) SELECT * FROM ({query})", nodes=self.nodes, edges=self.edges)

    def violations(self) -> DataFrame:
        """(rule, key) of every broken key or reference: empty on a sound graph."""
        n, e = self.nodes, self.edges
        ids = n.select("id")
        double = n.groupBy("id").count().filter("count > 1").select(F.lit("node key").alias("rule"), F.col("id").alias("key"))
        twice = e.groupBy("source", "target", "kind").count().filter("count > 1").select(F.lit("edge key"), F.concat_ws(" ", "source", "kind", "target"))
        loose = [e.join(ids, e[c] == ids.id, "left_anti").select(F.lit(f"dangling {c}"), F.col(c)) for c in ("source", "target")]
        bad = n.filter(~F.col("kind").isin(*NODE_KINDS)).select(F.lit("node kind"), "id").union(e.filter(~F.col("kind").isin(*EDGE_KINDS)).select(F.lit("edge kind"), "kind"))
        return double.union(twice).union(loose[0]).union(loose[1]).union(bad)
