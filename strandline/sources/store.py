"""A project's manifest and graph as Parquet: written anew beside the old, then switched by a pointer file."""

from __future__ import annotations

import time
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import ship
from strandline.functions.lineage import settle
from strandline.operators.build import build_graph
from strandline.session import GraphSession
from strandline.sources.aliases import read_aliases
from strandline.sources.crawl import MANIFEST, CrawlOptions, crawl, parsed_files, project_options

SCHEMA_VERSION = 1
KEEP = 2
META = "version int, project string, signature string, crawled_at long, snapshot string"


class Store:
    """Snapshots below `path`; edges are partitioned by kind, so that a filter on kinds prunes folders."""

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.path = spark, path.rstrip("/")

    def meta(self) -> dict | None:
        """The last snapshot's record; a store of a newer version is refused."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return None
        row = self.spark.read.schema(META).json(f"{self.path}/meta").orderBy(F.desc("crawled_at")).first()
        if row is None:
            return None
        if row.version > SCHEMA_VERSION:
            raise ValueError(f"the store has version {row.version}, this engine reads up to {SCHEMA_VERSION}")
        return row.asDict()

    def manifest(self) -> DataFrame:
        m = self.meta()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{m['snapshot']}/files") if m else self.spark.createDataFrame([], MANIFEST)

    def graph(self) -> GraphSession:
        m = self.meta()
        if m is None:
            raise ValueError("nothing was crawled here yet")
        return GraphSession(self.spark.read.parquet(f"{self.path}/{m['snapshot']}/nodes"), self.spark.read.parquet(f"{self.path}/{m['snapshot']}/edges"), m["crawled_at"])

    def write(self, project: str, manifest: DataFrame, g: GraphSession | None, options: CrawlOptions) -> None:
        snapshot = uuid.uuid4().hex
        manifest.select(*[x.split()[0] for x in MANIFEST.split(", ")]).write.parquet(f"{self.path}/{snapshot}/files")
        if g is not None:
            g.nodes.write.parquet(f"{self.path}/{snapshot}/nodes")
            g.edges.write.partitionBy("kind").parquet(f"{self.path}/{snapshot}/edges")
        row = (SCHEMA_VERSION, project, options.signature(), time.time_ns() // 1000, snapshot)
        self.spark.createDataFrame([row], META).coalesce(1).write.mode("append").json(f"{self.path}/meta")
        self._drop_old(KEEP)

    def crawl_project(self, project: str, options: CrawlOptions = CrawlOptions()) -> dict:
        """Crawl what changed and rebuild the graph; another project's store is refused before anything is written."""
        m = self.meta()
        if m and m["project"] != project:
            raise ValueError(f"this store holds {m['project']}")
        scoped = options.language or options.include
        options = project_options(self.spark, project, options)
        if not options.aliases:
            options = replace(options, aliases=read_aliases(self.spark, project))
        old = self.manifest()
        fresh = m is not None and m["signature"] == options.signature() and not options.force
        new = crawl(self.spark, project, old if fresh else None, options)
        if scoped:  # a scoped crawl leaves the other files as they are
            new = new.unionByName(old.join(new.select("path"), "path", "left_anti").withColumn("status", F.lit("unchanged")))
        new = settle(new)
        counts = {r.status: r.n for r in new.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        gone = old.join(new.select("path"), "path", "left_anti").count()
        if m and fresh and not gone and not counts.keys() - {"unchanged", "touched", "too-large"}:
            return {"removed": 0, "rebuilt": False, **counts}
        g = build_graph(parsed_files(new))
        self.write(project, new, g, options)
        kinds = {r.kind: r.n for r in g.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a kind
        return {"removed": gone, "rebuilt": True, "nodes": g.nodes.count(), "edges": sum(kinds.values()), "edges_by_kind": kinds, "failed": new.filter("error IS NOT NULL").count(), **counts}

    def _drop_old(self, keep: int) -> None:
        """Remove all snapshots but the last `keep`; readers of the last but one go on undisturbed."""
        rows = self.spark.read.schema(META).json(f"{self.path}/meta").orderBy(F.desc("crawled_at")).select("snapshot").collect()  # one row a crawl
        for r in rows[keep:]:
            fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{r.snapshot}")
            fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(fs_path, True)

    def clear(self) -> None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(fs_path, True)

    # -- keyed writes, as merges of frames

    @staticmethod
    def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        """The rows of new, and those of old whose keys new does not have."""
        return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)

    @staticmethod
    def prune_orphans(g: GraphSession, kinds: tuple[str, ...] = ("external_symbol", "unknown_symbol", "annotation", "import", "package")) -> GraphSession:
        """Without shared nodes that no edge touches any more."""
        used = g.edges.select(F.col("source").alias("id")).union(g.edges.select("target")).distinct()
        loose = g.nodes.filter(F.col("kind").isin(*kinds)).join(used, "id", "left_anti").select("id")
        return GraphSession(g.nodes.join(loose, "id", "left_anti"), g.edges)

    @staticmethod
    def remove_file(g: GraphSession, path: str) -> GraphSession:
        """Without a file's declarations and what touches them; shared symbols belong to no file and stay."""
        gone = g.nodes.filter((F.col("file_path") == path) | (F.col("id") == path)).select("id")
        edges = g.edges.join(gone, F.col("source") == gone.id, "left_anti").join(gone, F.col("target") == gone.id, "left_anti")
        return GraphSession(g.nodes.join(gone, "id", "left_anti"), edges)

    @staticmethod
    def mark_entry_point(g: GraphSession, marks: DataFrame) -> GraphSession:
        """marks (id, entry_point_kind); a node's first mark stays."""
        m = marks.groupBy("id").agg(F.min("entry_point_kind").alias("_k"))
        n = g.nodes.join(m, "id", "left").withColumn("entry_point_kind", F.coalesce("entry_point_kind", "_k")).withColumn("entry_point", F.coalesce("entry_point", F.lit(False)) | F.col("_k").isNotNull())
        return GraphSession(n.drop("_k"), g.edges)
