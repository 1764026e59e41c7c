"""Watching a source tree by Structured Streaming: each micro-batch of new files runs the incremental crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandline.sources.crawl import CrawlOptions
from strandline.sources.store import Store

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, options: CrawlOptions = CrawlOptions(), once: bool = False) -> StreamingQuery:
    """Start watching; files that the stream reports make the store crawl what changed since its manifest.

    The stream only says that something new is there: the manifest decides what is parsed, so that a batch that is
    run again after a failure changes nothing more.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).load(root).select("path")

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.crawl_project(root, options)

    writer = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
