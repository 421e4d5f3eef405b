"""Index requests as a stream: JSON files with repo_url and path land in a folder, each micro-batch is one index job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import embedding
from ..plans import service
from ..plans.store import Store

SCHEMA = "repo_url string, path string"
#: Requests that one micro-batch takes; what is left waits for the next.
FILES_PER_BATCH = 100


def watch(spark: SparkSession, store: Store, folder: str, checkpoint: str, make: Callable[[], embedding.Embedder] = embedding.HashingEmbedder, available_now: bool = False) -> StreamingQuery:
    """Start it. A batch that is run again after a failure indexes again, which replaces what it wrote."""

    def index(batch: DataFrame, _: int) -> None:
        trees = {r["repo_url"]: r["path"] for r in batch.dropna().dropDuplicates(["repo_url"]).collect()}  # requests, not data
        if trees:
            service.index_trees(spark, store, trees, make)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", FILES_PER_BATCH).json(folder)
    writer = stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
