"""The snapshot delta as a stream: pages come as they change, and each batch is merged into the stored nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import delta

KEYS = ["collection", "page_id"]


def merged(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The stored nodes (collection, page_id, node_id) with the batch's pages in place of their former nodes. A page whose only
    node is null has been removed."""
    touched = batch.select(*KEYS).distinct()
    return stored.join(touched, KEYS, "left_anti").unionByName(batch.where("node_id IS NOT NULL").select(*KEYS, "node_id").distinct())


def run(changes: DataFrame, path: str, checkpoint: str, schema: str = "collection string, page_id string, node_id string") -> StreamingQuery:
    """Keeps the table under `path` up to date. Versions are directories v0, v1, ...; a batch writes the next one from the last, so
    a batch that is repeated after a failure gives the same version."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(schema).parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], schema)
        merged(before, batch).write.mode("overwrite").partitionBy("collection").parquet(f"{path}/v{number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_pages(before: DataFrame, now: DataFrame) -> DataFrame:
    """Counts of pages by kind of change between two versions."""
    return delta.plan(delta.state(before), delta.state(now)).groupBy("change").count()
