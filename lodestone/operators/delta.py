"""Snapshot deltas: what changed between two states of a set of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state(nodes: DataFrame) -> DataFrame:
    """(collection, page_id, node_ids): each page's node ids in order."""
    return nodes.groupBy("collection", "page_id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))


def plan(before: DataFrame, now: DataFrame, full: bool = False) -> DataFrame:
    """(collection, page_id, change, old_ids, new_ids) of all pages of either state: added, changed, unchanged or removed. In
    full mode the state before is ignored, and all pages are added."""
    keys = ["collection", "page_id"]
    old = before.select(*keys, F.col("node_ids").alias("old_ids"))
    if full:
        old = old.limit(0)
    both = old.join(now.select(*keys, F.col("node_ids").alias("new_ids")), keys, "full_outer")
    change = F.when(F.col("old_ids").isNull(), "added").when(F.col("new_ids").isNull(), "removed").when(F.col("old_ids") == F.col("new_ids"), "unchanged").otherwise("changed")
    return both.withColumn("change", change)


def apply(stored: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored nodes after the delta: nodes of changed and removed pages go, all nodes of added and changed pages come."""
    keys = ["collection", "page_id"]
    gone = changes.where(F.col("change").isin("changed", "removed")).select(*keys)
    come = changes.where(F.col("change").isin("changed", "added")).select(*keys)
    return stored.join(gone, keys, "left_anti").unionByName(fresh.join(come, keys, "left_semi"))
