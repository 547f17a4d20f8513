"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scratch


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of some edges and the smallest end that each is connected with."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return nodes, nodes[label]
        label = least


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes of the edges (u, v), both long: the smallest node that is connected with it.

    Each task first joins the ends that its own edges connect, so a large group passes on one row for each of its
    nodes; then labels go round between tasks until none changes.
    """
    spark = edges.sparkSession

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches]
        if parts:
            nodes, root = roots(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["u", "v"])

    star = scratch.keep(edges.select("u", "v").mapInArrow(shrink, "u long, v long").distinct(), "edges")
    labels = scratch.keep(star.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "labels")
    both = star.where("u <> v").unionByName(star.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        new = scratch.keep(lower.join(jump, "c", "left").select("node", "old", F.coalesce("up", "c").alias("component")), "labels")
        moved = new.where("old <> component").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels
