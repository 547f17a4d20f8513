"""A stored index of vectors by cells: one folder a cell, so that a question's cells are all that is read; the model lies beside it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import cells


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, vectors: DataFrame, key: str = "vec_id", column: str = "embedding", n_cells: int | None = None) -> cells.Model:
        """Fits a model, unless n_cells is 0, in which case the stored one is kept, and writes every vector into its cell."""
        model = self.model() if n_cells == 0 else cells.fit(vectors, key, column, n_cells)
        rows = [(0, model.centres.ravel().tolist(), model.centres.shape[0], model.probes), (1, model.steps.tolist(), 0, 0)]
        self.spark.createDataFrame(rows, "part int, numbers array<double>, cells int, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/model")
        made = cells.build(vectors, model, key, column).repartition("cell", "piece")
        made.write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/cells")
        return model

    def model(self) -> cells.Model:
        rows = {r.part: r for r in self.spark.read.parquet(f"{self.root}/model").collect()}  # two rows
        return cells.Model(np.array(rows[0].numbers).reshape(rows[0].cells, -1), np.array(rows[1].numbers), rows[0].probes)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/cells")

    def topk(self, questions: DataFrame, k: int, by: str = "item_id", key: str = "vec_id") -> DataFrame:
        return cells.topk(self.rows(), self.model(), questions, k, by, key)

    def share(self) -> float:
        """The share of cells that a question reads."""
        model = self.model()
        return model.probes / len(model.centres)
