"""Approximate nearest vectors by cells: centres of a sample, codes of what vectors lack of their centre, and exact scores at the end.

The model (centres, scales of codes, number of probes) is fitted by k-means on a bounded sample, SAMPLE vectors by a hash of their key; every
vector is indexed. A vector belongs to its nearest centre's cell and is stored with one byte a dimension beside the vector itself. A question
reads the codes of its best cells only, keeps the best by them, and has exact scores for those alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors that the model is fitted on, at most; rounds of k-means; vectors of a cell's piece, about; candidates for each result.
SAMPLE, ROUNDS, PIECE, SPARE = 20_000, 12, 1 << 16, 4
#: The share of the sample's true neighbours that the probed cells must hold, and how many neighbours and questions that is measured with.
WANTED, NEAREST, TRIED = 0.97, 10, 500


@dataclass
class Model:
    """Centres of cells, the step of a code in each dimension, and how many cells a question reads."""

    centres: np.ndarray
    steps: np.ndarray
    probes: int

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each vector."""
        far = (self.centres**2).sum(axis=1)
        return np.concatenate([np.argmin(far - 2 * x[a : a + 4096] @ self.centres.T, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def code(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.clip(np.round((x - self.centres[cell]) / self.steps), -127, 127).astype(np.int8)

    def best_cells(self, questions: np.ndarray) -> np.ndarray:
        """The cells whose centres have the largest products with each question, the best first."""
        return np.argsort(-(questions @ self.centres.T), axis=1, kind="stable")[:, : self.probes]


def fit(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> Model:
    """A model of the vectors. Without a number of cells there are as many as the root of the vectors' number, and at least eight vectors of the
    sample for each. The sample's own neighbours decide how many cells are probed, so that WANTED of them are in those."""
    some = vectors.where(F.col(column).isNotNull()).select(column, F.xxhash64(key).alias("_h"))
    n = some.count()
    rows = some.orderBy("_h").limit(sample).collect()  # `sample` vectors at most
    if not rows:
        raise ValueError("there is no vector to fit cells on")
    x = np.array([r[0] for r in rows], float)
    m = max(1, min(cells or int(n**0.5), len(x) // 8))
    rng = np.random.default_rng(0)
    centres = x[np.sort(rng.choice(len(x), m, replace=False))]
    model = Model(centres, np.ones(x.shape[1]), m)
    for _ in range(ROUNDS):
        cell = model.cell(x)
        size = np.bincount(cell, minlength=m)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        model.centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], model.centres)
    cell = model.cell(x)
    model.steps = np.maximum(np.abs(x - model.centres[cell]).max(axis=0), 1e-9) / 100  # the sample doesn't hold the largest ones
    tried = x[rng.choice(len(x), min(TRIED, len(x)), replace=False)]
    near = np.argsort(-(tried @ x.T), axis=1)[:, :NEAREST]
    order = np.argsort(-(tried @ model.centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(m), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    model.probes = int(needed[int(np.ceil(WANTED * len(needed))) - 1]) + 1
    return model


def build(vectors: DataFrame, model: Model, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (cell, piece, key, code, embedding) of all vectors that aren't null. Large cells have several pieces."""
    kind = vectors.schema[key].dataType
    schema = pa.schema([("cell", pa.int32()), ("key", to_arrow_type(kind)), ("code", pa.binary()), ("embedding", pa.list_(pa.float32()))])
    base = vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).cast("array<float>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("embedding").flatten(), float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(model.steps)))
            cell = model.cell(x)
            codes = [c.tobytes() for c in model.code(x, cell)]
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("key"), pa.array(codes, pa.binary()), batch.column("embedding").cast(pa.list_(pa.float32()))], schema=schema)

    rows = base.mapInArrow(run, f"cell int, key {kind.simpleString()}, code binary, embedding array<float>")
    pieces = max(1, -(-base.count() // PIECE))  # a cell that holds everything has pieces of PIECE vectors
    return rows.withColumn("piece", F.pmod(F.xxhash64("key", "embedding"), F.lit(pieces)).cast("int"))


def _asked(questions: DataFrame, by: str) -> DataFrame:
    """(by, vector), each question once. Single-precision vectors stay so: they are dealt to each cell that is read, and sorted there."""
    kind = "array<float>" if questions.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
    return questions.where(F.col("vector").isNotNull()).select(F.col(by).alias("by"), F.col("vector").cast(kind).alias("vector"))


def probes(questions: DataFrame, model: Model, by: str) -> DataFrame:
    """(by, vector, cell): the cells that each question reads."""
    asked = _asked(questions, by)
    kind, numbers = asked.schema["by"].dataType, asked.schema["vector"].dataType
    schema = pa.schema([("by", to_arrow_type(kind)), ("vector", to_arrow_type(numbers)), ("cell", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("vector").flatten(), float).reshape(batch.num_rows, -1)
                cells = model.best_cells(x)
                at = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("by").take(at), batch.column("vector").take(at), pa.array(cells.ravel().astype(np.int32))], schema=schema)

    return asked.mapInArrow(run, f"by {kind.simpleString()}, vector {numbers.simpleString()}, cell int")


def topk(index: DataFrame, model: Model, questions: DataFrame, k: int, by: str = "item_id", key: str = "vec_id") -> DataFrame:
    """(by, key, score): the k best vectors that were found for each question (by, vector), by the scalar product and then the key; all of them are
    exact scores, but a vector in a cell that wasn't probed, or with a poor code, may be missed."""
    asked = probes(questions, model, by)
    cells = [r[0] for r in asked.select("cell").distinct().collect()]  # no more than there are cells
    some = index.where(F.col("cell").isin(cells)) if cells else index.limit(0)
    spare = SPARE * k
    by_type, key_type = asked.schema["by"].dataType, index.schema["key"].dataType
    schema = pa.schema([("by", to_arrow_type(by_type)), ("cell", pa.int32()), ("key", to_arrow_type(key_type)), ("about", pa.float64())])

    def guess(codes: pa.Table, wanted: pa.Table) -> pa.Table:
        """The best of a cell's piece for each question, by codes."""
        if not codes.num_rows or not wanted.num_rows:
            return schema.empty_table()
        cell = codes.column("cell")[0].as_py()
        raw = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.int8).reshape(codes.num_rows, -1)
        x = model.centres[cell] + raw * model.steps
        keys = codes.column("key").combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        who, out_by, out_at, out_about = wanted.column("by").to_pylist(), [], [], []
        for a in range(0, len(who), 256):
            q = np.array(wanted.column("vector").slice(a, 256).to_pylist(), float)
            about = x @ q.T
            n = min(spare, len(x))
            best = np.argpartition(-about, n - 1, axis=0)[:n]
            out_by += np.repeat(np.arange(a, a + q.shape[0]), n).tolist()
            out_at.append(best.T.ravel())
            out_about.append(np.take_along_axis(about, best, axis=0).T.ravel())
        at = np.concatenate(out_at)
        return pa.Table.from_arrays([pa.array([who[i] for i in out_by], schema.field(0).type), pa.array(np.full(len(at), cell, np.int32)), keys.take(pa.array(at)), pa.array(np.concatenate(out_about))], schema=schema)

    pieces = some.select("cell", "piece").distinct()
    dealt = asked.join(pieces, "cell").select(*(F.col(c).alias(c) for c in ("cell", "piece", "by", "vector")))
    ddl = f"by {by_type.simpleString()}, cell int, key {key_type.simpleString()}, about double"
    near = some.select("cell", "piece", "key", "code").groupBy("cell", "piece").cogroup(dealt.groupBy("cell", "piece")).applyInArrow(guess, ddl)
    near = near.withColumn("_r", F.row_number().over(W.partitionBy("by").orderBy(F.col("about").desc(), "key"))).where(F.col("_r") <= spare)
    exact = near.select("by", "cell", "key").join(some.select("cell", "key", "embedding"), ["cell", "key"]).join(_asked(questions, by), "by")
    product = F.aggregate(F.zip_with("embedding", "vector", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    best = exact.select(F.col("by").alias(by), F.col("key").alias(key), F.round(product, 6).alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.col("score").desc(), key))).where(F.col("rank") <= k)
