"""Whitening of vectors by singular value decompositions of parts, merged as a tree.

A part is summed up by its number of rows, its exact sums and the singular values and right vectors of its rows less their
mean, all of them. Two parts' summaries stand below each other, with one more row for the distance of their means, and are decomposed
again: what results is the summary of both together, and nothing is left out. Tasks sum up batches of rows one after the other;
tasks' summaries, of the vectors' width squared each, are merged FAN at a time until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm import scratch

#: Rows that are decomposed at a time, summaries that one task merges, and components.
BATCH, FAN, COMPONENTS = 4096, 16, 8
#: Entries must be whole numbers below this, so that sums over any table are exact.
LARGEST = 1 << 40
#: The quantisation of the query: fixed values of its contract.
SCALE, OFFSET = 1024, 100000
_SUMMARY = "part long, width int, n long, sums array<long>, factor binary"


@dataclass
class Summary:
    """Of some rows: their number, the sum of each dimension, and singular values times right vectors of the rows less their mean."""

    n: int
    sums: np.ndarray
    factor: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Summary:
        sums = rows.sum(axis=0)
        return cls(len(rows), sums, _decomposed(rows - sums / len(rows)))

    def merged(self, other: Summary) -> Summary:
        apart = self.sums / self.n - other.sums / other.n
        correction = np.sqrt(self.n / (self.n + other.n) * other.n) * apart
        return Summary(self.n + other.n, self.sums + other.sums, _decomposed(np.concatenate((self.factor, other.factor, correction[None]))))


def _decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors: as many rows as the rank may have, and the same products of columns."""
    if not rows.size:
        return rows[:0]
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _rows(summaries: list[tuple[int, Summary]], part: int) -> pa.RecordBatch:
    made = [{"part": part, "width": w, "n": s.n, "sums": s.sums.tolist(), "factor": s.factor.tobytes()} for w, s in summaries]
    return pa.RecordBatch.from_pylist(made, pa.schema([("part", pa.int64()), ("width", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("factor", pa.binary())]))


def _summary(row: dict) -> Summary:
    return Summary(row["n"], np.array(row["sums"], np.int64), np.frombuffer(row["factor"]).reshape(-1, row["width"]))


def clean(df: DataFrame, key: str, vector: str, entry=lambda c: c) -> DataFrame:
    """Rows (key, x) of the vectors without null, infinite and undefined entries, and of more than none; `entry` makes a whole number of each."""
    c = F.col(vector)
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    small = lambda e: F.when(F.abs(e) < LARGEST, e.cast("long")).otherwise(F.raise_error(F.lit("an entry is too large for exact sums")).cast("long"))
    return df.where(fine).select(F.col(key).alias("key"), F.transform(c, lambda e: small(entry(e.cast("double")))).alias("x"))


def fit(vectors: DataFrame, fan: int = FAN, batch: int = BATCH) -> Summary | None:
    """The summary of all rows x (arrays of whole numbers); None where there are none. Vectors of the commonest width count, of the
    wider one where two are as common; those of others are told apart, never mixed up."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[int, Summary] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                column = whole.column("x").slice(at, batch)
                widths = np.asarray(pa.compute.list_value_length(column))
                for w in np.unique(widths).tolist():
                    own = Summary.of(_matrix(column.filter(pa.array(widths == w)), w))
                    so_far[w] = so_far[w].merged(own) if w in so_far else own
        if so_far:
            yield _rows(list(so_far.items()), TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        out = _summary(rows[0])
        for row in rows[1:]:
            out = out.merged(_summary(row))
        return pa.Table.from_batches([_rows([(rows[0]["width"], out)], rows[0]["part"] // fan)])

    level = scratch.keep(vectors.select("x").mapInArrow(summed, _SUMMARY), "summaries")
    widest = level.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if widest is None:
        return None
    level = level.where(F.col("width") == widest.width)
    while level.count() > 1:
        level = scratch.keep(level.groupBy(F.floor(F.col("part") / fan)).applyInArrow(merge, _SUMMARY), "summaries")
    return _summary(level.first().asDict())


@dataclass
class Whitening:
    """Sums and unit eigenvectors of the covariance of n rows, by falling eigenvalue. Eigenvalues that rounding can't tell from zero
    are left out, as nothing can be scaled by them; so are those beyond the number of components asked for."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @classmethod
    def of(cls, summary: Summary, components: int = COMPONENTS) -> Whitening:
        _, s, v = np.linalg.svd(summary.factor, full_matrices=False) if summary.factor.size else (0, np.zeros(0), np.zeros((0, len(summary.sums))))
        kept = np.flatnonzero(s > s.max(initial=0) * len(summary.sums) * 1e-14)[:components]
        e = s**2 / summary.n
        return cls(summary.n, summary.sums, e[kept], v[kept], float(e.sum()))

    def centred(self, x: np.ndarray, deviation: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """The rows less the mean, and, if asked for, the sum over dimensions of the squares of n times that, exactly, as whole numbers."""
        if not deviation:
            return x - self.sums / self.n, None
        far = x * self.n - self.sums  # n * LARGEST fits for any n below 2**22; beyond, entries that large don't
        reach = int(np.abs(far).max(initial=0))
        if int(np.abs(x).max(initial=0)) * self.n >= 1 << 62 or reach * reach * x.shape[1] >= 1 << 63:
            exact = [[int(v) * self.n - int(s) for v, s in zip(row, self.sums.tolist(), strict=True)] for row in x.tolist()]
            return np.array(exact, float) / self.n, np.array([sum(v * v for v in row) for row in exact], object)
        return far / self.n, (far * far).sum(axis=1)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors.T / np.sqrt(self.values)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k, width = len(model.values), len(model.sums)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = model.whitened(model.centred(_matrix(batch.column("x"), width), False)[0])
            total += z.sum(axis=0)
            product += z.T @ z
        flat = np.concatenate((total, product.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    rows = vectors.where(F.size("x") == width).select("x").mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # k * (k + 1) numbers
    flat = np.array([v for _, v in sorted((r.i, r.v) for r in rows)])
    mean, second = flat[:k] / model.n, flat[k:].reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, components: int = COMPONENTS, deviation: bool = True) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error) of all vectors (key, x), for components 1 to
    `components` by falling eigenvalue e of the covariance, or as many as aren't zero: the row less the mean, projected on the
    component, over the root of e. deviation is the sum over dimensions of (n * x - sum of x) squared; it is an error where that has
    more than 64 bits, as it has for some million rows of any spread, and null if it isn't asked for. Equal vectors have equal rows, null and repeated keys stay as they are; an empty table gives none, nor do
    vectors of another width than the commonest."""
    spark, kind = vectors.sparkSession, vectors.schema["key"].dataType
    schema = f"key {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    summary = fit(vectors)
    model = summary and Whitening.of(summary, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    k, width, off = len(model.values), len(model.sums), identity_error(vectors, model)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                centred, far = model.centred(_matrix(batch.column("x"), width), deviation)
                m = batch.num_rows
                which = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    batch.column("key").take(which), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array([None] * m if far is None else far.tolist(), pa.int64()).take(which),
                    pa.array(model.whitened(centred).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, off)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([("key", to_arrow_type(kind)), *((c, columns[i].type) for i, c in enumerate(["component", "n", "deviation", "whitened", "explained", "identity_error"], 1))]))

    return vectors.where(F.size("x") == width).mapInArrow(run, schema)


def _quantised(c: Column) -> Column:
    return F.floor(c * SCALE) + OFFSET


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", _quantised)).withColumnRenamed("key", "vec_id")
