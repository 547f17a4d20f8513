"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts' bytes in one Arrow batch handled at a time, about; a single longer text is still handled whole.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about BATCH_BYTES, so that memory doesn't follow the row count."""
    sizes, start, total = pa.compute.binary_length(batch.column(column)).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        total += n or 0
        if total >= BATCH_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, column: str, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow over bounded runs of rows. `function` may return None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                if (out := function(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)
