"""Exact nearest vectors for a set of questions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import cycle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators.best import Best, groups, nearest, passed_on, question_blocks, slices
from lodestone.operators.lexical import ranked
from lodestone.sources import shared


def topk(vectors: DataFrame, questions: DataFrame, k: int, by: str = "item_id", key: str = "vec_id", within: str | None = None) -> DataFrame:
    """(by, key, score), and `within` if given: at least the k best of all vectors (key, embedding) for each stated question (by,
    vector), of each value of `within` if given, and about k for each task; lexical.ranked() takes the k best
    of these. The score is the scalar product, which is the
    cosine of unit vectors. Null vectors are passed over; all vectors have one length."""
    by_type, key_type = (df.schema[c].dataType for df, c in ((questions, by), (vectors, key)))
    fields = [(by, by_type), (key, key_type), *((c, vectors.schema[c].dataType) for c in [within] if c)]
    schema = pa.schema([*((n, to_arrow_type(t)) for n, t in fields), ("score", pa.float64())])
    ddl = ", ".join(f"{n} {t.simpleString()}" for n, t in fields) + ", score double"
    names_in = [n for n, _ in fields[1:]]

    def part(block: list) -> DataFrame:
        names = [r[by] for r in block]
        asked = np.array([r["vector"] for r in block], float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(names), k)
            for batch in batches:
                for some in slices(batch):
                    own, keys = some.column("embedding"), np.asarray(some.column(key))
                    values, parts = zip(*groups(some, within), strict=True)
                    matrix = np.asarray(own.flatten(), float).reshape(len(own), -1)
                    for value, (row, question, score) in zip(cycle(values), nearest(matrix, asked, keys, list(parts), k), strict=False):
                        best.add(value, question, keys[row], score)
                    yield from passed_on(best, names, schema)
            yield from passed_on(best, names, schema, end=True)

        return vectors.select(*names_in, "embedding").where("embedding IS NOT NULL").mapInArrow(run, ddl)

    blocks = list(question_blocks(questions.select(by, "vector").where("vector IS NOT NULL"), by))
    return reduce(DataFrame.unionByName, [part(b) for b in blocks if b] or [part([])])


def topk_of_equal(vectors: DataFrame, questions: DataFrame, k: int, by: str = "item_id", key: str = "vec_id", within: str | None = None) -> DataFrame:
    """The k best as topk() and ranked() give them, without rank, where many vectors are equal, as those of copies and of short texts are: of equal
    vectors only those with the k lowest keys can be among the k best, and equal questions have one list."""
    places = [within] * bool(within)
    first = W.partitionBy(*places, "_bytes").orderBy(key)
    some = _first_of_equal(vectors.select(key, *places, "embedding").where("embedding IS NOT NULL"), k, key, places)
    some = some.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    some = shared.keep(some.drop("_r", "_bytes"), "alike")
    asked = questions.select(by, "vector").where("vector IS NOT NULL")
    distinct = shared.keep(asked.groupBy("vector").agg(F.min(by).alias("_one")), "asked")
    found = topk(some, distinct, k, "_one", key, within)
    found = shared.keep(ranked(found, k, ["_one", *places], key).drop("rank"), "lists")
    return asked.join(distinct, "vector").join(found, "_one").select(by, key, *places, "score")


def _first_of_equal(vectors: DataFrame, k: int, key: str, places: list[str]) -> DataFrame:
    """The rows with the k lowest keys of each vector and place in each batch, with the vector's bytes: Spark would tell equal arrays of numbers apart
    number by number in each comparison of a sort."""
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("embedding")
            width = np.asarray(own.value_lengths(), np.int64)
            flat = np.asarray(own.flatten()) + 0  # -0 is 0
            ends = flat.itemsize * np.concatenate(([0], np.cumsum(width)))
            told = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
            code = pa.table({c: batch.column(c).dictionary_encode(null_encoding="encode").indices for c in places} | {"_v": told.dictionary_encode().indices, "_k": batch.column(key)})
            order = np.asarray(pc.sort_indices(code, [(c, "ascending") for c in code.column_names]))
            of = [np.asarray(code.column(c))[order] for c in [*places, "_v"]]
            new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in of], axis=0))) if len(order) else np.zeros(0, bool)
            at = np.arange(len(order))
            kept = np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < k])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, told.take(pa.array(kept))], names=[*names, "_bytes"])

    return vectors.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema) + ", _bytes binary")
