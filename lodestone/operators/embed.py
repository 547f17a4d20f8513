"""Vectors of texts: by a model that each Python worker loads once, or by a stand-in that counts letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that the stand-in counts.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters(text: Column) -> Column:
    """A deterministic stand-in for a model: how often a text has each letter, in any case, as a unit vector; null for a text without any."""
    return F.arrow_udf(_counted, "array<float>")(F.lower(text))


def _counted(text: pa.Array) -> pa.Array:
    """Unit vectors of lower-case texts. A byte of a letter is that letter in UTF-8, so a batch's bytes are counted at once."""
    flat = text.cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    letter = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] - np.uint8(ord(LETTERS[0]))
    row, known = np.repeat(np.arange(len(flat)), np.diff(ends)), letter < len(LETTERS)
    counts = np.bincount(row[known] * len(LETTERS) + letter[known], minlength=len(flat) * len(LETTERS)).reshape(len(flat), len(LETTERS)).astype(float)
    size = np.sqrt((counts**2).sum(axis=1))
    some = size > 0
    vectors = (counts[some] / size[some, None]).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * len(LETTERS)))), pa.int32()), pa.array(vectors.ravel()), mask=pa.array(~some))


def by_model(load: Callable[[], Callable[[list[str]], list]], text: Column, prefix: str = "", batch: int = 64) -> Column:
    """Vectors by a model: load() is called once in each Python worker's task stream and returns a function of some texts. Texts are handed over
    with the prefix (a question's or a document's), by length, `batch` at a time, so that a batch is about as long as each of its texts."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out: list = [None] * len(texts)
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                for i, v in zip(some, model([prefix + texts[i] for i in some]), strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, index=part.index)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)
