"""Second scoring of hits by a model that sees question and text together."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lexical import coverage


@dataclass(frozen=True)
class Model:
    """A model: load() is called once in each Python worker's task stream and returns a function of some questions and as many texts. Pairs are
    handed over by length, `batch` at a time, so that padding a batch to its longest pair costs little. Nulls are empty texts."""

    load: Callable[[], Callable[[list[str], list[str]], Sequence[float]]]
    batch: int = 64

    def score(self, question: Column, text: Column) -> Column:
        load, batch = self.load, self.batch

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for q, t in parts:
                asked, texts = q.fillna("").tolist(), t.fillna("").tolist()
                order = sorted(range(len(texts)), key=lambda i: len(asked[i]) + len(texts[i]))
                out = [0.0] * len(texts)
                for a in range(0, len(order), batch):
                    some = order[a : a + batch]
                    for i, s in zip(some, model([asked[i] for i in some], [texts[i] for i in some]), strict=True):
                        out[i] = float(s)
                yield pd.Series(out, index=t.index, dtype="float64")

        run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")(question, text)


#: A model, or a function of the questions and texts of a batch that needs no loading.
Scorer = Model | Callable[[pd.Series, pd.Series], pd.Series]


def rerank(hits: DataFrame, scorer: Scorer | None = None, question: str = "question", text: str = "text") -> DataFrame:
    """The hits with new scores. Without a scorer the token coverage stands in for a model, as plain expressions."""
    if scorer is None:
        return coverage(hits, question, text)
    if isinstance(scorer, Model):
        return hits.withColumn("score", F.round(scorer.score(F.col(question), F.col(text)), 6))

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return scorer(q, t)

    return hits.withColumn("score", F.round(score(question, text), 6))
