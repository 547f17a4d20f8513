"""The best rows of a block of a corpus for each question of a bounded set.

A corpus is scored block by block inside tasks, and a task passes on k rows a question, so no pair of a row and a question
is ever shuffled but those. Questions are a stated set: they are read to the driver in blocks of MOST_QUESTIONS, and
each block of them is one pass over the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Questions that are compared in one pass, and corpus rows that are compared with them at a time.
MOST_QUESTIONS, ROWS = 2**14, 2048
#: Questions whose scores for such rows are held at a time.
HELD = 256
#: Best rows that a task holds, at most; where there are more, it passes them on and starts anew.
MOST_HELD = 2**19


def question_blocks(questions: DataFrame, by: str) -> Iterator[list]:
    """The rows of `questions`, each question's together, in blocks of about MOST_QUESTIONS rows."""
    block: list = []
    for row in questions.orderBy(by).toLocalIterator():
        if len(block) >= MOST_QUESTIONS and row[by] != block[-1][by]:
            yield block
            block = []
        block.append(row)
    yield block


def pick(scores: np.ndarray, present: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, question) of the k best present scores of each question, the lowest keys first among equals."""
    s = np.where(present, scores, -np.inf)
    n = len(s)
    if n > k and present.sum(axis=0).max(initial=0) > k:
        present = present & (s >= np.partition(s, n - k, axis=0)[n - k])
    row, question = np.nonzero(present)
    order = np.lexsort((keys[row], -s[row, question], question))
    row, question = row[order], question[order]
    first = np.searchsorted(question, question)
    kept = np.arange(len(row)) - first < k
    return row[kept], question[kept]


class Best:
    """The k best rows of each of n questions among those a task has seen so far, of each value of a column: (value, question, key, score). Rows that k
    others are before aren't taken in, so what a task passes on doesn't grow with its rows."""

    def __init__(self, n: int, k: int, most: int = MOST_HELD):
        self.n, self.k, self.most = n, k, most
        self._anew()

    def _anew(self) -> None:
        self.number: dict = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows, self.due = 0, self.most // 8
        self.full, self.least = np.zeros(0, np.int64), np.zeros(0)  # lists of k rows, and the score of their last

    def bound(self, value: object, first: int, n: int) -> np.ndarray:
        """The least score with which a row of a value may still be among the best, for n questions from `first` on."""
        place, out = self.number.setdefault(value, len(self.number)) * self.n + first, np.full(n, -np.inf)
        a, b = np.searchsorted(self.full, (place, place + n))
        out[self.full[a:b] - place] = self.least[a:b]
        return out

    def add(self, value: object, question: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        """Takes in rows of one value, as places of questions, keys and scores."""
        at = question + self.number.setdefault(value, len(self.number)) * self.n
        if len(self.full):
            i = np.minimum(np.searchsorted(self.full, at), len(self.full) - 1)
            some = (self.full[i] != at) | ~(score < self.least[i])
            at, key, score = at[some], key[some], score[some]
        if len(at):
            self.parts.append((at, key, score))
            self.rows += len(at)

    def _cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, key, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((key, -score, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept, last = order[rank < self.k], order[rank == self.k - 1]
        self.full, self.least = at[rank == self.k - 1], score[last]
        at, key, score = at[rank < self.k], key[kept], score[kept]
        self.parts, self.rows, self.due = [(at, key, score)], len(at), 2 * len(at) + self.most // 8
        return at, key, score

    def passed(self, end: bool = False) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
        """What is to be passed on now, if anything, as values, and numbers of values, questions, keys and scores of rows; all that is held at the end."""
        if self.parts and (end or self.rows > self.due):
            at, key, score = self._cut()
            if end or self.rows > self.most:
                value, question = np.divmod(at, self.n)
                names = list(self.number)
                self._anew()
                yield names, value, question, key, score


def nearest(matrix: np.ndarray, asked: np.ndarray, keys: np.ndarray, parts: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (row, question) and scores of the k best rows of a matrix for each row of `asked` by scalar product, in each of `parts`, which are lists of
    rows. HELD questions are compared at a time, so memory doesn't grow with their number."""
    for at in range(0, len(asked), HELD):
        scores = np.round(matrix @ asked[at : at + HELD].T, 6)
        for g in parts:
            own = scores[g]
            row, question = pick(own, np.ones(own.shape, bool), keys[g], k)
            yield g[row], question + at, own[row, question]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def groups(batch: pa.RecordBatch, within: str | None) -> Iterator[tuple[object, np.ndarray]]:
    """The values of a column with their rows; all rows without one."""
    if within is None:
        yield None, np.arange(batch.num_rows)
    else:
        own = batch.column(within).dictionary_encode(null_encoding="encode")
        code = np.asarray(own.indices)
        for i, value in enumerate(own.dictionary.to_pylist()):
            yield value, np.flatnonzero(code == i)


def passed_on(best: Best, names: list, schema: pa.Schema, end: bool = False) -> Iterator[pa.RecordBatch]:
    """What `best` passes on, as batches of a schema of question, key, the value if there is one, and score."""
    for values, value, question, key, score in best.passed(end):
        columns = [pa.array(names, schema.field(0).type).take(pa.array(question)), pa.array(key, schema.field(1).type)]
        if len(schema) > 3:
            columns.append(pa.array(values, schema.field(2).type).take(pa.array(value)))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], schema=schema)
