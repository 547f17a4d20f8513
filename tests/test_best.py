"""The best rows that a task holds, and how often a corpus is read for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import best, lexical


@pytest.mark.parametrize(("most", "kind"), [(2**19, int), (4000, int), (200, int), (4000, str)])
def test_a_task_passes_on_the_best_of_all_its_rows(most, kind):
    rng = np.random.default_rng(3)
    held, n, k, want, passed = best.Best(7, 4, most), 7, 4, {}, []
    for at in range(0, 6000, 200):
        scores, present, keys = rng.integers(0, 60, (200, n)).astype(float), rng.random((200, n)) < 0.7, np.array([kind((i * 37) % 6011) for i in range(at, at + 200)])
        for value in (None, "a", "b"):
            g = np.flatnonzero(np.arange(200) % 3 == (None, "a", "b").index(value))
            row, question = best.pick(scores[g], present[g] & (scores[g] >= held.bound(value, 0, n)), keys[g], k)
            held.add(value, question, keys[g[row]], scores[g[row], question])
            for q in range(n):
                want.setdefault((value, q), []).extend((-scores[i, q], keys[i]) for i in g if present[i, q])
        passed += held.passed()
    passed += held.passed(end=True)
    got, rows = {}, sum(len(p[1]) for p in passed)
    for values, value, question, key, score in passed:
        for v, q, x, s in zip(value.tolist(), question.tolist(), key, score.tolist(), strict=True):
            got.setdefault((values[v], q), []).append((-s, x))
    assert {p: sorted(x)[:k] for p, x in got.items()} == {p: sorted(x)[:k] for p, x in want.items()}
    if most > 1000:
        assert rows == 3 * n * k  # whatever the number of rows; each block of 200 had as many


def test_a_corpus_is_told_into_tokens_once_and_tasks_pass_on_k_rows(spark):
    texts = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        texts.add(1)
        return text

    words = ["red", "fox", "sky", "sea", "oak"]
    n = F.col("id")
    docs = spark.range(0, 9000, 1, 3).select(n.alias("doc_id"), read(F.concat_ws(" ", F.get(F.array(*map(F.lit, words)), (n % 5).cast("int")), F.concat(F.lit("w"), n.cast("string")))).alias("text"), (n % 2).alias("g"))
    asked = spark.createDataFrame([(i, f"{words[i % 5]} " + " ".join(f"none{i}x{j}" for j in range(60))) for i in range(120)], "item_id long, text string")  # more terms than a block had
    found = lexical.topk(docs, asked, 3, within="g")
    assert found.count() == 120 * 3 * 2 * 3
    assert texts.value == 9000
    assert sorted(r["doc_id"] for r in lexical.ranked(found.where("item_id = 1"), 3, ["item_id", "g"]).collect()) == [1, 6, 11, 16, 21, 26]
