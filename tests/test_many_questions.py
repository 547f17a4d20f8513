"""Sets of questions that grow with the corpus."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import best, dense, lexical
from lodestone.plans import linked


@pytest.mark.parametrize("rare", [0, 2, 1000])
def test_questions_joined_by_terms_give_what_a_scan_gives(spark, monkeypatch, rare):
    n = F.col("id")
    words = [F.concat(F.lit("file"), (n % 4).cast("string")), F.concat(F.lit("item"), n.cast("string")), F.when(n % 3 == 0, "urgent urgent"), F.when(n % 5 == 0, "widget"), F.when(n % 7 > 0, "of other words")]
    docs = spark.range(120).select((200 - n).alias("doc_id"), F.concat(F.lit("r"), (n % 2).cast("string")).alias("repo"), F.when(n != 50, F.concat_ws(" ", *words)).alias("text"))
    asked = spark.range(90).select(n.alias("item_id"), F.concat_ws(" ", F.concat(F.lit("File"), (n % 4).cast("string")), F.concat(F.lit("item"), (n * 2).cast("string")), F.lit("urgent widget nowhere")).alias("text"))
    best = lambda pairs=None: {tuple(r) for r in lexical.ranked(lexical.topk(docs, asked, 5, within="repo", pairs=pairs), 5, ["item_id", "repo"]).select("item_id", "repo", "doc_id", "score", "rank").collect()}
    pairs = asked.where("item_id % 3 > 0").select("item_id", F.concat(F.lit("r"), (F.col("item_id") % 2).cast("string")).alias("repo"))
    whole, some = best(), best(pairs)
    assert some == {r for r in whole if r[0] % 3 and r[1] == f"r{r[0] % 2}"}
    sizes = []
    blocks = lexical.question_blocks
    monkeypatch.setattr(lexical, "question_blocks", lambda df, by: (sizes.append(len(b)) or b for b in blocks(df, by)))
    monkeypatch.setattr(lexical, "SCANNED", 0)
    monkeypatch.setattr(lexical, "RARE", rare)
    assert best() == whole and best(pairs) == some
    if rare == 2:  # questions meet the corpus by their distinct common terms: file, urgent and widget, of four files
        assert max(sizes) == 12


def test_equal_vectors_and_equal_questions_are_compared_once(spark, monkeypatch):
    n = F.col("id")
    vectors = spark.range(400).select((500 - n).alias("vec_id"), (n % 2).alias("part"), F.when(n != 7, F.array((n % 3).cast("float"), (n % 5).cast("float"))).alias("embedding"))
    asked = spark.range(60).select(n.alias("item_id"), F.when(n != 9, F.array((n % 4).cast("float"), F.lit(1.0).cast("float"))).alias("vector"))
    rows = lambda df: {tuple(r) for r in lexical.ranked(df, 6, ["item_id", "part"], "vec_id").select("item_id", "part", "vec_id", "score", "rank").collect()}
    whole, sizes, blocks = rows(dense.topk(vectors, asked, 6, within="part")), [], dense.question_blocks
    monkeypatch.setattr(dense, "question_blocks", lambda df, by: (sizes.append(len(b)) or b for b in blocks(df, by)))
    assert rows(dense.topk_of_equal(vectors, asked, 6, within="part")) == whole
    assert max(sizes) == 4


def test_scores_of_many_questions_are_held_in_part():
    vectors, asked, keys = np.random.default_rng(1).integers(-3, 4, (best.ROWS, 8)).astype(float), np.random.default_rng(2).integers(-3, 4, (best.MOST_QUESTIONS, 8)).astype(float), np.arange(best.ROWS)[::-1]
    parts = [np.flatnonzero(keys % 2 == i) for i in (0, 1)]
    tracemalloc.start()
    got = {(r, q, s) for row, question, score in best.nearest(vectors, asked, keys, parts, 3) for r, q, s in zip(row.tolist(), question.tolist(), score.tolist()) if q < 600}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * best.ROWS * best.MOST_QUESTIONS  # less than all scores once
    scores = np.round(vectors @ asked[:600].T, 6)
    for g in parts:
        row, question = best.pick(scores[g], np.ones(scores[g].shape, bool), keys[g], 3)
        assert set(zip(g[row].tolist(), question.tolist(), scores[g[row], question].tolist())) <= got
    assert len(got) == 600 * 3 * 2


def test_copies_of_a_page_fill_a_pool_once(spark):
    rows = spark.createDataFrame([("a", n, k) for n, keys in (("x", [7, 3, 5]), ("y", [9]), ("z", range(40)), ("w", [1])) for k in keys], "collection string, node_id string, key long")
    pool = spark.createDataFrame([(1, "a", n, 1.0, i + 1) for i, n in enumerate("xyzw")] + [(2, "a", n, 1.0, i + 1) for i, n in enumerate("zx")] + [(3, "a", "w", 1.0, 1)], "item_id long, collection string, node_id string, score double, rank int")
    got = sorted(tuple(r) for r in linked._with_rows(pool, rows, 6).select("item_id", "node_id", "key").collect())
    assert got == [(1, "x", 3), (1, "x", 5), (1, "x", 7), (1, "y", 9), (1, "z", 0), (1, "z", 1), *((2, "z", k) for k in range(6)), (3, "w", 1)]
