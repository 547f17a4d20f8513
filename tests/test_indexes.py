"""Stored indexes against plain scans: postings with block maxima, runs that add and take out, retrieval from a store."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import Retrieval
from lodestone.functions import text as tx
from lodestone.operators import cells, dense, embed, lexical, postings
from lodestone.plans import indexed
from lodestone.sources.store import Store
from lodestone.sources.textindex import TextIndex
from lodestone.sources.vectorindex import VectorIndex

WORDS = [f"w{i}" for i in range(40)] + ["rare", "the", "naïve"]


def corpus(n, seed=1):
    rnd = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(i, " ".join(rnd.choices(WORDS, weights, k=rnd.randint(0, 60))), "a" if i % 3 else None) for i in range(n)]


def brute(rows, questions, k, part=False):
    """The k best of each part for each question."""
    out = []
    for name in sorted({p or "" for _, _, p in rows}) if part else [""]:
        docs = [(key, re.findall(r"\w{2,}", (t or "").lower())) for key, t, p in rows if not part or (p or "") == name]
        mean = sum(len(t) for _, t in docs) / len(docs)
        df = {}
        for _, t in docs:
            for w in set(t):
                df[w] = df.get(w, 0) + 1
        for q, text in questions:
            scored = []
            for key, t in docs:
                s = 0.0
                for w in sorted(set(re.findall(r"\w{2,}", text.lower()))):
                    if tf := t.count(w):
                        s += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
                if s > 0:
                    scored.append((-round(s, 6), key))
            out += [(q, name, key, -s, i + 1) for i, (s, key) in enumerate(sorted(scored)[:k])]
    return sorted(out)


QUESTIONS = [(1, "w0 w1 rare"), (2, "The w39"), (3, "nothing known"), (4, "w2 w2 w3 naïve w4 w5 w6"), (5, "")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUESTIONS, "item_id long, text string")


def ranked(found, k, part=False):
    place = found.withColumn("place", F.concat_ws("/", F.col("item_id").cast("string"), *(["part"] if part else [])))
    rows = lexical.ranked(place, k, "place", "key").collect()
    return sorted((r.item_id, r.part if part else "", r.key, r.score, r["rank"]) for r in rows)


@pytest.mark.parametrize(("shard", "questions", "listed"), [(1 << 14, 4096, 2000), (60, 2, 1)])
def test_index_is_the_plain_ranking(spark, asked, tmp_path, monkeypatch, shard, questions, listed):
    monkeypatch.setattr(postings, "QUESTIONS", questions)
    monkeypatch.setattr(postings, "LISTED", listed)
    monkeypatch.setattr(postings.build, "__defaults__", (None, None, shard))
    rows = [*corpus(500), (500, None, None), (501, "", "a")]
    index = TextIndex(spark, str(tmp_path / "i"), "key", "text", buckets=4)
    index.update(spark.createDataFrame(rows, "key long, text string, part string"))
    assert ranked(index.topk(asked, 7), 7) == brute(rows, QUESTIONS, 7)


def test_runs_are_as_a_rebuild(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(postings.build, "__defaults__", (None, None, 50))
    frame = lambda rows: spark.createDataFrame(rows, "key long, text string, part string")
    index = TextIndex(spark, str(tmp_path / "i"), "key", "text", "part", buckets=3)
    before, other = corpus(300), corpus(300, 2)
    index.update(frame(before))
    now = dict((r[0], r) for r in before)
    changed = [other[i] for i in range(0, 300, 7)]
    gone, fresh = [before[i] for i in range(0, 300, 5)], [(1000 + i, f"w{i % 9} fresh rare", "b") for i in range(40)]
    index.update(frame(changed), frame([before[r[0]] for r in changed]))
    for r in changed:
        now[r[0]] = r
    index.update(frame(fresh), frame([now.pop(r[0]) for r in gone]))
    now |= {r[0]: r for r in fresh}
    index.update(frame([now[1001]]), frame([now[1001]]))  # as it was
    rows = list(now.values())
    assert index.runs() == [1, 2, 3, 4] and index.parts() == ["", "a", "b"]
    whole = TextIndex(spark, str(tmp_path / "w"), "key", "text", "part", buckets=5)
    whole.update(frame(rows))
    assert sorted(map(tuple, index.counts().collect())) == sorted(map(tuple, whole.counts().collect()))
    assert ranked(index.topk(asked, 6), 6, True) == ranked(whole.topk(asked, 6), 6, True) == brute(rows, QUESTIONS, 6, True)
    index.update(frame(before[:20]), full=True)
    assert index.runs() == [5] and ranked(index.topk(asked, 6), 6, True) == brute(before[:20], QUESTIONS, 6, True)


def test_questions_with_the_same_common_terms_are_ranked_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings.build, "__defaults__", (None, None, 50))
    monkeypatch.setattr(postings, "RARE", 8)
    monkeypatch.setattr(postings, "QUESTIONS", 7)
    rnd, k = random.Random(5), 4
    own = lambda i, n: " ".join(f"own{rnd.randrange(n)}" for _ in range(i % 4))
    rows = [(key, f"{text} {own(key, 90)}", part) for key, text, part in corpus(400, 3)]
    before = [(key, f"{text} was {own(key, 90)}" if key % 5 == 0 else text, part) for key, text, part in rows if key % 7] + [(1000 + i, f"w0 own{i}", "a") for i in range(90)]
    questions = [(i, f"w{i % 3} w1 own{i} own{i + 1} absent{i}") for i in range(90)] + [(90, "absent"), (91, "w0 w1"), (92, "own3")]
    frame = lambda some: spark.createDataFrame(some, "key long, text string, part string")
    index = TextIndex(spark, str(tmp_path / "i"), "key", "text", "part", buckets=3)
    index.update(frame(before))
    index.update(frame([r for r in rows if r not in before]), frame([r for r in before if r not in rows]))
    found = index.topk(spark.createDataFrame(questions, "item_id long, text string"), k)
    assert ranked(found, k, True) == brute(rows, questions, k, True)
    assert found.count() <= len(questions) * 2 * (k + 2 * postings.RARE)  # and not k of each of the shards, of which there are some twenty


def test_vectors_of_letters_and_equal_vectors(spark):
    texts = ["", None, "123 é", "Aa\u212ab", "zZy", "\u0130i", "b" * 300]
    letters = {r.t: r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", embed.letters(F.col("t")).alias("v")).collect()}
    want = lambda n, size: np.float32(n / math.sqrt(size))
    assert letters[""] is None and letters[None] is None and letters["123 é"] is None
    assert (letters["Aa\u212ab"][0], letters["Aa\u212ab"][1], letters["Aa\u212ab"][10]) == (want(2, 6), want(1, 6), want(1, 6)) and letters["zZy"][25] == want(2, 5)
    assert letters["\u0130i"][8] == letters["b" * 300][1] == 1.0
    rows = [(f"k{i:03}", "a" if i % 3 else None, [[1.0, 0.0], [1.0, -0.0], [0.6, 0.8]][i % 5 % 3]) for i in range(99, -1, -1)]
    vectors = spark.createDataFrame([*rows, ("none", "a", None)], "key string, part string, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "item_id long, vector array<float>")
    got = dense.topk_of_equal(vectors, asked, 5, "item_id", "key", within="part").collect()
    plain = lexical.ranked(dense.topk(vectors, asked, 5, "item_id", "key", within="part"), 5, ["item_id", "part"], "key").collect()
    assert sorted((r.item_id, str(r.part), r.key, r.score) for r in got) == sorted((r.item_id, str(r.part), r.key, r.score) for r in plain) and len(got) == 30
    assert dense._first_of_equal(vectors.where("embedding IS NOT NULL").coalesce(1), 5, "key", ["part"]).count() == 2 * 2 * 5


def test_an_unfinished_run_does_not_count(spark, asked, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "key long, text string, part string")
    last = {"run": 1}
    index = TextIndex(spark, str(tmp_path), "key", "text", buckets=2, upto=lambda: last["run"])
    index.update(frame(corpus(30)), run=1)
    index.update(frame(corpus(9, 3)), full=True, run=2)  # the larger job died behind this
    assert index.runs() == [1] and ranked(index.topk(asked, 4), 4) == brute(corpus(30), QUESTIONS, 4)
    index.update(frame([(77, "rare", None)]), run=2)
    last["run"] = 2
    assert index.runs() == [1, 2] and ranked(index.topk(asked, 4), 4) == brute([*corpus(30), (77, "rare", None)], QUESTIONS, 4)


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(3)
    n = 1 << 14
    length = rng.integers(20, 400, n)
    length[:40] = 10
    terms = []
    for share in (0.5, 0.1, 0.002):
        docs = np.flatnonzero(rng.random(n) < share).astype("<u4")
        tfs = rng.integers(1, 4, len(docs)).astype("<u4")
        tfs[docs < 40] = 30
        block = docs // postings.BLOCK
        cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        bounds = np.stack([block[cut], cut, np.maximum.reduceat(tfs, cut), np.minimum.reduceat(length[docs], cut)]).astype("<u4")
        terms.append((postings.Term(docs.tobytes(), tfs.tobytes(), bounds.tobytes()), math.log(1 / share)))
    whole = np.zeros(n)
    for t, idf in terms:
        whole[t.docs] += idf * postings._weight(t.tfs, length[t.docs], 200.0)
    whole = np.round(whole, 6)
    for alive in (None, np.arange(n) % 3 > 0):
        counted = np.flatnonzero(whole > 0) if alive is None else np.flatnonzero((whole > 0) & alive)
        want = counted[np.lexsort((counted, -whole[counted]))][:10]
        docs, scores, read = postings.best(terms, length, 200.0, 10, alive)
        assert docs.tolist() == want.tolist() and np.allclose(scores, whole[want])
        assert read < n // postings.BLOCK / 2


def test_only_the_asked_terms_are_read(spark, asked, tmp_path):
    index = TextIndex(spark, str(tmp_path), "key", "text", buckets=16)
    index.update(spark.createDataFrame(corpus(200), "key long, text string, part string"))
    rows = postings.only(index.rows(), postings.asked_terms(asked.where("item_id = 2"), "item_id", "text").select("term"), index.bucket)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN", plan) and re.search(r"PushedFilters: \[.*term", plan)
    assert len(rows.select("bucket").distinct().collect()) <= 2 < len(index.rows().select("bucket").distinct().collect())


def test_analysis(spark):
    row = spark.createDataFrame([("The ratings of relational singing, es and nationally as",)], "t string")
    assert row.select(tx.analysed(F.col("t"), "en")).first()[0] == ["rat", "relational", "sing", "es", "national"]
    assert row.select(tx.analysed(F.col("t"))).first()[0][:2] == ["the", "ratings"]


def clustered(n, d, centres, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, d))[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("piece", [1 << 16, 100])
def test_cells_find_nearly_all_neighbours(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(cells, "PIECE", piece)
    x = clustered(2000, 16, 25)
    x[:700] = x[0]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path))
    model = index.write(df)
    assert index.rows().count() == 2000 and index.share() < 0.5
    stored = index.model()
    assert stored.probes == model.probes and np.array_equal(stored.centres, model.centres)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(700, 2000, 20)] + [(9, None)], "item_id long, vector array<float>")
    got = {(r.item_id, r.vec_id): r.score for r in index.topk(asked, 10).collect()}
    scores = x[700:2000:20].astype(float) @ x.T.astype(float)
    true = {(i, int(v)) for i, row in zip(range(700, 2000, 20), scores, strict=True) for v in np.lexsort((np.arange(2000), -np.round(row, 6)))[:10]}
    assert len(got) == len(true) and len(got.keys() & true) >= 0.9 * len(true)
    assert all(s == pytest.approx(float(x[q].astype(float) @ x[v].astype(float)), abs=1e-6) for (q, v), s in got.items())
    plan = index.rows().where(F.col("cell").isin([0]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.split("PartitionFilters")[1]


def test_recall_of_the_query(spark):
    rows = indexed.dense_recall(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.found for r in rows) >= 0.9 * sum(r.wanted for r in rows)


def chunk(page, content, collection="technical", doc_type="endpoint"):
    return (collection, page, f"{page}:{content}", content, doc_type)


CHUNKS = "collection string, page_id string, node_id string, content string, doc_type string"


def test_retrieval_from_a_store(spark, tmp_path):
    first = [chunk("p1", "alpha beta"), chunk("p2", "gamma"), chunk("f1", "alpha", "functional", "feature-hub")]
    second = [chunk("p1", "alpha delta"), chunk("p3", "delta delta"), chunk("f1", "alpha", "functional", "feature-hub")]
    store, vector = Store(spark, str(tmp_path)), embed.letters(F.col("content"))
    asked = spark.createDataFrame([(1, "delta")], "item_id long, text string").withColumn("vector", embed.letters(F.col("text")))
    store.sync(spark.createDataFrame(first, CHUNKS), embedder=vector)
    plain = {(r.collection, r.node_id): r.score for r in indexed.lists(store, asked, 5).collect()}
    assert set(plain) == {(c, n) for c, _, n, *_ in first} and store.text.parts() == []  # vectors alone, scores as they are
    store.sync(spark.createDataFrame(second, CHUNKS), embedder=vector, indexed=("technical",))
    assert store.text.parts() == ["technical"]
    store.sync(spark.createDataFrame([*second, chunk("p4", "alpha")], CHUNKS), embedder=vector, indexed=("technical",))
    found = {r.node_id: r.score for r in indexed.lists(store, asked, 5).collect()}
    assert found["f1:alpha"] == pytest.approx(plain[("functional", "f1:alpha")])  # not fused
    assert max(found, key=lambda n: found[n] if n[0] == "p" else -1) == "p3:delta delta" and found["p3:delta delta"] == pytest.approx(2 / 60, abs=1e-6)
    hits = indexed.hits(store, asked, Retrieval(rerank=False)).collect()
    assert {r.node_id for r in hits} == {"p1:alpha delta", "p3:delta delta", "p4:alpha", "f1:alpha"} and {r.doc_type for r in hits} == {"endpoint", "feature-hub"}


def test_models_are_loaded_once_and_fed_by_length(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        with open(log, "a") as f:
            f.write("x")
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    df = spark.createDataFrame([("a" * (i % 7),) for i in range(300)] + [(None,)], "t string").coalesce(1)
    got = df.select("t", embed.by_model(load, F.col("t"), "query: ", 32).alias("v")).collect()
    assert all(r.v[0] == 7 + len(r.t or "") and r.v[1] <= 32 for r in got) and log.read_text() == "x"


def test_long_texts_make_more_shards(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("only"), F.col("id").cast("string")), F.array_join(F.array_repeat(F.lit("many same words"), 50), " ")).alias("text"))
    shards = lambda: {r.shard: r for r in postings.build(docs.unionByName(spark.createDataFrame([(99, None)], "doc_id long, text string")), "doc_id", "text").where("term = ''").collect()}
    assert len(shards()) == 1
    monkeypatch.setattr(postings, "SHARD_CHARS", 6400)  # 40 texts of some 805 characters
    found = shards()
    assert 3 <= len(found) <= 6
    assert sum(r.n for r in found.values()) == 41 and sum(r.total for r in found.values()) == 40 * 151
    assert sorted(k for r in found.values() for k in r["keys"]) == [*range(40), 99]


def test_questions_are_dealt_in_their_own_precision(spark):
    model = cells.Model(np.eye(3), np.ones(3), 2)
    asked = spark.createDataFrame([(1, [1.0, 0.5, 0.0]), (2, None)], "item_id long, vector array<double>")
    for kind in ("float", "double"):
        dealt = cells.probes(asked.withColumn("vector", F.col("vector").cast(f"array<{kind}>")), model, "item_id")
        assert dealt.schema["vector"].dataType.simpleString() == f"array<{kind}>"
        assert sorted((r.by, r.cell, *r.vector) for r in dealt.collect()) == [(1, 0, 1.0, 0.5, 0.0), (1, 1, 1.0, 0.5, 0.0)]
