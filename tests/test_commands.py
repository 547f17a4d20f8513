"""The command line, reports, hints by automaton, and page ids in JSON."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.config import CodeIndex
from lodestone.operators import answer, registry, rerank, route, select
from lodestone.plans import indexed
from lodestone.sources.store import Store
from lodestone.sources.textindex import TextIndex

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    assert cli.main(["ingest", SMALL, path]) == 0 and cli.main(["ingest", SMALL, path, "--strict"]) == 1  # some ids there are malformed
    return path


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_query_and_expand(spark, store, capsys):
    capsys.readouterr()
    assert cli.main(["query", store, "order 3 handled in which file", "--top-k", "4"]) == 0
    hits = lines(capsys)
    assert [h["rank"] for h in hits] == [1, 2, 3, 4] and all(set(h) >= {"id", "title", "doc_type", "collection", "content", "score", "citations"} for h in hits)
    assert cli.main(["query", store, "urgent", "--collection", "functional", "--no-citations"]) == 0
    assert {h["collection"] for h in lines(capsys)} == {"functional"}
    wanted = Store(spark, store).docstore().where("doc_type = 'endpoint'").orderBy("page_id").first()
    for name in (wanted.endpoint_id, wanted.page_id, wanted.node_id):
        assert cli.main(["expand", store, name]) == 0
        assert [x["content"] for x in lines(capsys)] == [wanted.content]
    assert cli.main(["expand", store, "ep::no::such"]) == 0 and lines(capsys) == []


def test_status(spark, store, tmp_path, capsys):
    capsys.readouterr()
    assert cli.main(["status", store]) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[0].startswith("functional | feature-hub | ") and said[-1] == f"total | | {Store(spark, store).docstore().count()} chunks"
    assert Store(spark, str(tmp_path)).status() == ["the store is empty: run an ingest"]
    one = Store(spark, str(tmp_path))
    one.sync(spark.createDataFrame([("technical", "p", "n", "text", None)], "collection string, page_id string, node_id string, content string, doc_type string"))
    assert one.status() == ["functional | (empty)", "technical | ? | 1 chunks", "total | | 1 chunks"]


def test_other_commands(spark, monkeypatch, capsys):
    capsys.readouterr()
    assert cli.main(["repos", SMALL]) == 1 and any(not x["ok"] for x in lines(capsys))
    monkeypatch.setattr(cli, "SHOWN", 2)
    assert cli.main(["validate-citations", SMALL]) == 0
    out = capsys.readouterr()
    assert len(out.out.splitlines()) == 2 and "more than 2 rows" in out.err
    assert cli.main(["query-code", SMALL, "--repo", "src1"]) == 0 and {x["repo"] for x in lines(capsys)} == {"src1"}


def test_report_with_latency(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} common {'rare' if i == 5 else ''}") for i in range(60)], "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path), "doc_id", "text", buckets=2)
    index.update(docs)
    asked = spark.createDataFrame([(1, "rare common"), (2, "word3"), (3, "absent")], "item_id long, text string")
    wanted = spark.createDataFrame([(1, 5), (2, 59), (3, 1)], "item_id long, doc_id long")
    report = indexed.eval_report(spark, index, asked, wanted)
    assert (report["cases"], report["passed"], report["first"]) == (3, 1, 1) and 0 < report["mean_ms"] <= report["worst_ms"] < 5000


def test_thousands_of_hints(spark):
    hits = spark.createDataFrame([(1, f"src/File{i}.cs", None, 1.0) for i in range(0, 20000, 100)] + [(2, "src/File7.cs", "x", 1.0), (3, None, None, 1.0)], "item_id long, file_path string, heading string, score double")
    hints = spark.range(10_000).select(F.lit(1).alias("item_id"), F.concat(F.lit(" FILE"), "id", F.lit(".cs ")).alias("hint")).unionByName(spark.createDataFrame([(2, "  "), (2, None), (9, "src")], "item_id long, hint string"))
    got = select.boost_many(hits, hints, 1.5, "item_id", "file_path", "heading")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == 202 and sum(r.score == 1.5 for r in rows) == 100 and all(r.score == 1.0 for r in rows if r.item_id != 1)
    same = select.boost(hits.where("item_id = 1"), [f"File{i}.cs" for i in range(0, 10000, 100)], 1.5, "file_path", "heading")
    assert sorted(r.file_path for r in same.where("score = 1.5").collect()) == sorted(r.file_path for r in rows if r.score == 1.5)


def test_page_ids_at_any_depth(spark):
    docs = [
        '{"rootPageId": "1", "x": {"deep": [{"PAGEID": "2"}, ["no", {"a_pageid": "3"}]]}, "note": "\\"pageId\\": \\"4\\""}',
        '{"pageId": 5, "pageIdx": "6", "pageid": null, "key\\"pageid": "7"}',
        '[[{"pageId": "2"}]]', '"pageId"', "{broken", "", None,
    ]
    got = registry.page_ids(spark.createDataFrame([(d,) for d in docs], "json string")).collect()
    assert sorted(r.page_id for r in got) == ["1", "2", "3", "7"]
    assert registry.page_ids(spark.createDataFrame([], "json string")).collect() == []


def test_code_stage_reranks_between_boost_and_quota(spark):
    loads = spark.sparkContext.accumulator(0)

    def scorer(question, text):
        loads.add(1)
        return text.str.len().astype(float)

    found = spark.createDataFrame([(1, "r", i, "H", f"f{i}.cs", "api", "code", "x" * (5 - i), 1.0, "q") for i in range(5)], "item_id long, repo string, chunk_id long, heading string, file_path string, layer string, source_type string, content string, score double, question string")
    repos = spark.createDataFrame([(1, "r", False, ["f4.cs"])], "item_id long, repo string, fallback boolean, files array<string>")
    plain = answer.code_hits(found, repos, CodeIndex(top_k=2, hint_boost=3.0)).orderBy("rank").collect()
    assert [r.chunk_id for r in plain] == [4, 0]
    again = answer.code_hits(found, repos, CodeIndex(top_k=2, hint_boost=3.0, rerank=True), scorer=scorer).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in again] == [(0, 5.0), (1, 4.0)] and loads.value >= 1


def test_rerank_models_are_loaded_once_and_fed_by_length(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        with open(log, "a") as f:
            f.write("x")

        def model(questions, texts):
            assert [len(q) + len(t) for q, t in zip(questions, texts)] == sorted(len(q) + len(t) for q, t in zip(questions, texts))
            return [len(t) + 100.0 * (len(texts) <= 32) for t in texts]

        return model

    hits = spark.createDataFrame([(i, "q" * (i % 3), "a" * (i % 7)) for i in range(300)] + [(300, None, None)], "id long, question string, text string").coalesce(1)
    got = rerank.rerank(hits, rerank.Model(load, 32)).collect()
    assert len(got) == 301 and all(r.score == 100 + len(r.text or "") for r in got) and log.read_text() == "x"
    # the model's scores, not the boosted ones, decide within the code stage
    found = spark.createDataFrame([(1, "r", i, "H", f"f{i}.cs", "api", "code", "x" * (5 - i), 1.0, "q") for i in range(5)], "item_id long, repo string, chunk_id long, heading string, file_path string, layer string, source_type string, content string, score double, question string")
    repos = spark.createDataFrame([(1, "r", False, ["f4.cs"])], "item_id long, repo string, fallback boolean, files array<string>")
    best = answer.code_hits(found, repos, CodeIndex(top_k=2, hint_boost=3.0, rerank=True), scorer=rerank.Model(load, 32)).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in best] == [(0, 105.0), (1, 104.0)]
    empty = rerank.rerank(hits.where("false"), rerank.Model(load))
    assert empty.collect() == [] and empty.schema["score"].dataType.simpleString() == "double"


def test_presentation_order_and_answers(spark):
    found = spark.createDataFrame([(1, "r", 1, "api", "doc-b", "code", 3.0), (1, "r", 2, "api", None, "rules", 2.0), (1, "r", 3, "api", "", "code", 1.0)], "item_id long, repo string, chunk_id long, layer string, doc_type string, source_type string, score double")
    found = found.withColumn("heading", F.lit("H")).withColumn("file_path", F.lit("f")).withColumn("content", F.lit("c"))
    repos = spark.createDataFrame([(1, "r", False, [""]), (1, "silent", False, [""])], "item_id long, repo string, fallback boolean, files array<string>")
    hits = answer.code_hits(found, repos, CodeIndex(priority_order=("rules", "code")))
    assert [r.chunk_id for r in hits.orderBy("rank").collect()] == [2, 3, 1]  # the type, else the source's
    scaled = answer.assemble(hits, repos).orderBy("chunk_id").collect()
    assert [r.score for r in scaled] == [1.0, 0.5, 0.0]  # a second repository has answered, without a chunk
    alone = route.merge_repos(hits, repos.where("repo = 'r'")).orderBy("chunk_id").collect()
    assert [r.score for r in alone] == [3.0, 2.0, 1.0]
