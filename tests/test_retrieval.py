"""Operators of the retrieval engine on inline fixtures."""

import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import parse
from lodestone.functions import text as tx
from lodestone.operators import answer, delta, dense, fuse, integrity, lexical, links, registry, route, select, tree
from lodestone.plans import catalog, ingest
from lodestone.sources import pages, store
from lodestone.sources.tables import entity_chunks
from lodestone.streaming import delta as stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("n", "cut"), [(7999, False), (8000, False), (8001, True)])
def test_cap(spark, n, cut):
    body = "x" * (n - 3) + " \n" + "y"
    got = spark.createDataFrame([(body,)], "t string").select(tx.cap(F.col("t"))).first()[0]
    assert got.endswith(tx.TRUNCATION_MARK) == cut
    assert got == (body if not cut else "x" * 7998 + tx.TRUNCATION_MARK)


def test_metadata_line(spark):
    line = "# T\n**Metadata** — repo: `a\\_b` · feature: `x` `y` · bare: none · repo: `last` ·"
    data = [(line,), ("1\n2\n3\n**Metadata** — repo: `a`",), ("no line",), ("**Metadata** — nothing",), (None,)]
    got = [r[0] for r in spark.createDataFrame(data, "t string").select(parse.metadata(F.col("t"))).collect()]
    assert got == [{"feature": ["x", "y"], "repo": ["last"]}, None, None, None, None]


def test_page_type_order(spark):
    data = [
        ("**Metadata** — docType: `x` · endpoint_id: `e`", "GET /a", None, "x"),
        ("**Metadata** — endpoint_id: `e` · store: `s` · collection: `c`", "t", None, "endpoint"),
        ("**Metadata** — store: `s` · collection: `c`", "t", None, "db-collection"),
        ("**Metadata** — repoType: `r`", "t", None, "repo-registry"),
        ("-", "users [mongo]  ", "Features", "db-collection"),
        ("-", "A · Technical Hub", "Features", "technical-hub"),
        ("-", "POST /x", "Features", "endpoint"),
        ("-", "A", "Features", "feature-hub"),
        ("-", "A", None, None),
    ]
    df = spark.createDataFrame(data, "m string, t string, p string, want string")
    assert df.where(~parse.page_type(parse.metadata(F.col("m")), F.col("t"), F.col("p")).eqNullSafe(F.col("want"))).count() == 0


def test_controller_sections(spark):
    md = "# R\n## Controllers\nintro\n### A\none\ntwo\n### B\n\n## Next\n### C\nno"
    got = spark.createDataFrame([(md,), ("## Controllers of X\n### A\nno",), ("x\n##  Controllers \n\n###\tLast\nend\n##  Next\n### B\nno",)], "m string").select(parse.controller_sections(F.col("m"))).collect()
    assert [[tuple(s) for s in r[0]] for r in got] == [[("A", "one\ntwo"), ("B", "")], [], [("Last", "end")]]


def test_html(spark):
    html = "<h2 class='a'>T</h2><script>x</script><ul><li>a &amp;lt;<li>b</ul><p>c<br/>d</p><!-- no -->"
    assert spark.createDataFrame([(html,)], "h string").select(parse.html_to_markdown(F.col("h"))).first()[0] == "## T\n\n* a &lt;\n* bc\nd"


def test_bm25_orders_by_match(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "red red wine"), (3, "blue sky"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "red fox"), (8, "zz")], "item_id long, text string")
    assert [(r["doc_id"], r["rank"]) for r in lexical.ranked(lexical.topk(docs, asked, 8), 8).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert [r["doc_id"] for r in lexical.ranked(lexical.topk(docs, asked, 1), 1).collect()] == [1]
    assert lexical.topk(docs, asked.limit(0), 3).count() == 0 == lexical.topk(docs.limit(0), asked, 3).count()


def test_blocks_of_rows_and_questions(spark, monkeypatch):
    """Many blocks give what one gives; ties go to the lowest keys, and each value of `within` has its own best."""
    words = ["red", "fox", "sky", "sea", "oak", "the"]
    docs = spark.createDataFrame([(i, " ".join(words[(i * j) % 6] for j in range(1, 2 + i % 4)), f"g{i % 3}") for i in range(60)], "doc_id long, text string, g string").repartition(4)
    asked = spark.createDataFrame([(i, f"{words[i % 6]} the") for i in range(9)], "item_id long, text string")
    vectors = docs.selectExpr("doc_id AS vec_id", "array(doc_id % 7, doc_id % 3) AS embedding")
    turned = asked.selectExpr("item_id", "array(1, item_id) AS vector")
    run = lambda: (rows(lexical.ranked(lexical.topk(docs, asked, 4), 4)), rows(lexical.topk(docs, asked, 60, within="g")), rows(lexical.ranked(dense.topk(vectors, turned, 4), 4, key="vec_id")))
    whole = run()
    best = sorted((-(v % 7 + q * (v % 3)), v) for q in [5] for v in range(60))[:4]
    assert [(-r[2], r[1]) for r in sorted(whole[2], key=lambda r: r[3]) if r[0] == 5] == best
    monkeypatch.setattr("lodestone.operators.best.MOST_QUESTIONS", 2)
    assert run() == whole


@pytest.mark.parametrize("mode", fuse.MODES)
def test_fusion(spark, mode):
    data = [(1, 10, 0.9, 1, "a"), (1, 11, 0.5, 2, "a"), (1, 11, 7.0, 1, "b"), (2, 10, 3.0, 1, "a")]
    got = rows(fuse.fuse(spark.createDataFrame(data, "item_id long, doc_id long, score double, rank int, list string"), mode))
    assert [(a, b) for a, b, _ in got] == [(1, 10), (1, 11), (2, 10)]
    if mode == "reciprocal_rerank":
        assert got[1][2] == round(1 / 61 + 1 / 60, 6)
    with pytest.raises(ValueError):
        fuse.fuse(spark.range(1), "unknown")


def test_min_max(spark):
    data = [("a", 1.0), ("a", None), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0)]
    got = rows(fuse.min_max(spark.createDataFrame(data, "p string, score double"), "p"))
    assert got == [("a", 0.0), ("a", 0.333333), ("a", 1.0), ("b", 1.0), ("c", 1.0), ("c", 1.0)]


def test_quota(spark):
    data = [(1, i, "x", 1.0 - i / 10, 100) for i in range(6)] + [(1, 10, "y", 0.01, 5), (1, 11, "y", None, 5), (1, 12, "z", 0.0, 1)]
    hits = spark.createDataFrame(data, "item_id long, doc_id long, kind string, score double, chars int")
    got = select.quota(hits, {"y": 1, "absent": 3}, 4, "kind").orderBy("rank").collect()
    assert [(r["doc_id"], r["guaranteed"]) for r in got] == [(10, True), (0, False), (1, False), (2, False)]
    assert [r["doc_id"] for r in select.quota(hits, {"x": 9, "y": 2}, 3, "kind").orderBy("rank").collect()] == [0, 1, 2]
    more = select.quota(hits, {"y": 1}, 9, "kind", min_chars=6, extra=5, chars="chars").where("guaranteed").collect()
    assert {r["doc_id"] for r in more} == {10, 11}


def test_boost_and_reorder(spark):
    hits = spark.createDataFrame([(1, 1, "SRC/a.cs", 0.5, 1), (1, 2, "b", 0.6, 2)], "item_id long, doc_id long, path string, score double, rank int")
    assert rows(select.boost(hits, ["A.CS", " "], 2.0, "path").select("doc_id", "score")) == [(1, 1.0), (2, 0.6)]
    assert select.boost(hits, [" "], 2.0, "path") is hits
    assert rows(select.reorder(hits, ["b"], "path").select("doc_id", "rank")) == [(1, 2), (2, 1)]


def test_delta(spark):
    kind = "collection string, page_id string, node_id string"
    old = spark.createDataFrame([("t", "same", "1"), ("t", "mod", "2"), ("t", "gone", "3"), ("t", "moves", "4")], kind)
    new = spark.createDataFrame([("t", "same", "1"), ("t", "mod", "2b"), ("t", "new", "5"), ("f", "moves", "4")], kind)
    plan = delta.plan(delta.state(old), delta.state(new))
    assert rows(plan.select("collection", "page_id", "change")) == [("f", "moves", "added"), ("t", "gone", "removed"), ("t", "mod", "changed"), ("t", "moves", "removed"), ("t", "new", "added"), ("t", "same", "unchanged")]
    assert rows(delta.apply(old, new, plan)) == rows(new)
    assert rows(delta.plan(delta.state(new), delta.state(new)).select("change").distinct()) == [("unchanged",)]


def test_crawl(spark):
    data = [("a", "A", "root"), ("b", "B", "a"), ("c", "Skip", "root"), ("d", "D", "c"), ("e", "E", "r2"), ("x", "X", None)]
    tree_pages = spark.createDataFrame(data, "page_id string, title string, parent_id string")
    assert rows(tree.crawl(tree_pages, ["root", "r2"], ["Skip"]).select("root", "page_id", "depth")) == [("r2", "e", 1), ("root", "a", 1), ("root", "b", 2)]


def test_crawl_of_nested_roots_and_circles(spark):
    data = [("a", "A", "root"), ("b", "B", "a"), ("c", "C", "b"), ("d", "D", "c"), ("x", "X", "y"), ("y", "Y", "x"), ("z", "Z", "nowhere"), ("two", "T", "a"), ("two", "T", "b"), (None, "N", "root"), ("top", "T", None)]
    got = tree.crawl(spark.createDataFrame(data, "page_id string, title string, parent_id string"), ["root", "b", "none"])
    want = [("root", "a", 1), ("root", "b", 2), ("root", "c", 3), ("root", "d", 4), ("b", "c", 1), ("b", "d", 2), ("root", "two", 2), ("root", "two", 3), ("b", "two", 1)]
    assert rows(got.select("root", "page_id", "depth")) == sorted(want)
    empty = spark.createDataFrame([], "page_id string, title string, parent_id string")
    assert rows(tree.crawl(empty, ["root"])) == []


def test_crawl_of_deep_and_large_trees(spark):
    wide = spark.range(1, 2_000_001).select(F.col("id").cast("string").alias("page_id"), F.lit("w").alias("title"), F.expr("id div 10").cast("string").alias("parent_id"))
    deep = spark.range(200).select(F.concat(F.lit("d"), "id").alias("page_id"), F.lit("d").alias("title"), F.when(F.col("id") == 0, "0").otherwise(F.concat(F.lit("d"), F.col("id") - 1)).alias("parent_id"))
    got = tree.crawl(wide.unionByName(deep), ["0"]).groupBy("title").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.sum("depth").alias("sum"))
    assert rows(got) == [("d", 200, 200, 20100), ("w", 2_000_000, 7, sum(len(str(i)) for i in range(1, 2_000_001)))]


def test_routing(spark):
    hits = spark.createDataFrame([(1, ["ep::r1::op", "db::m::c"], "see a.cs:12 and b.cs:3"), (1, ["ctrl::gone::C"], ""), (2, ["db::m::c"], "z.cs:1")], "item_id long, ids array<string>, content string")
    registered = spark.createDataFrame([("r1",), ("r2",)], "repo string")
    got = route.route(route.derive(hits), registered, hits)
    assert rows(got) == [(1, "r1", False, ["a.cs", "b.cs"], ["op"]), (2, "r1", True, [], []), (2, "r2", True, [], [])]
    none = spark.createDataFrame([], "item_id long, repo string")
    assert all(r[2] for r in route.pinned(none, registered, hits).collect())


def test_stale_citations(spark):
    pages = [
        ("1", "p", "ep::r::x", None, "see a.cs:5, a.cs:50, no.cs:1 and a.cs:50"),
        ("2", "q", "", "ctrl::r::C", "a.cs:99 has no known lines"),
        ("3", "p", "ep::s::y", None, "b.cs:7 is in r only"),
        ("4", "p", "ep::unregistered::z", None, "no.cs:1"),
        ("5", "p", None, None, "no.cs:1"),
        ("6", "p", "ep::r::w", None, None),
    ]
    chunks = spark.createDataFrame(pages, "node_id string, page_id string, endpoint_id string, controller_id string, content string")
    cited = route.cited_lines(chunks, spark.createDataFrame([("r",), ("s",)], "repo string"))
    files = spark.createDataFrame([("r", "src/deep/a.cs"), ("r", "b.cs"), ("s", "src/a.cs")], "repo string, file_path string")
    ranges = spark.createDataFrame([("p", "r", "x/a.cs", 1, 5), ("p", "r", "x/a.cs", 40, None), ("q", "r", "a.cs", None, 9), ("p", "s", "b.cs", 1, 2)], "page_id string, repo string, file_path string, start_line int, end_line int")
    got = {(r["node_id"], r["repo"], r["file"], r["line"]): r["reason"] for r in route.stale_citations(cited, files, ranges).collect()}
    assert got == {("1", "r", "a.cs", 50): "line not in any chunk", ("1", "r", "no.cs", 1): "no such file", ("3", "s", "b.cs", 7): "no such file"}


def test_integrity_rules(spark):
    schema = "node_id string, doc_type string, collection string, content string, repo string, feature array<string>, endpoint_id string, controller_id string, db_ids array<string>, route string, store string, type string, db_collection string, db_id string, used_by array<string>, page_id string"
    base = dict.fromkeys([c.split()[0] for c in schema.split(", ")])
    data = [
        base | {"node_id": "e", "doc_type": "endpoint", "content": "x", "endpoint_id": "bad", "controller_id": "ctrl::r::C", "db_ids": ["db::m::c", "wrong"], "feature": ["f"]},
        base | {"node_id": "c", "doc_type": "controller-context", "content": "y" * 6500, "controller_id": "ctrl::r::D", "used_by": ["ep::r::none"]},
        base | {"node_id": "d", "doc_type": "db-collection", "content": "z", "db_id": "db::m::other", "store": "m", "db_collection": "other"},
        base | {"node_id": "h", "doc_type": "technical-hub", "content": "h", "feature": []},
    ]
    chunks = spark.createDataFrame([tuple(r.values()) for r in data], schema)
    got = {(r["place"], r["message"]) for r in integrity.check(chunks).collect()}
    for want in [("e", "endpoint_id malformed"), ("e", "repo missing"), ("e", "route missing"), ("e", "db_ids malformed: wrong"), ("e", "no controller ctrl::r::C"), ("e", "no database db::m::c"), ("c", "near the cap"), ("c", "no endpoint ep::r::none"), ("d", "type missing"), ("d", "unreferenced db::m::other"), ("h", "feature empty"), ("f", "no feature hub for f"), ("f", "no technical hub for f")]:
        assert want in got
    assert not integrity.passes(chunks) and integrity.passes(chunks, strict=False)


def test_citations_keep_first_position_and_leave_hits_out(spark):
    schema = "node_id string, collection string, doc_type string, endpoint_id string, controller_id string, db_ids array<string>, feature array<string>, used_by array<string>, db_id string, page_id string"
    data = [
        ("e", "t", "endpoint", "ep::r::1", "ctrl::r::C", ["db::m::a", "db::m::b"], ["f"], None, None, "p1"),
        ("c", "t", "controller-context", None, "ctrl::r::C", None, None, ["ep::r::1"], None, "p2"),
        ("a", "t", "db-collection", None, None, None, None, None, "db::m::a", "p3"),
        ("b", "f", "db-collection", None, None, None, None, None, "db::m::b", "p4"),
        ("h", "t", "technical-hub", None, None, None, ["f", "db::m::a"], None, None, "p5"),
    ]
    chunks = spark.createDataFrame(data, schema)
    hits = chunks.where("node_id IN ('e', 'c')").withColumn("q", F.lit(1))
    assert rows(links.citations(hits, links.id_index(chunks), "q")) == [(1, "e", "a", 1, "db::m::a"), (1, "e", "h", 1, "db::m::a")]


def test_manifests(spark):
    data = [(1, 1, "a", "", "", "s", None), (2, 2, "a", "", "", None, "i"), (3, 2, "b", "", "", None, "i"), (4, 2, "c", "", "", None, "i"), (5, 9, "d", "", "", "s", None)]
    got = rows(registry.conflicts(spark.createDataFrame(data, registry.SCHEMA)).select("position", "conflict"))
    assert got == [(1, None), (2, "duplicate repoKey"), (3, None), (4, "persistDir in use")]
    docs = spark.createDataFrame([('{"PageId": "1", "a": [{"rootPageID": "2"}], "pageIdx": "3"}',)], "json string")
    assert rows(registry.page_ids(docs)) == [("1",), ("2",)]


def test_page_walk():
    site = {
        "https://h/api/pages/r/children?limit=100": {"results": [{"id": 1, "title": "A", "version": {"number": 2}}], "_links": {"next": "/api/more"}},
        "https://h/api/more": {"results": [{"id": 2, "title": "Skip"}, {"id": 3, "title": "C"}]},
        "https://h/api/pages/2": {"version": {"number": 7}},
        "https://h/api/pages/1/children?limit=100": {"results": [{"id": 4, "title": "D", "version": {"number": 1}}]},
    }
    assert list(pages.walk("https://h/api", "r", {"Skip"}, site.get)) == [("1", "A", "r", 2), ("3", "C", "r", None), ("4", "D", "1", 1)]


def test_stream_delta(spark, tmp_path):
    kind = "collection string, page_id string, node_id string"
    spark.createDataFrame([("t", "a", "1"), ("t", "b", "2")], kind).write.json(f"{tmp_path}/in/1")
    q = stream.run(spark.readStream.schema(kind).json(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    spark.createDataFrame([("t", "a", "1b"), ("t", "b", None), ("f", "c", "3")], kind).write.json(f"{tmp_path}/in/2")
    stream.run(spark.readStream.schema(kind).json(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert rows(spark.read.schema(kind).parquet(f"{tmp_path}/out/v1").select("collection", "page_id", "node_id")) == [("f", "c", "3"), ("t", "a", "1b")]


def test_config(tmp_path):
    assert config.load(str(tmp_path / "none.json")).sized() == (8, 24)
    (tmp_path / "c.json").write_text('{"top_k": 30}')
    assert config.load(str(tmp_path / "c.json")).sized(0) == (30, 30)
    (tmp_path / "c.json").write_text('{"typo": 1}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.json"))


def test_forms_of_ids(spark):
    data = [("ep::r::{x}", "ctrl::r::Foo-Bar", "db::m::c"), ("ep::r::x", "ctrl::r::a b", "db::m::c/d"), ("ep::r::'x'", "ctrl::r", "db::[m]::c"), ("ep::r::a-b.c", "ctrl::r::C:d", "db::m::\"c\"")]
    good = spark.createDataFrame(data, "e string, c string, d string").select(F.col("e").rlike(integrity.ENDPOINT_ID), F.col("c").rlike(integrity.CONTROLLER_ID), F.col("d").rlike(integrity.DB_ID))
    assert [tuple(r) for r in good.collect()] == [(False, True, True), (True, False, False), (False, False, False), (True, False, False)]


def test_every_query_has_sql():
    """All but the approximate index, whose finds no SQL states: tests/test_indexes.py holds it against all vectors."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"dense_indexed", "dense_recall"} and set(catalog.ORACLE) < set(catalog.QUERIES) and len(catalog.QUERIES) >= 76


def _pages(spark, data):
    chunks = spark.createDataFrame(data, "collection string, page_id string, content string, version long")
    return chunks.select("*", F.sha2("content", 256).alias("node_id"))


def test_store(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"))
    assert kept.docstore() is None and kept.vectors().count() == 0 and kept.state().count() == 0
    asked = spark.sparkContext.accumulator(0)

    def embedder(texts):
        asked.add(len(texts))
        return texts.map(lambda t: [float(len(t))])

    first = [("technical", "a", "one", 1), ("technical", "a", "two", 1), ("technical", "b", "three", 1), ("functional", "c", "four", 1), ("functional", "d", "5", 1)]
    assert rows(kept.sync(_pages(spark, first), embedder=embedder)) == [("functional", 2), ("technical", 3)]
    second = [("technical", "a", "one", 2), ("technical", "a", "two", 2), ("technical", "b", "changed", 2), ("functional", "c", "four", 1), ("functional", "e", "new", 1)]
    kept.sync(_pages(spark, second), embedder=embedder)
    assert asked.value == 5 + 2 and rows(kept.changes().select("page_id", "change")) == [("a", "unchanged"), ("b", "changed"), ("c", "unchanged"), ("d", "removed"), ("e", "added")]
    live = [("a", 3.0, 1), ("a", 3.0, 1), ("b", 7.0, 2), ("c", 4.0, 1), ("e", 3.0, 2)]
    seen = lambda: rows(kept.vectors().select("page_id", F.get("embedding", F.lit(0)), "run"))
    assert seen() == live and kept.docstore().count() == 5
    assert rows(kept.state().select("page_id", "version")) == [("a", 2), ("b", 2), ("c", 1), ("e", 1)]
    # a run that ended before its state was written doesn't count, and the next one takes its place
    (tmp_path / "s" / "vectors" / "run=3").mkdir()
    kept.vacuum()
    assert seen() == live and not (tmp_path / "s" / "docstore" / "run=1").exists()
    kept.sync(_pages(spark, second), embedder=embedder)
    assert asked.value == 7 and seen() == live and kept.last() == 3
    kept.sync(_pages(spark, second[:1]), full=True)
    assert seen() == [("a", None, 4)]
    kept.sync(_pages(spark, []))
    assert kept.vectors().count() == 0 and kept.docstore().count() == 0
    with pytest.raises(ValueError):
        kept.sync(_pages(spark, [("technical", None, "x", 1)]))


def test_ingest_gate(spark, tmp_path):
    chunks = entity_chunks(spark, "/root/testdata/sf0.001")
    done = ingest.run(spark, str(tmp_path / "s"), chunks, strict=True)
    assert not done.ok and done.findings["error"] > 0 and set(done.pages) == {"added"} and done.nodes["functional"] > 0
    sound = chunks.where("doc_type = 'feature-hub' AND size(feature) > 0")
    again = ingest.run(spark, str(tmp_path / "s"), sound, strict=True)
    assert again.ok and set(again.pages) == {"unchanged", "removed"}


def test_answers_of_repositories(spark):
    kind = "item_id long, repo string, chunk_id long, heading string, file_path string, layer string, source_type string, content string, score double"
    data = [(1, "a", 1, "h", "x/A.cs", "l", "code", "t", 1.0), (1, "a", 2, "h", "x/B.cs", "l", "code", "t", 0.9), (1, "b", 3, None, "C.cs", "l", "code", "t", 5.0), (1, "c", 4, "h", "D.cs", None, "rule", "t", 2.0), (2, "a", 5, "h", "A.cs", "l", "code", "t", 0.3)]
    repos = spark.createDataFrame([(1, "a", False, ["b.CS", " "]), (1, "b", False, []), (1, "c", False, None), (1, "none", False, []), (2, "a", True, [])], "item_id long, repo string, fallback boolean, files array<string>")
    hits = answer.code_hits(spark.createDataFrame(data, kind), repos, config.CodeIndex(hint_boost=2.0))
    # B.cs is hinted and leads; b's answer lacks a heading and is an error of b alone; scores are scaled over a and c
    got = rows(answer.assemble(hits, repos).select("item_id", "repo", F.coalesce("chunk_id", F.lit(0)), F.coalesce("rank", F.lit(0)), F.coalesce("score", F.lit(-1.0)), F.coalesce("error", F.lit(""))))
    assert got == [(1, "a", 1, 2, 0.0, ""), (1, "a", 2, 1, 0.8, ""), (1, "b", 0, 0, -1.0, "repo b: answer without heading"), (1, "c", 4, 1, 1.0, ""), (2, "a", 5, 1, 0.3, "")]
    assert answer.contract(hits).columns == ["item_id", "repo", "chunk_id", *answer.CODE_FIELDS]


def test_best_hits_without_rerank(spark):
    pool = [(1, f"t{i}", "technical", "endpoint" if i else "other", "c", "q", float(i)) for i in range(4)] + [(1, "f", "functional", "feature-hub", "c", "q", 0.001)]
    pool = spark.createDataFrame(pool, "item_id long, node_id string, collection string, doc_type string, content string, question string, score double")
    best = answer.best_hits(pool, config.Retrieval(top_k=3, quotas={"other": 1}, rerank=False))
    assert [(r["node_id"], r["score"], r["rank"]) for r in best.orderBy("rank").collect()] == [("f", 1.0, 1), ("t3", 1.0, 2), ("t2", 0.666667, 3)]


def test_validation_of_repositories(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "repo string")
    manifests = spark.createDataFrame([("a", "risk"), ("b", None), ("c", None)], "repoKey string, knownRisk string")
    chunks = spark.createDataFrame([("a", None, "code"), ("a", "l", None), ("c", "l", "code"), ("x", "l", "code")], "repo string, layer string, source_type string")
    errors = spark.createDataFrame([("c", "repo c: answer without heading")], "repo string, error string")
    got = rows(registry.validate(asked, manifests, chunks, errors).select("repo", "position", "step", "ok", F.coalesce("error", F.lit(""))))
    assert got == [
        ("a", 1, "manifest", True, ""), ("a", 2, "status", True, ""), ("a", 3, "probe", True, ""),
        ("b", 1, "manifest", True, ""), ("b", 2, "status", False, "status is empty"),
        ("c", 1, "manifest", True, ""), ("c", 2, "status", True, ""), ("c", 3, "probe", False, "repo c: answer without heading"),
        ("d", 1, "manifest", False, "not registered"),
    ]
    assert rows(registry.code_status(chunks, "repo")) == [("a", "-", "code", 1), ("a", "l", "?", 1), ("a", "total", "", 2), ("c", "l", "code", 1), ("c", "total", "", 1), ("x", "l", "code", 1), ("x", "total", "", 1)]


def test_manifest_files(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"contractVersion": 1,\n "repoKey": "a", "displayName": "A", "serve": {"command": "run"}, "repoRoot": ".."}')
    (tmp_path / "2.json").write_text('{"contractVersion": 2, "repoKey": "b", "displayName": "B", "index": {"store": {"persistDir": "idx"}}}')
    (tmp_path / "3.json").write_text('not json')
    (tmp_path / "4.json").write_text('{"contractVersion": "two", "repoKey": "d"}')
    got = registry.load(spark, [str(tmp_path / f"{i}.json") for i in (1, 2, 3, 4)]).orderBy("position").collect()
    assert [(r["repoKey"], r["error"]) for r in got] == [("a", None), ("b", None), (None, "not valid JSON, or not of the contract's types"), (None, "not valid JSON, or not of the contract's types")]
    assert got[0]["repoRoot"] == str(tmp_path.parent) and got[1]["persistDir"] == str(tmp_path / "idx") and got[1]["repoRoot"] == str(tmp_path)


def test_ingests_meet_their_pages_no_more_often_than_they_must(spark, tmp_path, monkeypatch):
    from lodestone.plans import ingest

    read, written, make = [], [], ingest.entity_chunks
    monkeypatch.setattr(ingest, "entity_chunks", lambda *a: read.append(1) or make(*a))
    monkeypatch.setattr(ingest.Store, "sync", lambda self, chunks, *a: written.append(chunks.inputFiles()))
    monkeypatch.setattr(ingest.Store, "changes", lambda self: spark.createDataFrame([], "collection string, page_id string, change string"))
    ingest.ingest_sync(spark, "/root/testdata/sf0.001")
    assert len(read) == 1 and sorted(written[0]) == sorted(written[1]) and all("/chunks-" in f for f in written[0])  # both read what was written once
