"""Reading a space of pages: the HTML converter, bodies, types, tags, sections and files."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import markdown, parse
from lodestone.functions.markdown import convert, to_markdown
from lodestone.operators import links
from lodestone.sources import files, pages, space

CASES = [
    ("<h2 class='a'>T</h2><script>x</script><ul><li>a &amp;lt;<li>b</ul><p>c<br/>d</p><!-- no -->", "## T\n\n* a &lt;\n* b\n\nc  \nd"),
    ("<p><strong>Metadata</strong> — endpoint_id: <code>ep::a_b</code></p>", "**Metadata** — endpoint\\_id: `ep::a_b`"),
    ("<ul><li>one<ul><li>see<p>para</p></li><li>two</li></ul></li><li>three</li></ul>after", "* one\n  + see\n\n    para\n  + two\n* three\n\nafter"),
    ("<ol start=3><li>x<li>y<ol><li>z</ol></ol>", "3. x\n4. y\n   1. z"),
    ("<ul><li><a href='/a'>one</a></li>see <b>link</b></ul>", "see **link**\n* [one](/a)"),
    ("<table><tr><th>a<th>b</tr><tr><td>1</td><td>2<br>3|</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 3\\| |"),
    ("<table><tbody><tr><td>x<td>y<tr><td>z</table>", "|  |  |\n| --- | --- |\n| x | y |\n| z |  |"),
    ("a&nbsp;b &#39;c&#39; &quot;d&quot; \n\t e", "a b 'c' \"d\" e"),
    ("<p>a</p> \n <p>b_c*</p>", "a\n\nb\\_c\\*"),
    ("<a href='http://q'>http://q</a> <a>no</a> <a href='/x' title='t'>x</a>", '<http://q> no [x](/x "t")'),
    ("x<b> bold </b>y<em></em><strong><b>z</b></strong>", "x **bold** y**z**"),
    ("<pre><code>  a_b\n  *c*</code></pre>", "```\n  a_b\n  *c*\n```"),
    ("<blockquote><p>q1</p><p>q2</p></blockquote><hr>end<img src=i alt=A>", "> q1\n>\n> q2\n\n---\n\nend![A](i)"),
    ("text <b>un<i>closed</b> more <p>p <div>d</div></span>", "text **un*closed*** more\n\np\n\nd"),
    ("<li>alone <td>cell", "* alone\n\n  cell"),
    ("", ""),
]


@pytest.mark.parametrize(("html", "want"), CASES)
def test_convert(html, want):
    assert convert(html) == want


def test_deep_and_long_pages():
    assert convert("<div>" * 500 + "x" + "</div>" * 500) == "x"
    assert convert("<p>word</p>" * 5000).count("word") == 5000
    assert len(convert("<b>" * 300 + "x")) == 5


PIECES = [
    "plain", "two words", "a_b *c*", " x", "x ", "a  b", "a|b", "a\\b", "it's", '"q"', "&amp;", "a & b", "a < b", "a>b", "/to", "n\n", "\n", "\xa0", "\ue0000_\ue001", "<!-- > x < -->", "<br>", "<hr/>", "<script>x</script>", "<pre>", "</pre>",
    '<a href="/to">', '<a href="a_b">', '<a href="x>/to<y">', '<a href="/to" title="t">', "</a>", *(f"<{end}{tag}>" for tag in ("p", "b", "em", "code", "h2", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "div") for end in ("", "/")),
]


def test_pages_of_one_form_are_parsed_once():
    markdown._form.cache_clear()
    page = lambda i: f"<h1>Order {i}</h1>\n" + meta(endpoint_id=f"ep::a_{i}::{i * i}", repo=f"nation {i}") + f'<ul><li>n_{i}<li><a href="/to/7">/to/{i}</a></ul>'
    got = [markdown.convert(page(i)) for i in range(300)]
    assert markdown._form.cache_info().misses == 1
    assert got == [markdown._parsed(page(i)).result() for i in range(300)] and got[7].endswith("* </to/7>") and "* n\\_8\n* [/to/8](/to/7)" in got[8]
    rnd = random.Random(7)
    for _ in range(3000):
        html = "".join(rnd.choices(PIECES, k=rnd.randint(1, 12)))
        for some in (html, html.replace("plain", "other_1").replace("two words", "/to")):  # of one form mostly
            assert markdown.convert(some) == markdown._parsed(some).result(), some
    long = "<p>word</p>" * 3000
    assert markdown.convert(long) == "\n\n".join(["word"] * 3000) and markdown.convert("") == ""


def test_pages_that_were_not_found_are_not_converted(spark):
    found = spark.createDataFrame([r[:3] for r in SPACE], "page_id string, parent_id string, title string")
    bodies = spark.createDataFrame([(p, "", h) for p, _, _, h in SPACE], "page_id string, title string, html string")
    plan = space.typed(found, bodies)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("EvalPython") < plan.index("Join [page_id")  # what is shown first comes last
    above = space.parents(found)
    assert {r.parent_id for r in above.collect()} == {r[1] for r in SPACE} & {r[0] for r in SPACE}
    told = space.typed(found, bodies, above)
    assert "hashpartitioning(parent_id" not in told._jdf.queryExecution().executedPlan().toString()  # nearly all pages have one
    assert sorted(map(str, told.collect())) == sorted(map(str, space.typed(found, bodies).collect()))


def test_metadata_survives_the_conversion(spark):
    html = "<h1>GET /x</h1><p><strong>Metadata</strong> &mdash; endpoint_id: <code>ep::r_1::x</code> &middot; db_ids: <code>db::a_b::c</code> <code>db::d::e</code></p>"
    rows = spark.createDataFrame([(html,), (None,)], "h string").select(parse.metadata(to_markdown(F.col("h"))).alias("m"), to_markdown(F.col("h")).alias("t")).collect()
    assert [r.m for r in rows] == [{"endpoint_id": ["ep::r_1::x"], "db_ids": ["db::a_b::c", "db::d::e"]}, None] and rows[1].t is None


def meta(**fields):
    return "<p><b>Metadata</b> — " + " · ".join(f"{k}: " + " ".join(f"<code>{x}</code>" for x in v.split()) for k, v in fields.items()) + "</p>"


SPACE = [
    ("root-child", "root", "Features", None),
    ("hub", "root-child", "Orders", meta(feature="orders")),
    ("tech", "root", "Orders · Technical Hub", meta(feature="orders")),
    ("e1", "root", "Get an order", meta(endpoint_id="ep::r::1", repo="r", controller="C", feature="orders", db_ids="db::s::c") + "text"),
    ("e2", "root", "POST /orders", meta(repo="r", controller="C")),
    ("e3", "root", "Delete", meta(docType="endpoint", endpoint_id="ep::r::0", repo="r", controller="C")),
    ("e4", "root", "Other", meta(endpoint_id="ep::q::1", repo="q", controller="C")),
    ("d1", "root", "c", meta(store="s", collection="c", type="mongo", consumed_by="ep::r::1", feature="lost")),
    ("d2", "root", "x [mongo]", meta(store="s")),
    ("reg", "root", "r", meta(repoType="api", repo="r") + "<h2>Controllers</h2><h3>C</h3><p>does it</p><h3>D</h3><h2>Next</h2><h3>no</h3>"),
    ("nav", "root", "Navigation", "<p>nothing</p>"),
    ("none", "root", "No type", meta(note="x")),
    ("own", "root", "Own type", meta(docType="guide", author="a b")),
    ("gone", "root", "GET /gone", meta(repo="r")),
]


def test_read_all(spark):
    found = spark.createDataFrame([r[:3] for r in SPACE], "page_id string, parent_id string, title string")
    bodies = spark.createDataFrame([(p, "Body title" if p == "e1" else "", h) for p, _, _, h in SPACE if p != "gone"], "page_id string, title string, html string")
    chunks = space.read(found, bodies)
    got = {(r.page_id, r.title): r for r in chunks.collect()}
    assert {k: r.doc_type for k, r in got.items()} == {
        ("hub", "Orders"): "feature-hub", ("tech", "Orders · Technical Hub"): "technical-hub", ("e1", "Body title"): "endpoint", ("e2", "POST /orders"): "endpoint", ("e3", "Delete"): "endpoint", ("e4", "Other"): "endpoint",
        ("d1", "c"): "db-collection", ("d2", "x [mongo]"): "db-collection", ("reg", "C"): "controller-context", ("reg", "D"): "controller-context", ("own", "Own type"): "guide",
    }
    e1, d1, c, d, own = (got[k] for k in (("e1", "Body title"), ("d1", "c"), ("reg", "C"), ("reg", "D"), ("own", "Own type")))
    assert (e1.endpoint_id, e1.controller_id, e1.db_ids, e1.feature, e1.route, e1.store, e1.collection) == ("ep::r::1", "ctrl::r::C", ["db::s::c"], ["orders"], "Get an order", None, "technical")
    assert e1.content.startswith("# Body title\n\n**Metadata** — endpoint\\_id: `ep::r::1`") and e1.content.endswith("\n\ntext")
    assert (d1.db_id, d1.db_collection, d1.consumed_by, d1.feature, d1.repo) == ("db::s::c", "c", ["ep::r::1"], None, None)
    assert (c.controller_id, c.used_by, c.content) == ("ctrl::r::C", ["ep::r::0", "ep::r::1"], "# C\n\ndoes it") and (d.used_by, d.content) == ([], "# D")
    assert own.metadata == {"docType": ["guide"], "author": ["a", "b"]} and e1.metadata is None
    assert got[("hub", "Orders")].collection == "functional" and len({r.node_id for r in got.values()}) == len(got)
    index = {(r.key, r.node_id) for r in links.id_index(chunks).collect()}
    assert ("e1", e1.node_id) in index and ("reg", c.node_id) in index and ("ep::r::1", e1.node_id) in index and ("orders", e1.node_id) not in index


def test_an_empty_space(spark):
    none = spark.createDataFrame([], "page_id string, parent_id string, title string")
    assert space.read(none, spark.createDataFrame([], "page_id string, title string, html string")).collect() == []


def test_metadata_is_parsed_once_and_bodies_do_not_go_by_parents(spark):
    found = spark.createDataFrame([r[:3] for r in SPACE], "page_id string, parent_id string, title string")
    bodies = spark.createDataFrame([(p, "", h) for p, _, _, h in SPACE], "page_id string, title string, html string").coalesce(1)
    plan = space.typed(found, bodies)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Contains(") == 1  # of the line that is looked for
    assert 0 < plan.index("hashpartitioning(page_id") < plan.index("hashpartitioning(parent_id")  # the join that is shown first comes last


def test_bodies_are_fetched_in_tasks(spark):
    def get(url):
        page = url.split("/pages/")[1].split("?")[0]
        return None if page == "404" else {"title": f"T{page}", "body": {"export_view": {"value": f"<p>{page}</p>"}} if page != "2" else None}

    got = pages.bodies(spark.createDataFrame([("1",), ("2",), ("404",), ("a%20b",)], "page_id string"), "https://host/api/", get=get).collect()
    assert sorted(map(tuple, got)) == [("1", "T1", "<p>1</p>"), ("2", "T2", ""), ("a%20b", "Ta%2520b", "<p>a%2520b</p>")]


def test_crawl_by_levels(spark):
    def get(url):
        page = url.split("/pages/")[1].split("/")[0].split("?")[0]
        if "children" not in url:
            return {"version": {"number": 9}}
        if page in ("gone", "leaf") or page.startswith("d40"):
            return None if page == "gone" else {"results": []}
        if page == "wide":
            at = int(url.split("cursor=")[1]) if "cursor=" in url else 0
            more = {"_links": {"next": f"/api/pages/wide/children?cursor={at + 100}"}} if at < 300 else {}
            return {"results": [{"id": f"w{i}", "title": "W", "version": {"number": 1}} for i in range(at, at + 100)], **more}
        if page[0] == "w":
            return {"results": []}
        nth = int(page[1:]) if page[0] == "d" else 0
        return {"results": [{"id": f"d{nth + 1}", "title": "D"}, {"id": "leaf", "title": "Skip"}]}

    got = pages.crawl(spark, "https://host/api", ["wide", "d0", "gone"], ["Skip"], tasks=4, get=get)
    rows = got.groupBy("root").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.max("version").alias("version")).collect()
    assert sorted(map(tuple, rows)) == [("d0", 40, 40, 9), ("wide", 400, 1, 1)]
    assert {r.parent_id for r in got.where("depth = 7").collect()} == {"d6"}


def test_file_listing(spark, tmp_path):
    for name in ("a/src/A.cs", "a/src/deep/B.cs", "a/readme.md", "b/A.cs"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").mkdir()
    found = files.listing(spark, {"a": str(tmp_path / "a"), "b": f"file://{tmp_path}/b/", "c": str(tmp_path / "empty")}, "*.cs")
    assert sorted((r.repo, r.file_path, r.length) for r in found.collect()) == [("a", "src/A.cs", 10), ("a", "src/deep/B.cs", 15), ("b", "A.cs", 6)]
    assert "content" not in found.select("repo", "file_path")._jdf.queryExecution().executedPlan().toString()
