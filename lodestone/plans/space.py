"""The query that reads a whole space: crawl, bodies, types, tags, sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import tree
from lodestone.sources import space
from lodestone.sources.tables import table


def _field(name: str, *values) -> F.Column:
    """A metadata field in HTML, null if a value is."""
    codes = [F.concat(F.lit("<code>"), v, F.lit("</code>")) for v in values]
    return F.concat(F.lit(f"{name}: "), F.concat_ws(" ", *codes) if len(codes) > 1 else codes[0])


def _page(page_id, parent: str | F.Column, title, *fields, body=None, intro: str = "h1") -> list:
    line = F.concat(F.lit("<p><strong>Metadata</strong> &mdash; "), F.concat_ws(" &middot; ", *fields), F.lit("</p>"))
    head = F.concat(F.lit(f"<{intro}>"), title, F.lit(f"</{intro}>\n"))
    return [page_id.alias("page_id"), (F.lit(parent) if isinstance(parent, str) else parent).alias("parent_id"), title.alias("title"), F.concat(head, line, body if body is not None else F.lit("")).alias("html")]


def _space(spark: SparkSession, sf: str) -> DataFrame:
    """Pages (page_id, parent_id, title, html): endpoints by each of three rules, databases by two, registry pages of nations with their
    customers as controllers, hubs, pages without metadata or type, some without a body and some below a title that is left out."""
    t = lambda n: table(spark, sf, n)
    s = lambda c: F.col(c).cast("string")
    one = lambda *rows: spark.createDataFrame(rows, "page_id string, parent_id string, title string, html string")
    folders = one(
        ("features", "func", "Features", "<h1>Features</h1>"), ("repos", "tech", "Repos", "<p>no metadata</p>"), ("stores", "tech", "Data Stores", None), ("artifacts", "tech", "Artifacts", ""),
        ("untyped", "tech", "Notes", "<p><b>Metadata</b>: note: <code>x</code></p>"), ("guide", "tech", "Guide", "<p><b>Metadata</b> - docType: <code>guide</code> · author: <code>a_b</code></p>How to"),
    )
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    status = F.col("o_orderstatus")
    order_id = F.when(status != "F", _field("endpoint_id", F.concat_ws("::", F.lit("ep"), "n_name", s("o_orderkey"))))
    common = [_field("repo", F.col("n_name")), _field("controller", s("o_custkey")), _field("feature", F.col("o_orderpriority"), F.lit("all_orders"))]
    route = F.concat(F.when(status == "P", "POST").otherwise("GET"), F.lit(" /orders/"), s("o_orderkey"))
    title = F.when(status == "O", F.concat(F.lit("Order "), s("o_orderkey"))).otherwise(route)
    body = F.concat(F.lit("\n<h2>Handled in</h2><ul><li><code>File"), (F.col("o_custkey") % 100).cast("string"), F.lit(".cs:"), (F.col("o_orderkey") % 500 + 1).cast("string"), F.lit("</code></li>\n<li>see <a href=\"/orders\">all_orders</a>"), F.lit("</li></ul>"))
    where = F.when(F.col("o_orderpriority") == "5-LOW", "artifacts").otherwise("repos")
    endpoints = o.select(*_page(F.concat(F.lit("order-"), s("o_orderkey")), where, title, F.when(status == "P", _field("docType", F.lit("endpoint"))), order_id, *common, body=body))
    p = t("part").withColumn("keyed", F.col("p_size") > 25)
    name = F.when(F.col("keyed"), F.col("p_name")).otherwise(F.concat("p_name", F.lit(" [mongo] ")))
    fields = [_field("store", F.col("p_brand")), _field("type", F.lit("mongo")), F.when(F.col("keyed"), _field("collection", s("p_partkey")))]
    cells = F.concat(F.lit("<table><tr><th>field<th>kind</tr><tr><td>size</td><td>"), s("p_size"), F.lit("</td></tr></table>"))
    stores = p.select(*_page(F.concat(F.lit("part-"), s("p_partkey")), "stores", name, *fields, body=cells)).withColumn("html", F.when(~F.col("title").startswith("b"), F.col("html")))
    c = t("customer").select("c_nationkey", "c_custkey", F.concat(F.lit("<h3>"), s("c_custkey"), F.lit("</h3><p>"), "c_mktsegment", F.lit(" &amp; <em>more</em></p>")).alias("part"))
    parts = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "part"))).alias("parts"))
    body = F.concat(F.lit("<h2>Controllers</h2>"), F.array_join(F.col("parts.part"), ""), F.lit("<h2>Other</h2><h3>none</h3>"))
    registry = t("nation").join(parts, F.col("c_nationkey") == F.col("n_nationkey")).select(*_page(F.concat(F.lit("nation-"), s("n_nationkey")), "repos", F.col("n_name"), _field("repoType", F.lit("api")), _field("repo", F.col("n_name")), body=body))
    features = t("orders").select("o_orderpriority").distinct()
    hub = F.col("o_orderpriority")
    functional = features.select(*_page(F.concat(F.lit("hub-"), hub), "features", hub, _field("feature", hub)))
    technical = features.select(*_page(F.concat(F.lit("tech-"), hub), "tech", F.concat(hub, F.lit(" · Technical Hub")), _field("feature", hub), intro="h2"))
    whole = folders
    for other in (endpoints, stores, registry, functional, technical):
        whole = whole.unionByName(other)
    return whole


def read_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk of the space below its two roots, with lists as text with bars between."""
    every = _space(spark, sf)
    pages = tree.crawl(every.select("page_id", "title", "parent_id"), ["tech", "func"], ["Artifacts"])
    bodies = every.where("html IS NOT NULL").select("page_id", "title", "html")  # as a page API gives them: none for a missing page
    chunks = space.read(pages, bodies)
    lists = [F.array_join(c, "|").alias(c) for c in ("feature", "db_ids", "consumed_by", "used_by")]
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ",")))), ";")
    names = ["collection", "doc_type", "page_id", "parent_id", "title", "content", "repo", "endpoint_id", "controller_id", "route", "store", "type", "db_collection", "db_id", "node_id"]
    return chunks.select(*names, *lists, meta.alias("metadata"))


READ_ALL_SQL = r"""WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN 'ep::' || n_name || '::' || o_orderkey END AS endpoint_id,
    CASE WHEN o_orderstatus = 'O' THEN 'Order ' || o_orderkey WHEN o_orderstatus = 'P' THEN 'POST /orders/' || o_orderkey ELSE 'GET /orders/' || o_orderkey END AS title
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority <> '5-LOW'),
used AS (SELECT n_name, o_custkey, string_agg(endpoint_id, '|' ORDER BY endpoint_id) AS used_by FROM o WHERE endpoint_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT DISTINCT o_orderpriority AS p FROM orders),
lf AS (SELECT chr(10) || chr(10) AS nn, chr(10) AS n),
parts AS (
  SELECT 'technical' AS collection, 'endpoint' AS doc_type, 'order-' || o_orderkey AS page_id, 'repos' AS parent_id, title, 'order-' || o_orderkey AS key,
    '# ' || title || nn || '# ' || title || nn || '**Metadata** — ' || CASE WHEN o_orderstatus = 'P' THEN 'docType: `endpoint` · ' ELSE '' END || coalesce('endpoint\_id: `' || endpoint_id || '` · ', '')
      || 'repo: `' || n_name || '` · controller: `' || o_custkey || '` · feature: `' || o_orderpriority || '` `all_orders`' || nn || '## Handled in' || nn || '* `File' || (o_custkey % 100) || '.cs:' || (o_orderkey % 500 + 1) || '`' || n || '* see [all\_orders](/orders)' AS content,
    n_name AS repo, endpoint_id, 'ctrl::' || n_name || '::' || o_custkey AS controller_id, title AS route, o_orderpriority || '|all_orders' AS feature, '' AS db_ids
  FROM o, lf
  UNION ALL BY NAME
  SELECT 'technical' AS collection, 'db-collection' AS doc_type, 'part-' || p_partkey AS page_id, 'stores' AS parent_id, title, 'part-' || p_partkey AS key,
    '# ' || title || nn || '# ' || trim(title) || nn || '**Metadata** — store: `' || p_brand || '` · type: `mongo`' || CASE WHEN p_size > 25 THEN ' · collection: `' || p_partkey || '`' ELSE '' END || nn || '| field | kind |' || n || '| --- | --- |' || n || '| size | ' || p_size || ' |' AS content,
    p_brand AS store, 'mongo' AS type, CASE WHEN p_size > 25 THEN p_partkey::VARCHAR END AS db_collection, CASE WHEN p_size > 25 THEN 'db::' || p_brand || '::' || p_partkey END AS db_id, '' AS consumed_by
  FROM (SELECT *, CASE WHEN p_size > 25 THEN p_name ELSE p_name || ' [mongo] ' END AS title FROM part), lf WHERE NOT starts_with(title, 'b')
  UNION ALL BY NAME
  SELECT 'technical' AS collection, 'controller-context' AS doc_type, 'nation-' || n_nationkey AS page_id, 'repos' AS parent_id, c_custkey::VARCHAR AS title, 'nation-' || n_nationkey || '::' || c_custkey AS key,
    '# ' || c_custkey || nn || c_mktsegment || ' & *more*' AS content, n.n_name AS repo, 'ctrl::' || n.n_name || '::' || c_custkey AS controller_id, coalesce(used_by, '') AS used_by
  FROM nation n JOIN customer ON c_nationkey = n_nationkey CROSS JOIN lf LEFT JOIN used ON used.n_name = n.n_name AND o_custkey = c_custkey
  UNION ALL BY NAME
  SELECT 'functional' AS collection, 'feature-hub' AS doc_type, 'hub-' || p AS page_id, 'features' AS parent_id, p AS title, 'hub-' || p AS key, '# ' || p || nn || '# ' || p || nn || '**Metadata** — feature: `' || p || '`' AS content, p AS feature FROM f, lf
  UNION ALL BY NAME
  SELECT 'technical' AS collection, 'technical-hub' AS doc_type, 'tech-' || p AS page_id, 'tech' AS parent_id, p || ' · Technical Hub' AS title, 'tech-' || p AS key, '# ' || p || ' · Technical Hub' || nn || '## ' || p || ' · Technical Hub' || nn || '**Metadata** — feature: `' || p || '`' AS content, p AS feature FROM f, lf
  UNION ALL BY NAME
  SELECT 'technical' AS collection, 'guide' AS doc_type, 'guide' AS page_id, 'tech' AS parent_id, 'Guide' AS title, 'guide' AS key, '# Guide' || nn || '**Metadata** - docType: `guide` · author: `a_b`' || nn || 'How to' AS content, 'author=a_b;docType=guide' AS metadata FROM lf)
SELECT collection, doc_type, page_id, parent_id, title, content, repo, endpoint_id, controller_id, route, store, type, db_collection, db_id, substr(sha256(doc_type || '|' || key || '|' || content), 1, 24) AS node_id,
  feature, db_ids, consumed_by, used_by, metadata FROM parts"""

QUERIES = {"read_all": (read_all, READ_ALL_SQL)}
