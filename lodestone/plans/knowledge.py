"""Queries of parsing, crawling, links, deltas, integrity, routing and registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import parse
from lodestone.functions.text import repo_of
from lodestone.operators import delta, integrity, links, registry, route, tree
from lodestone.plans.ranking import CHUNKS_SQL
from lodestone.sources.tables import ENTITY_SQL, document_chunks, entity_chunks, entity_pages, table

# --- parsing -----------------------------------------------------------------------------------------------------------


def _orders_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each order: pending ones name their type, open ones an endpoint id, others a store and collection only. Each has a field
    that its type doesn't know."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    fields = (
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("docType: `endpoint` · feature: `a\\_"), key, F.lit("` `b` · store: `no` · note")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("endpoint_id: `ep::x::"), key, F.lit("` · repo: `first` · repo: `x` · controller: `C` · db_ids: `db::m::a` `db::m::b` · consumed_by: `no`")))
        .otherwise(F.concat(F.lit("store: `s"), (F.col("o_custkey") % 7).cast("string"), F.lit("` · collection: `c` · type: `t` · consumed_by: `ep::x::1` `ep::x::2` · feature: `no`")))
    )
    head = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("# Page\n\n\n**Metadata** — "), fields)).otherwise(F.concat(F.lit("# Page\n**Metadata** — "), fields, F.lit("\n\nText")))
    title = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("GET /orders/"), key)).otherwise(F.concat(F.lit("Page "), key))
    return o.select("o_orderkey", head.alias("markdown"), title.alias("title"))


ORDERS_MD_SQL = r"""
f AS (SELECT *, CASE o_orderstatus WHEN 'P' THEN 'docType: `endpoint` · feature: `a\_' || o_orderkey || '` `b` · store: `no` · note'
                     WHEN 'O' THEN 'endpoint_id: `ep::x::' || o_orderkey || '` · repo: `first` · repo: `x` · controller: `C` · db_ids: `db::m::a` `db::m::b` · consumed_by: `no`'
                     ELSE 'store: `s' || (o_custkey % 7) || '` · collection: `c` · type: `t` · consumed_by: `ep::x::1` `ep::x::2` · feature: `no`' END AS fields FROM orders),
md AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '# Page' || chr(10) || chr(10) || chr(10) || '**Metadata** — ' || fields
                               ELSE '# Page' || chr(10) || '**Metadata** — ' || fields || chr(10) || chr(10) || 'Text' END AS markdown,
              CASE WHEN o_orderpriority = '5-LOW' THEN 'GET /orders/' || o_orderkey ELSE 'Page ' || o_orderkey END AS title FROM f),
line AS (SELECT o_orderkey, title, list_filter(string_split(markdown, chr(10))[1:3], lambda x: contains(x, '**Metadata**'))[1] AS line FROM md),
seg AS (SELECT o_orderkey, trim(unnest(string_split(replace(split_part(line, '**Metadata** — ', 2), '\_', '_'), '·'))) AS s, generate_subscripts(string_split(line, '·'), 1) AS i FROM line WHERE line IS NOT NULL),
kv AS (SELECT o_orderkey, i, split_part(s, ':', 1) AS k, regexp_extract_all(s, '`([^`]*)`', 1) AS v FROM seg),
meta AS (SELECT o_orderkey, k, arg_max(v, i) AS v FROM kv WHERE len(v) > 0 GROUP BY 1, 2)
"""


def metadata_parse(spark: SparkSession, sf: str) -> DataFrame:
    m = _orders_markdown(spark, sf).select("o_orderkey", F.explode(parse.metadata(F.col("markdown"))).alias("k", "v"))
    return m.select("o_orderkey", "k", F.array_join("v", "|").alias("v"))


METADATA_SQL = f"WITH {ORDERS_MD_SQL} SELECT o_orderkey, k, array_to_string(v, '|') AS v FROM meta"


def classify_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = _orders_markdown(spark, sf)
    kind = parse.page_type(parse.metadata(F.col("markdown")), F.col("title"), F.lit("Other"))
    return p.select("o_orderkey", kind.alias("doc_type")).where("doc_type IS NOT NULL")


CLASSIFY_SQL = rf"""WITH {ORDERS_MD_SQL}, k AS (SELECT o_orderkey, list(k) AS ks FROM meta GROUP BY 1),
c AS (SELECT o_orderkey, CASE WHEN list_contains(ks, 'docType') THEN 'endpoint' WHEN list_contains(ks, 'endpoint_id') THEN 'endpoint'
             WHEN list_contains(ks, 'store') AND list_contains(ks, 'collection') THEN 'db-collection' WHEN regexp_matches(title, '^(GET|POST|PUT|PATCH|DELETE)\s') THEN 'endpoint' END AS doc_type
      FROM md LEFT JOIN k USING (o_orderkey)) SELECT * FROM c WHERE doc_type IS NOT NULL"""


def build_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of each page's type, lists as text with bars between; empty for a list without values, null for what the type hasn't."""
    p = _orders_markdown(spark, sf).select("o_orderkey", "title", parse.metadata(F.col("markdown")).alias("m")).where("m IS NOT NULL")
    p = p.withColumn("doc_type", parse.page_type(F.col("m"), F.col("title"), F.lit(None).cast("string")))
    tags = parse.tags(F.col("m"), F.col("doc_type"), F.col("title"))
    return p.select("o_orderkey", "doc_type", *[(F.array_join(c, "|") if k in parse.LISTS else c).alias(k) for k, c in tags.items()])


def _tag_sql(doc_type: str, value: str, name: str) -> str:
    return f"CASE WHEN doc_type = '{doc_type}' THEN {value} END AS {name}"


_FIRST = "max(v[1]) FILTER (k = '{}')".format
_ALL = "coalesce(max(array_to_string(v, '|')) FILTER (k = '{}'), '')".format
TAGS_SQL = f"""WITH {ORDERS_MD_SQL}, g AS (SELECT o_orderkey, CASE WHEN bool_or(k IN ('docType', 'endpoint_id')) THEN 'endpoint' ELSE 'db-collection' END AS doc_type,
  {", ".join(f"{_FIRST(k)} AS f_{k}" for k in ("repo", "endpoint_id", "controller", "store", "type", "collection"))}, {", ".join(f"{_ALL(k)} AS l_{k}" for k in ("feature", "db_ids", "consumed_by"))} FROM meta GROUP BY 1)
SELECT o_orderkey, doc_type, {", ".join(_tag_sql("endpoint", v, n) for v, n in (("l_feature", "feature"), ("l_db_ids", "db_ids"), ("f_repo", "repo"), ("f_endpoint_id", "endpoint_id"), ("title", "route"), ("'ctrl::' || f_repo || '::' || f_controller", "controller_id")))},
  {", ".join(_tag_sql("db-collection", v, n) for v, n in (("l_consumed_by", "consumed_by"), ("f_store", "store"), ("f_type", "type"), ("f_collection", "db_collection"), ("'db::' || f_store || '::' || f_collection", "db_id")))} FROM g JOIN md USING (o_orderkey)"""


def _registry_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A registry page for each nation: a section for each of its customers. A page is a document, as long as a nation is."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    part = F.concat(F.lit("### "), F.col("c_custkey").cast("string"), F.lit("\n"), F.col("c_mktsegment"), F.lit("\n"))
    grouped = c.groupBy("n_name").agg(F.array_sort(F.collect_list(F.struct("c_custkey", part.alias("p")))).alias("ps"))
    body = F.array_join(F.transform("ps", lambda x: x["p"]), "\n")
    return grouped.select("n_name", F.concat(F.lit("# Registry\n\n## Controllers\n\n"), body, F.lit("\n## Other\n\n### no controller\n")).alias("markdown"))


def controller_sections(spark: SparkSession, sf: str) -> DataFrame:
    s = _registry_pages(spark, sf).select("n_name", F.posexplode(parse.controller_sections(F.col("markdown"))).alias("position", "s"))
    return s.select("n_name", "position", "s.name", "s.text")


SECTIONS_SQL = "SELECT n_name, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) - 1 AS position, c_custkey::VARCHAR AS name, c_mktsegment AS text FROM customer JOIN nation ON n_nationkey = c_nationkey"


def used_by_xref(spark: SparkSession, sf: str) -> DataFrame:
    """The endpoints of each controller section: sections and endpoints joined by repository and controller."""
    s = controller_sections(spark, sf).select(F.concat_ws("::", F.lit("ctrl"), "n_name", "name").alias("controller_id"))
    ep = entity_pages(spark, sf).where("doc_type = 'endpoint'").select("controller_id", "endpoint_id")
    ids = F.array_sort(F.collect_list("endpoint_id"))
    return s.join(ep, "controller_id", "left").groupBy("controller_id").agg(F.count("endpoint_id").alias("n"), F.array_join(ids, ",").alias("used_by"))


USED_BY_SQL = f"""WITH {ENTITY_SQL} SELECT 'ctrl::' || n_name || '::' || c_custkey AS controller_id, count(endpoint_id) AS n, coalesce(string_agg(endpoint_id, ',' ORDER BY endpoint_id), '') AS used_by
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN base ON controller_id = 'ctrl::' || n_name || '::' || c_custkey GROUP BY 1"""


def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", parse.html_to_markdown(F.col("html")).alias("markdown"))


def _html_sql() -> str:
    out = "regexp_replace(html, '<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<!--.*?-->', '', 'gis')"
    for n in range(1, 7):
        out = f"regexp_replace({out}, '<h{n}(\\s[^>]*)?>', chr(10) || '{'#' * n} ', 'gi')"
    out = f"regexp_replace({out}, '<li(\\s[^>]*)?>', chr(10) || '* ', 'gi')"
    out = f"regexp_replace({out}, '<br\\s*/?>|</p>|</h[1-6]>', chr(10), 'gi')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"SELECT page_id, regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS markdown FROM pages"


# --- tree --------------------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, customers and orders as a tree of pages."""
    t = lambda n: table(spark, sf, n)
    node = lambda df, kind, key, title, parent, above: df.select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("page_id"), F.col(title).cast("string").alias("title"), F.concat(F.lit(above), F.col(parent).cast("string")).alias("parent_id"))
    out = node(t("nation"), "n", "n_nationkey", "n_name", "n_regionkey", "r")
    out = out.unionByName(node(t("customer"), "c", "c_custkey", "c_mktsegment", "c_nationkey", "n"))
    return out.unionByName(node(t("orders"), "o", "o_orderkey", "o_orderpriority", "o_custkey", "c"))


def crawl_tree(spark: SparkSession, sf: str) -> DataFrame:
    return tree.crawl(_tree(spark, sf), ["r0", "r3"])


def crawl_excluded_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return tree.crawl(_tree(spark, sf), ["r0", "r3"], ["NATION_3", "FURNITURE", "5-LOW"])


def _crawl_sql(excluded: str) -> str:
    return f"""WITH RECURSIVE pages_ AS (SELECT 'n' || n_nationkey AS page_id, n_name AS title, 'r' || n_regionkey AS parent_id FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_mktsegment, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, o_orderpriority, 'c' || o_custkey FROM orders),
kept AS (SELECT * FROM pages_ WHERE title NOT IN ({excluded})),
walk AS (SELECT parent_id AS root, page_id, title, parent_id, 1 AS depth FROM kept WHERE parent_id IN ('r0', 'r3')
  UNION ALL SELECT w.root, p.page_id, p.title, p.parent_id, w.depth + 1 FROM walk w JOIN kept p ON p.parent_id = w.page_id) SELECT * FROM walk"""


# --- links -------------------------------------------------------------------------------------------------------------


def id_index(spark: SparkSession, sf: str) -> DataFrame:
    return links.id_index(entity_pages(spark, sf))


OWNED_SQL = f"""WITH {ENTITY_SQL}, idx AS (SELECT DISTINCT collection, key, node_id FROM (SELECT collection, node_id, unnest(list_concat([page_id], CASE doc_type WHEN 'endpoint' THEN [endpoint_id] WHEN 'controller-context' THEN [controller_id]
  WHEN 'db-collection' THEN [db_id] WHEN 'technical-hub' THEN feature ELSE []::VARCHAR[] END)) AS key FROM chunks) WHERE key <> '')"""


def resolve_citations(spark: SparkSession, sf: str) -> DataFrame:
    """What each endpoint, as the only hit, cites."""
    chunks = entity_chunks(spark, sf)
    hits = chunks.where("doc_type = 'endpoint'").withColumn("item_id", F.col("endpoint_id"))
    return links.citations(hits, links.owned(entity_pages(spark, sf)), "item_id").select("item_id", "cited", F.col("position").cast("long").alias("position"))


CITATIONS_SQL = f"""{OWNED_SQL}, l AS (SELECT endpoint_id AS item_id, node_id, collection, unnest(list_concat([controller_id], db_ids, feature)) AS key,
  generate_subscripts(list_concat([controller_id], db_ids, feature), 1) - 1 AS position FROM chunks WHERE doc_type = 'endpoint')
SELECT item_id, idx.node_id AS cited, min(position)::BIGINT AS position FROM l JOIN idx USING (collection, key) WHERE idx.node_id <> l.node_id GROUP BY 1, 2"""


def _asked_ids(chunks: DataFrame) -> DataFrame:
    """Endpoint ids, page ids of endpoints and of registry pages (each with many chunks), node ids of controllers, page ids of hubs, and one
    id that nothing owns."""
    ids = chunks.where("doc_type = 'endpoint'").select(F.explode(F.array("endpoint_id", "page_id")).alias("id"))
    ids = ids.unionByName(chunks.where("doc_type = 'controller-context'").select(F.col("page_id").alias("id")).distinct())
    ids = ids.unionByName(chunks.where("doc_type = 'controller-context'").select(F.col("node_id").alias("id")))
    ids = ids.unionByName(chunks.where("doc_type LIKE '%hub'").select(F.col("page_id").alias("id")))
    return ids.unionByName(chunks.sparkSession.createDataFrame([("ep::none::1",)], "id string"))


def expand_ids(spark: SparkSession, sf: str) -> DataFrame:
    chunks = entity_pages(spark, sf)
    return links.expand(_asked_ids(chunks), links.id_index(chunks), chunks)


EXPAND_SQL = f"""{OWNED_SQL}, ids AS (SELECT unnest([endpoint_id, page_id]) AS id FROM chunks WHERE doc_type = 'endpoint' UNION ALL SELECT DISTINCT page_id FROM chunks WHERE doc_type = 'controller-context' UNION ALL SELECT node_id FROM chunks WHERE doc_type = 'controller-context'
  UNION ALL SELECT page_id FROM chunks WHERE doc_type LIKE '%hub' UNION ALL SELECT 'ep::none::1'),
owned AS (SELECT id, collection, node_id FROM ids JOIN idx ON key = id),
open_ AS (SELECT id, collection FROM ids CROSS JOIN (SELECT DISTINCT collection FROM chunks) EXCEPT SELECT id, collection FROM owned),
expanded AS (SELECT * FROM owned UNION ALL SELECT o.id, o.collection, c.node_id FROM open_ o JOIN chunks c ON c.node_id = o.id AND c.collection = o.collection) SELECT * FROM expanded"""


def parent_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of conversations with their first turn as the parent's summary, unless a system turn, itself selected, is first."""
    c = table(spark, sf, "conversations").withColumn("chunk_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    selected = c.where("role = 'assistant' OR (role = 'system' AND turn = 0)").select("conv_id", "chunk_id", F.concat(F.col("conv_id").cast("string"), F.lit(":0")).alias("parent_id"))
    parents = c.where("turn = 0").select("chunk_id", F.col("text").alias("summary"))
    return links.parent_summaries(selected, parents, "conv_id").select("conv_id", "chunk_id", "parent_summary")


PARENT_SQL = """WITH s AS (SELECT conv_id, conv_id || ':' || turn AS chunk_id FROM conversations WHERE role = 'assistant' OR (role = 'system' AND turn = 0))
SELECT s.conv_id, chunk_id, CASE WHEN NOT EXISTS (SELECT 1 FROM s x WHERE x.chunk_id = s.conv_id || ':0') THEN p.text END AS parent_summary
FROM s LEFT JOIN conversations p ON p.conv_id = s.conv_id AND p.turn = 0"""


# --- delta -------------------------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes before and now. A page is a user's day; errors have been dropped since, and ten days have come."""
    e = table(spark, sf, "events")
    page = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    node = F.substring(F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props"), 256), 1, 24)
    collection = F.when(F.col("user_id") < 75, "functional").otherwise("technical")
    nodes = e.select("ts", "event_type", collection.alias("collection"), page.alias("page_id"), node.alias("node_id"))
    keep = ["collection", "page_id", "node_id"]
    return nodes.where("ts < timestamp_ntz'2024-01-21'").select(*keep), nodes.where("event_type <> 'error'").select(*keep)


SNAPSHOT_SQL = """nodes AS (SELECT ts, event_type, CASE WHEN user_id < 75 THEN 'functional' ELSE 'technical' END AS collection, user_id || ':' || strftime(ts, '%Y-%m-%d') AS page_id,
  substr(sha256(event_id || '|' || event_type || '|' || props), 1, 24) AS node_id FROM events),
b AS (SELECT collection, page_id, string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS old_ids FROM nodes WHERE ts < TIMESTAMP '2024-01-21' GROUP BY 1, 2),
n AS (SELECT collection, page_id, string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS new_ids FROM nodes WHERE event_type <> 'error' GROUP BY 1, 2)"""


def _delta(spark: SparkSession, sf: str, full: bool) -> DataFrame:
    before, now = _snapshots(spark, sf)
    changes = delta.plan(delta.state(before), delta.state(now), full)
    return changes.select("collection", "page_id", "change", F.array_join("old_ids", ",").alias("old_ids"), F.array_join("new_ids", ",").alias("new_ids"))


def delta_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _delta(spark, sf, False)


def delta_full(spark: SparkSession, sf: str) -> DataFrame:
    return _delta(spark, sf, True)


DELTA_SQL = f"""WITH {SNAPSHOT_SQL} SELECT collection, page_id, CASE WHEN old_ids IS NULL THEN 'added' WHEN new_ids IS NULL THEN 'removed' WHEN old_ids = new_ids THEN 'unchanged' ELSE 'changed' END AS change, old_ids, new_ids
FROM b FULL JOIN n USING (collection, page_id)"""
DELTA_FULL_SQL = f"WITH {SNAPSHOT_SQL} SELECT collection, page_id, 'added' AS change, NULL::VARCHAR AS old_ids, new_ids FROM n"


def delta_apply(spark: SparkSession, sf: str) -> DataFrame:
    before, now = _snapshots(spark, sf)
    return delta.apply(before, now, delta.plan(delta.state(before), delta.state(now)))


DELTA_APPLY_SQL = f"WITH {SNAPSHOT_SQL} SELECT collection, page_id, node_id FROM nodes WHERE event_type <> 'error'"


# --- integrity ---------------------------------------------------------------------------------------------------------


def _integrity(rule, doc_types: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return rule(entity_chunks(spark, sf).where(doc_types))

    return query


def integrity_size(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.sizes(document_chunks(spark, sf).withColumn("node_id", F.col("doc_id").cast("string")))


SIZE_SQL = f"""WITH {CHUNKS_SQL}, s AS (SELECT doc_id::VARCHAR AS place, content LIKE '%\\_[... truncated]\\_' ESCAPE '\\' AS cut, length(content) AS n FROM chunks)
SELECT 'error' AS severity, place, 'truncated' AS message FROM s WHERE cut UNION ALL SELECT 'warn', place, 'near the cap' FROM s WHERE NOT cut AND n >= 6400"""


def _findings_sql(rules: list[tuple[str, str, str]], where: str, more: str = "") -> str:
    parts = [f"SELECT '{s}' AS severity, node_id AS place, '{m}' AS message FROM chunks WHERE {where} AND ({w})" for s, m, w in rules]
    return f"WITH {ENTITY_SQL} " + " UNION ALL ".join(parts) + more


_EP, _CTRL, _DB = (p.replace("'", "''") for p in (integrity.ENDPOINT_ID, integrity.CONTROLLER_ID, integrity.DB_ID))
EP_SQL = _findings_sql(
    [
        ("error", "endpoint_id missing", "coalesce(endpoint_id, '') = ''"),
        ("error", "endpoint_id malformed", f"endpoint_id <> '' AND NOT regexp_matches(endpoint_id, '{_EP}')"),
        ("error", "controller_id missing", "coalesce(controller_id, '') = ''"),
        ("error", "controller_id malformed", f"controller_id <> '' AND NOT regexp_matches(controller_id, '{_CTRL}')"),
        ("error", "repo missing", "coalesce(repo, '') = ''"),
        ("warn", "feature empty", "len(feature) = 0"),
        ("error", "route missing", "coalesce(route, '') = ''"),
        ("warn", "db_ids empty", "len(db_ids) = 0"),
    ],
    "doc_type = 'endpoint'",
    f" UNION ALL SELECT 'error', node_id, 'db_ids malformed: ' || d FROM (SELECT node_id, unnest(db_ids) AS d FROM chunks WHERE doc_type = 'endpoint') WHERE NOT regexp_matches(d, '{_DB}')",
)
DB_SQL = _findings_sql([*[("error", f"{c} missing", f"coalesce({c}, '') = ''") for c in ("store", "type", "db_collection", "db_id")], ("error", "db_id malformed", f"db_id <> '' AND NOT regexp_matches(db_id, '{_DB}')")], "doc_type = 'db-collection'")
CTRL_SQL = _findings_sql([("error", "controller_id missing", "coalesce(controller_id, '') = ''"), ("error", "controller_id malformed", f"controller_id <> '' AND NOT regexp_matches(controller_id, '{_CTRL}')"), ("warn", "used_by empty", "len(used_by) = 0")], "doc_type = 'controller-context'")
HUB_SQL = _findings_sql([("error", "feature empty", "len(feature) = 0")], "doc_type LIKE '%hub'")
XREF_BODY = f"""ep AS (SELECT * FROM chunks WHERE doc_type = 'endpoint'), c AS (SELECT * FROM chunks WHERE doc_type = 'controller-context'), d AS (SELECT * FROM chunks WHERE doc_type = 'db-collection'),
td AS (SELECT * FROM (SELECT node_id, unnest(db_ids) AS db_id FROM ep) WHERE regexp_matches(db_id, '{_DB}')), epc AS (SELECT * FROM ep WHERE regexp_matches(controller_id, '{_CTRL}')), back AS (SELECT node_id, controller_id, unnest(used_by) AS endpoint_id FROM c), used AS (SELECT DISTINCT unnest(feature) AS f FROM chunks WHERE doc_type IN ('endpoint', 'technical-hub')),
xref AS (SELECT 'error' AS severity, node_id AS place, 'no controller ' || controller_id AS message FROM ep WHERE regexp_matches(controller_id, '{_CTRL}') AND controller_id NOT IN (SELECT controller_id FROM c)
UNION ALL SELECT 'error', node_id, 'no database ' || db_id FROM td WHERE db_id NOT IN (SELECT db_id FROM d)
UNION ALL SELECT 'warn', node_id, 'no endpoint ' || endpoint_id FROM back WHERE endpoint_id NOT IN (SELECT endpoint_id FROM ep WHERE regexp_matches(endpoint_id, '{_EP}'))
UNION ALL SELECT 'error', node_id, 'not listed by ' || controller_id FROM epc WHERE controller_id IN (SELECT controller_id FROM c) AND NOT EXISTS (SELECT 1 FROM back b WHERE b.controller_id = epc.controller_id AND b.endpoint_id = epc.endpoint_id)
UNION ALL SELECT 'warn', node_id, 'lists, but is not used by ' || endpoint_id FROM back b WHERE NOT EXISTS (SELECT 1 FROM epc WHERE b.controller_id = epc.controller_id AND b.endpoint_id = epc.endpoint_id)
UNION ALL SELECT 'warn', node_id, 'unreferenced ' || db_id FROM d WHERE db_id NOT IN (SELECT db_id FROM td)
UNION ALL SELECT 'warn', f, 'no feature hub for ' || f FROM used WHERE f NOT IN (SELECT unnest(feature) FROM chunks WHERE doc_type = 'feature-hub')
UNION ALL SELECT 'error', f, 'no technical hub for ' || f FROM used WHERE f NOT IN (SELECT unnest(feature) FROM chunks WHERE doc_type = 'technical-hub'))"""


def integrity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.check(entity_chunks(spark, sf)).groupBy("severity").agg(F.count("*").alias("n"))


SUMMARY_SQL = f"WITH {ENTITY_SQL}, {XREF_BODY}, " + ", ".join(f"f{i} AS (SELECT * FROM ({sql.replace(f'WITH {ENTITY_SQL} ', '')}))" for i, sql in enumerate((EP_SQL, DB_SQL, CTRL_SQL, HUB_SQL))) + " SELECT severity, count(*) AS n FROM (SELECT severity FROM xref UNION ALL SELECT severity FROM f0 UNION ALL SELECT severity FROM f1 UNION ALL SELECT severity FROM f2 UNION ALL SELECT severity FROM f3) GROUP BY 1"


def db_mapping_check(spark: SparkSession, sf: str) -> DataFrame:
    """Databases that an endpoint names, but doesn't cite once its links are resolved; endpoints without any are warned of."""
    chunks = entity_chunks(spark, sf)
    ep = chunks.where("doc_type = 'endpoint'")
    pages = entity_pages(spark, sf)
    cited = links.citations(ep.withColumn("item_id", F.col("endpoint_id")), links.owned(pages), "item_id")
    has = cited.join(pages.where("db_id IS NOT NULL").select(F.col("node_id").alias("cited"), "db_id"), "cited").select(F.col("item_id").alias("endpoint_id"), "db_id")
    lost = ep.select("endpoint_id", F.explode("db_ids").alias("db_id")).join(has, ["endpoint_id", "db_id"], "left_anti").select(F.lit("error").alias("severity"), F.col("endpoint_id").alias("place"), F.col("db_id").alias("message"))
    return lost.unionByName(ep.where(F.size("db_ids") == 0).select(F.lit("warn").alias("severity"), F.col("endpoint_id").alias("place"), F.lit("no database expected").alias("message")))


DB_MAPPING_SQL = f"""WITH {ENTITY_SQL} SELECT 'error' AS severity, endpoint_id AS place, db_id AS message FROM (SELECT endpoint_id, unnest(db_ids) AS db_id FROM chunks WHERE doc_type = 'endpoint')
WHERE db_id NOT IN (SELECT db_id FROM chunks WHERE doc_type = 'db-collection') UNION ALL SELECT 'warn', endpoint_id, 'no database expected' FROM chunks WHERE doc_type = 'endpoint' AND len(db_ids) = 0"""


def expand_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every id that is looked up: how many chunks it gives, of which type, and whether all have content."""
    chunks = entity_pages(spark, sf)
    ids = _asked_ids(chunks)
    found = links.expand(ids, links.id_index(chunks), chunks).join(chunks.select("collection", "node_id", "doc_type", "content"), ["collection", "node_id"])
    out = ids.join(found, "id", "left").groupBy("id").agg(F.count("node_id").alias("n"), F.min("doc_type").alias("doc_type"), F.coalesce(F.bool_and(F.col("content") != ""), F.lit(False)).alias("has_content"))
    return out


EXPAND_CHECK_SQL = EXPAND_SQL.replace(" SELECT * FROM expanded", "") + " SELECT ids.id, count(e.node_id) AS n, min(doc_type) AS doc_type, coalesce(bool_and(content <> ''), false) AS has_content FROM ids LEFT JOIN expanded e ON e.id = ids.id LEFT JOIN chunks c ON c.node_id = e.node_id AND c.collection = e.collection GROUP BY 1"


# --- routing -----------------------------------------------------------------------------------------------------------


def _routing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Derived repositories, registered ones (nations outside region 0) and questions: each customer asks for its endpoints."""
    ep = entity_chunks(spark, sf).where("doc_type = 'endpoint'").withColumn("item_id", F.col("controller_id"))
    ids = F.concat(F.array("endpoint_id", "controller_id"), "db_ids")
    registered = table(spark, sf, "nation").where("n_regionkey <> 0").select(F.col("n_name").alias("repo"))
    return route.derive(ep.select("item_id", ids.alias("ids"), "content")), registered, ep.select("item_id").distinct()


def _shown(routed: DataFrame) -> DataFrame:
    return routed.select("item_id", "repo", "fallback", F.array_join("files", ",").alias("files"), F.array_join("symbols", ",").alias("symbols"))


def route_repos(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(route.route(*_routing(spark, sf)))


def route_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return route.route(*_routing(spark, sf)).where("fallback").groupBy("item_id").agg(F.count("*").alias("n_repos"))


ROUTE_BODY = f"""WITH {ENTITY_SQL}, reg AS (SELECT n_name AS repo FROM nation WHERE n_regionkey <> 0), ep AS (SELECT * FROM chunks WHERE doc_type = 'endpoint'),
sym AS (SELECT controller_id AS item_id, repo, split_part(endpoint_id, '::', 3) AS s FROM ep),
ss AS (SELECT item_id, repo, string_agg(DISTINCT s, ',' ORDER BY s) AS symbols FROM sym GROUP BY 1, 2),
fs AS (SELECT controller_id AS item_id, repo, string_agg(DISTINCT regexp_extract(content, '\\b([\\w.]+\\.cs):(\\d+)\\b', 1), ',' ORDER BY regexp_extract(content, '\\b([\\w.]+\\.cs):(\\d+)\\b', 1)) AS files FROM ep GROUP BY 1, 2),
good AS (SELECT item_id, repo, false AS fallback, files, symbols FROM ss JOIN fs USING (item_id, repo) WHERE repo IN (SELECT repo FROM reg)),
routed AS (SELECT * FROM good UNION ALL SELECT item_id, reg.repo, true, '', '' FROM (SELECT DISTINCT controller_id AS item_id FROM ep) CROSS JOIN reg WHERE item_id NOT IN (SELECT item_id FROM good))"""


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer pins its own nation and one that doesn't exist."""
    items = _routing(spark, sf)[2]
    return items.select("item_id", F.explode(F.array(repo_of(F.col("item_id")), F.lit("NOWHERE"))).alias("repo"))


def route_pinned(spark: SparkSession, sf: str) -> DataFrame:
    _, registered, questions = _routing(spark, sf)
    return _shown(route.pinned(_wanted(spark, sf), registered, questions))


PINNED_SQL = f"""{ROUTE_BODY}, own AS (SELECT DISTINCT item_id, split_part(item_id, '::', 2) AS repo FROM sym), pin AS (SELECT * FROM own WHERE repo IN (SELECT repo FROM reg))
SELECT item_id, repo, false AS fallback, '' AS files, '' AS symbols FROM pin UNION ALL SELECT item_id, reg.repo, true, '', '' FROM (SELECT DISTINCT item_id FROM own WHERE item_id NOT IN (SELECT item_id FROM pin)) CROSS JOIN reg"""


def routing_eval(spark: SparkSession, sf: str) -> DataFrame:
    """For each customer: whether exactly its own nation is routed to, or all by fallback where it isn't registered."""
    derived, registered, questions = _routing(spark, sf)
    routed = route.route(derived, registered, questions)
    got = routed.groupBy("item_id").agg(F.array_sort(F.collect_set("repo")).alias("repos"), F.bool_or("fallback").alias("fallback"))
    known = registered.select(F.col("repo").alias("own"), F.lit(True).alias("known"))
    out = got.withColumn("own", repo_of(F.col("item_id"))).join(known, "own", "left")
    passed = F.when(F.coalesce("known", F.lit(False)), (F.size("repos") == 1) & (F.element_at("repos", 1) == F.col("own")) & ~F.col("fallback")).otherwise(F.col("fallback"))
    return out.select("item_id", F.size("repos").cast("long").alias("n_repos"), "fallback", passed.alias("passed"))


ROUTING_EVAL_SQL = f"""{ROUTE_BODY}, g AS (SELECT item_id, count(DISTINCT repo) AS n_repos, bool_or(fallback) AS fallback, min(repo) AS first FROM routed GROUP BY 1)
SELECT item_id, n_repos, fallback, CASE WHEN split_part(item_id, '::', 2) IN (SELECT repo FROM reg) THEN n_repos = 1 AND first = split_part(item_id, '::', 2) AND NOT fallback ELSE fallback END AS passed FROM g"""


def citation_check(spark: SparkSession, sf: str) -> DataFrame:
    """Files and lines that endpoints cite (urgent orders one more), in registered nations, against the files of the nation (one for each of its
    customers outside furniture, in a folder for the segment) and the lines that a probe of the page returns (its line items)."""
    ep = entity_chunks(spark, sf).where("doc_type = 'endpoint'")
    number = F.regexp_extract("page_id", r"order-(\d+)", 1).cast("long")
    more = F.concat(F.lit(" and File"), (number % 90).cast("string"), F.lit(".cs:"), (number % 300 + 1).cast("string"))
    ep = ep.withColumn("content", F.when(F.array_contains("feature", "1-URGENT"), F.concat("content", more)).otherwise(F.col("content")))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    path = lambda key: F.concat(F.lit("src/"), "c_mktsegment", F.lit("/File"), (F.col(key) % 100).cast("string"), F.lit(".cs"))
    files = c.where("c_mktsegment <> 'FURNITURE'").select(F.col("n_name").alias("repo"), path("c_custkey").alias("file_path"))
    o = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    start = F.col("l_linenumber") * 60
    ranges = o.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("page_id"), F.col("n_name").alias("repo"), path("o_custkey").alias("file_path"), start.alias("start_line"), F.when(F.col("l_returnflag") != "R", start + 40).alias("end_line"))
    registered = table(spark, sf, "nation").where("n_regionkey <> 0").select(F.col("n_name").alias("repo"))
    return route.stale_citations(route.cited_lines(ep, registered), files, ranges).drop("node_id")


CITATION_SQL = """WITH o AS (SELECT o_orderkey, 'order-' || o_orderkey AS page_id, n_name AS repo, o_custkey, o_orderpriority, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 0),
c AS (SELECT DISTINCT o_orderkey, page_id, repo, f, line FROM (SELECT o_orderkey, page_id, repo, o_custkey % 100 AS f, o_orderkey % 500 + 1 AS line FROM o UNION ALL SELECT o_orderkey, page_id, repo, o_orderkey % 90, o_orderkey % 300 + 1 FROM o WHERE o_orderpriority = '1-URGENT')),
k AS (SELECT DISTINCT n_name AS repo, c_custkey % 100 AS f FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment <> 'FURNITURE'),
r AS (SELECT o_orderkey, o_custkey % 100 AS f, l_linenumber * 60 AS a FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R')
SELECT page_id, repo, 'File' || f || '.cs' AS file, line, CASE WHEN (repo, f) NOT IN (SELECT (repo, f) FROM k) THEN 'no such file' ELSE 'line not in any chunk' END AS reason FROM c
WHERE (repo, f) NOT IN (SELECT (repo, f) FROM k) OR (EXISTS (SELECT 1 FROM r WHERE r.o_orderkey = c.o_orderkey AND r.f = c.f) AND NOT EXISTS (SELECT 1 FROM r WHERE r.o_orderkey = c.o_orderkey AND r.f = c.f AND line BETWEEN a AND a + 40))"""


# --- registry ----------------------------------------------------------------------------------------------------------

#: Manifests with every fault there is, in the order they are loaded.
MANIFESTS = [
    (1, 1, "a", "A", "/a", "run a", None),
    (2, 2, "b", "B", "/b", None, "/idx/b"),
    (3, 2, "c", "C", "/c", None, None),
    (4, 3, "d", "D", "/d", "run d", None),
    (5, 1, "e", "E", "/e", None, "/idx/e"),
    (6, 2, "a", "A again", "/a2", "run a2", None),
    (7, 2, "f", "F", "/f", "run f", "/idx/b"),
    (8, 2, "", "no key", "/g", "run g", None),
    (9, None, "h", "H", "/h", "run h", None),
]


def _manifests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANIFESTS, registry.SCHEMA)


def manifest_rules(spark: SparkSession, sf: str) -> DataFrame:
    return registry.rules(_manifests(spark)).select("position", "repoKey", "error")


_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in m) + ")" for m in MANIFESTS)
RULES_BODY = f"""m(position, version, "repoKey", display, root, serve, idx) AS (VALUES {_VALUES}),
r AS (SELECT *, CASE WHEN version IS NULL OR version NOT IN (1, 2) THEN 'unsupported contractVersion' WHEN coalesce("repoKey", '') = '' THEN 'repoKey missing'
  WHEN version = 1 AND (serve IS NULL OR idx IS NOT NULL) THEN 'version 1 needs serve and allows no index' WHEN version = 2 AND serve IS NULL AND idx IS NULL THEN 'version 2 needs serve or index' END AS error FROM m)"""


def registry_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return registry.conflicts(_manifests(spark)).select("position", "repoKey", "conflict")


CONFLICT_SQL = f"""WITH {RULES_BODY}, g AS (SELECT *, row_number() OVER (PARTITION BY "repoKey" ORDER BY position) AS k FROM r WHERE error IS NULL)
SELECT position, "repoKey", CASE WHEN k > 1 THEN 'duplicate repoKey' WHEN idx IS NOT NULL AND row_number() OVER (PARTITION BY CASE WHEN k = 1 THEN idx END ORDER BY position) > 1 THEN 'persistDir in use' END AS conflict FROM g"""


def manifest_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Page ids in JSON manifests (here one for each nation, naming itself and its successor, with another id in a text and one that is no
    text) that the crawl of two trees lacks; every customer's manifest holds its page's id three lists deep, and orders' ones are cut off."""
    k = F.col("n_nationkey")
    docs = table(spark, sf, "nation").select(F.concat(F.lit('{"x": {"rootPageId": "n'), k.cast("string"), F.lit('", "note": "\\"pageId\\": \\"n998\\""}, "pageid": "n'), (k + 1).cast("string"), F.lit('", "other": "n999", "oldPageID": 7}')).alias("json"))
    c = table(spark, sf, "customer").select(F.concat(F.lit('[[[{"PAGEID":"c'), F.col("c_custkey").cast("string"), F.lit('"}]]]')).alias("json"))
    docs = docs.unionByName(c).unionByName(table(spark, sf, "orders").select(F.lit('{"pageId": "cut"').alias("json")))
    return registry.audit(docs, crawl_tree(spark, sf))


AUDIT_SQL = """SELECT DISTINCT 'n' || k AS page_id FROM (SELECT unnest([n_nationkey, n_nationkey + 1]) AS k FROM nation) WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 3))
UNION ALL SELECT 'c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey NOT IN (0, 3)"""


QUERIES = {
    "metadata_parse": (metadata_parse, METADATA_SQL),
    "classify_pages": (classify_pages, CLASSIFY_SQL),
    "build_tags": (build_tags, TAGS_SQL),
    "controller_sections": (controller_sections, SECTIONS_SQL),
    "used_by_xref": (used_by_xref, USED_BY_SQL),
    "html_to_markdown": (html_to_markdown, _html_sql()),
    "crawl_tree": (crawl_tree, _crawl_sql("''")),
    "crawl_excluded_subtree": (crawl_excluded_subtree, _crawl_sql("'NATION_3', 'FURNITURE', '5-LOW'")),
    "id_index": (id_index, f"{OWNED_SQL} SELECT * FROM idx"),
    "resolve_citations": (resolve_citations, CITATIONS_SQL),
    "expand_ids": (expand_ids, EXPAND_SQL),
    "parent_summary": (parent_summary, PARENT_SQL),
    "delta_plan": (delta_plan, DELTA_SQL),
    "delta_full": (delta_full, DELTA_FULL_SQL),
    "delta_apply": (delta_apply, DELTA_APPLY_SQL),
    "integrity_size": (integrity_size, SIZE_SQL),
    "integrity_endpoint": (_integrity(integrity.endpoints, "doc_type = 'endpoint'"), EP_SQL),
    "integrity_db": (_integrity(integrity.databases, "doc_type = 'db-collection'"), DB_SQL),
    "integrity_controller": (_integrity(integrity.controllers, "doc_type = 'controller-context'"), CTRL_SQL),
    "integrity_hub": (_integrity(integrity.hubs, "doc_type LIKE '%hub'"), HUB_SQL),
    "integrity_xref": (_integrity(integrity.references, "true"), f"WITH {ENTITY_SQL}, {XREF_BODY} SELECT * FROM xref"),
    "integrity_summary": (integrity_summary, SUMMARY_SQL),
    "db_mapping_check": (db_mapping_check, DB_MAPPING_SQL),
    "expand_check": (expand_check, EXPAND_CHECK_SQL),
    "route_repos": (route_repos, f"{ROUTE_BODY} SELECT * FROM routed"),
    "route_fallback": (route_fallback, f"{ROUTE_BODY} SELECT item_id, count(*) AS n_repos FROM routed WHERE fallback GROUP BY 1"),
    "route_pinned": (route_pinned, PINNED_SQL),
    "routing_eval": (routing_eval, ROUTING_EVAL_SQL),
    "citation_check": (citation_check, CITATION_SQL),
    "manifest_rules": (manifest_rules, f'WITH {RULES_BODY} SELECT position, "repoKey", error FROM r'),
    "registry_conflicts": (registry_conflicts, CONFLICT_SQL),
    "manifest_audit": (manifest_audit, AUDIT_SQL),
}
