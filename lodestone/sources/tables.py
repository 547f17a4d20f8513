"""The driver's tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import chunk_id, chunk_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the language plays the type, the source the repository; Spanish ones are the functional collection."""
    d = table(spark, sf_dir, "documents")
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    d = d.select("doc_id", F.col("lang").alias("doc_type"), F.col("source").alias("repo"), title.alias("title"), chunk_text(title, F.coalesce("text", F.lit(""))).alias("content"))
    collection = F.when(F.col("doc_type") == "es", "functional").otherwise("technical")
    return d.withColumn("collection", collection).withColumn("node_id", chunk_id(F.col("doc_type"), F.col("doc_id").cast("string"), F.col("content")))


ENTITY_FIELDS = ["doc_type", "collection", "page_id", "title", "content", "repo", "feature", "endpoint_id", "controller_id", "db_ids", "route", "used_by", "store", "type", "db_collection", "db_id", "node_id"]


def _marked(column: str, n: int, before: str, behind: str) -> F.Column:
    """A key as text, malformed where n divides it."""
    text = F.col(column).cast("string")
    return F.when(F.col(column) % n == 0, F.concat(F.lit(before), text, F.lit(behind))).otherwise(text)


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their nation as repository, and the ids of endpoint and controller."""
    t = lambda name: table(spark, sf_dir, name)
    base = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    ids = F.concat_ws("::", F.lit("ep"), "n_name", _marked("o_orderkey", 97, "{", "}")), F.concat_ws("::", F.lit("ctrl"), "n_name", _marked("o_custkey", 89, "[", "]"))
    return base.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("n_name").alias("repo"), ids[0].alias("endpoint_id"), ids[1].alias("controller_id"))


def entity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of entity_pages(), with their links."""
    return entity_links(spark, sf_dir, entity_pages(spark, sf_dir)).select(*ENTITY_FIELDS)


def entity_links(spark: SparkSession, sf_dir: str, pages: DataFrame, some: bool = False) -> DataFrame:
    """Pages (doc_type, key, ...) with what they link to: db_ids of endpoints, used_by of controllers. `some`: they aren't all there are, so
    orders and line items are first reduced to theirs."""
    none = F.array().cast("array<string>")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("::", F.lit("db"), "p_brand", _marked("p_partkey", 83, "/", "")).alias("db_id"))
    lines, uses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_partkey"), _endpoints(spark, sf_dir).where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("key"), "endpoint_id")
    ep, ctrl = pages.where("doc_type = 'endpoint'"), pages.where("doc_type = 'controller-context'")
    if some:
        lines, uses = lines.join(ep.select("key").distinct(), "key", "left_semi"), uses.join(ctrl.select("key").distinct(), "key", "left_semi")
    dbs = lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).groupBy("key").agg(F.array_sort(F.collect_set("db_id")).alias("db_ids"))
    uses = uses.groupBy("key").agg(F.array_sort(F.collect_set("endpoint_id")).alias("used_by"))
    ep = ep.join(dbs, "key", "left").withColumn("db_ids", F.coalesce("db_ids", none))
    ctrl = ctrl.join(uses, "key", "left").withColumn("used_by", F.coalesce("used_by", none))
    return ep.unionByName(ctrl, allowMissingColumns=True).unionByName(pages.where("doc_type NOT IN ('endpoint', 'controller-context')"), allowMissingColumns=True)


def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as endpoints, customers as controllers, parts as databases, priorities as features.

    Some of what a real knowledge base lacks is lacking here too: furniture customers and parts of size 1 have no chunk,
    pending orders no route, and finished orders aren't listed by their controller. Some ids are malformed (orders by 97, customers
by 89, parts by 83), parts of size 2 have no store, those of size 3 no type, and one feature hub has no feature. `key` is that of the table."""
    t = lambda name: table(spark, sf_dir, name)
    s = lambda c: F.col(c).cast("string")
    none = F.array().cast("array<string>")
    title = F.concat(F.lit("Order "), s("o_orderkey"))
    ep = _endpoints(spark, sf_dir).select(
        F.col("o_orderkey").alias("key"),
        F.lit("endpoint").alias("doc_type"),
        F.lit("technical").alias("collection"),
        F.concat(F.lit("order-"), s("o_orderkey")).alias("page_id"),
        title.alias("title"),
        F.concat(F.lit("# "), title, F.lit("\n\nHandled in File"), (F.col("o_custkey") % 100).cast("string"), F.lit(".cs:"), (F.col("o_orderkey") % 500 + 1).cast("string")).alias("content"),
        "repo",
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), none).otherwise(F.array("o_orderpriority")).alias("feature"),
        "endpoint_id",
        "controller_id",
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("GET /orders/"), s("o_orderkey"))).alias("route"),
    )
    owner = t("customer").where("c_mktsegment <> 'FURNITURE'").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    ctrl = owner.select(
        F.col("c_custkey").alias("key"),
        F.lit("controller-context").alias("doc_type"),
        F.lit("technical").alias("collection"),
        F.concat(F.lit("repo-"), "n_name").alias("page_id"),
        F.col("c_name").alias("title"),
        F.concat(F.lit("# "), "c_name", F.lit("\n\n"), "c_mktsegment").alias("content"),
        F.col("n_name").alias("repo"),
        F.concat_ws("::", F.lit("ctrl"), "n_name", _marked("c_custkey", 89, "[", "]")).alias("controller_id"),
    )
    db = t("part").where("p_size > 1").select(
        F.lit("db-collection").alias("doc_type"),
        F.lit("technical").alias("collection"),
        F.concat(F.lit("part-"), s("p_partkey")).alias("page_id"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("# "), "p_name", F.lit("\n\n"), "p_type").alias("content"),
        F.when(F.col("p_size") != 2, F.col("p_brand")).alias("store"),
        F.when(F.col("p_size") == 3, "").otherwise(F.col("p_type")).alias("type"),
        s("p_partkey").alias("db_collection"),
        F.concat_ws("::", F.lit("db"), "p_brand", _marked("p_partkey", 83, "/", "")).alias("db_id"),
    )
    features = t("orders").select("o_orderpriority").distinct()

    def hub(kind: str, collection: str, without: str) -> DataFrame:
        p = F.col("o_orderpriority")
        return features.where(p != without).select(
            F.lit(kind).alias("doc_type"), F.lit(collection).alias("collection"), F.concat(F.lit(kind + "-"), p).alias("page_id"), p.alias("title"), F.concat(F.lit("# "), p).alias("content"), F.when((F.lit(kind) == "feature-hub") & (p == "3-MEDIUM"), none).otherwise(F.array(p)).alias("feature")
        )

    parts = [ep, ctrl, db, hub("feature-hub", "functional", "5-LOW"), hub("technical-hub", "technical", "1-URGENT")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.withColumn("node_id", chunk_id(F.col("doc_type"), F.concat_ws("/", "page_id", "title"), F.col("content")))


#: The same chunks in SQL, as common table expressions that end in `chunks`.
ENTITY_SQL = """
base AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, n_name AS repo, 'ep::' || n_name || '::' || CASE WHEN o_orderkey % 97 = 0 THEN '{' || o_orderkey || '}' ELSE o_orderkey::VARCHAR END AS endpoint_id,
                'ctrl::' || n_name || '::' || CASE WHEN o_custkey % 89 = 0 THEN '[' || o_custkey || ']' ELSE o_custkey::VARCHAR END AS controller_id
         FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
dbs AS (SELECT l_orderkey AS o_orderkey, list(DISTINCT 'db::' || p_brand || '::' || CASE WHEN p_partkey % 83 = 0 THEN '/' || p_partkey ELSE p_partkey::VARCHAR END ORDER BY 'db::' || p_brand || '::' || CASE WHEN p_partkey % 83 = 0 THEN '/' || p_partkey ELSE p_partkey::VARCHAR END) AS db_ids
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
listed AS (SELECT o_custkey, list(DISTINCT endpoint_id ORDER BY endpoint_id) AS used_by FROM base WHERE o_orderstatus <> 'F' GROUP BY 1),
parts AS (
    SELECT 'endpoint' AS doc_type, 'technical' AS collection, 'order-' || o_orderkey AS page_id, 'Order ' || o_orderkey AS title,
           '# Order ' || o_orderkey || chr(10) || chr(10) || 'Handled in File' || (o_custkey % 100) || '.cs:' || (o_orderkey % 500 + 1) AS content, repo,
           CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN []::VARCHAR[] ELSE [o_orderpriority] END AS feature,
           endpoint_id, controller_id, coalesce(db_ids, []::VARCHAR[]) AS db_ids,
           CASE WHEN o_orderstatus <> 'P' THEN 'GET /orders/' || o_orderkey END AS route
    FROM base LEFT JOIN dbs USING (o_orderkey)
    UNION ALL BY NAME
    SELECT 'controller-context' AS doc_type, 'technical' AS collection, 'repo-' || n_name AS page_id, c_name AS title,
           '# ' || c_name || chr(10) || chr(10) || c_mktsegment AS content, n_name AS repo, 'ctrl::' || n_name || '::' || CASE WHEN c_custkey % 89 = 0 THEN '[' || c_custkey || ']' ELSE c_custkey::VARCHAR END AS controller_id,
           coalesce(used_by, []::VARCHAR[]) AS used_by
    FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN listed ON o_custkey = c_custkey WHERE c_mktsegment <> 'FURNITURE'
    UNION ALL BY NAME
    SELECT 'db-collection' AS doc_type, 'technical' AS collection, 'part-' || p_partkey AS page_id, p_name AS title,
           '# ' || p_name || chr(10) || chr(10) || p_type AS content, CASE WHEN p_size <> 2 THEN p_brand END AS store, CASE WHEN p_size = 3 THEN '' ELSE p_type END AS type, p_partkey::VARCHAR AS db_collection,
           'db::' || p_brand || '::' || CASE WHEN p_partkey % 83 = 0 THEN '/' || p_partkey ELSE p_partkey::VARCHAR END AS db_id
    FROM part WHERE p_size > 1
    UNION ALL BY NAME
    SELECT 'feature-hub' AS doc_type, 'functional' AS collection, 'feature-hub-' || p AS page_id, p AS title, '# ' || p AS content, CASE WHEN p = '3-MEDIUM' THEN []::VARCHAR[] ELSE [p] END AS feature
    FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) WHERE p <> '5-LOW'
    UNION ALL BY NAME
    SELECT 'technical-hub' AS doc_type, 'technical' AS collection, 'technical-hub-' || p AS page_id, p AS title, '# ' || p AS content, [p] AS feature
    FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) WHERE p <> '1-URGENT'),
chunks AS (SELECT *, substr(sha256(doc_type || '|' || page_id || '/' || title || '|' || content), 1, 24) AS node_id FROM parts)
"""
