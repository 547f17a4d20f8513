"""Queries over linked chunks: hits with citations, routing by what hits cite, the code stage with hints, and their checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.config import CodeIndex, Retrieval
from lodestone.operators import answer, lexical, links, registry
from lodestone.sources import shared
from lodestone.sources.tables import ENTITY_SQL, entity_links, entity_pages, table

DOCS = Retrieval()
SCOPED = replace(DOCS, top_k=5, quota_after_rerank=True)
CODE = CodeIndex(quotas={"hot": 2}, priority_order=("2-HIGH", "1-URGENT"), hint_boost=1.5, category_map={"1-URGENT": "hot", "2-HIGH": "hot"})
TOP, POOL = DOCS.sized()


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier asks for a file, a customer, a priority and a kind of part."""
    n = lambda digits: F.lpad(F.col("s_suppkey").cast("string"), digits, "0")
    text = F.concat(F.lit("File"), (F.col("s_suppkey") % 100).cast("string"), F.lit(" Customer#"), n(9), F.lit(" urgent widget"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item_id"), text.alias("text"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks without their links, written once: ranking, ids and titles all read them. Hits alone get their links."""
    return shared.keep(entity_pages(spark, sf), "chunks")


def _shown_rows(rows: DataFrame, pool: DataFrame, *key: str) -> DataFrame:
    """The rows that a pool names. Many questions share theirs, so the distinct keys are mostly few, and once they are written Spark knows: then
    neither the rows nor the pool are shuffled to meet them."""
    wanted = shared.keep(pool.select(*key).distinct(), "wanted")
    return shared.keep(rows.join(wanted, list(key), "left_semi"), "shown")


def _with_rows(pool: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """A pool (item_id, collection, node_id, score, rank) with its rows, and no more than `size` of them for a question and collection. Pages that are
    copies of each other share a node_id and each fill a place, the lowest keys first, so the pool ends where those before fill it: a pool of n ids
    with m copies each isn't spread over n * m rows."""
    on = ["collection", "node_id"]
    copy = F.row_number().over(W.partitionBy(*on).orderBy("key"))
    wanted = shared.keep(pool.select(*on).distinct(), "wanted")
    shown = shared.keep(rows.join(wanted, on, "left_semi").withColumn("_copy", copy).where(F.col("_copy") <= size), "shown")
    copies = shown.groupBy(*on).agg(F.max("_copy").alias("_copies"))
    before = F.sum("_copies").over(W.partitionBy("item_id", "collection").orderBy("rank").rowsBetween(W.unboundedPreceding, -1))
    pool = pool.join(copies, on).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < size)
    return pool.join(shown, on).where(F.col("_before") + F.col("_copy") <= size).drop("_before", "_copies", "_copy", "rank")


def _hits(spark: SparkSession, sf: str, config: Retrieval, chunks: DataFrame) -> DataFrame:
    asked = _questions(spark, sf)
    found = lexical.topk(chunks, asked.withColumnRenamed("text", "content"), config.sized()[1], "node_id", "content", within="collection")
    found = found.withColumn("place", F.concat_ws("/", F.col("item_id").cast("string"), "collection"))
    pool = shared.keep(lexical.ranked(found, config.sized()[1], "place", "node_id").drop("place"), "pool")
    pool = _with_rows(pool, chunks, config.sized()[1]).join(asked.withColumnRenamed("text", "question"), "item_id")
    return shared.keep(answer.best_hits(pool, config), "hits")


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("item_id", "rank", "id", "title", "doc_type", "collection", "score", F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["id"], c["title"], c["doc_type"])), ",").alias("citations"))


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(spark, sf)
    hits = _hits(spark, sf, DOCS, chunks)
    own = shared.keep(hits.where("key IS NOT NULL").select("doc_type", "key").distinct(), "hit-pages")  # many questions share theirs
    linked = entity_links(spark, sf, own, some=True)
    hits = hits.join(linked.select("doc_type", "key", "db_ids", "used_by"), ["doc_type", "key"], "left")
    return answer.with_citations(hits, chunks)


def docs_query(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of both collections, reranked, with what each of them cites."""
    return _shown(_cited(spark, sf))


def docs_query_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Five hits of the technical collection alone, under the quota after the rerank, without citations."""
    hits = links.public_id(_hits(spark, sf, SCOPED, _chunks(spark, sf).where("collection = 'technical'")))
    return hits.select("item_id", "rank", "id", "doc_type", "score")


def _bm25_sql(p: str, docs: str, key: str, text: str) -> str:
    token = r"'[\p{L}\p{N}_]{2,}'"
    return f"""{p}d AS (SELECT {key} AS k, regexp_extract_all(lower({text}), {token}) AS t FROM {docs}),
{p}st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM {p}d),
{p}q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), {token})) AS term FROM asked),
{p}tf AS (SELECT k, term, dl, count(*) AS tf FROM (SELECT k, len(t) AS dl, unnest(t) AS term FROM {p}d) WHERE term IN (SELECT term FROM {p}q) GROUP BY 1, 2, 3),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY 1),
{p}bm25 AS (SELECT item_id, k, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score
  FROM {p}tf JOIN {p}df USING (term) JOIN {p}q USING (term) CROSS JOIN {p}st GROUP BY 1, 2)"""


ASKED_SQL = "asked AS (SELECT s_suppkey AS item_id, 'File' || (s_suppkey % 100) || ' Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') || ' urgent widget' AS text FROM supplier)"


def _pool_sql(chunks: str) -> str:
    token = r"'[\p{L}\p{N}_]{2,}'"
    return f"""WITH {ENTITY_SQL}, {ASKED_SQL}, scope_ AS (SELECT * FROM chunks{chunks}), {_bm25_sql("e", "scope_", "node_id", "content")},
ep_ AS (SELECT * FROM (SELECT item_id, c.*, row_number() OVER (PARTITION BY item_id, collection ORDER BY score DESC, node_id) AS pr FROM ebm25 JOIN scope_ c ON c.node_id = k) WHERE pr <= {POOL}),
cov AS (SELECT p.* EXCLUDE (pr), coalesce(nullif(endpoint_id, ''), nullif(controller_id, ''), nullif(db_id, ''), page_id) AS id,
        list_distinct(regexp_extract_all(lower(a.text), {token})) AS qa, list_distinct(regexp_extract_all(lower(content), {token})) AS ha FROM ep_ p JOIN asked a USING (item_id)),
scored AS (SELECT * EXCLUDE (qa, ha), round(len(list_intersect(qa, ha)) / len(qa), 6) AS score FROM cov)"""


HITS_SQL = f"""{_pool_sql("")},
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, node_id) AS rank FROM scored) WHERE rank <= {TOP}),
idx AS (SELECT DISTINCT collection, key, node_id FROM (SELECT collection, node_id, unnest(list_concat([page_id], CASE doc_type WHEN 'endpoint' THEN [endpoint_id] WHEN 'controller-context' THEN [controller_id]
  WHEN 'db-collection' THEN [db_id] WHEN 'technical-hub' THEN feature ELSE []::VARCHAR[] END)) AS key FROM chunks) WHERE key <> ''),
keys_ AS (SELECT item_id, node_id, collection, CASE doc_type WHEN 'endpoint' THEN list_concat([controller_id], db_ids, feature) WHEN 'controller-context' THEN used_by ELSE []::VARCHAR[] END AS ks FROM hits),
l AS (SELECT item_id, node_id, collection, unnest(ks) AS key, generate_subscripts(ks, 1) - 1 AS position FROM keys_),
cited AS (SELECT item_id, l.node_id, idx.node_id AS target, min(position) AS position, arg_min(key, position) AS key FROM l JOIN idx USING (collection, key)
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.item_id = l.item_id AND h.node_id = idx.node_id) GROUP BY 1, 2, 3),
cs AS (SELECT item_id, c.node_id, string_agg(key || '|' || d.title || '|' || d.doc_type, ',' ORDER BY position, key, d.title, d.doc_type) AS citations FROM cited c JOIN chunks d ON d.node_id = target GROUP BY 1, 2)"""
DOCS_SQL = f"{HITS_SQL} SELECT item_id, rank, id, title, doc_type, collection, score, coalesce(citations, '') AS citations FROM hits LEFT JOIN cs USING (item_id, node_id)"
SCOPED_SQL = f"""{_pool_sql(" WHERE collection = 'technical'")},
g AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_type ORDER BY score DESC, node_id) <= CASE doc_type WHEN 'endpoint' THEN 2 WHEN 'controller-context' THEN 1 WHEN 'db-collection' THEN 1 ELSE 0 END AS safe FROM scored)
SELECT item_id, rank, id, doc_type, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY safe DESC, score DESC, node_id) AS rank FROM g) WHERE rank <= 5"""

# --- code stage --------------------------------------------------------------------------------------------------------


def _code(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as code chunks of their customer's nation; pending ones of NATION_3 lack the heading that a chunk must have."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    file = F.concat(F.lit("File"), (F.col("o_custkey") % 100).cast("string"))
    return o.select(
        F.col("o_orderkey").alias("chunk_id"), F.col("n_name").alias("repo"), F.col("o_orderpriority").alias("layer"), F.lit("code").alias("source_type"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("doc_type"), F.concat(file, F.lit(".cs")).alias("file_path"),
        F.concat(file, F.lit(" "), "o_orderpriority").alias("content"), F.when((F.col("n_name") != "NATION_3") | (F.col("o_orderstatus") != "P"), F.col("o_orderpriority")).alias("heading"),
    )


def _registered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").where("n_regionkey <> 0").select(F.col("n_name").alias("repo"))


def _deep(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The routes, and the code stage's answer in them."""
    asked = _questions(spark, sf)
    repos = shared.keep(answer.routed(_cited(spark, sf), _registered(spark, sf), asked), "routes")
    code = shared.keep(_code(spark, sf), "code")
    found = lexical.topk(code, asked.withColumnRenamed("text", "content"), CODE.pool_size, "chunk_id", "content", within="repo", pairs=repos)
    found = found.withColumn("place", F.concat_ws("/", F.col("item_id").cast("string"), "repo"))
    found = shared.keep(lexical.ranked(found, CODE.pool_size, "place", "chunk_id").drop("rank", "place"), "code-pool")
    found = found.join(_shown_rows(code, found, "repo", "chunk_id"), ["repo", "chunk_id"])
    return repos, answer.assemble(shared.keep(answer.code_hits(found, repos, CODE), "code-hits"), repos)


def deep_query_cited(spark: SparkSession, sf: str) -> DataFrame:
    """Docs stage, routing by the ids of hits and of their citations, code stage in those repositories with the cited files as
    hints, scores scaled over all that answered; a repository whose answer breaks the contract gives its error instead."""
    _, d = _deep(spark, sf)
    return d.select("item_id", "repo", "fallback", F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("score", F.lit(-1.0)).alias("score"), F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("error", F.lit("")).alias("error"))


DEEP_BODY = f"""{HITS_SQL},
ids AS (SELECT item_id, node_id, id FROM hits UNION ALL SELECT item_id, node_id, key FROM cited),
reg AS (SELECT n_name AS repo FROM nation WHERE n_regionkey <> 0),
der AS (SELECT DISTINCT item_id, regexp_extract(i.id, '^(ep|ctrl)::([^:]+)::', 2) AS repo, regexp_extract(h.content, '\\b([\\w.]+\\.cs):(\\d+)\\b', 1) AS file FROM ids i JOIN hits h USING (item_id, node_id) WHERE regexp_matches(i.id, '^(ep|ctrl)::([^:]+)::')),
rt AS (SELECT DISTINCT item_id, repo, false AS fallback FROM der WHERE repo IN (SELECT repo FROM reg)),
routed AS (SELECT * FROM rt UNION ALL SELECT item_id, repo, true FROM asked CROSS JOIN reg WHERE item_id NOT IN (SELECT item_id FROM rt)),
code AS (SELECT o_orderkey AS chunk_id, n_name AS repo, o_orderpriority AS layer, 'File' || (o_custkey % 100) || '.cs' AS file_path, 'File' || (o_custkey % 100) || ' ' || o_orderpriority AS content,
  CASE WHEN n_name <> 'NATION_3' OR o_orderstatus <> 'P' THEN o_orderpriority END AS heading, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority ELSE 'code' END AS kind FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
{_bm25_sql("c", "code", "chunk_id", "content")},
kp AS (SELECT * FROM (SELECT item_id, c.*, score, row_number() OVER (PARTITION BY item_id, repo ORDER BY score DESC, chunk_id) AS pr FROM cbm25 JOIN code c ON c.chunk_id = k) WHERE pr <= {POOL}),
kb AS (SELECT p.* EXCLUDE (score), fallback, CASE WHEN layer IN ('1-URGENT', '2-HIGH') THEN 'hot' ELSE 'other' END AS category,
  score * CASE WHEN NOT fallback AND EXISTS (SELECT 1 FROM der d WHERE d.item_id = p.item_id AND d.repo = p.repo AND d.file <> '' AND contains(lower(p.file_path || '|' || coalesce(p.heading, '')), lower(d.file))) THEN 1.5 ELSE 1.0 END AS score
  FROM kp p JOIN routed USING (item_id, repo)),
kg AS (SELECT *, category = 'hot' AND row_number() OVER (PARTITION BY item_id, repo, category ORDER BY score DESC, chunk_id) <= 2 AS safe FROM kb),
kr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, repo ORDER BY safe DESC, score DESC, chunk_id) AS r FROM kg) WHERE r <= {TOP}),
ko AS (SELECT *, row_number() OVER (PARTITION BY item_id, repo ORDER BY CASE kind WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, r) AS rank FROM kr),
bad AS (SELECT DISTINCT item_id, repo, fallback FROM ko WHERE heading IS NULL),
ok AS (SELECT * FROM ko WHERE (item_id, repo) NOT IN (SELECT (item_id, repo) FROM bad)),
nr AS (SELECT item_id, count(DISTINCT repo) AS n FROM routed WHERE (item_id, repo) NOT IN (SELECT (item_id, repo) FROM bad) GROUP BY 1),
sc AS (SELECT * EXCLUDE (score), CASE WHEN n = 1 THEN score WHEN hi = lo THEN 1.0 ELSE round((score - lo) / (hi - lo), 6) END AS score
  FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM ok WINDOW w AS (PARTITION BY item_id)) JOIN nr USING (item_id)),
deep AS (SELECT item_id, repo, fallback, chunk_id, file_path, score, rank, '' AS error FROM sc UNION ALL SELECT item_id, repo, fallback, -1, '', -1.0, 0, 'repo ' || repo || ': answer without heading' FROM bad)"""


# --- checks ------------------------------------------------------------------------------------------------------------


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    """The controller each question is after; informational where it has no chunk (furniture customers), never counted."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    key = F.when(F.col("c_custkey") % 89 == 0, F.concat(F.lit("["), "c_custkey", F.lit("]"))).otherwise(F.col("c_custkey").cast("string"))
    c = c.select(F.col("c_custkey").alias("item_id"), F.concat_ws("::", F.lit("ctrl"), "n_name", key).alias("accepted"), (F.col("c_mktsegment") == "FURNITURE").alias("informational"))
    return _questions(spark, sf).select("item_id").join(c, "item_id")


def cited_eval(spark: SparkSession, sf: str) -> DataFrame:
    """A question passes if an accepted id is among its three best hits or cited by the first; by = rank, citation or nothing."""
    hits = _cited(spark, sf).where("rank <= 5").select("item_id", "rank", "id", F.col("citations.id").alias("cited"))
    found = _accepted(spark, sf).join(hits, "item_id", "left").groupBy("item_id", "informational").agg(
        F.min(F.when(F.col("id") == F.col("accepted"), F.col("rank"))).alias("best"),
        F.coalesce(F.bool_or((F.col("rank") == 1) & F.array_contains("cited", F.col("accepted"))), F.lit(False)).alias("cited_on_top"),
    )
    return found.select("item_id", "informational", F.coalesce("best", F.lit(0)).alias("best_rank"), "cited_on_top", (F.coalesce(F.col("best") <= 3, F.lit(False)) | F.col("cited_on_top")).alias("passed"))


def eval_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that count, those of them that passed, those first at rank 1, and those that are shown only."""
    counts = F.expr("count_if(NOT informational)"), F.expr("count_if(NOT informational AND passed)"), F.expr("count_if(NOT informational AND best_rank = 1)"), F.expr("count_if(informational)")
    return cited_eval(spark, sf).agg(*[c.alias(n) for c, n in zip(counts, ("scored", "passed", "first", "informational"), strict=True)])


EVAL_BODY = f"""{HITS_SQL},
acc AS (SELECT c_custkey AS item_id, 'ctrl::' || n_name || '::' || CASE WHEN c_custkey % 89 = 0 THEN '[' || c_custkey || ']' ELSE c_custkey::VARCHAR END AS accepted, c_mktsegment = 'FURNITURE' AS informational
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (SELECT item_id FROM asked)),
ev AS (SELECT item_id, informational, coalesce((SELECT min(rank) FROM hits h WHERE h.item_id = acc.item_id AND h.id = accepted AND rank <= 5), 0) AS best_rank,
  EXISTS (SELECT 1 FROM hits h JOIN cited c ON c.item_id = h.item_id AND c.node_id = h.node_id WHERE h.item_id = acc.item_id AND h.rank = 1 AND c.key = accepted) AS cited_on_top FROM acc),
evp AS (SELECT *, best_rank BETWEEN 1 AND 3 OR cited_on_top AS passed FROM ev)"""


def deep_eval(spark: SparkSession, sf: str) -> DataFrame:
    """For each question: repositories that answered or failed, and whether any returned file ends with an accepted name (the file
    that the question asks for)."""
    _, d = _deep(spark, sf)
    name = F.concat(F.lit("File"), (F.col("item_id") % 100).cast("string"), F.lit(".cs"))
    ok = F.coalesce(F.bool_or(F.col("file_path").endswith(name) & F.col("error").isNull()), F.lit(False))
    return d.groupBy("item_id").agg(F.count_distinct(F.when(F.col("error").isNull(), F.col("repo"))).alias("n_repos"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.bool_or("fallback").alias("fallback"), ok.alias("passed"))


DEEP_EVAL_SQL = f"""{DEEP_BODY} SELECT item_id, count(DISTINCT CASE WHEN error = '' THEN repo END) AS n_repos, count(*) FILTER (error <> '') AS n_errors, bool_or(fallback) AS fallback,
  coalesce(bool_or(error = '' AND suffix(file_path, 'File' || (item_id % 100) || '.cs')), false) AS passed FROM deep GROUP BY 1"""



def orchestrator_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Each question judged as a whole: the nation of the customer it asks for is the one repository routed to, without fallback, or, where that isn't
    registered, any by fallback; and a file that the question names is among those returned."""
    repos, code = _deep(spark, sf)
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    cases = _questions(spark, sf).select("item_id").join(c.select(F.col("c_custkey").alias("item_id"), F.col("n_name").alias("own"), (F.col("n_regionkey") != 0).alias("known")), "item_id")
    routed = repos.groupBy("item_id").agg(F.collect_set("repo").alias("repos"), F.bool_or("fallback").alias("fallback"))
    name = F.concat(F.lit("File"), (F.col("item_id") % 100).cast("string"), F.lit(".cs"))
    seen = code.where("error IS NULL").groupBy("item_id").agg(F.bool_or(F.col("file_path").endswith(name)).alias("seen"))
    judged = cases.join(routed, "item_id", "left").join(seen, "item_id", "left")
    repos_ok = ~F.col("known") | F.coalesce(F.col("repos") == F.array("own"), F.lit(False))
    fallback_ok, files_ok = F.coalesce(F.col("fallback") != F.col("known"), F.lit(False)), F.coalesce("seen", F.lit(False))
    return judged.select("item_id", repos_ok.alias("repos_ok"), fallback_ok.alias("fallback_ok"), files_ok.alias("files_ok"), (repos_ok & fallback_ok & files_ok).alias("passed"))


ORCHESTRATOR_SQL = f"""{DEEP_BODY}, cases AS (SELECT s_suppkey AS item_id, n_name AS own, n_regionkey <> 0 AS known FROM supplier JOIN customer ON c_custkey = s_suppkey JOIN nation ON n_nationkey = c_nationkey),
j AS (SELECT item_id, NOT known OR coalesce((SELECT list(DISTINCT repo) FROM routed r WHERE r.item_id = c.item_id) = [own], false) AS repos_ok,
  coalesce((SELECT bool_or(fallback) FROM routed r WHERE r.item_id = c.item_id) <> known, false) AS fallback_ok,
  EXISTS (SELECT 1 FROM deep d WHERE d.item_id = c.item_id AND error = '' AND suffix(file_path, 'File' || (c.item_id % 100) || '.cs')) AS files_ok FROM cases c)
SELECT *, repos_ok AND fallback_ok AND files_ok AS passed FROM j"""


def code_status(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each repository's code index by layer and type, and in all; urgent orders have no layer here."""
    layer = F.when(F.col("layer") != "1-URGENT", F.col("layer"))
    return registry.code_status(_code(spark, sf).withColumn("layer", layer))


CODE_STATUS_SQL = """WITH c AS (SELECT n_name AS repo, CASE WHEN o_orderpriority = '1-URGENT' THEN '-' ELSE o_orderpriority END AS layer FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT repo, layer, 'code' AS source_type, count(*) AS n FROM c GROUP BY 1, 2 UNION ALL SELECT repo, 'total', '', count(*) FROM c GROUP BY 1"""


def repo_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of every nation's validation, and of one that doesn't exist: registered, an index that isn't empty (that of NATION_5 is),
    an answer to a probe that keeps the contract."""
    names = table(spark, sf, "nation").select(F.col("n_name").alias("repo"))
    code = shared.keep(_code(spark, sf).where("repo <> 'NATION_5'"), "code")
    probe = spark.createDataFrame([(0, "urgent")], "item_id long, content string")
    found = lexical.topk(code, probe, 1, "chunk_id", "content", within="repo").withColumn("place", F.col("repo"))
    answers = lexical.ranked(found, 1, "place", "chunk_id").join(code, ["repo", "chunk_id"])
    manifests = _registered(spark, sf).select(F.col("repo").alias("repoKey"), F.lit(None).cast("string").alias("knownRisk"))
    asked = names.unionByName(spark.createDataFrame([("NOWHERE",)], "repo string"))
    return registry.validate(asked, manifests, code, answer.response_errors(answers)).select("repo", "position", "step", "ok", F.coalesce("error", F.lit("")).alias("error"))


VALIDATE_SQL = f"""WITH asked AS (SELECT 0 AS item_id, 'urgent' AS text), reg AS (SELECT n_name AS repo FROM nation WHERE n_regionkey <> 0),
code AS (SELECT o_orderkey AS chunk_id, n_name AS repo, 'File' || (o_custkey % 100) || ' ' || o_orderpriority AS content,
  CASE WHEN n_name <> 'NATION_3' OR o_orderstatus <> 'P' THEN o_orderpriority END AS heading FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name <> 'NATION_5'),
{_bm25_sql("c", "code", "chunk_id", "content")},
best AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY repo ORDER BY score DESC, chunk_id) AS r FROM cbm25 JOIN code c ON c.chunk_id = k) WHERE r = 1),
a AS (SELECT n_name AS repo FROM nation UNION ALL SELECT 'NOWHERE'), known AS (SELECT * FROM a WHERE repo IN (SELECT repo FROM reg)), filled AS (SELECT * FROM known WHERE repo IN (SELECT repo FROM code))
SELECT repo, 1::INT AS position, 'manifest' AS step, repo IN (SELECT repo FROM reg) AS ok, CASE WHEN repo IN (SELECT repo FROM reg) THEN '' ELSE 'not registered' END AS error FROM a
UNION ALL SELECT repo, 2, 'status', repo IN (SELECT repo FROM code), CASE WHEN repo IN (SELECT repo FROM code) THEN '' ELSE 'status is empty' END FROM known
UNION ALL SELECT f.repo, 3, 'probe', b.repo IS NULL, coalesce('repo ' || b.repo || ': answer without heading', '') FROM filled f LEFT JOIN (SELECT repo FROM best WHERE heading IS NULL) b ON b.repo = f.repo"""

QUERIES = {
    "code_status": (code_status, CODE_STATUS_SQL),
    "repo_validate": (repo_validate, VALIDATE_SQL),
    "docs_query": (docs_query, DOCS_SQL),
    "docs_query_scoped": (docs_query_scoped, SCOPED_SQL),
    "deep_query_cited": (deep_query_cited, f"{DEEP_BODY} SELECT * FROM deep"),
    "cited_eval": (cited_eval, f"{EVAL_BODY} SELECT * FROM evp"),
    "eval_counts": (eval_counts, f"{EVAL_BODY} SELECT count(*) FILTER (NOT informational) AS scored, count(*) FILTER (NOT informational AND passed) AS passed, count(*) FILTER (NOT informational AND best_rank = 1) AS first, count(*) FILTER (informational) AS informational FROM evp"),
    "deep_eval": (deep_eval, DEEP_EVAL_SQL),
    "orchestrator_eval": (orchestrator_eval, ORCHESTRATOR_SQL),
}
