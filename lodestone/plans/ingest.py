"""The ingest job: chunks into the store, then the integrity rules over what is stored."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import chunk_id
from lodestone.operators import integrity
from lodestone.sources import shared
from lodestone.sources.store import Embedder, Store
from lodestone.sources.tables import ENTITY_SQL, entity_chunks


@dataclass(frozen=True)
class Report:
    """Nodes by collection, pages by kind of change, findings by severity; ok unless a strict run found errors."""

    nodes: dict[str, int]
    pages: dict[str, int]
    findings: dict[str, int]
    ok: bool


def run(spark: SparkSession, root: str, chunks: DataFrame, full: bool = False, strict: bool = False, embedder: Embedder | Column | None = None, indexed: tuple[str, ...] | bool = False) -> Report:
    """Syncs the store under `root` to the chunks and checks the stored ones. Findings never undo a sync; a strict run with errors
    is reported as not ok."""
    store = Store(spark, root)
    nodes = {r["collection"]: r["n"] for r in store.sync(chunks, full, embedder, indexed).collect()}
    pages = {r["change"]: r["count"] for r in store.changes().groupBy("change").count().collect()}
    findings = {r["severity"]: r["count"] for r in integrity.check(store.docstore()).groupBy("severity").count().collect()}
    return Report(nodes, pages, findings, not (strict and findings.get("error", 0)))


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one; one on this machine only where none is set and Spark runs in one process."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{top.rstrip('/')}/store-{uuid.uuid4().hex[:12]}"


def _earlier(chunks: DataFrame) -> DataFrame:
    """The chunks as they were: pending orders (no route) had another text, databases without a type weren't there, and each
    feature hub has since lost a sibling page."""
    was = chunks.withColumn("content", F.when((F.col("doc_type") == "endpoint") & F.col("route").isNull(), F.concat("content", F.lit(" (old)"))).otherwise(F.col("content")))
    was = was.where("doc_type <> 'db-collection' OR type <> ''")
    gone = was.where("doc_type = 'feature-hub'").withColumn("page_id", F.concat("page_id", F.lit("-old")))
    return was.unionByName(gone).withColumn("node_id", chunk_id(F.col("doc_type"), F.concat_ws("/", "page_id", "title"), F.col("content")))


def ingest_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Two ingests into a new store: the run that each live node's vector comes from, and what happened to its page in the second."""
    store, now = Store(spark, _folder(spark)), shared.keep(entity_chunks(spark, sf), "chunks")  # both ingests read them, and links are joined once
    store.sync(_earlier(now))
    store.sync(now)
    changes = store.changes().select("collection", "page_id", "change")
    return store.vectors().join(changes, ["collection", "page_id"], "full_outer").select("collection", "page_id", F.coalesce("node_id", F.lit("")).alias("node_id"), F.coalesce("run", F.lit(0)).alias("run"), "change")


INGEST_SQL = f"""WITH {ENTITY_SQL},
was AS (SELECT collection, page_id, doc_type, title, CASE WHEN doc_type = 'endpoint' AND route IS NULL THEN content || ' (old)' ELSE content END AS content FROM chunks WHERE doc_type <> 'db-collection' OR type <> ''),
old_ AS (SELECT * FROM was UNION ALL SELECT collection, page_id || '-old', doc_type, title, content FROM was WHERE doc_type = 'feature-hub'),
b AS (SELECT collection, page_id, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT collection, page_id, substr(sha256(doc_type || '|' || page_id || '/' || title || '|' || content), 1, 24) AS id FROM old_) GROUP BY 1, 2),
n AS (SELECT collection, page_id, string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS ids FROM chunks GROUP BY 1, 2),
p AS (SELECT collection, page_id, CASE WHEN b.ids IS NULL THEN 'added' WHEN n.ids IS NULL THEN 'removed' WHEN b.ids = n.ids THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN n USING (collection, page_id))
SELECT collection, page_id, coalesce(node_id, '') AS node_id, CASE WHEN node_id IS NULL THEN 0 WHEN change = 'unchanged' THEN 1 ELSE 2 END::INT AS run, change
FROM p LEFT JOIN (SELECT DISTINCT collection, page_id, node_id FROM chunks) c USING (collection, page_id)"""

QUERIES = {"ingest_sync": (ingest_sync, INGEST_SQL)}
