"""Links between chunks by stable ids: the id index, citations, lookups, parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import filled


def id_index(chunks: DataFrame) -> DataFrame:
    """owned(), each row once."""
    return owned(chunks).distinct()


def owned(chunks: DataFrame) -> DataFrame:
    """(collection, key, node_id): the ids that each chunk owns, first of all its page's; ids that it only refers to aren't its own.
    Technical hubs own their features too."""
    none = F.array().cast("array<string>")
    own = F.when(F.col("doc_type") == "endpoint", F.array("endpoint_id")).when(F.col("doc_type") == "controller-context", F.array("controller_id")).when(F.col("doc_type") == "db-collection", F.array("db_id"))
    own = own.when(F.col("doc_type") == "technical-hub", F.coalesce("feature", none)).otherwise(none)
    spread = chunks.select("collection", "node_id", F.explode(F.concat(F.array("page_id"), own)).alias("key"))
    return spread.where(F.col("key").isNotNull() & (F.col("key") != "")).select("collection", "key", "node_id")


def public_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("id", filled("endpoint_id", "controller_id", "db_id", "page_id"))


def citations(hits: DataFrame, index: DataFrame, by: str) -> DataFrame:
    """(by, node_id, cited, position, key) of the chunks that hits link to, in the order of the links, each once a hit and never a
    hit itself. Endpoints link to their controller, databases and features, controllers to their endpoints; links stay in a
    hit's own collection. The index may name a chunk's id more than once. hits: by, node_id, collection, doc_type, controller_id, db_ids, feature, used_by."""
    empty = F.array().cast("array<string>")
    keys = F.when(F.col("doc_type") == "endpoint", F.concat(F.array("controller_id"), F.coalesce("db_ids", empty), F.coalesce("feature", empty)))
    keys = keys.when(F.col("doc_type") == "controller-context", F.coalesce("used_by", empty)).otherwise(empty)
    links = hits.select(by, "node_id", "collection", F.posexplode(keys).alias("position", "key")).where(F.col("key").isNotNull())
    found = links.join(index.withColumnRenamed("node_id", "cited"), ["collection", "key"])
    found = found.join(hits.select(by, F.col("node_id").alias("cited")), [by, "cited"], "left_anti")
    first = W.partitionBy(by, "node_id", "cited").orderBy("position")
    return found.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(by, "node_id", "cited", "position", "key")


def expand(ids: DataFrame, index: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, collection, node_id): the chunks that own each id and, per collection without one, the chunk of that node id."""
    owned = ids.join(index, ids["id"] == index["key"]).select("id", "collection", "node_id")
    places = chunks.select("collection").distinct()
    open_ = ids.crossJoin(F.broadcast(places)).join(owned, ["id", "collection"], "left_anti")  # two collections
    raw = open_.join(chunks.select("collection", F.col("node_id").alias("id")), ["id", "collection"]).select("id", "collection", F.col("id").alias("node_id"))
    return owned.unionByName(raw)


def parent_summaries(selected: DataFrame, parents: DataFrame, by: str) -> DataFrame:
    """The selected chunks with their parent's summary, null where the parent is selected itself."""
    shown = selected.select(by, F.col("chunk_id").alias("parent_id")).withColumn("_shown", F.lit(True))
    out = selected.join(parents.select(F.col("chunk_id").alias("parent_id"), "summary"), "parent_id", "left").join(shown, [by, "parent_id"], "left")
    return out.withColumn("parent_summary", F.when(F.col("_shown").isNull(), F.col("summary"))).drop("_shown", "summary")
