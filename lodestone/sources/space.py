"""A whole space of pages as chunks: bodies, metadata, types, tags, controllers' sections and who uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import markdown, parse
from lodestone.functions.text import chunk_id, chunk_text
from lodestone.sources import shared

#: The type whose pages have no chunk of their own, only their sections have.
REGISTRY = "repo-registry"
FIELDS = ["doc_type", "collection", "page_id", "parent_id", "title", "content", "repo", "feature", "endpoint_id", "controller_id", "db_ids", "route", "store", "type", "db_collection", "db_id", "consumed_by", "used_by", "metadata"]


def parents(pages: DataFrame) -> DataFrame:
    """(parent_id, parent_title) of the pages that others are below of, written: where they are few, Spark knows, and nearly all pages may have one
    parent without meeting it in one task."""
    named = shared.keep(pages.select("parent_id").distinct(), "parent-ids")
    return shared.keep(pages.select(F.col("page_id").alias("parent_id"), F.col("title").alias("parent_title")).join(named, "parent_id", "left_semi"), "parents")


def typed(pages: DataFrame, bodies: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Pages (page_id, parent_id, title) that have a body (page_id, title, html), a metadata line and a type, with markdown, meta and
    doc_type. A body's title stands before the page's; a parent is looked up among the pages themselves, or among those of parents()."""
    above = pages.select(F.col("page_id").alias("parent_id"), F.col("title").alias("parent_title")) if above is None else above
    # a few files of bodies would keep a few cores busy; a page that wasn't found isn't converted
    body = bodies.select("page_id", F.nullif("title", F.lit("")).alias("body_title"), F.coalesce("html", F.lit("")).alias("html")).repartition("page_id")
    read = pages.select("page_id", "parent_id", "title").join(above, "parent_id", "left").join(body, "page_id")
    read = read.withColumn("markdown", markdown.to_markdown(F.col("html"))).drop("html")
    # as the only element of an array, a line is parsed once, before the rules that read it
    read = read.select("*", F.explode(F.array(parse.metadata(F.col("markdown")))).alias("meta")).where("meta IS NOT NULL")
    read = read.withColumn("doc_type", parse.page_type(F.col("meta"), F.col("title"), F.col("parent_title"))).where("doc_type IS NOT NULL")
    return read.select("page_id", "parent_id", "title", F.coalesce("body_title", "title").alias("heading"), "markdown", "meta", "doc_type")


def read(pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """The chunks of all pages, with FIELDS and node_id: one for each page of a type, but for registry pages, which have one for each of
    their controllers' sections, with the endpoints of that repository and controller (used_by, in the order of their ids). Pages of
    types without fields of their own keep their metadata. Pages without a body, a metadata line or a type have none."""
    every = shared.keep(typed(pages, bodies, parents(pages)), "pages")
    tags = parse.tags(F.col("meta"), F.col("doc_type"), F.col("title"))
    kept = F.when(~F.col("doc_type").isin(list(parse.TAGS)), F.col("meta")).alias("metadata")
    about = ["doc_type", "page_id", "parent_id", F.col("heading").alias("title"), chunk_text(F.col("heading"), F.col("markdown")).alias("content")]
    own = every.where(F.col("doc_type") != REGISTRY).select(*about, *[c.alias(k) for k, c in tags.items()], kept, F.col("page_id").alias("_key"))
    endpoints = every.where("doc_type = 'endpoint'").select(*[parse.one(F.col("meta"), k).alias(k) for k in ("repo", "controller", "endpoint_id")]).where("endpoint_id <> ''")
    users = endpoints.groupBy("repo", F.col("controller").alias("name")).agg(F.array_sort(F.collect_list("endpoint_id")).alias("used_by"))
    parts = every.where(F.col("doc_type") == REGISTRY).select("page_id", "parent_id", parse.one(F.col("meta"), "repo").alias("repo"), F.explode(parse.controller_sections(F.col("markdown"))).alias("s"))
    parts = parts.select("page_id", "parent_id", "repo", "s.name", "s.text").join(users, ["repo", "name"], "left")
    sections = parts.select(
        F.lit("controller-context").alias("doc_type"), "page_id", "parent_id", F.col("name").alias("title"), chunk_text(F.col("name"), F.col("text")).alias("content"), "repo",
        parse.joined_id("ctrl", F.col("repo"), F.col("name")).alias("controller_id"), F.coalesce("used_by", F.array().cast("array<string>")).alias("used_by"), F.concat_ws("::", "page_id", "name").alias("_key"),
    )
    whole = own.unionByName(sections, allowMissingColumns=True).withColumn("collection", F.when(F.col("doc_type") == "feature-hub", "functional").otherwise("technical"))
    return whole.select(*FIELDS, chunk_id(F.col("doc_type"), F.col("_key"), F.col("content")).alias("node_id"))
