"""Answers: hits cut and shown with what they cite, and the code stage in the repositories that hits and citations name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import CodeIndex, Retrieval
from lodestone.operators import fuse, lexical, links, rerank, route, select
from lodestone.sources import shared

#: Fields of a code chunk that must not be null.
REQUIRED = ("heading", "file_path", "source_type", "content", "score")
#: Fields of a code chunk, as shown.
CODE_FIELDS = ("heading", "file_path", "layer", "source_type", "content", "score", "start_line", "end_line", "parent_summary")


def best_hits(pool: DataFrame, config: Retrieval, by: str = "item_id", scorer: rerank.Scorer | None = None) -> DataFrame:
    """The top_k of each question's pool (by, node_id, collection, doc_type, content, question, score), with rank. With a rerank the
    technical quota holds for the pool, or for the final cut if the settings say so; without one, scores of each collection are scaled
    to 0..1 and merged."""
    top, size = config.sized()
    technical, other = pool.where("collection = 'technical'"), pool.where("collection <> 'technical'")
    quota = lambda hits, k: select.quota(hits, config.quotas, k, "doc_type", by, "node_id").drop("guaranteed", "rank")
    if not config.rerank:
        merged = fuse.min_max(other, by).unionByName(fuse.min_max(quota(technical, top), by))
        return lexical.ranked(merged, top, by, "node_id")
    scored = rerank.rerank(other.unionByName(quota(technical, size)), scorer, text="content")
    if not config.quota_after_rerank:
        return lexical.ranked(scored, top, by, "node_id")
    # functional hits have no quota, and so none is guaranteed
    return select.quota(scored, config.quotas, top, "doc_type", by, "node_id").drop("guaranteed")


def with_citations(hits: DataFrame, chunks: DataFrame, by: str = "item_id") -> DataFrame:
    """Hits with id and citations: an array of (position, id, title, doc_type) in the order of the links, empty for a hit that
    cites nothing. Ids are those the hit names the cited chunk by."""
    cited = shared.keep(links.citations(hits, links.owned(chunks), by), "cited")
    about = chunks.select(F.col("node_id").alias("cited"), "title", "doc_type").join(cited.select("cited").distinct(), "cited", "left_semi").dropDuplicates(["cited"])
    shown = cited.join(about, "cited").groupBy(by, "node_id").agg(F.sort_array(F.collect_list(F.struct("position", F.col("key").alias("id"), "title", "doc_type"))).alias("citations"))
    out = links.public_id(hits).join(shown, [by, "node_id"], "left")
    return out.withColumn("citations", F.coalesce("citations", F.array().cast(shown.schema["citations"].dataType)))


def routed(hits: DataFrame, registered: DataFrame, questions: DataFrame, by: str = "item_id") -> DataFrame:
    """route() by the ids of hits and of what they cite."""
    ids = F.concat(F.array("id"), F.col("citations.id"))
    return route.route(route.derive(hits.select(by, ids.alias("ids"), "content"), by), registered, questions, by)


def code_hits(found: DataFrame, repos: DataFrame, config: CodeIndex, by: str = "item_id", key: str = "chunk_id", scorer: rerank.Scorer | None = None) -> DataFrame:
    """The top_k code chunks of each question and routed repository, from what its index found (by, repo, key, heading, file_path, layer,
    content, score, and question for a rerank): chunks in a hinted file are boosted, then all are reranked if the settings say so, which
    makes new scores; quotas and priorities hold within a repository. `repos`: by, repo, files."""
    hits = found.join(repos.select(by, "repo", "fallback", "files"), [by, "repo"])
    place = F.lower(F.concat_ws("|", "file_path", "heading"))
    hinted = F.exists(F.filter(F.transform("files", lambda f: F.lower(F.trim(f))), lambda f: f != ""), lambda f: place.contains(f))
    hits = hits.withColumn("score", F.col("score") * F.when(hinted, config.hint_boost).otherwise(1.0))
    if config.rerank:
        hits = rerank.rerank(hits, scorer, text="content")
    hits = hits.withColumn("place", F.concat_ws("/", F.col(by).cast("string"), "repo")).withColumn("chars", F.char_length("content"))
    hits = hits.withColumn("category", select.category(F.coalesce("heading", F.lit("")), F.col("layer"), config.category_map, config.overview_suffix))
    best = select.quota(hits, config.quotas, config.top_k, "category", "place", key, config.min_category_chars, config.min_category_extra, "chars")
    kind = [F.nullif(F.col(c), F.lit("")) for c in ("doc_type", "source_type") if c in best.columns]
    best = best.withColumn("_kind", F.coalesce(*kind, F.lit("")))
    return select.reorder(best, list(config.priority_order), "_kind", "place").drop("place", "chars", "guaranteed", "files", "_kind")


def response_errors(chunks: DataFrame, by: str = "item_id") -> DataFrame:
    """(by, repo, error) of the answers that lack a required field; the error names the repository and the first such field."""
    first = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    bad = chunks.select(by, "repo", first.alias("field")).where("field IS NOT NULL").groupBy(by, "repo").agg(F.min("field").alias("field"))
    return bad.select(by, "repo", F.concat(F.lit("repo "), "repo", F.lit(": answer without "), "field").alias("error"))


def assemble(chunks: DataFrame, repos: DataFrame, by: str = "item_id") -> DataFrame:
    """The code stage's answer: for each routed repository its chunks, with scores scaled over all repositories of a question that
    answered, or one row with its error. An answer that breaks the contract is an error of that repository alone; one without
    chunks is no error, and no row."""
    errors = response_errors(chunks, by)
    answered = repos.select(by, "repo").join(errors, [by, "repo"], "left_anti")
    good = route.merge_repos(chunks.join(errors, [by, "repo"], "left_anti"), answered, by).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(errors.join(repos.select(by, "repo", "fallback"), [by, "repo"]), allowMissingColumns=True)


def contract(chunks: DataFrame) -> DataFrame:
    """Exactly the nine fields of a code chunk, null where a chunk has none, beside the keys (all columns named *_id, and repo)."""
    keys = [c for c in chunks.columns if c.endswith("_id") or c == "repo"]
    return chunks.select(*keys, *[F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in CODE_FIELDS])
