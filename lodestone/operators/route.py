"""Routing of document hits to repositories, and the merge of what those return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import base_name, cited_files, file_lines, repo_of
from lodestone.operators.fuse import min_max


def derive(hits: DataFrame, by: str = "item_id") -> DataFrame:
    """(by, repo, files, symbols) from hits (by, ids, content): the repositories in the ids of a hit, its own first, and of its
    citations; its cited files and the last part of its own id, if that names a repository, are hints for each of them."""
    repos = F.array_distinct(F.filter(F.transform("ids", repo_of), lambda r: r.isNotNull()))
    own = F.get("ids", F.lit(0))
    symbols = F.when(repo_of(own).isNotNull(), F.array(F.element_at(F.split(own, "::"), -1))).otherwise(F.array().cast("array<string>"))
    spread = hits.select(by, cited_files(F.col("content")).alias("files"), symbols.alias("symbols"), F.explode(repos).alias("repo"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return spread.groupBy(by, "repo").agg(union("files").alias("files"), union("symbols").alias("symbols"))


#: Repositories that are broadcast, at most.
MOST_REPOS = 10_000


def everywhere(questions: DataFrame, registered: DataFrame, by: str = "item_id") -> DataFrame:
    """(by, repo): each question with every registered repository, which is what a fallback asks. Up to MOST_REPOS of them are broadcast; more are
    dealt with the questions."""
    repos = registered.select("repo").distinct()
    few = repos.limit(MOST_REPOS + 1).count() <= MOST_REPOS
    return questions.select(by).distinct().crossJoin(F.broadcast(repos) if few else repos)


def route(derived: DataFrame, registered: DataFrame, questions: DataFrame, by: str = "item_id") -> DataFrame:
    """(by, repo, fallback, files, symbols): derived repositories that are registered; all registered ones, without hints, for a
    question that has none."""
    good = derived.join(registered, "repo", "left_semi").withColumn("fallback", F.lit(False))
    rest = everywhere(questions.select(by).distinct().join(good, by, "left_anti"), registered, by)
    none = F.array().cast("array<string>")
    rest = rest.select(by, "repo", F.lit(True).alias("fallback"), none.alias("files"), none.alias("symbols"))
    return good.select(by, "repo", "fallback", "files", "symbols").unionByName(rest)


def pinned(wanted: DataFrame, registered: DataFrame, questions: DataFrame, by: str = "item_id") -> DataFrame:
    """As route() for repositories (by, repo) that are asked for: no hints, and all repositories if none of them is registered."""
    none = F.array().cast("array<string>")
    return route(wanted.select(by, "repo", none.alias("files"), none.alias("symbols")).distinct(), registered, questions, by)


def merge_repos(chunks: DataFrame, answered: DataFrame, by: str = "item_id", across: bool = True) -> DataFrame:
    """Chunks of several repositories with scores scaled to 0..1 over all of them, or within each repository; those of a question
    that one repository answered are left alone. `answered` (by, repo) are the answers, those without chunks too."""
    counted = answered.groupBy(by).agg(F.count_distinct("repo").alias("_answers"))
    scaled = min_max(chunks.withColumn("_own", F.col("score")), *((by,) if across else (by, "repo"))).join(counted, by, "left")
    return scaled.withColumn("score", F.when(F.col("_answers") > 1, F.col("score")).otherwise(F.col("_own"))).drop("_own", "_answers")


def stale_citations(cited: DataFrame, files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Citations (node_id, page_id, repo, file, line) that don't hold, with a reason: no file (repo, file_path) of that name anywhere in
    the repository, or lines known of that file, and none of them the cited one. Lines are those of the chunks that a probe of the
    page returned (page_id, repo, file_path, start_line, end_line); without any with both lines nothing is said against a citation."""
    on = ["repo", "file"]
    known = files.select("repo", base_name(F.col("file_path")).alias("file")).distinct()
    missing = cited.join(known, on, "left_anti").withColumn("reason", F.lit("no such file"))
    lines = ranges.where("start_line IS NOT NULL AND end_line IS NOT NULL").select("page_id", "repo", base_name(F.col("file_path")).alias("file"), "start_line", "end_line")
    checked = cited.join(known, on, "left_semi").join(lines, ["page_id", *on]).groupBy(*cited.columns).agg(F.bool_or(F.col("line").between(F.col("start_line"), F.col("end_line"))).alias("_held"))
    return missing.select(*cited.columns, "reason").unionByName(checked.where("NOT _held").select(*cited.columns, F.lit("line not in any chunk").alias("reason")))


def cited_lines(chunks: DataFrame, registered: DataFrame) -> DataFrame:
    """(node_id, page_id, repo, file, line) of each chunk's distinct citations, where the repository of its id is a registered one."""
    repo = F.coalesce(repo_of(F.col("endpoint_id")), repo_of(F.col("controller_id")))
    spread = chunks.select("node_id", "page_id", repo.alias("repo"), F.explode(file_lines(F.col("content"))).alias("c"))
    return spread.join(registered.select("repo").distinct(), "repo", "left_semi").select("node_id", "page_id", "repo", "c.file", "c.line")
