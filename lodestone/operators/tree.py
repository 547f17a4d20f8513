"""Crawls of page trees given as parent edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources import shared


def crawl(pages: DataFrame, roots: list[str], excluded_titles: list[str] | None = None) -> DataFrame:
    """All pages (page_id, title, parent_id) below the roots, with root and depth from 1. A root itself is no result, and a page
    with an excluded title goes with all below it. Trees of several roots are concatenated; where a root lies below another, what is below it
    is in both trees. Pages that no root reaches, in a circle or below a page that isn't there, are none of the result.

    Every page knows its parent; in each round it takes over what the page it knows knows, twice as far up, until that is a root. So a tree of
    any depth takes as many rounds as its depth has binary digits, and each round is a table of as many rows as there are pages.
    """
    kept = pages.select("page_id", "title", "parent_id").where("page_id IS NOT NULL AND parent_id IS NOT NULL")
    if excluded_titles:
        kept = kept.where(~F.coalesce(F.col("title"), F.lit("")).isin(excluded_titles))
    at_root = F.col("up").isin(roots)
    far = shared.keep(kept.withColumn("up", F.col("parent_id")).withColumn("depth", F.lit(1).cast("long")).withColumn("done", at_root), "crawl")
    n = far.count()
    done = far.where("done")
    while far.where(f"NOT done AND depth <= {n}").limit(1).count():  # further up than there are pages: a circle
        # the pages that others know, which may be few and then are met without a shuffle, where most pages know the same one
        ups = shared.keep(far.where("NOT done").select("up").distinct(), "ups")
        known = far.select(F.col("page_id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        known = shared.keep(known.join(ups, "up", "left_semi"), "known")
        moved = far.where("NOT done").join(known, "up").select("page_id", "title", "parent_id", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        far = shared.keep(moved.unionByName(far.where("done")), "crawl")
        done = far.where("done")
    # roots below others: a few rows, as many as roots
    above = {}
    for r in done.where(F.col("page_id").isin(roots)).select("page_id", "up", "depth").collect():
        above.setdefault(r.page_id, []).append((r.up, r.depth))
    chains = []
    for root in roots:
        todo, seen = [(root, 0)], {root}
        while todo:
            name, more = todo.pop()
            chains.append((root, name, more))
            for up, depth in above.get(name, []):
                if up not in seen:
                    seen.add(up)
                    todo.append((up, more + depth))
    trees = pages.sparkSession.createDataFrame(chains, "up string, root string, more long")
    return done.join(F.broadcast(trees), "up").select("root", "page_id", "title", "parent_id", (F.col("depth") + F.col("more")).cast("int").alias("depth"))
