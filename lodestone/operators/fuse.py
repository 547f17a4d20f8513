"""Fusion of ranked lists (by, key, score, rank, list)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Added to ranks, which count from 0.
RRF_OFFSET = 60
MODES = ("reciprocal_rerank", "relative_score", "dist_based_score", "simple")


def fuse(lists: DataFrame, mode: str = "reciprocal_rerank", n_lists: int = 2, by: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(by, key, score) of all members of the lists."""
    own = W.partitionBy(by, "list")
    if mode == "reciprocal_rerank":
        part = 1 / (RRF_OFFSET + F.col("rank") - 1)
    elif mode == "relative_score":
        low, high = F.min("score").over(own), F.max("score").over(own)
        part = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)) / n_lists
    elif mode == "dist_based_score":
        mean, spread = F.avg("score").over(own), F.stddev_pop("score").over(own)
        low, high = mean - 3 * spread, mean + 3 * spread
        # a spread of next to nothing is rounding
        part = F.when(spread < 1e-9, 1.0).otherwise((F.col("score") - low) / (high - low)) / n_lists
    elif mode == "simple":
        return lists.groupBy(by, key).agg(F.max("score").alias("score"))
    else:
        raise ValueError(f"fusion mode must be one of {', '.join(MODES)}")
    return lists.select(by, key, part.alias("part")).groupBy(by, key).agg(F.round(F.sum("part"), 6).alias("score"))


def min_max(pool: DataFrame, *by: str) -> DataFrame:
    """Scores scaled to 0..1 within each pool; a null score counts as 0, equal scores become 1."""
    own = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    s = F.coalesce("score", F.lit(0.0))
    low, high = F.min(s).over(own), F.max(s).over(own)
    return pool.withColumn("score", F.round(F.when(high == low, 1.0).otherwise((s - low) / (high - low)), 6))
