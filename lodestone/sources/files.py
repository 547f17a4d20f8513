"""The files of repositories, listed by Spark without a look into them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, roots: dict[str, str], pattern: str = "*") -> DataFrame:
    """(repo, file_path, length, modified) of all files below each repository's root, whose names fit the pattern. Only paths and dates
    are read: the content column is pruned, and directories are listed in parallel. A root that doesn't exist is an error, an empty
    one has no rows. Paths are below the root."""
    some = []
    for repo, root in roots.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
        base = "/" + root.split("://")[-1].split(":")[-1].strip("/") + "/"
        below = F.substring(path, F.length(F.lit(base)) + 1, F.length(path))
        some.append(files.select(F.lit(repo).alias("repo"), below.alias("file_path"), "length", F.col("modificationTime").alias("modified")))
    return reduce(DataFrame.unionByName, some) if some else spark.createDataFrame([], "repo string, file_path string, length long, modified timestamp")
