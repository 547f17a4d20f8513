"""Tables that a job writes and reads again, in the folder that all executors share.

The folder is the one in spark.checkpoint.dir; only where that is unset and Spark runs in one process (as in tests) is one
made on this machine. Tables stay as long as results may read them: what a scope() has collected can be dropped. A written table cuts the lineage: an executor lost later costs a re-read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, noted in the innermost open scope."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def keep(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The DataFrame, written once as a table in the shared folder and read from there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the paths made inside, for drop()."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables; results that still read them must have been written before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    paths.clear()
