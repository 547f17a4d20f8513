"""Working tables of jobs, in the folder that all executors share.

The folder is the one in spark.checkpoint.dir; only where that is unset and Spark runs in one process (as in tests) is one made on
this machine. A written table cuts the lineage: what reads it many times computes it once, and an executor lost later costs a re-read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        top = _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return f"{top.rstrip('/')}/work-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame, written once and read from there."""
    path = folder(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
