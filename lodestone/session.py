"""Session settings that the library's queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings a session needs; all are runtime settings, so they can also be set on a running session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, app: str = "lodestone") -> SparkSession:
    """A session with SETTINGS; on a cluster, leave `master` and `shuffle_partitions` to spark-submit."""
    b = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
