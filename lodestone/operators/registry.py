"""Manifests of code indexes: rules, conflicts, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources import shared

#: Contract versions that are understood.
VERSIONS = (1, 2)
SCHEMA = "position int, contractVersion int, repoKey string, displayName string, repoRoot string, serve string, persistDir string"


def rules(manifests: DataFrame) -> DataFrame:
    """The manifests with error, null for a good one."""
    serve, index = F.col("serve").isNotNull(), F.col("persistDir").isNotNull()
    version = F.col("contractVersion")
    error = (
        F.when(version.isNull() | ~version.isin(*VERSIONS), "unsupported contractVersion")
        .when(F.coalesce(F.col("repoKey"), F.lit("")) == "", "repoKey missing")
        .when((version == 1) & (~serve | index), "version 1 needs serve and allows no index")
        .when((version == 2) & ~serve & ~index, "version 2 needs serve or index")
    )
    return manifests.withColumn("error", error)


def conflicts(manifests: DataFrame) -> DataFrame:
    """Good manifests in the order given, with conflict: a key that is taken, or an index directory that is; the first one stays."""
    good = rules(manifests).where("error IS NULL").drop("error")
    first_key = F.row_number().over(W.partitionBy("repoKey").orderBy("position")) == 1
    keyed = good.withColumn("_key", first_key)
    place = F.when(F.col("_key") & F.col("persistDir").isNotNull(), F.col("persistDir"))
    clash = (F.row_number().over(W.partitionBy(place).orderBy("position")) > 1) & place.isNotNull()
    return keyed.withColumn("conflict", F.when(~F.col("_key"), "duplicate repoKey").when(clash, "persistDir in use")).drop("_key")


def page_ids(documents: DataFrame, column: str = "json") -> DataFrame:
    """All strings under keys that end in "pageid", in any case, at any depth of JSON documents. What isn't JSON has none. Documents are taken
    apart level by level, all of them at once, until nothing is nested any more."""
    level = documents.select(F.try_parse_json(F.col(column)).alias("v")).where("v IS NOT NULL")
    found: list[DataFrame] = []
    while True:
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.lower(F.col("key").cast("string")).alias("key"), F.col("value").alias("v"), F.schema_of_variant("value").alias("kind"))
        inner = shared.keep(inner, "json")
        found.append(inner.where(F.col("key").endswith("pageid") & (F.col("kind") == "STRING")).select(F.try_variant_get("v", "$", "string").alias("page_id")))
        level = inner.where(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")).select("v")
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, found).distinct()


def audit(documents: DataFrame, crawled: DataFrame) -> DataFrame:
    """Page ids of manifests that the crawl hasn't met; for information only."""
    return page_ids(documents).join(crawled.select("page_id"), "page_id", "left_anti")


#: A manifest file, as far as it is read.
FILE = "contractVersion int, repoKey string, displayName string, repoRoot string, known_risk string, serve struct<command: string, args: array<string>>, index struct<store: struct<persistDir: string>>, _bad string"


def load(spark: SparkSession, files: list[str]) -> DataFrame:
    """Manifests from JSON files, in the order given, with error as rules() gives it, or that of a file that can't be read as one.
    Relative folders are taken from the manifest's own; absolute ones stay. A file that doesn't exist is an error."""
    order = spark.createDataFrame(list(enumerate(files, 1)), "position int, file string")
    read = spark.read.schema(FILE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(files)
    read = read.withColumn("file", F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"))).withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))

    def placed(path: Column) -> Column:
        """The path from the manifest's folder, with leading ./ and ../ resolved."""
        below = F.regexp_replace(F.concat("folder", F.lit("/"), path, F.lit("/")), r"/(\./)+", "/")
        return F.regexp_replace(F.regexp_replace(F.when(path.startswith("/"), path).otherwise(below), r"/[^/]+/\.\./", "/"), r"(?<=.)/+$", "")

    found = order.join(read, "file", "left").select(
        "position", "contractVersion", "repoKey", "displayName", placed(F.coalesce("repoRoot", F.lit("."))).alias("repoRoot"), F.col("serve.command").alias("serve"),
        placed(F.col("index.store.persistDir")).alias("persistDir"), F.col("known_risk").alias("knownRisk"), "_bad",
    )
    broken = F.col("_bad").isNotNull()
    error = F.when(broken, "not valid JSON, or not of the contract's types").otherwise(F.col("error"))
    return rules(found).withColumn("error", error).withColumn("repoKey", F.when(~broken, F.col("repoKey"))).drop("_bad")


def code_status(chunks: DataFrame, by: str = "repo") -> DataFrame:
    """(by, layer, source_type, n) of each code index, layers and types in order, with a row "total"."""
    layer, kind = F.coalesce("layer", F.lit("-")).alias("layer"), F.coalesce(F.nullif("source_type", F.lit("")), F.lit("?")).alias("source_type")
    counts = chunks.select(by, layer, kind).groupBy(by, "layer", "source_type").agg(F.count("*").alias("n"))
    total = counts.groupBy(by).agg(F.sum("n").alias("n")).select(by, F.lit("total").alias("layer"), F.lit("").alias("source_type"), "n")
    return counts.unionByName(total)


def validate(asked: DataFrame, manifests: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """(repo, position, step, ok, error, knownRisk): the steps manifest, status and probe of each repository asked for, up to the first
    that fails. manifests: the good ones; chunks: those of the indexes; errors (repo, error): those of a probe's answers."""
    known = manifests.select(F.col("repoKey").alias("repo"), "knownRisk", F.lit(True).alias("_known"))
    counted = chunks.select("repo").distinct().withColumn("_filled", F.lit(True))
    failed = errors.groupBy("repo").agg(F.min("error").alias("_error"))
    all_ = asked.select("repo").distinct().join(known, "repo", "left").join(counted, "repo", "left").join(failed, "repo", "left")
    step = lambda n, name, error: F.struct(F.lit(n).alias("position"), F.lit(name).alias("step"), error.isNull().alias("ok"), error.alias("error"))
    manifest = step(1, "manifest", F.when(F.col("_known").isNull(), "not registered"))
    status = step(2, "status", F.when(F.col("_filled").isNull(), "status is empty"))
    steps = F.when(F.col("_known").isNull(), F.array(manifest)).when(F.col("_filled").isNull(), F.array(manifest, status)).otherwise(F.array(manifest, status, step(3, "probe", F.col("_error"))))
    return all_.select("repo", "knownRisk", F.explode(steps).alias("s")).select("repo", "s.*", "knownRisk")
