"""A stored inverted index that is kept up run by run, as Parquet under one folder that all executors share.

    index/run=N/bucket=B   postings of the documents that run N added, by a hash of the term and in the order of the terms; shards' keys
                           and lengths are in bucket -1
    dead/run=N             documents of earlier runs that run N took out: part, run, shard, doc
    counts/run=N           documents with each term that run N took out, as negative numbers
    full/run=N             there if run N started anew: nothing before it is read

A run writes what it adds and takes out, and nothing of what stays. The counts are written last: a run without them doesn't count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import postings

#: Folders of a run, by the hash of the term.
BUCKETS = 64
_DEAD, _COUNTS = "part string, run int, shard int, doc int", "part string, term string, n long, total long"


class TextIndex:
    """Documents have a key and a text, and may have a part (a collection), which is ranked by itself with counts of its own. `upto`
    names the last run that counts, where a larger job decides that."""

    def __init__(self, spark: SparkSession, root: str, key: str, text: str, part: str | None = None, language: str | None = None, buckets: int = BUCKETS, upto: Callable[[], int] | None = None):
        self.spark, self.root, self.key, self.text, self.part, self.language, self.buckets = spark, root.rstrip("/"), key, text, part, language, buckets
        self.upto = upto

    def _paths(self, pattern: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [str(f.getPath()) for f in fs.globStatus(path) or []]

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(p.split("/run=")[1].split("/")[0]) for p in self._paths(f"{name}/run=*/_SUCCESS"))

    def runs(self) -> list[int]:
        """The runs that are read: from the last one that started anew."""
        last = self.upto() if self.upto else None
        done, full = ([r for r in self._numbers(x) if last is None or r <= last] for x in ("counts", "full"))
        return [r for r in done if r >= max(full, default=0)]

    def parts(self) -> list[str]:
        """The parts that have documents."""
        return sorted(r[0] for r in self.rows().where("bucket = -1").select("part").distinct().collect()) if self.runs() else []

    def _forget(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [p for r in self.runs() for p in self._paths(f"{name}/run={r}")]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _part(self) -> Column | None:
        return F.col(self.part) if self.part else None

    def update(self, added: DataFrame, removed: DataFrame | None = None, full: bool = False, run: int | None = None) -> int:
        """Adds documents (key, text, part) and takes out some of those that are in, as they were put in; with `full` all that is in is
        forgotten first. A key that is in both is replaced. Returns the number of the run: the next one, or the one given, which
        overwrites what an unfinished one has left."""
        run = run or max([*self._numbers("counts"), *self._numbers("full"), 0]) + 1
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")
        if full:
            write(self.spark.createDataFrame([], "x int"), "full")
        else:
            self._forget(f"full/run={run}")
        self._forget(f"counts/run={run}")
        none = removed is None or full or not self.runs()
        if none:
            write(self.spark.createDataFrame([], _DEAD), "dead")
        else:
            heads = self.rows().where("bucket = -1").select("part", "run", "shard", F.posexplode("keys").alias("doc", "key"))
            name = F.coalesce(self._part().cast("string"), F.lit("")) if self.part else F.lit("")
            gone = removed.select(name.alias("part"), F.col(self.key).alias("key")).distinct()
            write(heads.join(gone, ["part", "key"], "left_semi").select("part", "run", "shard", "doc").join(self.dead(), ["part", "run", "shard", "doc"], "left_anti"), "dead")
        built = postings.build(added, self.key, self.text, self._part(), self.language)
        built = built.withColumn("bucket", F.when(F.col("term") == postings.ALL, -1).otherwise(self.bucket(F.col("term"))))
        built.repartition("bucket").sortWithinPartitions("bucket", "term", "shard").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/index/run={run}")
        write(self.spark.createDataFrame([], _COUNTS) if none else postings.signed(removed, self.key, self.text, self._part(), self.language), "counts")
        return run

    def rows(self) -> DataFrame:
        """All index rows, with run and bucket, by which folders are left out."""
        paths = [p for r in self.runs() for p in self._paths(f"index/run={r}/bucket=*")]
        return self.spark.read.option("basePath", f"{self.root}/index").parquet(*paths)

    def dead(self) -> DataFrame:
        return self._read("dead", _DEAD)

    def counts(self, terms: DataFrame | None = None) -> DataFrame:
        """(part, term, n, total) as a rebuild would count them; of some terms and of all documents (term ALL), or of every term."""
        rows, taken = self.rows().select("part", "term", "n", "total", "bucket"), self._read("counts", _COUNTS)
        if terms is not None:
            rows = postings.only(rows, terms, self.bucket).drop("bucket").unionByName(rows.where("bucket = -1").drop("bucket"))
            taken = taken.join(terms.distinct().unionByName(self.spark.createDataFrame([(postings.ALL,)], "term string")), "term", "left_semi").select("part", "term", "n", "total")
        whole = postings.counted(rows.select("part", "term", "n", "total").unionByName(taken.select("part", "term", "n", "total")))
        return whole.withColumn("total", F.when(F.col("term") == postings.ALL, F.col("total")).otherwise(F.lit(0))).where("n > 0")

    def topk(self, questions: DataFrame, k: int, by: str = "item_id", text: str = "text", timed: bool = False) -> DataFrame:
        """(by, key, score), and the part: at least the k best documents of each part for each question by BM25, and no more than k for each
        shard; lexical.ranked() takes the k best of these. Only the asked terms' rows and their shards' keys are read. With `timed`, seconds say
        how long the question took in the row's shard."""
        asked = postings.asked_terms(questions, by, text, self.language)
        terms = asked.select("term").distinct()
        rows = postings.only(self.rows(), terms, self.bucket).drop("keys", "bucket")
        shards = self.rows().where("bucket = -1").join(rows.select("part", "run", "shard").distinct(), ["part", "run", "shard"], "left_semi")
        return postings.topk(rows, shards, self.counts(terms), asked, k, by, self.key, self.part, self.dead(), timed=timed)
