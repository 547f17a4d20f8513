"""The stored index: the docstore, the vectors and the state of each ingest, as Parquet under one folder that all executors share.

    docstore/run=N  every chunk there is after run N; the only read of the source, all else is derived from it
    changes/run=N   what happened to each page: added, changed, unchanged or removed
    vectors/run=N   embeddings of the nodes of added and changed pages; a run adds vectors and rewrites none
    state/run=N     each page's node ids and the run that holds its vectors
    text/           an inverted index of the content by collection, kept up by the same runs (textindex.py)

The state is written last, and a run without it doesn't count: the next one takes its number and overwrites what it left. Deleting
a node means that no state names it any more; its vector stays on disk until vacuum().
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import delta
from lodestone.sources.textindex import TextIndex

KEYS = ["collection", "page_id"]
STATE = "collection string, page_id string, node_ids array<string>, nodes_run int, version long, parent_id string"
VECTORS = "collection string, page_id string, node_id string, embedding array<float>"

#: Texts of a batch to their vectors.
Embedder = Callable[[pd.Series], pd.Series]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.text = TextIndex(spark, f"{self.root}/text", "node_id", "content", "collection", upto=self.last)

    def _paths(self, pattern: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [str(f.getPath()) for f in fs.globStatus(path) or []]

    def last(self) -> int:
        """The number of the last run that was finished; 0 if there is none."""
        return max((int(p.split("/run=")[1].split("/")[0]) for p in self._paths("state/run=*/_SUCCESS")), default=0)

    def _read(self, name: str, run: int, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.root}/{name}/run={run}")

    def state(self) -> DataFrame:
        """Each page's node ids; empty where nothing has been stored."""
        run = self.last()
        return self._read("state", run, STATE) if run else self.spark.createDataFrame([], STATE)

    def docstore(self) -> DataFrame | None:
        """All chunks as of the last run; None where nothing has been stored, and retrieval has no lexical list."""
        run = self.last()
        return self._read("docstore", run) if run else None

    def changes(self) -> DataFrame | None:
        run = self.last()
        return self._read("changes", run) if run else None

    def vectors(self) -> DataFrame:
        """(collection, page_id, node_id, embedding, run) of all nodes that the state names."""
        state = self.state()
        runs = [r[0] for r in state.select("nodes_run").distinct().collect()]  # one row a run
        if not runs:
            return self.spark.createDataFrame([], VECTORS + ", run int")
        paths = [f"{self.root}/vectors/run={r}" for r in sorted(runs)]
        stored = self.spark.read.schema(VECTORS + ", run int").option("basePath", f"{self.root}/vectors").parquet(*paths)
        return stored.join(state.select(*KEYS, F.col("nodes_run").alias("run")), [*KEYS, "run"], "left_semi").select(*KEYS, "node_id", "embedding", "run")

    def sync(self, chunks: DataFrame, full: bool = False, embedder: Embedder | Column | None = None, indexed: tuple[str, ...] | bool = False) -> DataFrame:
        """Brings the store up to the chunks (collection, page_id, node_id, content, ...) and returns (collection, n), the nodes
        each collection holds then. Only nodes of added and changed pages are embedded; in full mode all are, and what was
        stored is forgotten. An embedder is a function of a batch of texts or a column of them; without one the vectors are null.
        Chunks without a page id or node id are an error. The text index, if wanted (for some collections, or for all), takes the
        nodes of changed pages in and out by the same delta; collections that it doesn't have are ranked by their vectors alone."""
        n, spark = self.last() + 1, self.spark
        write = lambda df, name, *by: df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{name}/run={n}")
        write(chunks, "docstore")
        chunks = self._read("docstore", n, chunks.schema)
        if bad := chunks.where("collection IS NULL OR page_id IS NULL OR node_id IS NULL").limit(1).count():
            raise ValueError(f"{bad} or more chunks without collection, page_id or node_id")
        old = spark.createDataFrame([], STATE) if full else self.state()
        planned = delta.plan(old, delta.state(chunks)).join(old.select(*KEYS, "nodes_run"), KEYS, "left")
        write(planned, "changes")
        planned = self._read("changes", n, planned.schema)
        if indexed:
            self._index(n, chunks, planned, full, indexed)
        touched = chunks.join(planned.where("change IN ('added', 'changed')").select(*KEYS), KEYS, "left_semi").dropDuplicates([*KEYS, "node_id"])
        vector = embedder if isinstance(embedder, Column) else F.pandas_udf(lambda t: embedder(t), "array<float>")("content") if embedder else F.lit(None).cast("array<float>")
        write(touched.select(*KEYS, "node_id", vector.alias("embedding")), "vectors")
        kinds = {"version": "long", "parent_id": "string"}
        run = F.when(F.col("change") == "unchanged", F.col("nodes_run")).otherwise(F.lit(n))
        kept = planned.where("change <> 'removed'").select(*KEYS, F.col("new_ids").alias("node_ids"), run.alias("nodes_run"))
        if about := [F.max(c).cast(t).alias(c) for c, t in kinds.items() if c in chunks.columns]:  # else the pages needn't be met again
            kept = kept.join(chunks.groupBy(*KEYS).agg(*about), KEYS)
        write(kept.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in chunks.columns}), "state")
        return self.state().groupBy("collection").agg(F.sum(F.size("node_ids")).alias("n"))

    def _index(self, run: int, chunks: DataFrame, planned: DataFrame, full: bool, indexed: tuple[str, ...] | bool) -> None:
        """Takes the nodes of added and changed pages into the text index, and those that changed and removed pages had out of it."""
        some = lambda df: df if indexed is True else df.where(F.col("collection").isin(*indexed))
        of = lambda df, *kinds: some(df).join(planned.where(F.col("change").isin(*kinds)).select(*KEYS), KEYS, "left_semi").select("collection", "node_id", "content").dropDuplicates(["collection", "node_id"])
        before = None if full else self.docstore()
        anew = full or not self.text.runs()
        added = of(chunks, "added", "changed", "unchanged") if anew else of(chunks, "added", "changed")
        self.text.update(added, None if before is None or anew else of(before, "changed", "removed"), anew, run)

    def status(self, collections: tuple[str, ...] = ("functional", "technical")) -> list[str]:
        """A line for each collection and type with its chunks, one for each collection that is empty, and one for all; or that nothing is stored."""
        chunks = self.docstore()
        rows = chunks.groupBy("collection", F.coalesce(F.nullif("doc_type", F.lit("")), F.lit("?")).alias("doc_type")).agg(F.count("*").alias("n")).collect() if chunks is not None else []
        if not rows:
            return ["the store is empty: run an ingest"]
        lines = []
        for name in sorted({*collections, *(r.collection for r in rows)}):
            own = sorted((r.doc_type, r.n) for r in rows if r.collection == name)
            lines += [f"{name} | {kind} | {n} chunks" for kind, n in own] or [f"{name} | (empty)"]
        return [*lines, f"total | | {sum(r.n for r in rows)} chunks"]

    def vacuum(self) -> None:
        """Removes what no later run reads: everything of runs before the last, but vectors that the state still names."""
        last = self.last()
        used = {r[0] for r in self.state().select("nodes_run").distinct().collect()}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self._paths("*/run=*"):
            run = int(path.rsplit("/run=", 1)[1])
            if run < last and not ("/vectors/run=" in path and run in used):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
