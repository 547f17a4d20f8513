"""Queries over stored indexes: BM25 from postings, after one run and after several, and hybrid retrieval from a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Retrieval
from lodestone.functions.text import STOPWORDS, ending
from lodestone.operators import answer, dense, embed, fuse, lexical
from lodestone.plans.ingest import _earlier
from lodestone.plans.linked import ASKED_SQL, POOL, TOP, _questions
from lodestone.plans.ranking import BM25_SQL, _ranked_sql
from lodestone.sources import shared
from lodestone.sources.store import Store
from lodestone.sources.tables import ENTITY_SQL, entity_chunks, table
from lodestone.sources.textindex import TextIndex
from lodestone.sources.vectorindex import VectorIndex

#: Folders of terms in these queries' own indexes.
FOLDERS = 8


def bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents for each question, from an index that is written once and read by the questions' terms."""
    index = TextIndex(spark, shared.folder(spark, "bm25"), "doc_id", "text", buckets=FOLDERS)
    index.update(table(spark, sf, "documents").select("doc_id", "text"))
    return lexical.ranked(index.topk(table(spark, sf, "benchmark"), TOP), TOP)


def _synced(spark: SparkSession, sf: str) -> TextIndex:
    """An index by language, after two runs: German documents have come with the second, French ones had other texts before, and Spanish ones
    stood under other keys as well, which have gone."""
    index = TextIndex(spark, shared.folder(spark, "bm25"), "doc_id", "text", "lang", "en", buckets=FOLDERS)
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    french = d.where("lang = 'fr'").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" formerly worded otherwise")))
    gone = d.where("lang = 'es'").withColumn("doc_id", -1 - F.col("doc_id"))
    index.update(d.where("lang IN ('en', 'es') OR lang IS NULL").unionByName(french).unionByName(gone))
    index.update(d.where("lang IN ('de', 'fr')"), french.unionByName(gone))
    return index


def bm25_synced(spark: SparkSession, sf: str) -> DataFrame:
    """The three best documents of each language for each question, without stop words and endings, each language with counts of its own."""
    found = _synced(spark, sf).topk(table(spark, sf, "benchmark"), 3)
    found = found.withColumn("place", F.concat_ws("/", F.col("item_id").cast("string"), "lang"))
    return lexical.ranked(found, 3, "place").drop("place")


def _analysed_sql(text: str, language: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS[language].split())
    return f"list_transform(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains([{stop}], t)), lambda t: regexp_replace(t, '{ending(language)}', '\\1'))"


SYNCED_SQL = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, {_analysed_sql("text", "en")} AS t FROM documents),
st AS (SELECT lang, count(*) AS n, avg(len(t)) AS mean FROM d GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({_analysed_sql("text", "en")}) AS term FROM benchmark),
tf AS (SELECT lang, doc_id, term, dl, count(*) AS tf FROM (SELECT lang, doc_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4),
df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY 1, 2),
s AS (SELECT item_id, lang, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score FROM tf JOIN df USING (lang, term) JOIN q USING (term) JOIN st USING (lang) GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3"""


def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts that the index holds after two runs: how many documents of each language have each term, and under the empty term how many
    there are, and how many terms they have."""
    return _synced(spark, sf).counts().select(F.col("part").alias("lang"), "term", "n", "total")


COUNTS_SQL = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, {_analysed_sql("text", "en")} AS t FROM documents)
SELECT lang, term, count(*) AS n, 0 AS total FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY 1, 2 UNION ALL SELECT lang, '', count(*), sum(len(t))::BIGINT FROM d GROUP BY 1"""


# --- retrieval from a store --------------------------------------------------------------------------------------------


def lists(store: Store, questions: DataFrame, pool: int, by: str = "item_id", fusion: str = "reciprocal_rerank") -> DataFrame:
    """(by, collection, node_id, score): the pool of each question and collection by what the store has: vectors and the text index fused
    where it has both, and the vectors' list as it is, with scores not fused, for a collection that isn't indexed. questions: by, text, vector."""
    place = F.concat_ws("/", F.col(by).cast("string"), "collection")
    one = lambda df, name: lexical.ranked(df.withColumn("place", place), pool, "place", "node_id").withColumn("list", F.lit(name))
    near = dense.topk_of_equal(store.vectors(), questions.select(by, "vector"), pool, by, "node_id", within="collection")
    indexed = store.text.parts()
    if not indexed:
        return one(near, "dense").select(by, "collection", "node_id", "score")
    alone = one(near.where(~F.col("collection").isin(indexed)), "dense")
    both = one(near.where(F.col("collection").isin(indexed)), "dense").unionByName(one(store.text.topk(questions.select(by, "text"), pool, by), "bm25"), allowMissingColumns=True)
    fused = fuse.fuse(both.withColumn("_both", F.struct(by, "collection")), fusion, by="_both", key="node_id").select("_both.*", "node_id", "score").withColumn("place", place)
    fused = lexical.ranked(fused, pool, "place", "node_id")
    return fused.select(by, "collection", "node_id", "score").unionByName(alone.select(by, "collection", "node_id", "score"))


def hits(store: Store, questions: DataFrame, config: Retrieval, by: str = "item_id", collection: str | None = None) -> DataFrame:
    """The best chunks of all collections, or of one, for each question, from the store alone."""
    found = lists(store, questions, config.sized()[1], by, config.fusion)
    if collection:
        found = found.where(F.col("collection") == collection)
    pool = found.join(store.docstore(), ["collection", "node_id"]).join(questions.select(by, F.col("text").alias("question")), by)
    return answer.best_hits(pool, config, by)


def stored_query(spark: SparkSession, sf: str) -> DataFrame:
    """Two ingests into a store, then each supplier's question to it: the technical collection is indexed, the functional one is not. Vectors
    are those of the stand-in, for chunks and questions."""
    store, now = Store(spark, shared.folder(spark, "store")), shared.keep(entity_chunks(spark, sf), "chunks")  # both syncs read them
    vector = embed.letters(F.col("content"))
    store.sync(_earlier(now), embedder=vector, indexed=("technical",))
    store.sync(now, embedder=vector, indexed=("technical",))
    asked = _questions(spark, sf).withColumn("vector", embed.letters(F.col("text")))
    return hits(store, asked, Retrieval(rerank=False)).select("item_id", "rank", "node_id", "collection", "doc_type", "score")


def _letters_sql(text: str) -> str:
    counts = f"list_transform(string_split('{embed.LETTERS}', ''), lambda c: (length(lower({text})) - length(replace(lower({text}), c, '')))::DOUBLE)"
    return f"list_transform({counts}, lambda x: (x / sqrt(list_sum(list_transform({counts}, lambda y: y * y))))::FLOAT::DOUBLE)"


_TOKEN = r"'[\p{L}\p{N}_]{2,}'"
STORED_SQL = f"""WITH {ENTITY_SQL}, {ASKED_SQL},
v AS (SELECT collection, node_id, {_letters_sql("content")} AS x FROM chunks), qv AS (SELECT item_id, {_letters_sql("text")} AS y FROM asked),
dn AS (SELECT *, row_number() OVER (PARTITION BY item_id, collection ORDER BY score DESC, node_id) AS rank FROM (SELECT item_id, collection, node_id, round(list_inner_product(x, y), 6) AS score FROM v CROSS JOIN qv)),
d AS (SELECT node_id, regexp_extract_all(lower(content), {_TOKEN}) AS t FROM chunks WHERE collection = 'technical'),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), {_TOKEN})) AS term FROM asked),
tf AS (SELECT node_id, term, dl, count(*) AS tf FROM (SELECT node_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT item_id, node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY 1, 2),
ls AS (SELECT item_id, node_id, rank FROM dn WHERE collection = 'technical' AND rank <= {POOL} UNION ALL
  SELECT * FROM (SELECT item_id, node_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, node_id) AS rank FROM bm) WHERE rank <= {POOL}),
fu AS (SELECT item_id, node_id, round(sum(1 / (60 + rank - 1)), 6) AS score FROM ls GROUP BY 1, 2),
pool AS (SELECT item_id, 'technical' AS collection, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, node_id) AS rank FROM fu) WHERE rank <= {POOL}
  UNION ALL SELECT item_id, collection, node_id, score FROM dn WHERE collection = 'functional' AND rank <= {POOL}),
hit AS (SELECT p.*, c.doc_type FROM pool p JOIN chunks c USING (collection, node_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_type ORDER BY score DESC, node_id) <= CASE doc_type WHEN 'endpoint' THEN 2 WHEN 'controller-context' THEN 1 WHEN 'db-collection' THEN 1 ELSE 0 END AS safe FROM hit WHERE collection = 'technical'),
t AS (SELECT item_id, collection, node_id, score, doc_type FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY safe DESC, score DESC, node_id) AS r FROM g) WHERE r <= {TOP}),
u AS (SELECT * FROM t UNION ALL SELECT item_id, collection, node_id, score, doc_type FROM hit WHERE collection = 'functional'),
s AS (SELECT item_id, collection, node_id, doc_type, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS score
  FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM u WINDOW w AS (PARTITION BY item_id, collection)))
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, node_id) AS rank, node_id, collection, doc_type, score FROM s) WHERE rank <= {TOP}"""

def eval_report(spark: SparkSession, index: TextIndex, questions: DataFrame, accepted: DataFrame, by: str = "item_id") -> dict:
    """Passed and first counts of some cases, and how long questions took: the average and the worst, in milliseconds of their ranking over all
    shards. accepted: (by, key) of what a question is after; it passes if that is among its three best. A question without hits has failed."""
    found = shared.keep(index.topk(questions, TOP, by, timed=True), "timed")
    ranked = lexical.ranked(found, TOP, by, index.key)
    best = questions.select(by).join(ranked.join(accepted, [by, index.key]).groupBy(by).agg(F.min("rank").alias("best")), by, "left")
    took = found.groupBy(by, "seconds").agg(F.lit(1)).groupBy(by).agg(F.sum("seconds").alias("s"))  # a question's rows of one shard have one time
    row = best.agg(F.count("*").alias("cases"), F.count_if(F.col("best") <= 3).alias("passed"), F.count_if(F.col("best") == 1).alias("first")).first()
    time = took.agg(F.avg("s").alias("mean"), F.max("s").alias("worst")).first()
    return {**row.asDict(), "mean_ms": 1000 * (time["mean"] or 0.0), "worst_ms": 1000 * (time["worst"] or 0.0)}


# --- approximate neighbours --------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> tuple[VectorIndex, DataFrame, DataFrame]:
    """An index of all vectors, the vectors, and the questions: every vector whose id is divisible by 20."""
    v = table(spark, sf, "embeddings")
    index = VectorIndex(spark, shared.folder(spark, "cells"))
    index.write(v)
    return index, v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def dense_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The best vectors of the cells that each question reads. No SQL states which neighbours an approximate index finds; the tests and
    dense_recall hold them against all."""
    index, _, asked = _vectors(spark, sf)
    return index.topk(asked, TOP)


def dense_recall(spark: SparkSession, sf: str) -> DataFrame:
    """For each question, how many of its true neighbours the index finds, and the share of the cells that it reads."""
    index, v, asked = _vectors(spark, sf)
    true = lexical.ranked(dense.topk(v, asked, TOP), TOP, key="vec_id").select("item_id", "vec_id")
    found = index.topk(asked, TOP).select("item_id", "vec_id", F.lit(1).alias("hit"))
    per = true.join(found, ["item_id", "vec_id"], "left").groupBy("item_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return per.withColumn("share", F.lit(index.share()))


QUERIES = {
    "dense_indexed": (dense_indexed, None),
    "dense_recall": (dense_recall, None),
    "bm25_indexed": (bm25_indexed, f"WITH {BM25_SQL} {_ranked_sql('bm25', TOP)}"),
    "bm25_synced": (bm25_synced, SYNCED_SQL),
    "term_counts": (term_counts, COUNTS_SQL),
    "stored_query": (stored_query, STORED_SQL),
}
