"""An inverted index: postings of terms in shards of documents, and BM25 ranking that reads the asked terms only.

Documents are dealt into shards of about SHARD documents or SHARD_CHARS characters of one part (a collection, say), whichever are fewer. In a shard they are numbered by key, and a term has one
row: the numbers of its documents, how often each has it, and for each run of BLOCK numbers what bounds any score there: the most
occurrences and the least length. So a frequent term is many rows, one for each shard, and no row is longer than a shard.

A shard is ranked in one task. The bounds of a question's terms are added up by block, blocks are read from the highest bound down, and
reading stops where no block left can reach the k-th score (block-max skipping); what is skipped can't be among the k best.

Where many questions have the same common terms, each set of these is ranked once instead of each question, and a question's own, rare terms
lead to the few documents that have them, which get their whole scores: see topk().
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.text import analysed
from lodestone.operators.lexical import K1, RARE, B, ranked
from lodestone.sources import shared

#: Documents of a shard, about, and of a block; questions that meet a shard at a time; terms that are listed in a filter of the scan.
SHARD, BLOCK, QUESTIONS, LISTED = 1 << 14, 128, 4096, 2000
#: Characters of a shard's texts, about: a shard is numbered in one task, whose memory grows with them.
SHARD_CHARS = 1 << 23
#: The term of the rows that hold a shard's keys and lengths.
ALL = ""
ROWS = "part string, shard int, term string, n long, total long, docs binary, tfs binary, blocks binary, keys array<{kind}>"


def build(docs: DataFrame, key: str, text: str, part: Column | None = None, language: str | None = None, shard: int = SHARD) -> DataFrame:
    """Rows ROWS for all documents: for each shard one with its keys and lengths (term ALL), and one for each of its terms. Null texts have no
    terms and count with length 0. `part` names the part that a document belongs to, which has counts of its own; all are one without it."""
    base = docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part") if part is not None else F.lit("").alias("part"), F.col(key).alias("key"), analysed(F.col(text), language).alias("tokens"), F.xxhash64(key, text).alias("_h"))
    count, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.char_length(text)), F.lit(0))).first()
    shards = max(1, -(-count // shard), -(-chars // SHARD_CHARS))
    base = base.withColumn("shard", F.pmod("_h", F.lit(shards)).cast("int"))
    kind = base.schema["key"].dataType
    schema = pa.schema([("part", pa.string()), ("shard", pa.int32()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), *((c, pa.binary()) for c in ("docs", "tfs", "blocks")), ("keys", pa.list_(to_arrow_type(kind)))])

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        part, shard = table.column("part")[0].as_py(), table.column("shard")[0].as_py()
        lists = table.column("tokens").chunk(0)
        length = np.asarray(lists.value_lengths()).astype("<u4")
        coded = lists.flatten().dictionary_encode()
        owner = np.repeat(np.arange(len(lists)), length)
        pairs, tf = np.unique(np.asarray(coded.indices).astype(np.int64) * len(lists) + owner, return_counts=True)
        term, doc = np.divmod(pairs, max(1, len(lists)))
        head = pa.Table.from_pylist([{"part": part, "shard": shard, "term": ALL, "n": len(lists), "total": int(length.sum()), "tfs": length.tobytes(), "keys": table.column("key").to_pylist()}], schema)
        if not len(term):
            return head
        block, changes = doc // BLOCK, term[1:] != term[:-1]
        edge = np.flatnonzero(np.concatenate(([True], changes, [True])))
        cut = np.flatnonzero(np.concatenate(([True], changes | (block[1:] != block[:-1]))))
        of_term = np.searchsorted(cut, edge)
        size = np.diff(of_term)
        # a term's blocks are four rows of as many numbers, one term's after another's
        bounds, place = np.empty(4 * len(cut), "<u4"), np.arange(len(cut)) + 3 * np.repeat(of_term[:-1], size)
        for i, row in enumerate((block[cut], cut - np.repeat(edge[:-1], size), np.maximum.reduceat(tf, cut), np.minimum.reduceat(length[doc], cut))):
            bounds[place + i * np.repeat(size, size)] = row
        cells = lambda numbers, ends: pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype("<i4")), pa.py_buffer(np.ascontiguousarray(numbers, "<u4"))])
        n = len(edge) - 1
        columns = [pa.array([part] * n, pa.string()), pa.array(np.full(n, shard, np.int32)), coded.dictionary.take(pa.array(term[edge[:-1]])), pa.array(np.diff(edge)), pa.array(np.add.reduceat(tf, edge[:-1]))]
        columns += [cells(doc, edge), cells(tf, edge), cells(bounds, 4 * of_term), pa.nulls(n, schema.field("keys").type)]
        return pa.concat_tables([head, pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)])

    return base.drop("_h").groupBy("part", "shard").applyInArrow(number, ROWS.format(kind=kind.simpleString()))


class Term:
    """A term's postings in a shard."""

    def __init__(self, docs: bytes, tfs: bytes, blocks: bytes):
        self.docs, self.tfs = np.frombuffer(docs, "<u4"), np.frombuffer(tfs, "<u4")
        self.block, self.start, self.most, self.least = np.frombuffer(blocks, "<u4").reshape(4, -1).astype(np.int64)
        self.end = np.concatenate((self.start[1:], [len(self.docs)]))


def _weight(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf / (tf + K1 * (1 - B + B * length / mean))


def best(terms: list[tuple[Term, float]], length: np.ndarray, mean: float, k: int, alive: np.ndarray | None = None, step: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers and scores of the k best documents of a shard, by score and then number, and how many blocks were read. terms: each with its idf."""
    bound = np.zeros(-(-len(length) // BLOCK))
    for t, idf in terms:
        bound[t.block] += idf * _weight(t.most, t.least, mean)
    order = np.argsort(-bound, kind="stable")
    order = order[: np.count_nonzero(bound)]
    scores, read, found, least = np.zeros(len(length)), 0, np.zeros(0, np.int64), -np.inf
    while read < len(order) and bound[order[read]] + 1e-6 >= least:  # scores are rounded to six digits
        some = np.sort(order[read : read + step])
        for t, idf in terms:
            at = np.searchsorted(t.block, some)
            at = at[(at < len(t.block)) & (t.block[np.minimum(at, len(t.block) - 1)] == some)]
            size = t.end[at] - t.start[at]
            own = np.repeat(t.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())  # the places of all these blocks' documents
            d = t.docs[own]
            scores[d] += idf * _weight(t.tfs[own], length[d], mean)
        new = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        new = new[new < len(length)]
        new = new[scores[new] > 0]
        found = np.concatenate((found, new if alive is None else new[alive[new]]))
        rounded = np.round(scores[found], 6)
        found = found[np.lexsort((found, -rounded))][:k]
        least = np.round(scores[found[-1]], 6) if len(found) == k else -np.inf
        read += len(some)
    return found, np.round(scores[found], 6), read


def whole_scores(terms: list[tuple[Term, float]], rare: list[Term], length: np.ndarray, mean: float, k: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores, by all of the terms, of the k best of a shard's documents that have one of the rare terms, in the order of best()."""
    docs = np.unique(np.concatenate([t.docs for t in rare]))
    docs = docs if alive is None else docs[alive[docs]]
    scores = np.zeros(len(docs))
    for t, idf in terms:
        at = np.minimum(np.searchsorted(t.docs, docs), len(t.docs) - 1)
        has = t.docs[at] == docs
        scores[has] += idf * _weight(t.tfs[at[has]], length[docs[has]], mean)
    scores = np.round(scores, 6)
    order = np.lexsort((docs, -scores))[:k]
    return docs[order], scores[order]


def asked_terms(questions: DataFrame, by: str, text: str, language: str | None = None) -> DataFrame:
    return questions.select(F.col(by).alias("by"), F.explode(F.array_distinct(analysed(F.col(text), language))).alias("term"))


def only(index: DataFrame, terms: DataFrame, bucket=None) -> DataFrame:
    """The rows of some terms. Up to LISTED terms are named in the scan's filter, so that other buckets and row groups aren't read; more are
    joined. bucket: the column expression that deals terms to the table's folders, if it has any."""
    listed = [r[0] for r in terms.distinct().limit(LISTED + 1).collect()]
    if len(listed) > LISTED:
        wanted = terms.distinct() if bucket is None else terms.distinct().withColumn("bucket", bucket(F.col("term")))
        return index.join(wanted, wanted.columns, "left_semi")
    rows = index.where(F.col("term").isin(listed))
    if bucket is None or not listed:
        return rows
    spark = index.sparkSession
    places = [r[0] for r in spark.createDataFrame([(t,) for t in listed], "term string").select(bucket(F.col("term"))).distinct().collect()]
    return rows.where(F.col("bucket").isin(places))


def topk(rows: DataFrame, shards: DataFrame, counts: DataFrame, asked: DataFrame, k: int, by: str, key: str, part: str | None = None, dead: DataFrame | None = None, score_step: int = 16, timed: bool = False) -> DataFrame:
    """(by, key, score), and the part's name if asked for: at least the k best documents of each part for each question, and no more than k of a shard, or
    of its part by common terms and of a shard by rare ones. timed: also seconds, the time that the question took in the shard, on each of its rows.

    rows: of the asked terms (part, run, shard, term, n, docs, tfs, blocks); shards: their shards (part, run, shard, tfs, keys); counts: how many
    documents of a part have each term, with the part's own number and total length under ALL (part, term, n, total); asked: (by, term);
    dead: documents that don't count any more (part, run, shard, doc).

    Where there are half as many sets of common terms, which more than RARE documents have, as questions, a set is ranked in the shards once for all of its
    questions. The documents with a question's rare terms are found by these, and get their whole scores. The set's list may name one of them too, by
    less than its score: the higher one counts. What such a document is listed before, its whole score is before too, so none of the k best is missing."""
    on = ["part", "run", "shard"]
    own = counts.where(F.col("term") == ALL).select("part", F.col("n").alias("_n"), (F.col("total") / F.col("n")).alias("mean"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = counts.where((F.col("term") != ALL) & (F.col("n") > 0)).select("part", "term", F.col("n").alias("df")).join(own, "part").select("part", "term", idf.alias("idf"), "mean", (F.col("df") <= RARE).alias("rare"))
    told = shared.keep(asked.join(weights, "term").select("part", "by", "term", "idf", "mean", "rare"), "told")
    places = rows.select(*on, "term")
    often = told.where("NOT rare").groupBy("part", "by").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("set"))  # terms hold no spaces
    sets = often.groupBy("part", "set").agg(F.min("by").alias("one"))
    alike = not timed and 2 * sets.count() <= often.count()
    if alike:
        often = shared.keep(often.join(sets, ["part", "set"]).select("part", "by", "one"), "sets")
        listed = told.where("NOT rare").join(often.where(F.col("by") == F.col("one")).select("part", "by"), ["part", "by"], "left_semi")
        meets = told.where("rare").join(places, ["part", "term"]).select(*on, "by").distinct()
        ask = listed.join(places, ["part", "term"]).withColumn("whole", F.lit(False)).unionByName(meets.join(told, ["part", "by"]).withColumn("whole", F.lit(True)))
    else:
        ask = told.join(places, ["part", "term"]).withColumn("whole", F.lit(False))
    ask = shared.keep(ask.select(*on, "by", "term", "idf", "mean", "rare", "whole"), "ask")
    met = ask.select(*on, "by", "whole").distinct().groupBy(*on).count().agg(F.max("count")).first()[0] or 0
    n_blocks = max(1, -(-met // QUESTIONS))
    ask = ask.withColumn("q", F.pmod(F.xxhash64("by"), F.lit(n_blocks)).cast("int"))
    payload = rows.select(*on, "term", "docs", "tfs", "blocks").withColumn("keys", F.lit(None).cast(shards.schema["keys"].dataType))
    heads = shards.select(*on, F.lit(ALL).alias("term"), F.lit(None).cast("binary").alias("docs"), "tfs", F.lit(None).cast("binary").alias("blocks"), "keys")
    if dead is not None:
        gone = dead.groupBy(*on).agg(F.array_sort(F.collect_set("doc")).alias("_dead"))  # of one shard
        heads = heads.drop("docs").join(gone, on, "left").withColumn("docs", F.encode(F.array_join("_dead", ","), "UTF-8")).select(*payload.columns)
    payload = payload.unionByName(heads)
    payload = payload.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))) if n_blocks > 1 else payload.withColumn("q", F.lit(0))
    by_type, key_type = asked.schema["by"].dataType, shards.schema["keys"].dataType.elementType
    schema = pa.schema([("by", to_arrow_type(by_type)), ("key", to_arrow_type(key_type)), ("part", pa.string()), ("run", pa.int32()), ("shard", pa.int32()), ("doc", pa.int32()), ("score", pa.float64()), ("whole", pa.bool_()), ("seconds", pa.float64())])

    def rank(table: pa.Table, questions: pa.Table) -> pa.Table:
        if not questions.num_rows or not table.num_rows:
            return schema.empty_table()
        terms, keys, length, alive = {}, None, None, None
        part, run, shard = (table.column(c)[0].as_py() for c in on)
        for row in table.select(["term", "docs", "tfs", "blocks"]).to_pylist():
            if row["term"] != ALL:
                terms[row["term"]] = Term(row["docs"], row["tfs"], row["blocks"])
            else:
                length = np.frombuffer(row["tfs"], "<u4").astype(np.int64)
                if row["docs"]:
                    alive = np.ones(len(length), bool)
                    alive[np.array(row["docs"].decode().split(","), np.int64)] = False
        at = pc.index(table.column("term"), ALL).as_py()
        keys = table.column("keys").combine_chunks()
        keys = (keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys)[at].values
        questions = questions.sort_by([("whole", "ascending"), ("by", "ascending"), ("term", "ascending")])
        who, mean = list(zip(questions.column("whole").to_pylist(), questions.column("by").to_pylist(), strict=True)), questions.column("mean")[0].as_py()
        # a question's rare terms lead to shards that needn't have its other ones
        wanted = [(terms.get(t), w, rare) for t, w, rare in zip(*(questions.column(c).to_pylist() for c in ("term", "idf", "rare")), strict=True)]
        out_by, out_whole, out_doc, out_score, out_time, a = [], [], [], [], [], 0
        while a < len(who):
            b = a
            while b < len(who) and who[b] == who[a]:
                b += 1
            whole, name = who[a]
            began = time.perf_counter()
            held = [(t, w) for t, w, _ in wanted[a:b] if t is not None]
            if whole:
                doc, score = whole_scores(held, [t for t, _, rare in wanted[a:b] if rare and t is not None], length, mean, k, alive)
            else:
                doc, score, _ = best(held, length, mean, k, alive, score_step)
            out_time += [time.perf_counter() - began] * len(doc)
            out_by += [name] * len(doc)
            out_whole += [whole] * len(doc)
            out_doc.append(doc)
            out_score.append(score)
            a = b
        doc = np.concatenate(out_doc)
        columns = [pa.array(out_by, schema.field(0).type), keys.take(pa.array(doc)), *(pa.array([x] * len(doc), schema.field(c).type) for c, x in (("part", part), ("run", run), ("shard", shard)))]
        columns += [pa.array(doc, pa.int32()), pa.array(np.concatenate(out_score)), pa.array(out_whole, pa.bool_()), pa.array(out_time, pa.float64())]
        return pa.Table.from_arrays(columns, schema=schema)

    group = [*on, "q"]
    ddl = f"by {by_type.simpleString()}, key {key_type.simpleString()}, part string, run int, shard int, doc int, score double, whole boolean, seconds double"
    found = payload.groupBy(*group).cogroup(ask.groupBy(*group)).applyInArrow(rank, ddl)
    if alike:
        found = shared.keep(found.drop("seconds"), "found")
        lists = ranked(found.where("NOT whole"), k, ["part", "by"], "key").withColumnRenamed("by", "one").join(often, ["part", "one"])
        one = ["by", "key", "part", "run", "shard", "doc"]  # keys may be those of several documents
        found = lists.select(*one, "score").unionByName(found.where("whole").select(*one, "score")).groupBy(*one).agg(F.max("score").alias("score"))
    return found.select(F.col("by").alias(by), F.col("key").alias(key), *([F.col("part").alias(part)] if part else []), "score", *(["seconds"] if timed else []))


def counted(rows: DataFrame) -> DataFrame:
    """(part, term, n, total) of index rows: documents with each term, and under ALL all documents and their length."""
    return rows.groupBy("part", "term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def signed(docs: DataFrame, key: str, text: str, part: Column | None = None, language: str | None = None) -> DataFrame:
    """(part, term, n, total) that go with documents which are taken out: negative counts of their terms, and of themselves under ALL."""
    name = F.coalesce(part.cast("string"), F.lit("")) if part is not None else F.lit("")
    base = docs.select(name.alias("part"), analysed(F.col(text), language).alias("t"))
    each = base.select("part", F.explode(F.array_append(F.array_distinct("t"), F.lit(ALL))).alias("term"), F.size("t").cast("long").alias("dl"))
    return each.groupBy("part", "term").agg((-F.count("*")).alias("n"), (-F.sum(F.when(F.col("term") == ALL, F.col("dl")).otherwise(0))).alias("total"))

