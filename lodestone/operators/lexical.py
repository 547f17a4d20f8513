"""BM25 ranking of a corpus for a set of questions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.text import tokens
from lodestone.operators.best import HELD, MOST_QUESTIONS, Best, groups, passed_on, pick, question_blocks, slices
from lodestone.sources import shared

K1, B = 1.5, 0.75
#: Terms of all questions, each question's counted, up to which the corpus is scanned with all questions; and documents that have a term,
#: up to which the term is joined where there are more questions.
SCANNED, RARE = MOST_QUESTIONS, 256


def ranked(scores: DataFrame, k: int, by: str | list[str] = "item_id", key: str = "doc_id") -> DataFrame:
    """The k best rows of each question, by score and then key, with their rank from 1."""
    order = W.partitionBy(by).orderBy(F.col("score").desc(), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(corpus: DataFrame, questions: DataFrame, k: int, key: str = "doc_id", text: str = "text", by: str = "item_id", within: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(by, key, score), and `within` if given: at least the k best rows for each question by BM25, of each value of `within` if
    given, among all rows that share a token with the question; ranked() takes the k best of these. `pairs` (by, within) names the values
    that each question is asked of, all of them without it; frequencies are those of the whole corpus in any case.

    A bounded set of questions goes over the corpus with each block of rows: its tokens are told once and those asked for are written, then counted and
    scored. A larger one, which grows with the corpus, is joined by its rare terms, and by the rows that have the same common terms: see _joined().
    """
    spark = corpus.sparkSession
    some = corpus.select(key, *[within] * bool(within), text)
    if 0 < len(some.inputFiles()) < spark.sparkContext.defaultParallelism:  # one small file would keep one core busy; the names alone are read
        some = some.repartition(spark.sparkContext.defaultParallelism)
    cut = some.select(key, *[within] * bool(within), tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    asked = questions.select(by, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    if asked.limit(SCANNED + 1).count() > SCANNED:
        return _joined(cut, asked, k, key, by, within, pairs)
    terms = [r["term"] for r in asked.select("term").distinct().collect()]
    cut = shared.keep(cut.withColumn("t", _only(terms)), "asked")
    spread = cut.select("dl", F.explode(F.array_append(F.array_distinct("t"), "")).alias("term"))
    counted = lambda known: spread.join(known, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    found = _scan(cut, asked, k, key, by, within, counted, told=True)
    return found if pairs is None else found.join(pairs.select(by, within).distinct(), [by, within], "left_semi")


def _only(terms: list[str]) -> Column:
    """The terms in column t that are among these, as one text: a literal made for each of thousands takes seconds. Terms hold no quotes."""
    return F.expr("filter(t, x -> x IN ({}))".format(", ".join(f"'{x}'" for x in terms or [""])))


def _scan(cut: DataFrame, asked: DataFrame, k: int, key: str, by: str, within: str | None, counted: Callable[[DataFrame], DataFrame], told: bool = False) -> DataFrame:
    """At least the k best rows for each question, and about k for each task. cut: key, `within`, t (tokens), dl (how many there
    are in the whole text); asked: by, term; counted: gives (term, n, mean) of known terms, n rows that have it, and for the empty term the
    number and mean length of all rows. `told`: rows have asked terms only.

    Frequencies are counted over the whole corpus first, by partial counts of the questions' terms only. Then each block of rows is
    scored against all questions at once: a frequent term is one row of numbers, not a join key. Tasks get the asked tokens only.
    """
    spark = cut.sparkSession
    by_type, key_type = (df.schema[c].dataType for df, c in ((asked, by), (cut, key)))
    names = [by, key, *[within] * bool(within), "score"]
    types = [by_type, key_type, *(cut.schema[c].dataType for c in [within] if c)]
    schema = pa.schema([*((n, to_arrow_type(t)) for n, t in zip(names, types, strict=False)), ("score", pa.float64())])
    ddl = ", ".join(f"{n} {t.simpleString()}" for n, t in zip(names, types, strict=False)) + ", score double"

    def part(block: list) -> DataFrame:
        items = list(dict.fromkeys(r[by] for r in block))
        number, wanted = {x: i for i, x in enumerate(items)}, defaultdict(list)
        for r in block:
            wanted[r["term"]].append(number[r[by]])
        terms = {t: i for i, t in enumerate(sorted(wanted))}
        # by HELD questions: the terms that some of them ask for, and the places of these
        held = [{i: own[(own >= at) & (own < at + HELD)] - at for i, t in enumerate(terms) if ((own := np.array(wanted[t])) // HELD == at // HELD).any()} for at in range(0, len(items), HELD)]
        # one row for each term of the block's questions, and one, the empty term, that stands for every row of the corpus
        known = F.broadcast(spark.createDataFrame([(t,) for t in ["", *terms]], "term string"))
        counts = {r["term"]: r for r in counted(known).collect()}
        n, mean = (counts[""]["n"], counts[""]["mean"]) if counts else (0, 1.0)
        df = np.array([counts[t]["n"] if t in counts else 0 for t in terms], float)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

        def weights(some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Terms of rows, the rows, ascending in a term, and what the term adds to the row's score."""
            lists = some.column("t")
            length = np.asarray(some.column("dl"))
            coded = lists.flatten().dictionary_encode()
            term = np.array([terms.get(x, -1) for x in coded.dictionary.to_pylist()], np.int64)[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths(), np.int64))
            pairs, tf = np.unique(term[term >= 0] * len(lists) + row[term >= 0], return_counts=True)  # by term, then row
            term, row = np.divmod(pairs, max(1, len(lists)))
            return term, row, idf[term] * tf / (tf + K1 * (1 - B + B * length[row] / mean))

        def scored(some: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            """Scores of rows for HELD questions at a time, 0 where they share no term, and the place of the first of these."""
            term, row, weight = weights(some)
            edges = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1], [True]))) if len(term) else np.zeros(1, np.int64)
            for i, of in enumerate(held):
                scores = np.zeros((some.num_rows, min(HELD, len(items) - i * HELD)))
                for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                    if (asking := of.get(int(term[a]))) is not None:
                        scores[np.ix_(row[a:b], asking)] += weight[a:b, None]
                yield i * HELD, scores

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(items), k)
            for batch in batches:
                for some in slices(batch):
                    keys, parts = np.asarray(some.column(key)), list(groups(some, within))
                    for first, exact in scored(some):
                        meets, scores = exact > 0, np.round(exact, 6)
                        for value, g in parts:
                            own = scores[g]
                            row, question = pick(own, meets[g] & (own >= best.bound(value, first, own.shape[1])), keys[g], k)
                            best.add(value, question + first, keys[g[row]], own[row, question])
                    yield from passed_on(best, items, schema)
            yield from passed_on(best, items, schema, end=True)

        return (cut if told else cut.withColumn("t", _only(list(terms)))).mapInArrow(run, ddl)

    return reduce(DataFrame.unionByName, [part(b) for b in question_blocks(asked, by)])


def _joined(cut: DataFrame, asked: DataFrame, k: int, key: str, by: str, within: str | None, pairs: DataFrame | None) -> DataFrame:
    """As topk(), for any number of questions. Keys must be unique.

    A row that has one of a question's rare terms, which are those that up to RARE rows have, is found by that term and gets its whole score.
    All other rows are scored by common terms alone: rows of one length that have the same common terms as often each have one score
    for any question, so the k lowest keys of them stand for all, and questions with the same common terms have one list of k. That list may
    name a row with a rare term, by less than its score: the higher score counts. What such a row is listed before, its whole
    score is before too, so no row of the k best is missing. Where texts are long, few rows stand for others, and each block of such
    sets of common terms is a pass.
    """
    place = [key, *[within] * bool(within)]
    occurs = cut.select(*place, "dl", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    occurs = shared.keep(occurs.groupBy(*place, "dl", "term").agg(F.count("*").alias("tf")), "occurrences")
    n, mean = cut.agg(F.count("*"), F.avg("dl")).first()
    terms = shared.keep(occurs.groupBy("term").agg(F.count("*").alias("df")), "terms")
    rare, common = terms.where(F.col("df") <= RARE), terms.where(F.col("df") > RARE)

    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean or 1))))
    met = occurs.join(rare, "term", "left_semi").join(asked, "term").select(by, *place).distinct()
    if pairs is not None:
        pairs = pairs.select(by, within).distinct()
        met = met.join(pairs, [by, within], "left_semi")
    weights = occurs.join(terms, "term").select(key, "term", weight.alias("weight"))
    whole = met.join(weights, key).join(asked, [by, "term"]).groupBy(by, *place).agg(F.round(F.sum("weight"), 6).alias("score"))

    often = asked.join(common, "term", "left_semi").groupBy(by).agg(F.array_sort(F.collect_set("term")).alias("terms")).withColumn("set", F.array_join("terms", " "))
    often = shared.keep(often, "sets")
    alike = occurs.join(common, "term", "left_semi").groupBy(*place, "dl").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("has"))
    first = W.partitionBy(*place[1:], "dl", "has").orderBy(key)
    alike = alike.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    alike = shared.keep(alike.select(*place, "dl", F.flatten(F.transform("has", lambda h: F.array_repeat(h["term"], h["tf"].cast("int")))).alias("t")), "alike")
    sets = often.select("set", "terms").distinct().select("set", F.explode("terms").alias("term"))
    all_rows = cut.sparkSession.createDataFrame([("", n, float(mean or 1))], "term string, n long, mean double")
    counted = lambda known: terms.select("term", F.col("df").alias("n"), F.lit(None).cast("double").alias("mean")).join(known, "term", "left_semi").unionByName(all_rows)
    lists = shared.keep(ranked(_scan(alike, sets, k, key, "set", within, counted), k, ["set", *place[1:]], key).drop("rank"), "lists")
    of = often.select(by, "set")
    part = of.join(lists, "set") if pairs is None else of.join(pairs, by).join(lists, ["set", within])
    return whole.unionByName(part.select(*whole.columns)).groupBy(by, *place).agg(F.max("score").alias("score"))


def coverage(hits: DataFrame, question: str = "question", text: str = "text") -> DataFrame:
    """The deterministic stand-in for a cross-encoder: the share of the question's distinct tokens that the text has."""
    asked, has = F.array_distinct(tokens(F.col(question))), F.array_distinct(tokens(F.col(text)))
    share = F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, has)) / F.size(asked))
    return hits.withColumn("score", F.round(share, 6))
