"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes the documents its predecessor kept and returns those it keeps, with the columns of documents; the last
one returns the packed pieces. A stage's result is written as Parquet and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, packing, quality, scratch, suffix, toxicity

#: Bytes of a repeated passage: fewer than any passage of fifty words has, so that one of more is found whole.
PASSAGE_BYTES = 240

_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Working tables of stages called by hand: (folder, stage, paths).
_open: list[tuple[str, str, list[str]]] = []


def _stage(after: str | None) -> Callable[[_Stage], _Stage]:
    """A stage as it is called by hand, one after the other. Its documents are what the stage `after` gave, written by then, so
    that one's working tables go, unless it has been called more than once meanwhile: then it isn't known whose result has been
    written. run() calls the plain functions and keeps account itself."""

    def decorate(function: _Stage) -> _Stage:
        @wraps(function)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before = [x for x in _open if x[:2] == (sf_dir, after)]
            if len(before) == 1:
                _open.remove(before[0])
                scratch.drop(spark, before[0][2])
            with scratch.scope() as made:
                out = function(spark, docs, sf_dir)
            _open.append((sf_dir, function.__name__, made))
            return out

        stage.plain = function
        return stage

    return decorate


def _as(docs: DataFrame, made: DataFrame) -> DataFrame:
    """Rows (_others, text) with the columns of `docs`; n_chars follows the text."""
    out = made.select("_others.*", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _others(docs: DataFrame):
    """All columns but the text as one, so that no operator's column can clash with them."""
    return F.struct(*[c for c in docs.columns if c != "text"]).alias("_others")


@_stage(None)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents of a host share go; documents that fail the base rules, or of which such lines are most, go whole."""
    return _as(docs, quality.quality(docs.select(_others(docs), "text", "source"), with_text=True).where("kept"))


@_stage("quality_rules")
def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model is fitted on labelled documents that are still here."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(_others(docs), "text"), model).where("predicted = 0").select("_others.*", "text").select(*docs.columns)


@_stage("toxic_documents")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays, once; null ids stand behind all others. Rows are
    told apart by numbers, which are written down, so null and repeated ids lose nothing."""
    rows = scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = jaccard.linked(rows.select("_row", "text"), "_row").select("_row", "component_id").join(rows.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_row"))
    kept = groups.groupBy("component_id").agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


@_stage("near_duplicates")
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of PASSAGE_BYTES bytes that stand anywhere else go; documents stay, even if nothing of them is left."""
    made = suffix.dedup(docs.select(_others(docs), "text"), "_others", length=PASSAGE_BYTES, with_text=True)
    return _as(docs, made.select("_others", F.col("kept_text").alias("text")))


@_stage("repeated_passages")
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    made = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(scratch.keep(made, "pieces")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: The classifier and the tokenizer can't be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Every stage's result but the last is a table in the shared folder, which goes, with the
    stage's working tables, as soon as the next one is written. What the result reads stays; several runs don't touch each other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: list[str] = []
    for name, stage in STAGES[:-1]:
        with scratch.scope() as made:
            out = stage.plain(spark, docs, sf_dir)
        with scratch.scope() as result:
            docs = scratch.keep(out, name.replace(" ", "-"))
        scratch.drop(spark, [*made, *written])
        written = result
    out = STAGES[-1][1].plain(spark, docs, sf_dir)  # cuts the documents into a table of pieces, which the result reads
    scratch.drop(spark, written)
    return out
