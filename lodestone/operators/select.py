"""Quotas, boosts and presentation order of hits."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources import shared


def category_table(values: dict[str, object], default: object, column: Column) -> Column:
    """The value of a small mapping for a column."""
    out = None
    for k, v in values.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return F.lit(default) if out is None else out.otherwise(default)


def quota(hits: DataFrame, quotas: dict[str, int], k: int, category: str, by: str = "item_id", key: str = "doc_id", min_chars: int = 0, extra: int = 0, chars: str | None = None) -> DataFrame:
    """The k best hits of each question, where each category's best are guaranteed up to its quota, and up to `extra` more
    while the category's hits before them hold fewer than min_chars characters. Adds guaranteed and rank."""
    score = F.coalesce("score", F.lit(0.0))
    own = W.partitionBy(by, category).orderBy(score.desc(), key)
    limit = category_table(quotas, 0, F.col(category))
    ranked = hits.withColumn("_n", F.row_number().over(own))
    safe = F.col("_n") <= limit
    if extra and chars:
        before = F.coalesce(F.sum(chars).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.withColumn("_before", before)
        listed = F.col(category).isin(list(quotas))  # one with a quota of 0 is topped up too
        safe = safe | (listed & (F.col("_n") <= limit + extra) & (F.col("_before") < min_chars))
    ranked = ranked.withColumn("guaranteed", safe).drop("_n")
    order = W.partitionBy(by).orderBy(F.col("guaranteed").desc(), score.desc(), key)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_before")


def category(heading: Column, layer: Column, mapping: dict[str, str], suffix: str = " (overview)") -> Column:
    """A code chunk's category; overviews and unknown layers are "other"."""
    return F.when(heading.endswith(suffix), "other").otherwise(category_table(mapping, "other", layer))


def boost(hits: DataFrame, hints: list[str], factor: float, *columns: str) -> DataFrame:
    """Scores times `factor` where a hint occurs, in any case, in one of the columns; blank hints are dropped, and no hit is."""
    wanted = [h.strip().lower() for h in hints if h.strip()]
    if not wanted:
        return hits
    place = F.lower(F.concat_ws("|", *columns))
    hit = F.exists(F.array(*map(F.lit, wanted)), lambda h: place.contains(h))
    return hits.withColumn("score", F.col("score") * F.when(hit, factor).otherwise(1.0))


def boost_many(hits: DataFrame, hints: DataFrame, factor: float, by: str, *columns: str) -> DataFrame:
    """As boost(), with hints (by, hint) of each question, however many: a question's hits are read once each, against an automaton of all of
    its hints at a time. Hits without a hint keep their score."""
    wanted = hints.select(by, F.lower(F.trim("hint")).alias("hint")).where("hint <> ''").distinct()
    numbered = hits.withColumn("_n", F.monotonically_increasing_id()).withColumn("_place", F.lower(F.concat_ws("|", *columns)))
    kind = hits.schema[by].dataType
    schema = pa.schema([("_n", pa.int64())])

    def matched(rows: pa.Table, own: pa.Table) -> pa.Table:
        automaton = ahocorasick.Automaton()
        for h in own.column("hint").to_pylist():
            automaton.add_word(h, h)
        if not rows.num_rows or not len(automaton):
            return schema.empty_table()
        automaton.make_automaton()
        found = [n for n, place in zip(rows.column("_n").to_pylist(), rows.column("_place").to_pylist(), strict=True) if next(automaton.iter(place), None) is not None]
        return pa.Table.from_arrays([pa.array(found, pa.int64())], schema=schema)

    kept = shared.keep(numbered, "hits")  # the numbers must be the same at both reads
    hit = kept.select(F.col(by).alias("_by"), "_n", "_place").groupBy("_by").cogroup(wanted.select(F.col(by).cast(kind).alias("_by"), "hint").groupBy("_by")).applyInArrow(matched, "_n long")
    out = kept.join(hit.withColumn("_hit", F.lit(True)), "_n", "left")
    return out.withColumn("score", F.col("score") * F.when(F.col("_hit"), factor).otherwise(1.0)).drop("_n", "_place", "_hit")


def reorder(hits: DataFrame, order: list[str], category_column: str, by: str = "item_id") -> DataFrame:
    """Ranks by the category's place in `order`, unknown ones last, otherwise as before."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(category_column))
    place = F.when(place == 0, len(order) + 1).otherwise(place)
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(place, "rank")))
