"""Document fingerprints: the k smallest hashes of a text's word shingles.

A sketch is the sorted array of the k smallest distinct 48-bit hashes of the shingles. It can be merged from the
sketches of a text's parts, and estimates the number of distinct shingles, the resemblance of two texts (shared part of
the shingles of both) and the containment of one in the other. Everything here is built of SQL functions.

Shingles are five words in a row, words being what stands between the six ASCII white spaces; a text of fewer words is
one shingle, and a text without words has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.columns import documents, text_of

#: Hashes in a sketch, at most, and words in a shingle.
K, WORDS = 256, 5
_HASH_SPACE = float(1 << 48)
#: Text bytes in one bucket of neighbouring documents, about, and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 10_000


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """A 48-bit hash of each shingle, in order; empty for a null text and one without words."""
    text = F.coalesce(text, F.lit(""))
    hashes = F.transform(F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), "[\\x09-\\x0D ]+"), lambda w: F.xxhash64(w))
    several = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(words)]), 16))
    one = lambda h: F.array(F.shiftrightunsigned(F.xxhash64(h), 16))
    # the word hashes are bound once, as the only element of an array, and then used for all shingles
    made = F.element_at(F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= words, several(h)).otherwise(one(h))), 1)
    return F.when(F.btrim(text, F.lit(" \t\n\x0b\f\r")) == "", F.array().cast("array<bigint>")).otherwise(made)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(parts: DataFrame, by: list[str], sketch_column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group of sketches: what the sketch of all their shingles together would be. Each task passes on
    at most k hashes of a group, so no group is gathered whole. Null and empty sketches add nothing."""
    hashes = parts.select(*by, F.explode_outer(sketch_column).alias("_h")).distinct()
    least = hashes.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last()))).where(F.col("_r") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketch_column))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Distinct shingles: exact below k, estimated from the largest kept hash otherwise."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / (F.element_at(s, -1) / _HASH_SPACE))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the shared part of all shingles of two texts, 0 to 1. Two texts without shingles are alike (1), one of
    them and any other text are not (0)."""
    smallest = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    shared = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    # bound once, as in shingle_hashes
    share = F.element_at(F.transform(F.array(smallest), shared), 1)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the part of a's shingles that b has too, 0 to 1; 1 if a has none."""
    r = resemblance(a, b, k)
    both = r / (1 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(s: Column) -> Column:
    """A sketch as text: 12 hexadecimal digits for each hash."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 12, "0"))), "")


def _bucketed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, list[tuple[int, object, int]]]:
    """The rows with _bucket, ascending ranges of the key (null keys: the lowest), and for each bucket (its number, its
    highest key, the bucket after it in the order of following())."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    n = max(1, min(MOST_BUCKETS, -(-size // BUCKET_BYTES), rows or 1))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n)).first()[0] or [] if n > 1 else []
    cuts = sorted(set(cuts))
    # the place among the cuts, found in two steps of about sqrt(n) comparisons
    wide = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    if cuts:
        kind = docs.schema[key].dataType.simpleString()
        heads = F.array(*[F.lit(g[0]).cast(kind) for g in groups])
        table = F.array(F.array().cast(f"array<{kind}>"), *[F.array(*[F.lit(x).cast(kind) for x in g]) for g in groups])
        group = F.size(F.filter(heads, lambda c: c <= F.col(key)))
        inside = F.size(F.filter(F.get(table, group), lambda c: c <= F.col(key)))
        bucket = F.when(F.col(key).isNull(), 0).otherwise(F.greatest(group - 1, F.lit(0)) * wide + inside)
    else:
        bucket = F.lit(0)
    out = docs.withColumn("_bucket", bucket)
    # at most MOST_BUCKETS rows, whatever the corpus
    tops = sorted((r["_bucket"], r["top"]) for r in out.groupBy("_bucket").agg(F.max(key).alias("top")).collect())
    return out, [(b, top, tops[(i + 1) % len(tops)][0]) for i, (b, top) in enumerate(tops)]


def following(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text, sketch, next_text, next_sketch) of all documents, the next one being that with the next lower
    key; after the lowest comes the highest. Equal keys are ordered by their texts' hashes; null keys are the lowest.

    Documents are dealt out by ranges of the key. The highest one of each range also goes to the range above, where
    it follows the lowest, so no task sees more than a range.
    """
    spark = docs.sparkSession
    rows, edges = _bucketed(docs.select(F.col(key), text_of(text).alias(text)), key, text)
    kind = docs.schema[key].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(edges, f"_bucket int, _top {kind}, _above int"))  # one row for each bucket
    rows = rows.join(table, "_bucket", "left")
    top = F.col(key).eqNullSafe(F.col("_top"))
    places = F.when(top, F.array("_bucket", "_above")).otherwise(F.array("_bucket"))
    rows = rows.select(key, text, F.posexplode(places).alias("_guest", "_bucket")).repartition("_bucket")
    rows = rows.withColumn("sketch", sketch(F.col(text)))
    order = W.partitionBy("_bucket").orderBy("_guest", F.col(key).desc_nulls_last(), F.xxhash64(text))
    rows = rows.withColumn("next_text", F.lead(text).over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return rows.where("_guest = 0").drop("_guest", "_bucket")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = following(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )
