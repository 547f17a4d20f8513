"""Harmonic packing of token sequences.

A document's ids are cut into pieces whose lengths fall into reciprocal-capacity classes: class k holds lengths in
(capacity / (k + 1), capacity / k], and k of its pieces always fit one sequence. So a sequence of class k is any k pieces of
the class, and each class can be filled by many workers at once: a piece's number within its class says which
sequence it is in. Documents may be cut freely, so all but the short last pieces have exactly the length
capacity // k, which leaves next to no padding.

What remains of each class, fewer than k pieces, is bounded by the capacity alone (at most the sum of k - 1 over the
classes), whatever the size of the corpus. It is dealt to groups of about GROUP pieces, each packed by best fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import memo, scratch
from lodestone.llm.columns import documents, map_texts, text_of

CAPACITY, END_ID = 2048, 1
#: A document's last piece may have any length up to capacity // SHORT.
SHORT = 16


def cut(total: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(length, class) of each piece of a document with `total` ids, in order."""
    for _ in range(total // capacity):
        yield capacity, 1
    rest = total % capacity
    while rest > capacity // SHORT:
        k = -(-capacity // rest)
        yield capacity // k, k
        rest -= capacity // k
    if rest:
        yield rest, capacity // rest


def pieces(docs: DataFrame, vocabulary: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, k) of all documents; a null text is an empty one, which
    still has its end id. With with_ids, also ids array<int>. Null ids stay null, repeated rows are cut one by one, and an empty
    table gives none. Only doc_id and the text are read, so other columns may have any name."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = memo.encoder(vocabulary).encode_column(batch.column("_text"))
        owner, rows, parts = [], [], []
        plans: dict[int, list] = {}
        for i, ids in enumerate(made):
            ids = np.append(ids.astype("<u4"), np.uint32(end_id))
            start = 0
            if (plan := plans.get(len(ids))) is None:
                plan = plans[len(ids)] = list(cut(len(ids), capacity))
            for length, k in plan:
                part = ids[start : start + length]
                owner.append(i)
                rows.append((start, length, zlib.crc32(part.tobytes()), len(ids), k))
                if with_ids:
                    parts.append(part.astype(np.int32))
                start += length
        columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k"]
        if with_ids:
            columns.append(pa.array(parts, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "start long, length long, ids_crc32 long, doc_tokens long, k long" + ", ids array<int>" * with_ids
    base = docs.select("doc_id", text_of(text).alias("_text"))
    return map_texts(base, "_text", run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {schema}")


#: Pieces of the remainder that one task packs, about.
GROUP = 1024


def _fit(left: pa.Table, capacity: int) -> pa.Table:
    """The rows with bin and offset: the longest first, each in the bin with the least room that takes it."""
    left = left.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    rooms, bins = 0, 0  # bit r is set where a bin has room r
    where, offset = [], []
    for n in left.column("length").to_pylist():
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            rooms &= ~(0 if by_room[room] else 1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        where.append(b)
        offset.append(capacity - room)
        by_room[room - n].append(b)
        rooms |= 1 << room - n
    return left.append_column("bin", pa.array(where, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id (from 0, without gaps) and offset. `made` must be a written table: its rows are
    numbered, so they must not change between reads. Null ids come first, repeated documents are packed as often as they
    occur, and an empty table has no sequences. Columns of `made` beside those of pieces() are kept."""
    spark = made.sparkSession
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = made.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = spread.groupBy("k", "_b").agg(F.count("*").alias("n"))
    # capacity classes times buckets rows: small, whatever the corpus
    before = counts.select("k", "_b", (F.sum("n").over(W.partitionBy("k").orderBy("_b")) - F.col("n")).alias("_before"))
    classes = counts.groupBy("k").agg(F.sum("n").alias("_n")).withColumn("_full", F.expr("_n div k"))
    base = (F.sum("_full").over(W.orderBy("k")) - F.col("_full")).alias("_base")
    # what is left of all classes is dealt to as many groups as it fills
    groups = F.greatest(F.lit(1), F.expr(f"sum(_n - _full * k) over () div {GROUP}")).alias("_groups")
    classes = classes.select("k", "_full", base, groups, F.sum("_full").over(W.partitionBy()).alias("_total"))
    rank = F.col("_before") + F.row_number().over(W.partitionBy("k", "_b").orderBy("doc_id", "start", "length", "ids_crc32")) - 1
    # the classes are at most `capacity` rows
    ranked = spread.join(before, ["k", "_b"]).withColumn("_rank", rank).join(F.broadcast(classes), "k").withColumn("_bin", F.expr("_rank div k"))
    names = [c for c in made.columns if c != "k"]
    whole = ranked.where("_bin < _full").withColumn("sequence_id", F.col("_base") + F.col("_bin"))
    offset = F.sum("length").over(W.partitionBy("sequence_id").orderBy("_rank").rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    whole = whole.withColumn("offset", offset).select(*names, "sequence_id", "offset")
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "length"), F.col("_groups")).alias("_group")
    left = ranked.where("_bin >= _full").select(*names, "_total", group)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema)
    left = left.groupBy("_group").applyInArrow(lambda t: _fit(t, capacity), schema + ", bin long, offset long")
    # a row for each group: at most the remainder's bound over GROUP
    bins = left.groupBy("_group").agg((F.max("bin") + 1).alias("_bins"))
    bins = bins.select("_group", (F.sum("_bins").over(W.orderBy("_group")) - F.col("_bins")).alias("_first"))
    left = left.join(F.broadcast(bins), "_group").withColumn("sequence_id", F.col("_total") + F.col("_first") + F.col("bin"))
    return whole.unionByName(left.select(*names, "sequence_id", "offset"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pack(scratch.keep(made, "pieces")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
