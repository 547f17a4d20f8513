"""Token ids in binary shard files with constant-time access by document key.

A shard holds the ids of a range of keys in ascending order, as raw little-endian integers of the narrowest width that
holds the vocabulary, and an index: a minimal perfect hash that maps each key to one slot, and for each slot the key's
fingerprint, its first id's place in the shard and its number of ids. A lookup hashes the key, reads one displacement
and one slot, and compares the fingerprint; a key that isn't in the shard is refused but for one in 2**32.

    magic 8 bytes | n keys, n documents, n without key, n ids, width, n buckets u64
    displacements u32[n buckets] | fingerprints u32[n keys] | keys i64[n keys] | first documents u64[n keys]
    numbers of documents u64[n keys] | starts u64[n documents + 1] | ids

Documents of one key stand next to each other, each with its own ids, and may fill several shards; those without a key are
the first ones. Files are written under a name of their own for each attempt, and only the files of finished attempts are
listed in the returned manifest, so a lost or repeated task leaves no trace in what is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import memo, scratch, spans
from lodestone.llm.columns import documents, slices, text_of
from lodestone.llm.spans import mix

MAGIC, _HEAD = b"LODEIDS2", struct.Struct("<8s6Q")
END_ID = 1
#: Text bytes of one shard, about.
SHARD_BYTES = 8 << 20
#: Shards whose numbers of ids are added up in one go, and that are read in one task.
GROUP, TASK_SHARDS = 1024, 4
#: Keys that share a displacement, on average.
PER_BUCKET = 4


def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key: one value for its bucket, one for its slot, and its fingerprint."""
    h = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    g = mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    return h, g, (mix(g) >> np.uint64(32)).astype(np.uint32)


def _slot(g: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (mix(g + displacement.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) % np.uint64(max(1, n))).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of the buckets, and the slot of each of the distinct keys: 0 ... n - 1, each once."""
    n = len(keys)
    n_buckets = max(1, -(-n // PER_BUCKET))
    h, g, _ = _hashes(keys)
    bucket = (h % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    count = np.bincount(bucket, minlength=n_buckets)
    start = np.cumsum(count) - count
    displacements, taken, slots = np.zeros(n_buckets, np.uint32), np.zeros(n, bool), np.zeros(n, np.int64)
    for b in np.argsort(-count, kind="stable").tolist():  # crowded buckets first, while there is room
        own = order[start[b] : start[b] + count[b]]
        if not len(own):
            break
        base, width = 0, 16
        while True:  # the first displacement that sends the bucket's keys to free and different slots
            tried = np.arange(base, base + width, dtype=np.uint64)
            at = _slot(g[own][None, :], tried[:, None], n)
            good = ~taken[at].any(1)
            if len(own) > 1:
                ordered = np.sort(at, 1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                displacements[b] = base + k
                slots[own] = at[k]
                taken[at[k]] = True
                break
            base, width = base + width, min(1 << 16, width * 4)
    return displacements, slots


@dataclass
class Shard:
    """A shard's file content, for reading."""

    raw: bytes

    def __post_init__(self):
        magic, self.n, self.n_docs, self.n_without, self.n_ids, width, n_buckets = _HEAD.unpack_from(self.raw)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = _HEAD.size

        def part(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.raw, dtype, n, at)
            at += out.nbytes
            return out

        self.displacements, self.fingerprints, self.keys = part("<u4", n_buckets), part("<u4", self.n), part("<i8", self.n)
        self.first, self.count, self.starts = part("<u8", self.n), part("<u8", self.n), part("<u8", self.n_docs + 1)
        self.ids = part(f"<u{width}", self.n_ids)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: whether it is here, its first document's number, and how many documents it has."""
        if not self.n:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        h, g, fingerprint = _hashes(keys)
        slot = _slot(g, self.displacements[(h % np.uint64(len(self.displacements))).astype(np.int64)], self.n)
        return self.fingerprints[slot] == fingerprint, self.first[slot].astype(np.int64), self.count[slot].astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        return self.ids[int(self.starts[i]) : int(self.starts[i + 1])]

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each of a key's documents; none if the key isn't here."""
        found, first, count = self.find(np.array([key], np.int64))
        return [self.document(i) for i in range(int(first[0]), int(first[0] + count[0]))] if found[0] else []


def pack_shard(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray, without: int = 0) -> bytes:
    """A shard's bytes: each document's number of ids, all ids in a row, and the ascending keys of all documents but the first
    `without`, which have none."""
    fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    distinct, count = keys[fresh], np.diff(np.concatenate((fresh, [len(keys)])))
    displacements, slots = build_index(distinct)
    by_slot = np.argsort(slots)
    _, _, fingerprints = _hashes(distinct)
    return b"".join(
        [
            _HEAD.pack(MAGIC, len(distinct), len(lengths), without, len(ids), ids.dtype.itemsize, len(displacements)),
            displacements.astype("<u4").tobytes(),
            fingerprints[by_slot].astype("<u4").tobytes(),
            distinct[by_slot].astype("<i8").tobytes(),
            (fresh + without)[by_slot].astype("<u8").tobytes(),
            count[by_slot].astype("<u8").tobytes(),
            np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes(),
            ids.tobytes(),
        ]
    )


def write(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes all documents as shards under `path` (a URI that all executors reach) and returns the manifest, a written table:
    (shard, file, first_key, last_key, n_docs, n_ids), shards in ascending order of keys.

    Null texts are empty and have the end id only. Null keys come first. Equal keys are ordered by their texts' hashes and
    may go on in the next shard, so no key decides a shard's size; repeated rows are documents of their own. An empty table
    gives no shard.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("_key"), text_of(text).alias("_text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    n = max(1, -(-total // shard_bytes))
    order = ["_key", "_hash", "_n"]
    ordered = base.withColumn("_hash", F.xxhash64("_text")).withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).select("_key", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memo.encoder(vocabulary)
        keys, lengths, ids, without = [], [], [], 0
        for batch in batches:
            for part in slices(batch, "_text"):
                without += part.column("_key").null_count
                keys.append(np.asarray(part.column("_key").drop_null(), np.int64))
                got = [np.append(x, encoder.dtype.type(end_id)) for x in encoder.encode_column(part.column("_text"))]
                lengths.append(np.fromiter(map(len, got), np.int64, len(got)))
                ids.append(np.concatenate(got))
        if keys:
            keys, lengths, ids = np.concatenate(keys), np.concatenate(lengths), np.concatenate(ids)
            shard = TaskContext.get().partitionId()
            name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
            store, place = pa.fs.FileSystem.from_uri(f"{path}/{name}")
            with store.open_output_stream(place) as out:
                out.write(pack_shard(keys, lengths, ids, without))
            some = [int(keys[i]) for i in (0, -1)] if len(keys) else [None, None]
            row = {"shard": shard, "file": name, "first_key": some[0], "last_key": some[1], "n_docs": len(lengths), "n_ids": len(ids)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.string() if c == "file" else pa.int64()) for c in row]))

    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    return scratch.keep(ordered.mapInArrow(run, "shard long, file string, first_key long, last_key long, n_docs long, n_ids long"), "manifest")


def read(path: str, manifest: DataFrame) -> DataFrame:
    """One row for each document, read from the files by lookups through their indexes: key, start (ids of all documents before
    it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    grouped = manifest.withColumn("_group", F.expr(f"shard div {GROUP}"))
    sums = grouped.groupBy("_group").agg(F.sum("n_ids").alias("n"))
    before = sums.select("_group", (F.sum("n").over(W.orderBy("_group")) - F.col("n")).alias("before"))  # a row for GROUP shards
    base = F.col("before") + F.sum("n_ids").over(W.partitionBy("_group").orderBy("shard")) - F.col("n_ids")
    placed = grouped.join(before, "_group").select("shard", "file", base.alias("base"))
    tasks = max(1, -(-manifest.count() // TASK_SHARDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, place = pa.fs.FileSystem.from_uri(f"{path}/{name}")
                with store.open_input_stream(place) as file:
                    shard = Shard(file.read())
                keys = np.sort(shard.keys)
                found, first, count = shard.find(keys)
                docs = np.concatenate((np.arange(shard.n_without), spans.ragged(first, count)))
                if not found.all() or len(docs) != shard.n_docs:
                    raise ValueError("a key is missing from its shard's index")
                own = np.concatenate((np.zeros(shard.n_without, np.int64), np.repeat(keys, count)))
                starts = shard.starts.astype(np.int64)
                crc = [zlib.crc32(shard.document(i).astype("<u4").tobytes()) for i in docs.tolist()]
                columns = [pa.array(own, pa.int64(), mask=np.arange(len(docs)) < shard.n_without), starts[docs] + base, starts[docs + 1] - starts[docs], crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(tasks, "shard").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def op8_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "ids")
    manifest = write(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(path, manifest).withColumnRenamed("key", "doc_id")
