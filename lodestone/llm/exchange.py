"""Corpus-wide counts of 64-bit keys for blocks of documents.

A block is a few megabytes of texts, handled in one piece by numpy. Each block deals its distinct keys out by their value;
where all blocks' keys of one range meet they are counted, and the counts go back in the same order, as numbers of the type asked for, which bounds them. So
no key is gathered more than once a block, whatever its frequency, and what moves is some bytes a key.

Up to DIRECT buckets, a block sends a row to each of them. Beyond, rows would be many and small: n blocks send n / 16 rows each.
There a block sends a row to each of some wide ranges, as many as the root of the buckets' number; groups of as many blocks merge
their keys and send them on, and the counts come back the same way. Rows then grow with the power 1.5 of the input, not 2.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scratch
from lodestone.llm.columns import text_of

BLOCK_BYTES = 4 << 20
#: Blocks whose keys' share one bucket counts, where a block has few keys; and keys that are sorted at a time there.
BUCKET_BLOCKS, AT_A_TIME = 16, 1 << 20
#: Buckets up to which blocks send to them directly: a block's keys make rows of some dozens of keys or more there.
DIRECT = 4096
_DEALT = "_blk int, bucket int, keys binary, counts binary"


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(_key, _text, _blk) of all rows, null texts empty, and how many blocks there are. Blocks are dealt by the key's and
    the text's hash, so a frequent key or text alone doesn't decide a block's size."""
    base = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    n = max(16, -(-total // block_bytes))
    return base.withColumn("_blk", F.pmod(F.xxhash64("_key", "_text"), F.lit(n)).cast("int")), n


def buckets(n_blocks: int, bucket_blocks: int = BUCKET_BLOCKS) -> int:
    """How many buckets count the keys of so many blocks: each gets about bucket_blocks blocks' worth. A square number beyond DIRECT."""
    n = max(16, -(-n_blocks // bucket_blocks))
    return n if n <= DIRECT else (math.isqrt(n - 1) + 1) ** 2


def sent(n_buckets: int) -> int:
    """How many ranges a block deals its keys to."""
    return n_buckets if n_buckets <= DIRECT else math.isqrt(n_buckets)


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as their first and the steps between them, in as few whole bytes as the largest step needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return struct.pack("<IBQ", len(keys), width, int(keys[0]) if len(keys) else 0) + np.ascontiguousarray(planes.T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n, width, first = struct.unpack_from("<IBQ", blob)
    out = np.zeros((n, 8), np.uint8)
    if n > 1:
        out[1:, :width] = np.frombuffer(blob, np.uint8, offset=13).reshape(width, n - 1).T
    keys = out.view("<u8").ravel()
    if n:
        keys[0] = first
    return np.cumsum(keys, dtype=np.uint64)


def bounds(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's keys start among ascending keys, and their number."""
    edges = [(b << 64) // n_buckets for b in range(1, n_buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)])).astype(np.int64)


def write_counts(counts: np.ndarray, dtype: type) -> bytes:
    return zstandard.compress(np.minimum(counts, np.iinfo(dtype).max).astype(dtype).tobytes(), 1)


def rows(blk: int, keys: np.ndarray, counts: np.ndarray, n_ranges: int, dtype: type) -> list[dict]:
    """Ascending keys and their counts, a row for each of the ranges that has any."""
    at = bounds(keys, n_ranges).tolist()
    return [{"_blk": blk, "bucket": b, "keys": pack(keys[x:y]), "counts": write_counts(counts[x:y], dtype)} for b, (x, y) in enumerate(zip(at, at[1:], strict=False)) if y > x]


def _table(made: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(made, pa.schema([("_blk", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))


def counted(base: DataFrame, n_blocks: int, find: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], dtype: type = np.uint8, bucket_blocks: int = BUCKET_BLOCKS) -> DataFrame:
    """Rows (_blk, bucket, counts). find(block) gives a block's distinct keys, ascending, and how often it has each. The
    counts of all blocks together come back for the same keys: read_counts() puts a block's rows in order."""
    n_buckets = buckets(n_blocks, bucket_blocks)
    n_ranges = sent(n_buckets)

    def deal(table: pa.Table) -> pa.Table:
        return _table(rows(table.column("_blk")[0].as_py(), *find(table), n_ranges, dtype))

    return answer(base.groupBy("_blk").applyInArrow(deal, _DEALT), n_buckets, dtype)


def answer(dealt: DataFrame, n_buckets: int, dtype: type = np.uint8) -> DataFrame:
    """Counts of all rows (_blk, bucket, keys, counts) of a range together, for each row's keys, where rows() dealt them to the
    ranges that sent() names. Rows of a negative block are counted, but not answered."""
    return _direct(dealt, dtype) if n_buckets <= DIRECT else _by_groups(dealt, n_buckets, dtype)


def _by_groups(dealt: DataFrame, n_buckets: int, dtype: type) -> DataFrame:
    """The same by way of groups of blocks, which have about a block's worth of keys in each wide range."""
    side, most = sent(n_buckets), np.iinfo(dtype).max
    number = F.when(F.col("_blk") < 0, -1 - F.col("_blk")).otherwise(F.col("_blk"))
    dealt = scratch.keep(dealt.select("_blk", "bucket", "keys", "counts"), "dealt").withColumn("_group", F.floor(number / side).cast("int"))

    def merge(table: pa.Table) -> pa.Table:
        counts = np.concatenate([np.frombuffer(zstandard.decompress(c), dtype) for c in table.column("counts").to_pylist()])
        keys, inverse = np.unique(np.concatenate([unpack(k) for k in table.column("keys").to_pylist()]), return_inverse=True)
        return _table(rows(table.column("_group")[0].as_py(), keys, np.minimum(np.bincount(inverse, counts), most), n_buckets, dtype))

    def part(table: pa.Table, replies: pa.Table) -> pa.Table:
        keys = [unpack(k) for k in table.column("keys").to_pylist()]
        totals, merged = read_counts(replies, dtype), np.unique(np.concatenate(keys))
        blocks = zip(table.column("_blk").to_pylist(), table.column("bucket").to_pylist(), keys, strict=True)
        made = [{"_blk": blk, "bucket": b, "counts": write_counts(totals[np.searchsorted(merged, k)], dtype)} for blk, b, k in blocks if blk >= 0]
        return pa.Table.from_pylist(made, pa.schema([("_blk", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary())]))

    merged = dealt.groupBy("_group", "bucket").applyInArrow(merge, _DEALT)
    replies = _direct(merged, dtype).select(F.col("_blk").alias("_group"), F.floor(F.col("bucket") / side).cast("int").alias("_wide"), "bucket", "counts")
    return dealt.groupBy("_group", "bucket").cogroup(replies.groupBy("_group", "_wide")).applyInArrow(part, "_blk int, bucket int, counts binary")


def _direct(dealt: DataFrame, dtype: type) -> DataFrame:
    """Where all rows of a bucket meet."""

    def add(table: pa.Table) -> pa.Table:
        keys = [unpack(k) for k in table.column("keys").to_pylist()]
        counts = [np.frombuffer(zstandard.decompress(c), dtype) for c in table.column("counts").to_pylist()]
        totals, most = [np.empty(len(k), dtype) for k in keys], np.iinfo(dtype).max
        for own in _ranges(keys):
            _, inverse = np.unique(np.concatenate([k[x:y] for k, (x, y) in zip(keys, own, strict=True)]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([c[x:y] for c, (x, y) in zip(counts, own, strict=True)]))[inverse]
            ends = np.cumsum([0, *(y - x for x, y in own)]).tolist()
            for t, (x, y), a, b in zip(totals, own, ends, ends[1:], strict=False):
                t[x:y] = np.minimum(total[a:b], most)
        asks = np.asarray(table.column("_blk")) >= 0
        replies = [write_counts(t, dtype) for t, ask in zip(totals, asks.tolist(), strict=True) if ask]
        table = table.filter(pa.array(asks))
        return pa.Table.from_arrays([table.column("_blk"), table.column("bucket"), pa.array(replies, pa.binary())], names=["_blk", "bucket", "counts"])

    return dealt.groupBy("bucket").applyInArrow(add, "_blk int, bucket int, counts binary")


def _ranges(keys: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """For each range of about AT_A_TIME keys: where each of the ascending lists is in it."""
    some = [k for k in keys if len(k)]
    low, high = min((int(k[0]) for k in some), default=0), max((int(k[-1]) for k in some), default=0)
    n = max(1, sum(map(len, keys)) // AT_A_TIME)
    edges = np.array([low + (high - low) * i // n for i in range(1, n)], np.uint64)
    at = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k in keys]
    return [[(a[i], a[i + 1]) for a in at] for i in range(n)]


def read_counts(replies: pa.Table, dtype: type = np.uint8) -> np.ndarray:
    """A block's counts, in the order of its ascending keys."""
    order = np.argsort(np.asarray(replies.column("bucket")), kind="stable")
    blobs = replies.column("counts").to_pylist()
    return np.frombuffer(b"".join(zstandard.decompress(blobs[i]) for i in order.tolist()), dtype)
