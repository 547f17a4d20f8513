"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. A block, some megabytes of texts, keeps its pre-tokens' positions as numbers into its
own list of distinct words, and deals those words out by their hash. Where all blocks' copies of a word meet, it is
encoded once; its ids go back to the blocks, and each text is put together again by position. Neither a frequent word
nor a large group of equal texts weighs more than one word a block.

Decoding joins ids with the table of token bytes, a row each, which the vocabulary bounds: all ids of all documents (decode), or the
distinct ids of a bucket's words on their way back to a block, which puts each text's bytes together by position (op4_byte_bpe).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm import memo, spans
from lodestone.llm.columns import documents, text_of

#: Text bytes of a block, and blocks whose words' share meets in one bucket, about.
BLOCK_BYTES, BUCKET_BLOCKS = 4 << 20, 8

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@cache
def pattern(text: str = public_tokenizers.PATTERN) -> regex.Pattern:
    """The pre-token pattern; white space is spelt out, as regex libraries differ on some control characters."""
    out = text.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    return regex.compile(out)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """The table of token bytes: (id, bytes), a row for each token of the vocabulary."""
    return spark.createDataFrame([(i, b) for b, i in ranks(path).items()], "id int, bytes binary")


def by_id(ids: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (id, bytes): each id's number of bytes, 0 where there is no row, where they start, and all bytes."""
    size = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    own, first = np.unique(ids, return_index=True)
    parts = [tokens[i] or b"" for i in first.tolist()]
    size[own] = np.fromiter(map(len, parts), np.int64, len(parts))
    return size, np.cumsum(size) - size, np.frombuffer(b"".join(parts), np.uint8)


def decode_ids(ids: np.ndarray, size: np.ndarray, start: np.ndarray, raw: np.ndarray) -> bytes:
    """The bytes of ids in a row, by rows that by_id() put in order. No token is empty, so an id without bytes is an error."""
    if len(ids) and (int(ids.max()) >= len(size) or not size[ids].all()):
        raise ValueError("an id has no token")
    return raw[spans.ragged(start[ids], size[ids])].tobytes()


def _write_list(items: list[bytes]) -> bytes:
    return zstandard.compress(struct.pack("<I", len(items)) + np.array([len(x) for x in items], "<u4").tobytes() + b"".join(items), 3)


def _read_list(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def _write_numbers(x: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent: a byte each, and four more for those from 255."""
    large = x[x >= 255].astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.compress(struct.pack("<Q", len(x)) + np.minimum(x, 255).astype(np.uint8).tobytes() + large.T.tobytes(), 3)


def _read_numbers(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    n = struct.unpack_from("<Q", raw)[0]
    out = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    planes = np.frombuffer(raw, np.uint8, offset=8 + n).reshape(4, -1).astype(np.int64)
    out[out == 255] = planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24
    return out


def cut(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pre-tokens of a column of texts: the distinct ones, the frequent ones first; all texts' pre-tokens as numbers of
    these; and how many each text has."""
    raw, starts = spans.buffer(column)
    w_start, w_end = spans.words(raw, starts)
    first = spans.owners(w_start, starts)
    simple = memo.simple(raw, starts, w_start, w_end, first, spaced=True)
    w_start = memo.with_space(w_start, first)
    find = pattern().findall
    number: dict[str, int] = {}
    put = number.setdefault
    data = raw.tobytes()
    index, _, inverse = spans.distinct(raw, w_start, w_end)
    parts: list[int] = []
    ends: list[int] = []
    plain, one = memo.PLAIN.fullmatch, parts.append
    for a, b in zip(w_start[index].tolist(), w_end[index].tolist(), strict=True):
        chunk = data[a:b].decode("utf-8", "replace")
        if m := plain(chunk):
            word, marks = m.groups()
            one(put(word, len(number)))
            if marks:
                one(put(marks, len(number)))
        else:
            for x in find(chunk):
                one(put(x, len(number)))
        ends.append(len(parts))
    size = np.diff(np.array([0, *ends], np.int64))
    at = np.cumsum(size) - size
    per_word = size[inverse]
    flat = np.asarray(parts, np.int64)[spans.ragged(at[inverse], per_word)]
    bounds = np.concatenate(([0], np.cumsum(per_word)))[first]
    if not simple.all():  # texts with other white space, one by one
        rows = [flat[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        for i in np.flatnonzero(~simple).tolist():
            rows[i] = np.array([put(x, len(number)) for x in find(column[i].as_py())], np.int64)
        flat = np.concatenate(rows)
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    count = np.bincount(flat, minlength=len(number))
    order = np.argsort(-count, kind="stable")
    order = order[: np.count_nonzero(count)]
    rank = np.zeros(len(number), np.int64)
    rank[order] = np.arange(len(order))
    words = list(number)
    return [words[i].encode() for i in order.tolist()], rank[flat], np.diff(bounds)


def _bucket(words: list[bytes], n: int) -> np.ndarray:
    column = pa.array(words, pa.binary())
    raw, at = spans.buffer(column)
    return ((spans.Hashes(raw).of(at[:-1], at[1:]) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def encoded(docs: DataFrame, vocabulary: str, finish, columns: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, with_tokens: bool = False) -> DataFrame:
    """finish(ids, positions, counts, tokens) of each block, as columns beside each document's key, where ids holds the ids of
    each of the block's distinct words, and tokens, if asked for, what by_id() makes of these ids' rows in the token-byte table. It
    returns one list for each of the columns. Null texts are empty; keys may be null, repeated and of any type.

    The texts are cut twice, once for the words and once for the positions; writing the positions down in between would
    cost more disk than cutting costs time. A block is named by its content, so that cuts which don't agree (rows in
    another order at the second read) are found out and raise an error.
    """
    base = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    kind = base.schema["_key"].dataType.simpleString()
    total = base.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    n_buckets = min(1 << 16, max(16, -(-total // (block_bytes * BUCKET_BLOCKS))))
    arrow_key = to_arrow_type(base.schema["_key"].dataType)
    position_type = pa.schema([("blk", pa.int64()), ("keys", pa.list_(arrow_key)), ("counts", pa.binary()), ("positions", pa.binary()), ("buckets", pa.binary())])
    word_type = pa.schema([("blk", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary())])

    def block(parts: list[pa.RecordBatch], of_words: bool) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        words, positions, counts = cut(table.column("_text").chunk(0))
        keys = table.column("_key").to_pylist()
        bucket = _bucket(words, n_buckets)
        name = xxhash.xxh3_64(positions.tobytes())
        for part in (repr(keys).encode(), counts.tobytes(), b"\0".join(words)):
            name.update(part)
        number = name.intdigest() - (1 << 63)
        if not of_words:
            rows = [{"blk": number, "keys": keys, "counts": counts.astype("<u4").tobytes(), "positions": _write_numbers(positions), "buckets": zstandard.compress(bucket.astype("<u2").tobytes(), 1)}]
            return pa.RecordBatch.from_pylist(rows, position_type)
        rows = []
        order = np.argsort(bucket, kind="stable").tolist()
        ends = np.cumsum(np.bincount(bucket, minlength=n_buckets)).tolist()
        for b, (x, y) in enumerate(zip([0, *ends], ends, strict=False)):
            if y > x:
                rows.append({"blk": number, "bucket": b, "words": _write_list([words[i] for i in order[x:y]])})
        return pa.RecordBatch.from_pylist(rows, word_type)

    def cut_blocks(batches: Iterator[pa.RecordBatch], of_words: bool) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            ends = np.cumsum(pa.compute.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                stop = min(batch.num_rows, int(np.searchsorted(ends, before + block_bytes - size)) + 1)
                parts.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - before
                at = stop
                if size >= block_bytes:
                    yield block(parts, of_words)
                    parts, size = [], 0
        if parts:
            yield block(parts, of_words)

    reply_type = pa.schema([("blk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("id", pa.int32())])

    def encode_words(table: pa.Table) -> pa.Table:
        """Each distinct word once; ids go back to every block that has the word, and if its tokens' bytes have to follow, a row for each
        of their distinct ids."""
        enc = encoding(vocabulary).encode_ordinary
        known: dict[bytes, bytes] = {}
        rows = []
        for blk, bucket, blob in zip(*(table.column(c).to_pylist() for c in ("blk", "bucket", "words")), strict=True):
            words = _read_list(blob)
            for w in words:
                if w not in known:
                    known[w] = np.asarray(enc(w.decode("utf-8", "replace")), "<u4").tobytes()
            found = [known[w] for w in words]
            rows.append(pa.RecordBatch.from_pylist([{"blk": blk, "bucket": bucket, "ids": _write_ids(found)}], reply_type))
            if with_tokens:
                own = np.unique(np.frombuffer(b"".join(found), "<u4")).astype(np.int32)
                same = [pa.array(np.full(len(own), x), t) for x, t in ((blk, pa.int64()), (bucket, pa.int32()))]
                rows.append(pa.RecordBatch.from_arrays([*same, pa.nulls(len(own), pa.binary()), pa.array(own)], schema=reply_type))
        return pa.Table.from_batches(rows, reply_type)

    fields = [c.split() for c in columns.split(",")]
    arrow_of = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    final = pa.schema([("_key", arrow_key), *((n, arrow_of[t]) for n, t in fields)])

    def together(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        if blocks.num_rows == 0:
            raise ValueError("the texts came in another order at the second read; write them as a table first")
        row = blocks.to_pylist()[0]
        tokens = None
        if with_tokens:
            spelt = replies.filter(pa.compute.is_valid(replies.column("id")))
            tokens = by_id(np.asarray(spelt.column("id")), spelt.column("bytes").to_pylist())
            replies = replies.filter(pa.compute.is_valid(replies.column("ids")))
        copies = blocks.num_rows  # blocks of equal content
        bucket = np.frombuffer(zstandard.decompress(row["buckets"]), "<u2")
        ids: list = [None] * len(bucket)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(n_buckets))
        replied = dict(zip(replies.column("bucket").to_pylist(), replies.column("ids").to_pylist(), strict=True))
        if len(replied) != len(np.unique(bucket)):
            raise ValueError("the texts came in another order at the second read; write them as a table first")
        for b, blob in replied.items():
            got = _read_ids(blob)
            for i, x in zip(order[starts[b] : starts[b] + len(got)].tolist(), got, strict=True):
                ids[i] = x
        made = finish(ids, _read_numbers(row["positions"]), np.frombuffer(row["counts"], "<u4").astype(np.int64), tokens)
        done = pa.Table.from_arrays([pa.array(row["keys"], arrow_key), *(pa.array(m, t.type) for m, t in zip(made, list(final)[1:], strict=True))], schema=final)
        return pa.concat_tables([done] * copies)

    words = base.mapInArrow(lambda it: cut_blocks(it, True), "blk long, bucket int, words binary")
    replies = words.groupBy("bucket").applyInArrow(encode_words, "blk long, bucket int, ids binary, id int")
    if with_tokens:  # a left join, as rows of words have no id; the vocabulary bounds the table
        replies = replies.join(F.broadcast(token_table(docs.sparkSession, vocabulary)), "id", "left")
    blocks = base.mapInArrow(lambda it: cut_blocks(it, False), f"blk long, keys array<{kind}>, counts binary, positions binary, buckets binary")
    out = blocks.groupBy("blk").cogroup(replies.groupBy("blk")).applyInArrow(together, f"_key {kind}, {columns}")
    return out.select(F.col("_key").alias(key), *(n for n, _ in fields))


def _write_ids(items: list[bytes]) -> bytes:
    """Lists of ids: how many each has, then all of them, two bytes each where they fit."""
    flat = np.frombuffer(b"".join(items), "<u4")
    narrow = not len(flat) or int(flat.max()) < 1 << 16
    size = np.array([len(x) // 4 for x in items], "<u4")
    planes = flat.astype("<u2" if narrow else "<u4").view(np.uint8).reshape(len(flat), -1).T
    return zstandard.compress(struct.pack("<IB", len(items), 2 if narrow else 4) + size.tobytes() + planes.tobytes(), 1)


def _read_ids(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, width = struct.unpack_from("<IB", raw)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 5)).tolist()
    planes = np.frombuffer(raw, np.uint8, offset=5 + 4 * n).reshape(width, -1)
    flat = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>) of all documents, as the tiktoken library would encode each text without special tokens. Null texts are empty; keys
    may be null or repeated, and stay so; an empty table gives no rows, and other columns are passed over."""

    def finish(ids: list[np.ndarray], positions: np.ndarray, counts: np.ndarray, _):
        flat, bounds = _flat_ids(ids, positions, counts)
        return ([flat[a:b].astype(np.int32) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)],)

    return encoded(docs, vocabulary, finish, "ids array<int>", key, text)


def decode(encoded_docs: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, text binary): the ids' bytes in a row, by a join with the token-byte table. Null ids give an empty text; an
    id outside the table is an error."""
    table = F.broadcast(token_table(encoded_docs.sparkSession, vocabulary))  # bounded by the vocabulary
    spread = encoded_docs.withColumn("_row", F.monotonically_increasing_id()).select("_row", key, F.posexplode_outer(ids).alias("_pos", "id"))
    joined = spread.join(table, "id", "left").withColumn("bytes", F.when(F.col("id").isNull(), F.lit(b"")).otherwise(F.expr("coalesce(bytes, raise_error('an id has no token'))")))
    whole = joined.groupBy("_row").agg(F.first(key).alias(key), F.sort_array(F.collect_list(F.struct("_pos", "bytes"))).alias("parts"))
    hexed = F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), "")
    return whole.select(key, F.unhex(hexed).alias("text"))


def _flat_ids(ids: list[np.ndarray], positions: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in a row, and where each text's start."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    at = np.cumsum(size) - size
    pool = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    per = size[positions]
    flat = pool[spans.ragged(at[positions], per)]
    ends = np.concatenate(([0], np.cumsum(per)))
    return flat, ends[np.concatenate(([0], np.cumsum(counts)))]


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def finish(ids: list[np.ndarray], positions: np.ndarray, counts: np.ndarray, tokens: tuple[np.ndarray, np.ndarray, np.ndarray]):
        flat, bounds = _flat_ids(ids, positions, counts)
        digits = [str(i).encode() for i in range(int(flat.max()) + 1)] if len(flat) else []
        n, ids_sha, text_sha = np.diff(bounds), [], []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            own = flat[a:b]
            ids_sha.append(hashlib.sha256(b" ".join(map(digits.__getitem__, own.tolist()))).hexdigest())
            text_sha.append(hashlib.sha256(decode_ids(own, *tokens)).hexdigest())
        return n, ids_sha, text_sha

    return encoded(documents(spark, sf_dir), vocabulary, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", with_tokens=True)
