"""Removal of long repeated byte strings, by suffix sorting at content-defined places.

A place is a cut if the 16 bytes there hash to a multiple of a rate, so equal strings are cut at equal places wherever
they stand. A text is then a sequence of phrases, what lies between its cuts, long ones cut again at fixed distances, and a
block of texts a sequence of phrase numbers, some fifty times shorter than its bytes.

1. Each block's sequence is suffix-sorted in linear time by Lyndon groups (suffix_array below). A cut's class are the cuts
   around it in that order that share as many phrases with it as all its windows hold: a stretch of the suffix array, found
   by the common prefixes of neighbours. Each class is named once, by its string, and its size counted over all blocks by that
   name (exchange.py).
2. A window is a string of LENGTH bytes; it belongs to the first cut in it. A cut whose class is unique has no
   repeated window. Where even the longer string of all the cut's windows together is repeated, all of them are.
3. What remains are cuts near the ends of repeated passages. Their windows are checked one by one, again by counts
   over all blocks, against all windows of their class; so are windows whose first bytes have no cut.

Between blocks, strings are compared by hashes of their bytes modulo a prime of 61 bits (spans.py), without a look at the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exchange, scratch, spans
from lodestone.llm.columns import documents

#: Bytes of a repeated string, and of the shortest that may be asked for.
LENGTH, LEAST = 400, 100
#: Bytes that decide a cut; one place in so many is one, for strings of LENGTH bytes.
CONTEXT, RATE = 16, 48
#: Counts of classes must be exact, as they are compared.
COUNTS = np.uint32


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of a sequence of non-negative numbers, in ascending order, in linear time.

    First phase: suffixes are grouped by their longest Lyndon prefix. Groups are taken from the highest down; for each
    member, the nearest smaller group to its left is found by previous-smaller pointers, and the suffixes found move
    behind the rest of their own group, the more often found the further. Second phase: in ascending order, each suffix
    emits the ones before it along those pointers to the front of their groups. Nothing is renamed or sorted again.
    """
    n = len(symbols)
    if not n:
        return []
    order = np.argsort(np.asarray(symbols), kind="stable")
    sorted_symbols = np.asarray(symbols)[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_symbols[1:] != sorted_symbols[:-1])))
    sizes = np.diff(np.concatenate((first, [n])))
    sa = order.tolist()
    group_np = np.empty(n, np.int64)
    group_np[order] = np.repeat(first, sizes)
    group = group_np.tolist()  # the place in sa where a suffix's group starts
    place_np = np.empty(n, np.int64)
    place_np[order] = np.arange(n)
    place = place_np.tolist()
    size_np = np.zeros(n, np.int64)
    size_np[first] = sizes
    size = size_np.tolist()  # of the group that starts at a place
    smaller = [-1] * n  # previous-smaller pointers

    end = n
    while end > 0:
        start = group[sa[end - 1]]
        if end - start == 1:
            s = sa[start]
            p = s - 1
            while p >= 0 and group[p] > start:
                p = smaller[p]
            smaller[s] = p
            found = (p,) if p >= 0 else ()
            levels = (found,)
        else:
            times: dict[int, int] = {}
            for s in sorted(sa[start:end]):
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            levels = [by_times[k] for k in sorted(by_times, reverse=True)]
        for found in levels:
            moved: dict[int, list[int]] = {}
            for p in found:
                h = group[p]
                if size[h] > 1:
                    moved.setdefault(h, []).append(p)
            for h, members in moved.items():
                count = len(members)
                if count == size[h]:
                    continue  # the whole group moves: nothing changes
                last = h + size[h]
                for p in members:
                    last -= 1
                    q, at = sa[last], place[p]
                    sa[last], sa[at] = p, q
                    place[p], place[q] = last, at
                size[h] -= count
                size[last] = count
                for p in members:
                    group[p] = last
        end = start

    front = list(range(n))  # next free place of the group that starts at a place
    done = [False] * n
    out = [0] * n
    s = n - 1  # the end of the sequence is the smallest suffix; it emits the last one
    i = -1
    while True:
        while s >= 0 and not done[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            done[s] = True
            s = smaller[s]
        i += 1
        if i == n:
            return out
        s = out[i] - 1


class Block:
    """Cuts, phrases and windows of a block's texts."""

    def __init__(self, column: pa.Array, length: int):
        self.raw, self.starts = spans.buffer(column)
        #: Windows whose first cut is within `reach` bytes go by that cut, and all hold `sure` bytes behind it.
        self.length, self.reach, self.rate = length, 3 * length // 5, max(8, RATE * length // LENGTH)
        self.sure = length - self.reach - CONTEXT
        self.hashes = spans.Hashes(self.raw)
        self.cuts = self._cuts()
        text = np.searchsorted(self.starts, self.cuts, "right") - 1
        begin, end = self.starts[text], self.starts[text + 1]
        same = np.concatenate(([False], text[1:] == text[:-1])) if len(text) else np.zeros(0, bool)
        before = np.where(same, np.concatenate(([0], self.cuts[:-1])), begin - 1)
        self.text = text
        self.phrase_end = np.where(np.concatenate((same[1:], [False])), np.concatenate((self.cuts[1:], [0])), end) if len(text) else self.cuts
        #: First and last start of the windows that go by each cut.
        self.low = np.maximum(before + 1, self.cuts - self.reach)
        self.high = np.minimum(self.cuts, end - length)

    def _cuts(self) -> np.ndarray:
        data, n, found = self.raw.tobytes(), len(self.raw) - CONTEXT + 1, []
        for at in range(0, max(0, n), 1 << 19):
            m = min(1 << 19, n - at)
            a, b = (np.ndarray((m,), "<u8", data, at + k, (1,)).copy() for k in (0, 8))
            a *= np.uint64(0x9FB21C651E98DF25)
            b ^= a >> np.uint64(29)
            found.append(np.flatnonzero(spans.mix(b) % np.uint64(self.rate) == 0) + at)
        cuts = np.concatenate(found) if found else np.zeros(0, np.int64)
        return cuts[cuts + CONTEXT <= self.starts[np.searchsorted(self.starts, cuts, "right")]]

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all phrases, those longer than `sure` in pieces, and which is the first one of each cut."""
        pieces = -(-(self.phrase_end - self.cuts) // self.sure)
        first = np.cumsum(pieces) - pieces
        nth = spans.ragged(np.zeros(len(pieces), np.int64), pieces)
        start = np.repeat(self.cuts, pieces) + nth * self.sure
        return start, np.minimum(start + self.sure, np.repeat(self.phrase_end, pieces)), first

    def depths(self, end: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many phrases lie in all windows of each cut: what equal windows have in common decides them."""
        return np.searchsorted(end, self.cuts + self.sure, "right") - first

    def short_keys(self, which: np.ndarray | None = None) -> np.ndarray:
        """The name of each cut's class, or of some cuts': a hash of the phrases."""
        start, end, first = self.phrases()
        depth = self.depths(end, first)
        if which is not None:
            first, depth = first[which], depth[which]
        hashes, out = self.hashes.of(start, end), np.zeros(len(first), np.uint64)
        todo = np.arange(len(first))
        for d in range(int(depth.max()) if len(depth) else 0):
            todo = todo[depth[todo] > d]
            out[todo] = spans.mix((out[todo] ^ hashes[first[todo] + d]) + np.uint64(d + 1))
        return out

    def long_keys(self, which: np.ndarray) -> np.ndarray:
        """The string of all windows of each given cut, with the cut's place in it."""
        low, high = self.low[which], self.high[which]
        return spans.mix(self.hashes.of(low, high + self.length) + (self.cuts[which] - low).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def serving(self) -> np.ndarray:
        return np.flatnonzero(self.high >= self.low)

    def uncut(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last starts of the runs of windows that go by no cut."""
        open_ = np.ones(len(self.raw) + 1, np.int8)
        open_[-1] = 0
        for s, e in ((np.maximum(self.starts[:-1], self.starts[1:] - self.length + 1), self.starts[1:]),):  # no window starts in a text's last bytes
            open_[spans.ragged(s, e - s)] = 0
        own = self.serving()
        open_[spans.ragged(self.low[own], self.high[own] - self.low[own] + 1)] = 0
        edge = np.diff(np.concatenate(([0], open_)))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1

    def window_keys(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = spans.ragged(low, high - low + 1)
        return self.hashes.of(at, at + self.length)

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the classes of cuts that windows go by, ascending, and how often each class occurs here."""
        own = self.serving()
        if not len(own):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        start, end, first = self.phrases()
        _, symbol = np.unique(self.hashes.of(start, end), return_inverse=True)
        text = np.searchsorted(self.starts, start, "right") - 1
        at = np.arange(len(symbol)) + text - text[0]  # a zero stands between texts
        sequence = np.zeros(int(at[-1]) + 1, np.int64)
        sequence[at] = symbol + 1
        order = np.asarray(suffix_array(sequence.tolist()))
        depth = np.zeros(len(sequence), np.int64)  # phrases that make the class of a cut that windows go by
        depth[at[first[own]]] = self.depths(end, first)[own]
        cut_at = np.zeros(len(sequence), np.int64)
        cut_at[at[first]] = np.arange(len(first))
        # common prefixes of neighbours, as far as any class goes
        most = int(depth.max())
        padded = np.concatenate((sequence, np.full(most, -1)))
        alike, common = np.arange(1, len(order)), np.zeros(len(order), np.int64)
        for d in range(most):
            alike = alike[padded[order[alike] + d] == padded[order[alike - 1] + d]]
            common[alike] += 1
        members, names, sizes = depth[order], [], []
        place = np.arange(len(order))
        for d in range(1, most + 1):
            here = np.flatnonzero(members == d)
            if len(here):
                stretch = np.maximum.accumulate(np.where(common < d, place, 0))[here]
                fresh = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1])))
                names.append(cut_at[order[here[fresh]]])
                sizes.append(np.diff(np.concatenate((fresh, [len(here)]))))
        named, sizes = np.concatenate(names), np.concatenate(sizes)
        keys = self.short_keys(named)
        ranked = np.argsort(keys, kind="stable")
        for i in np.flatnonzero(np.diff(keys[ranked]) == 0).tolist():
            a, b = (at[first[named[k]]] for k in ranked[i : i + 2])
            if depth[a] == depth[b] and np.array_equal(sequence[a : a + depth[a]], sequence[b : b + depth[b]]):
                raise ValueError("a class lies in two stretches: the suffixes are out of order")
        return keys[ranked], sizes[ranked]

    def all_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of classes, of long strings and of windows without a cut, distinct and ascending; and where each cut's class
        and long string and each such window is among them."""
        own = self.serving()
        parts = [self.short_keys()[own], self.long_keys(own), self.window_keys(*self.uncut())]
        keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        a, b = len(own), 2 * len(own)
        return keys, inverse[:a], inverse[a:b], inverse[b:]


def _column(table: pa.Table) -> pa.Array:
    c = table.column("_text").combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c if not isinstance(c, pa.ChunkedArray) else pa.array([], pa.string())


def _ranges(low: np.ndarray, high: np.ndarray) -> bytes:
    return np.stack((low, high)).astype("<i8").tobytes()


def _unranged(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(blob, "<i8").reshape(2, -1))


def _covered(n: int, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes are in a window that starts in one of the ranges."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, low, 1)
    np.add.at(step, high + length, -1)
    return np.cumsum(step[:-1]) > 0


_DONE = "doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
_STATE = "_blk int, bucket int, keys binary, counts binary, " + _DONE + ", text binary, solid binary, loose binary"


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256) of all documents, and kept_text if asked for: the remaining bytes
    as text, without the bytes of characters that a removed string has cut in two. The key may be a struct.

    A byte goes if it is in a string of `length` bytes that also starts anywhere else, in its own text (overlaps too) or in
    another; strings are judged on the input, and none crosses a text's end. Null texts are empty. Repeated rows are
    copies of each other. Null keys stay null, each row with its own result; an empty table gives none. Other columns are passed over,
    whatever their names.
    """
    base, n_blocks = exchange.blocks(docs, key, text)
    base = base.withColumn("_text", F.col("_text").cast("binary"))
    kind = base.schema["_key"].dataType.simpleString()
    n_buckets = exchange.buckets(n_blocks)
    n_ranges = exchange.sent(n_buckets)
    if length < LEAST:
        raise ValueError(f"repeated strings must have {LEAST} bytes or more")

    def find(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        block = Block(_column(table), length)
        keys, counts = block.classes()
        own = block.serving()
        rest = np.concatenate((block.long_keys(own), block.window_keys(*block.uncut())))
        out, inverse = np.unique(np.concatenate((keys, rest)), return_inverse=True)
        return out, np.bincount(inverse, np.concatenate((counts, np.ones(len(rest), np.int64))), len(out)).astype(np.int64)

    def row(raw: np.ndarray, gone: np.ndarray) -> dict:
        kept = raw[~gone]
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
        made = {"n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": runs, "kept_sha256": hashlib.sha256(kept.tobytes()).hexdigest()}
        return made | ({"kept_text": kept.tobytes().decode("utf-8", "ignore")} if with_text else {})

    def settle(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(_column(table), length)
        keys, short, long, window = block.all_keys()
        counts = exchange.read_counts(replies, COUNTS) if len(keys) else np.zeros(0, COUNTS)
        own = block.serving()
        whole = counts[long] >= 2
        open_ = (counts[short] >= 2) & ~whole
        mixed = whole & (counts[short] != counts[long])  # others of the class may be open and equal one of these windows
        low, high = block.uncut()
        at = spans.ragged(low, high - low + 1)[counts[window] >= 2]
        solid = (np.concatenate((block.low[own[whole]], at)), np.concatenate((block.high[own[whole]], at)))
        loose = (block.low[own[open_]], block.high[own[open_]])
        docs_of = table.column("_key").to_pylist()
        blk = table.column("_blk")[0].as_py()
        rows = []
        for i, ((s1, s2), (l1, l2)) in enumerate(zip(_by_text(block.starts, *solid), _by_text(block.starts, *loose), strict=True)):
            raw = block.raw[block.starts[i] : block.starts[i + 1]]
            if len(l1):
                rows.append({"_blk": blk, "doc": docs_of[i], "text": raw.tobytes(), "solid": _ranges(s1, s2), "loose": _ranges(l1, l2)})
            else:
                rows.append({"doc": docs_of[i], **row(raw, _covered(len(raw), s1, s2, length))})
        for name, (low, high) in ((blk, loose), (-1 - blk, (block.low[own[mixed]], block.high[own[mixed]]))):
            found, times = np.unique(block.window_keys(low, high), return_counts=True)
            rows += exchange.rows(name, found, times, n_ranges, COUNTS)
        return pa.Table.from_pylist(rows, _arrow(_STATE, table.column("_key").type))

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        block_raw = pa.array(texts, pa.binary())
        raw, starts = spans.buffer(block_raw)
        hashes = spans.Hashes(raw)
        loose = [_unranged(x) for x in table.column("loose").to_pylist()]
        at = [spans.ragged(a, b - a + 1) for a, b in loose]
        keys = [hashes.of(x + s, x + s + length) for x, s in zip(at, starts.tolist(), strict=False)]
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        many = (exchange.read_counts(replies, COUNTS) >= 2)[inverse]
        rows, k = [], 0
        for i, (doc, solid) in enumerate(zip(table.column("doc").to_pylist(), table.column("solid").to_pylist(), strict=True)):
            hit = at[i][many[k : k + len(at[i])]]
            k += len(at[i])
            low, high = _unranged(solid)
            own = raw[starts[i] : starts[i + 1]]
            rows.append({"doc": doc, **row(own, _covered(len(own), np.concatenate((low, hit)), np.concatenate((high, hit)), length))})
        return pa.Table.from_pylist(rows, _arrow(_DONE, table.column("doc").type))

    replies = exchange.counted(base, n_blocks, find, COUNTS)
    state = scratch.keep(base.groupBy("_blk").cogroup(replies.groupBy("_blk")).applyInArrow(settle, _STATE.format(kind=kind)), "repeats")
    answers = exchange.answer(state.where("bucket IS NOT NULL").select("_blk", "bucket", "keys", "counts"), n_buckets, COUNTS)
    pending = state.where("text IS NOT NULL").select("_blk", "doc", "text", "solid", "loose")
    finished = pending.groupBy("_blk").cogroup(answers.groupBy("_blk")).applyInArrow(finish, _DONE.format(kind=kind))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    both = state.where("bucket IS NULL AND text IS NULL").select("doc", *names).unionByName(finished.select("doc", *names))
    return both.withColumnRenamed("doc", key)


def _by_text(starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ranges in a block as ranges in each of its texts."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    at = np.searchsorted(low, starts)
    return [(low[a:b] - s, high[a:b] - s) for a, b, s in zip(at.tolist(), at[1:].tolist(), starts.tolist(), strict=False)]


def _arrow(schema: str, key: pa.DataType) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "{kind}": key}
    return pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text"))
