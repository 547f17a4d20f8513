"""Encoding with the tokenizers library, word by word and with a memory.

Texts are cut where the tokenizer's own pattern always cuts. Of a batch's distinct pieces, those not met lately are handed to
the library together, a mark before each, and the ids of a text are its pieces' ids in a row. The result is what the tokenizer
gives for the whole text. Pieces are found by hashes and told apart by their bytes; what is remembered are arrays of a bounded number of
pieces.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lodestone.llm import spans

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores

#: Pieces handed over as one text, and pieces remembered in each of two generations, of which the older is forgotten.
RUN, REMEMBERED = 1024, 1 << 20
#: Letters alone, or letters and then punctuation, which the pattern of byte-level BPE cuts apart in any case.
PLAIN = re.compile(r"(\s?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]+)?")
#: Pieces on which an encoder first tries whether joining changes nothing.
_TRIED = ["a", " b", "don't", " x's", "...", " --", "12", " 345", "é", " ñandú,", "日本", " 🙂", "a.b", "('c')", " <|endoftext|>", "_", " ́", "$1"]


def simple(raw: np.ndarray, starts: np.ndarray, w_start: np.ndarray, w_end: np.ndarray, first: np.ndarray, spaced: bool) -> np.ndarray:
    """Texts that numpy may cut: no odd white space and, where it counts, single spaces or line breaks only."""
    here = np.flatnonzero((raw < 32) & (raw >= 28) | (raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    a, b, c = raw[here], *(raw[np.minimum(here + k, len(raw) - 1)] for k in (1, 2))
    wide = (a < 32) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    bad = np.zeros(len(starts) - 1, bool)
    bad[np.searchsorted(starts, here[wide], "right") - 1] = True
    if spaced:
        tab = np.flatnonzero((raw == 9) | (raw >= 11) & (raw <= 13))
        bad[np.searchsorted(starts, tab, "right") - 1] = True
        lengths = np.concatenate(([0], np.cumsum(w_end - w_start)))
        inside = lengths[first[1:]] - lengths[first[:-1]]
        gaps = np.maximum(np.diff(first) - 1, 0)
        bad |= inside + gaps != np.diff(starts)  # more white space than one between words
    return ~bad


def with_space(w_start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word starts moved back by the white space before them, but for each text's first word."""
    out = w_start - 1
    heads = first[:-1][np.diff(first) > 0]
    out[heads] += 1
    return out


class Memory:
    """Ids of pieces by their hashes, in ascending order of these, with the pieces' bytes."""

    def __init__(self, dtype: np.dtype):
        self.hashes, self.at, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, dtype)
        self.raw, self.start, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known, and where."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[i] == hashes, i

    def agrees(self, i: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the pieces remembered at some places are the given ones, byte by byte."""
        return spans.same(raw, start, end - start, self.raw, self.start[i], self.length[i])

    def add(self, hashes: np.ndarray, pool: np.ndarray, at: np.ndarray, size: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Ascending hashes that aren't known, their ids in `pool` and their bytes in `raw`."""
        all_ = np.concatenate((self.hashes, hashes))
        order = np.argsort(all_, kind="stable")
        length = end - start
        self.hashes = all_[order]
        self.at = np.concatenate((self.at, at + len(self.pool)))[order]
        self.size = np.concatenate((self.size, size.astype(np.int32)))[order]
        self.pool = np.concatenate((self.pool, pool))
        self.start = np.concatenate((self.start, len(self.raw) + np.cumsum(length) - length))[order]
        self.length = np.concatenate((self.length, length))[order]
        self.raw = np.concatenate((self.raw, raw[spans.ragged(start, length)]))


class Encoder:
    """Ids of texts as little-endian arrays of the narrowest type that holds the vocabulary."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced = len(self._direct(["a b"])[0]) == len(self._direct(["a", " b"])[1]) + 1 and self._direct([" b"]) != self._direct(["b"])
        self.uncased = self._direct(["ABCXYZ"]) == self._direct(["abcxyz"])
        # a line break stands for itself in front of a word; where white space is dropped, a bar between spaces does
        self.before = b"\n" if self.spaced else b" | "
        mark = self._direct([self.before.decode()])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.new, self.old = Memory(self.dtype), Memory(self.dtype)
        self.joins = self.mark is not None and self._joinable()

    def _direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joinable(self) -> bool:
        """Whether pieces with the mark before each have the ids that each has alone."""
        flat = self._direct(["".join(self.before.decode() + x for x in _TRIED)])[0]
        return flat == [x for ids in self._direct(_TRIED) for x in (self.mark, *ids)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_column(pa.array(texts, pa.string())) if texts else []

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column without nulls. Texts whose words stand one space or line break apart (or, where white
        space is dropped, any white space that numpy knows) are cut all at once; others are handed over whole."""
        flat, ends, odd = self.encode_flat(column)
        out = [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
        for i, ids in odd.items():
            out[i] = ids
        return out

    def encode_flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """All texts' ids in a row and where each one's start, but for the texts that numpy doesn't cut, whose ids stand apart."""
        raw, starts = spans.buffer(column)
        if self.uncased:
            raw = spans.LOWER[raw]  # fewer distinct words, and the same ids
        w_start, w_end = spans.words(raw, starts)
        first = spans.owners(w_start, starts)
        fine = simple(raw, starts, w_start, w_end, first, self.spaced) & self.joins
        if not fine.all():
            kept = fine[np.repeat(np.arange(len(fine)), np.diff(first))]
            w_start, w_end = w_start[kept], w_end[kept]
            first = np.concatenate(([0], np.cumsum(np.where(fine, np.diff(first), 0))))
        if self.spaced:  # the white space before a word is part of the piece; a text's first word has none
            w_start = with_space(w_start, first)
        pool, at, size = self._pool(raw, w_start, w_end)
        ends = np.concatenate(([0], np.cumsum(size)))[first]
        odd = np.flatnonzero(~fine).tolist()
        whole = self._direct([column[i].as_py() for i in odd]) if odd else []
        return pool[spans.ragged(at, size)], ends, {i: np.asarray(x, self.dtype) for i, x in zip(odd, whole, strict=True)}

    def _pool(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct pieces in a row, and where each piece's ids are there."""
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        index, hashes, inverse = spans.distinct(raw, start, end)
        pool, at, size = self._recalled(hashes, raw, start[index], end[index])
        return pool, at[inverse], size[inverse]

    def _recalled(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, of which the first have ascending hashes: from the newer memory, or the older one, which then go to
        the newer, or encoded. Pieces that share their hash with another one, here or in a memory, are encoded each time."""
        if len(self.new.hashes) > REMEMBERED:
            self.old, self.new = self.new, Memory(self.dtype)
        n = len(hashes)
        known, i = self.new.find(hashes)
        clash = np.concatenate((np.zeros(n, bool), np.ones(len(start) - n, bool)))
        here = np.flatnonzero(known)
        clash[here] = ~self.new.agrees(i[here], raw, start[here], end[here])
        if (rest := np.flatnonzero(~known)).size:
            was, i = self.old.find(hashes[rest])
            was[was] = self.old.agrees(i[was], raw, start[rest[was]], end[rest[was]])
            i = i[was]
            size = self.old.size[i].astype(np.int64)
            pools, ats, sizes = [self.old.pool[spans.ragged(self.old.at[i], size)]], [np.cumsum(size) - size], [size]
            if len(fresh := rest[~was]):
                pool, at, size = self._joined(raw, start[fresh], end[fresh])
                ats.append(at + len(pools[0]))
                pools.append(pool)
                sizes.append(size)
            order = np.argsort(np.concatenate((rest[was], fresh)), kind="stable")
            self.new.add(hashes[rest], np.concatenate(pools), np.concatenate(ats)[order], np.concatenate(sizes)[order], raw, start[rest], end[rest])
        _, i = self.new.find(hashes)
        pool, at, size = self.new.pool, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        at[:n], size[:n] = self.new.at[i], self.new.size[i]
        if (alone := np.flatnonzero(clash)).size:
            own, place, size[alone] = self._joined(raw, start[alone], end[alone])
            at[alone] = place + len(pool)
            pool = np.concatenate((pool, own))
        return pool, at, size

    def _joined(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, the mark before each. A piece behind a line break has that as its mark, so it keeps the mark."""
        broken = (raw[start] == 10) if self.spaced else np.zeros(len(start), bool)
        start = start + broken
        if not self.spaced and (bars := np.flatnonzero(raw == ord("|"))).size:  # what holds the mark itself goes alone
            alone = np.searchsorted(bars, start) < np.searchsorted(bars, end)
        else:
            alone = np.zeros(len(start), bool)
        length = np.where(alone, 0, end - start)
        wide = len(self.before)
        place = np.cumsum(length + wide) - length
        out = np.empty(int(place[-1] + length[-1]), np.uint8)
        for k, byte in enumerate(self.before):
            out[place - wide + k] = byte
        out[spans.ragged(place, length)] = raw[spans.ragged(start, length)]
        cuts = [*(place[::RUN] - wide).tolist(), len(out)]
        data = out.tobytes()
        ids = self._direct([data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)])
        pool = np.concatenate([np.asarray(x, self.dtype) for x in ids])
        marks = np.flatnonzero(pool == self.mark)
        if len(marks) != len(start):
            raise ValueError("the tokenizer joins words across white space")
        at = marks + 1 - broken
        size = np.concatenate((marks[1:], [len(pool)])) - at
        if alone.any():
            which = np.flatnonzero(alone).tolist()
            own = [np.asarray(x, self.dtype) for x in self._direct([raw[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in which])]
            size[which] = [len(x) for x in own]
            at[which] = len(pool) + np.cumsum(size[which]) - size[which]
            pool = np.concatenate([pool, *own])
        return pool, at, size


@cache
def encoder(path: str) -> Encoder:
    """One for each vocabulary and Python worker, kept from task to task."""
    return Encoder(path)
