"""Words of many texts at once: positions, hashes and distinct strings, by numpy over an Arrow column's bytes."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

#: The six ASCII white spaces.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII upper case as lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Hashes are polynomials of the bytes modulo this prime, at this place: two different strings of n bytes agree at n of 2**61 places, at
#: most. The place was drawn at random and is fixed, so that all workers agree.
PRIME, _BASE = np.uint64((1 << 61) - 1), 0x13A9_5C2E_7F04_8B6D
#: Bytes that are summed at a time, and the low bits of a factor.
_STEP, _LOW = 1 << 16, np.uint64((1 << 31) - 1)


def _folded(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo PRIME."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.minimum(x, x - PRIME)  # below PRIME the difference wraps around and is the larger


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, by halves, as no product may have more than 64 bits."""
    a_high, a_low, b_high, b_low = a >> np.uint64(31), a & _LOW, b >> np.uint64(31), b & _LOW
    middle = a_high * b_low + a_low * b_high
    out = a_high * b_high
    out += out
    out += a_low * b_low
    out += middle >> np.uint64(30)
    out += (middle & np.uint64((1 << 30) - 1)) << np.uint64(31)
    return _folded(out)


@cache
def _powers(base: int) -> np.ndarray:
    """The first _STEP powers."""
    out = np.ones(1, np.uint64)
    while len(out) < _STEP:  # each turn doubles them
        out = np.concatenate((out, times(out, np.uint64(pow(base, len(out), int(PRIME))))))
    return out


@cache
def _steps(base: int, n: int) -> np.ndarray:
    """The powers _STEP, 2 * _STEP and so on, n of them."""
    step, out = pow(base, _STEP, int(PRIME)), [1]
    while len(out) < n:
        out.append(out[-1] * step % int(PRIME))
    return np.array(out, np.uint64)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without nulls, and where each row starts (one entry more than rows)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Hashes:
    """Hashes of any stretch of `raw`, each in constant time. Equal strings have equal hashes; where a hash stands for a string that
    must not be mistaken, distinct() compares the bytes."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        self.inverse = pow(_BASE, -1, int(PRIME))
        #: Always a power of two, so that few sizes of the table are kept.
        self.n_steps = 1 << max(8, (n // _STEP + 1).bit_length())
        powers, steps, carry = _powers(_BASE), _steps(_BASE, self.n_steps), np.uint64(0)
        high, low = powers >> np.uint64(31), powers & _LOW
        for i, at in enumerate(range(0, n, _STEP)):
            values = raw[at : at + _STEP].astype(np.uint64)
            values += np.uint64(1)
            # sums of 2**16 products of 9 and 31 bits have less than 57
            a, b = np.cumsum(values * high[: len(values)]), np.cumsum(values * low[: len(values)])
            b += a >> np.uint64(30)
            b += (a & np.uint64((1 << 30) - 1)) << np.uint64(31)
            own = times(_folded(b), steps[i])
            own += carry
            self.sums[at + 1 : at + 1 + len(own)] = own = _folded(own)
            carry = own[-1]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        small, large = _powers(self.inverse), _steps(self.inverse, self.n_steps)
        for at in range(0, len(starts), _STEP):
            a = starts[at : at + _STEP]
            own = _folded(self.sums[ends[at : at + _STEP]] + (PRIME - self.sums[a]))
            own = times(own, small[a & (_STEP - 1)])
            out[at : at + _STEP] = mix(times(own, large[a // _STEP]))
        return out


def same(raw: np.ndarray, a: np.ndarray, a_size: np.ndarray, other: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether the strings at the places `a` of `raw` are those at the places `b` of `other`, compared eight bytes at a time."""
    out = a_size == b_size
    todo = np.flatnonzero(out & (a_size > 0))
    one, two = (np.concatenate((x, np.zeros(8, np.uint8))).tobytes() for x in (raw, other))
    one, two = (np.ndarray((len(x) - 7,), "<u8", x, 0, (1,)) for x in (one, two))
    done = 0
    while len(todo):
        left = np.minimum(a_size[todo] - done, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        unlike = ((one[a[todo] + done] ^ two[b[todo] + done]) & mask) != 0
        out[todo[unlike]] = False
        done += 8
        todo = todo[~unlike & (a_size[todo] > done)]
    return out


def distinct(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings among some stretches: where one of each is among the stretches, in the ascending order of their hashes;
    these hashes; and which of them each stretch is. They are told apart by their bytes: strings that share a hash with another come
    last, without a hash of their own, so the second result may be shorter than the first."""
    hashes = Hashes(raw).of(start, end)
    order = np.argsort(hashes)
    ranked = hashes[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    index = order[fresh]
    size = end - start
    clash = np.flatnonzero(~same(raw, start, size, raw, start[index[inverse]], size[index[inverse]]))
    more: dict[bytes, int] = {}
    others: list[int] = []
    for i in clash.tolist():
        string = raw[start[i] : end[i]].tobytes()
        if string not in more:
            more[string] = len(index) + len(others)
            others.append(i)
        inverse[i] = more[string]
    return np.concatenate((index, np.array(others, np.int64))), ranked[fresh], inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts; no word crosses a text's end."""
    cut = np.ones(len(raw) + 2, bool)
    cut[1:-1] = IS_SPACE[raw]
    edge = cut[:-1] & ~cut[1:]  # a word starts at i
    last = ~cut[:-1] & cut[1:]  # a word ends before i
    inner = starts[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    joined = inner[~cut[inner] & ~cut[inner + 1]]  # two texts meet without a space
    edge[joined] = True
    last[joined] = True
    return np.flatnonzero(edge[: len(raw)]), np.flatnonzero(last)


def owners(word_starts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words start before each text's start, and all words: bounds of each text's words."""
    return np.searchsorted(word_starts, starts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + lengths[i] - 1 for each i, in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
