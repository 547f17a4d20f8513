"""Hashes of stretches, and operators on words that a hash modulo a power of two can't tell apart."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import bpe, jaccard, memo, packing, scratch, shards, spans

P = (1 << 61) - 1


def thue_morse(bits: int, flip: bool) -> str:
    return "".join("ab"[(i.bit_count() + flip) & 1] for i in range(1 << bits))


@pytest.fixture(scope="module")
def twins():
    a, b = thue_morse(10, False), thue_morse(10, True)
    return [(0, f"{a} one two three four five"), (1, f"{b} one two three four five"), (2, f"six {b} {a}"), (3, f"six {a} {b}")]


def few_hashes(self, starts, ends):
    return (ends - starts).astype(np.uint64) % np.uint64(3)


def test_products_and_sums():
    rnd = random.Random(1)
    a, b = ([0, 1, P - 1, *(rnd.randrange(P) for _ in range(500))] for _ in range(2))
    assert spans.times(np.array(a, np.uint64), np.array(b[::-1], np.uint64)).tolist() == [x * y % P for x, y in zip(a, b[::-1], strict=True)]
    raw = np.frombuffer(rnd.randbytes(3 * 65536 + 17), np.uint8)
    h = spans.Hashes(raw)
    total, power, sums = 0, 1, [0]
    for x in raw.tolist():
        total, power = (total + (x + 1) * power) % P, power * spans._BASE % P
        sums.append(total)
    assert h.sums.tolist() == sums


def test_equal_strings_have_equal_hashes_anywhere():
    raw = np.frombuffer((b"x" * 65530 + b"needle in hay" + b"y" * 131000 + b"needle in hay\0"), np.uint8)
    a, b = 65530, 65530 + 13 + 131000
    got = spans.Hashes(raw).of(np.array([a, b, a, b]), np.array([a + 13, b + 13, a + 12, b + 14]))
    assert got[0] == got[1] and len(set(got.tolist())) == 3


@pytest.mark.parametrize("clash", [False, True])
def test_distinct_compares_bytes(monkeypatch, clash):
    if clash:
        monkeypatch.setattr(spans.Hashes, "of", few_hashes)
    rnd = random.Random(2)
    words = [b"", b"a", b"ab", b"a" * 8, b"a" * 9, thue_morse(10, False).encode(), thue_morse(10, True).encode(), b"\0" * 3, b"\0" * 4]
    words = [rnd.choice(words) for _ in range(400)]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    index, hashes, inverse = spans.distinct(np.frombuffer(b"".join(words), np.uint8), starts, ends)
    assert [words[index[i]] for i in inverse.tolist()] == words
    assert len(index) == len(set(words)) and len(hashes) == (3 if clash else len(index))
    assert (np.diff(hashes.astype(object)) > 0).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_with_clashing_hashes(monkeypatch, twins, name):
    monkeypatch.setattr(spans.Hashes, "of", few_hashes)
    path = public_tokenizers.path(name)
    real, encoder = Tokenizer.from_file(path), memo.Encoder(path)
    real.encode_special_tokens = True
    for part in ([t for _, t in twins], ["one two six", "two one\nten", "ab ba"], [t for _, t in twins[::-1]]):
        want = [e.ids for e in real.encode_batch_fast(part, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode_column(pa.array(part))] == want


def test_operators_tell_twins_apart(spark, twins):
    docs = spark.createDataFrame(twins, "doc_id long, text string")
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in twins}
    links = {r.doc_id: r.component_id for r in jaccard.linked(docs).collect()}
    assert links == {i: i for i, _ in twins}
    ids = {name: dict(ids_of(twins, public_tokenizers.path(name))) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    for r in packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        own = ids["byte_bpe_50k.json"][r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    path = scratch.new_path(spark, "twins")
    for r in shards.read(path, shards.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))).collect():
        assert r.ids_crc32 == zlib.crc32(ids["word_bpe_49k.json"][r.key].tobytes())


def ids_of(rows, path):
    """Ids with the end id, of one text at a time."""
    real = Tokenizer.from_file(path)
    real.encode_special_tokens = True
    for i, text in rows:
        yield i, np.array([*real.encode(text, add_special_tokens=False).ids, 1], "<u4")
