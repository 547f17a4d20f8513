"""SuperMinHash near duplicates against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import minhash, registry

SPLIT = re.compile(r"[\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    words = [w for w in SPLIT.split((text or "").translate(UPPER)) if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute(rows, percent=85):
    """(n_shingles, component) of each row; null keys are the component only where no other is reachable."""
    own = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] and own[j] and 100 * both >= percent * (len(own[i]) + len(own[j]) - both):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    least = {r: min((k for (k, _), x in zip(rows, root, strict=True) if x == r and k is not None), default=None) for r in root}
    return [(k, len(s), least[r], k == least[r]) for (k, _), s, r in zip(rows, own, root, strict=True)]


def corpus():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdeéßñ") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    out = [None, "", " \n\t", "word", "Word", "two words", "a b c d e", "a b c d e f", prose(50), prose(9000)]
    for size, changes, copies in ((220, 5, 14), (400, 12, 10), (90, 1, 8)):  # similarities on both sides of the bound
        base = prose(size).split(" ")
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randint(0, changes)):
                text[rnd.randrange(size)] = rnd.choice(vocabulary)
            out.append(" ".join(text))
    chain = prose(300).split(" ")  # each is linked with the next one only
    out += [" ".join(chain[i * 12 : i * 12 + 180]) for i in range(8)]
    out += [out[8], out[8].upper(), "\n".join(SPLIT.split(out[8])), out[9]]
    return out


@pytest.fixture(scope="module")
def rows():
    keys = list(range(100, 100 + len(corpus())))
    random.Random(3).shuffle(keys)
    rows = list(zip(keys, corpus(), strict=True))
    rows += [rows[12], rows[12], (None, rows[13][1]), (None, "a text that no other has at all"), (None, None), (rows[3][0], "a second text of the same key and other words"), (-(1 << 63), rows[20][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, 1, b"x", 2, 3) for k, t in rows], "doc_id long, text string, n long, signature binary, key int, cluster long").repartition(3)


@pytest.mark.parametrize("task_sets", [4000, 6, 2])
@pytest.mark.parametrize("hot", [5000, 1])
def test_against_brute_force(docs, rows, task_sets, hot, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_CLASSES", hot)
    got = minhash.deduplicated(docs, task_sets=task_sets).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_other_bounds(docs, rows):
    got = minhash.deduplicated(docs, percent=60, m=256, rows=4).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, 60), key=repr)


def test_query_and_empty_table(spark, docs, rows, tmp_path):
    some = [r for r in rows if r[0] is not None]
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op11_superminhash_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(some))
    assert minhash.deduplicated(docs.limit(0)).collect() == []


def walk(elements, m):
    """The published algorithm, one element and one step at a time, with its histogram of ranks to stop early."""
    h, b, a = [float("inf")] * m, [0] * (m - 1) + [len(elements) and m], m - 1
    for e in elements:
        order = list(range(m))
        j = 0
        while j <= a:
            rank, k = (int(x[0]) for x in minhash._drawn(np.array([e], np.uint64), j, m - j))
            k += j
            order[j], order[k] = order[k], order[j]
            slot = order[j]
            if rank < h[slot]:
                before = m - 1 if h[slot] == float("inf") else min(h[slot] >> 56, m - 1)
                h[slot] = rank
                if j < before:
                    b[before] -= 1
                    b[j] += 1
                    while b[a] == 0:
                        a -= 1
            j += 1
    return h


def test_signatures_are_the_published_ones():
    rnd = random.Random(7)
    sets = [[rnd.getrandbits(64) for _ in range(n)] for n in (1, 2, 3, 17, 64, 200, 1500)]
    at = np.cumsum([0, *map(len, sets)])
    got = minhash.signatures(np.array(sum(sets, []), np.uint64), at, 64)
    for row, own in zip(got.tolist(), sets, strict=True):
        assert row == walk(own, 64)
    assert (minhash.signatures(np.zeros(0, np.uint64), np.array([0, 0])) == np.uint64(2**64 - 1)).all()


def test_estimates_are_unbiased_and_tighter():
    rng = np.random.default_rng(1)
    m, trials = 64, 400
    errors, plain = [], []
    for _ in range(trials):
        pool = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
        a, b = pool[:24], pool[6:]
        s, t = minhash.signatures(np.concatenate((a, b)), np.array([0, 24, 48]), m)
        errors.append((s == t).mean() - 18 / 30)
        plain.append(rng.binomial(m, 18 / 30) / m - 18 / 30)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.75 * np.var(plain)


def test_similarity_column(spark, docs):
    signed = minhash.signed(docs.where("doc_id IS NOT NULL AND text LIKE '%a%'"))
    pair = signed.alias("x").crossJoin(signed.alias("y").where("n > 200").limit(1))
    rows = pair.select(F.col("x.signature").alias("s"), F.col("y.signature").alias("t"), minhash.similarity(F.col("x.signature"), F.col("y.signature")).alias("j")).collect()
    for r in rows:
        s, t = (np.frombuffer(x, np.uint64) for x in (r.s, r.t))
        assert r.j == (s == t).mean()
