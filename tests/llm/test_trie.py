"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import duckdb
import pytest

from lodestone.llm import registry, trie


def conversations():
    rnd = random.Random(8)
    say = [("user", "hello"), ("assistant", "hi"), ("user", "é" * 40), (None, "no role"), ("user", None), ("", "no role"), ("assistant", "a" * 3000), ("user\nhi", "x"), ("user", "hi\nx")]
    rows = []
    for c in [*range(60), 1 << 40, 75, 76, 81, 83, 84]:
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, t if t or c % 3 else None, *rnd.choice(say[: 2 + c % 8])))
    rows += [(90, t, "user", "deep") for t in range(300)] + [(93, t, "user", "deep") for t in range(299)]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]  # a hot conversation
    return rows


def rebuilt(rows):
    own = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(built):
    nodes = {}
    for c, p in built.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    saved = {k: (len(m) - 1) * len(k[-1][1].encode()) if k else 0 for k, m in nodes.items()}
    children = {}
    for k in nodes:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    leaves, total = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in nodes:
        for d in range(len(k) + 1):
            total[k[:d]] += saved[k]
            leaves[k[:d]] += k not in children
    ends = lambda k: ",".join(map(str, sorted(c for c, p in built.items() if tuple(p) == k)))
    return [(min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children.get(k, 0), leaves[k], total[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in nodes.items()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("conversations")
    rows = [(*r, 1, b"x") for r in conversations()]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, path binary").repartition(4).write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize(("run", "hot", "blob"), [(1 << 16, 5000, 1 << 16), (16, 1, 7)])
def test_query_against_brute_force(spark, folder, run, hot, blob, monkeypatch):
    for name, value in (("RUN", run), ("HOT_PARENTS", hot), ("BLOB", blob)):
        monkeypatch.setattr(trie, name, value)
    got = [tuple(r) for r in registry.QUERIES["op13_conversation_trie"](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(brute(rebuilt(conversations())), key=repr)


def test_sql_says_the_same(folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(registry.ORACLE["op13_conversation_trie"]).fetchall(), key=repr) == sorted(brute(rebuilt(conversations())), key=repr)


def test_intervals_are_a_preorder(spark, folder):
    made = trie.trie(trie.rebuilt(trie.paths(spark.read.parquet(f"{folder}/conversations.parquet")))).collect()
    by_first = sorted(made, key=lambda r: r.first)
    assert [r.first for r in by_first] == list(range(len(made)))
    open_ = []
    for r in by_first:
        while open_ and open_[-1].last <= r.first:
            open_.pop()
        assert len(open_) == r.depth and (not open_ or r.last <= open_[-1].last)
        open_.append(r)


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    made = lambda rows: sorted(tuple(r)[:7] for r in trie.trie(trie.rebuilt(trie.paths(spark.createDataFrame(rows, schema)))).collect())
    assert made([]) == []
    assert made([(None, 0, "user", "x")]) == []  # no conversation
    # crc32("2") % 9 turns come from conversation 0, which isn't there
    h = zlib.crc32(b"2") % 9
    assert made([(2, 0, None, None)]) == ([(2, 0, None, 1, 0, 1, 0)] if h else [(2, 0, None, 1, 1, 1, 0), (2, 1, 2, 1, 0, 1, 0)])
    # repeated rows are turns of their own, ordered by their names
    ten = [(10, 1, "user", "x")] * 12
    assert [r[1] for r in made(ten)] == list(range(13))
