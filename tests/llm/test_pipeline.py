"""The pipeline's stages on a small table, held against the operators' rules."""

import random

import corpus_pipeline


def test_near_duplicates_of_null_and_repeated_ids(spark, tmp_path):
    rnd = random.Random(2)
    prose = lambda: " ".join(str(rnd.random())[2:8] for _ in range(60))
    a, b, c = prose(), prose(), prose()
    data = [(None, prose()) for _ in range(5)] + [(7, prose()) for _ in range(5)] + [(None, a), (3, a), (9, a), (7, b), (7, b), (None, c), (None, c), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, f"s{n}") for n, (i, t) in enumerate(data)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/in")
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/in"), str(tmp_path))
    assert got.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert left == sorted([*data[:10], (3, a), (7, b), (None, c), (None, ""), (None, None)], key=str)


def test_stages(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(90)
    near = prose(300).split(" ")
    rows = [(i, prose(200)) for i in range(60)]
    rows += [(60, "short"), (61, None), (62, rows[3][1]), (63, " ".join(near)), (64, " ".join(near[:150] + ["changed"] + near[151:]))]
    rows += [(70, prose(100) + " " + passage + " " + prose(100)), (71, prose(120) + " " + passage + " " + prose(50))]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = d.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, sf).write.parquet(f"{sf}/{name}")
        d = spark.read.parquet(f"{sf}/{name}")
        kept.append({r["doc_id"] for r in d.collect()})
        if name != "packing":
            assert d.columns == columns
    everything = {i for i, _ in rows}
    assert kept[0] == everything - {60, 61} == kept[1]
    assert kept[2] == kept[1] - {62, 64} == kept[3] == kept[4]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/suffix-array dedup").collect()}
    assert passage not in texts[70] and passage not in texts[71] and texts[5] == rows[5][1]
    first, second = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)  # neither has been read yet
    want = sorted(map(tuple, d.collect()))
    assert sorted(map(tuple, first.collect())) == want == sorted(map(tuple, second.collect()))


def test_passages_of_little_more_than_fifty_words(spark, tmp_path):
    """Passages of 51 to 60 words, some 290 bytes and more, that two documents share are cut out whole; nothing else is."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstuéß") for _ in range(rnd.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    data, want = [], {}
    for k in range(40):
        passage = prose(51 + k % 10)
        for i in (2 * k, 2 * k + 1):
            a, b = f"{i}a{prose(120)}", f"{prose(60)}{i}b"
            data.append((i, f"{a} {passage} {b}"))
            want[i] = (a, b, passage)
    data += [(100 + i, prose(150)) for i in range(20)] + [(200, ""), (201, None), (None, prose(90))]
    docs = spark.createDataFrame([(i, t, "en", "h", len(t or ""), True) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, n_removed boolean")
    got = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, docs, str(tmp_path)).collect()}
    assert len(got) == len(data)
    for i, (a, b, passage) in want.items():
        assert got[i]["text"].startswith(a[:-1]) and got[i]["text"].endswith(b[1:]) and len(got[i]["text"]) <= len(a) + len(b) + 2, i
        assert got[i]["n_chars"] == len(got[i]["text"]) and got[i]["n_removed"] is True
    assert all(got[i]["text"] == (t or "") for i, t in data if i not in want)


def test_empty_and_odd_tables(spark, tmp_path):
    """Every stage on an empty table, and on null and repeated ids with columns named as the operators'."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, _i int, line string, sequence_id long"
    rnd = random.Random(8)
    prose = lambda n: " ".join(str(rnd.random())[2:8] for _ in range(n))
    text = prose(70)
    odd = [(None, text), (None, prose(80)), (4, prose(60)), (4, prose(60)), (5, text), (5, text), (6, None), (7, "x " * 9000)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data in ([], [(i, t, None, None, 0, "a", 0.1, 3, "b", 9) for i, t in odd]):
        docs = spark.createDataFrame(data, kind)
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{len(data)}-{name}"
            docs.write.parquet(path)
            docs = stage(spark, spark.read.parquet(path), str(tmp_path))
            if name != "packing":
                assert dict(docs.dtypes) == dict(spark.read.parquet(path).dtypes)
        ids = sorted((r["doc_id"] for r in docs.where("start = 0").collect()), key=str)
        assert ids == ([] if not data else [4, 4, 5, None])
