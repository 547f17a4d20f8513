"""Near duplicates by SuperMinHash signatures, bands, verification on whole sets and union-find.

1. A document's signature has M slots. Each shingle walks through the slots in an order of its own, drawn by Fisher and Yates, and
   offers its j-th slot the rank j + r, with r in [0, 1). A slot keeps the least rank offered. As a shingle's ranks in
   different slots differ by their whole parts, slots are more even than independent ones, and the share of equal slots
   estimates the Jaccard similarity with less variance. A document stops as soon as each slot's rank is below the walk's next step.
2. Documents of equal sets are one class, found by a 128-bit sum of the shingles. Only classes go on.
3. A signature is cut into bands of ROWS slots. Classes that share a band with others are candidates; what bands join, directly
   or by others, is a cluster, which bounds what may have to be compared.
4. Tasks compare a cluster's candidates on their whole sets and join linked ones (union-find). Two classes that are joined
   already aren't compared, so a large group of near copies takes about one comparison for each.
   A cluster of more than TASK_SETS classes is first joined within parts, then by one class for each joined part. Only where that
   leaves more than one part, all pairs of its small parts are compared, but for what is joined.

With M = 128 and ROWS = 4, a pair at exactly 0.85 shares no band with a chance of (1 - 0.85 ** 4) ** 32, or 6e-11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import graph, jaccard, scratch, spans
from lodestone.llm.columns import documents, map_texts, text_of
from lodestone.llm.jaccard import Sets

#: Slots of a signature, slots of a band, words of a shingle, similarity of linked sets in percent.
M, ROWS, WORDS, PERCENT = 128, 4, 5, 85
#: Classes that one task compares, about, and classes of copies whose documents aren't shuffled to meet their class, at most.
TASK_SETS, HOT_CLASSES = 4000, 5000
#: Shingles whose walks are kept at a time.
_WALKS = 1 << 15
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _drawn(hashes: np.ndarray, j: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's rank at step j (the step in the upper byte, the rest drawn) and which of the slots left it draws."""
    x = spans.mix(hashes + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    y = spans.mix(x ^ np.uint64(0xD1B54A32D192ED03))
    return (x >> np.uint64(8)) | np.uint64(j << 56), ((y >> np.uint64(32)) * np.uint64(left) >> np.uint64(32)).astype(np.int64)


def signatures(hashes: np.ndarray, at: np.ndarray, m: int = M) -> np.ndarray:
    """SuperMinHash signatures of sets, one after the other in `hashes`, each without repeats: a row of m ranks for each. Those of
    an empty set are the highest number."""
    out = np.full((len(at) - 1, m), _FREE, np.uint64)
    size = np.diff(at)
    a = 0
    while a < len(size):  # some sets at a time, a larger one alone
        b = max(a + 1, int(np.searchsorted(at, at[a] + _WALKS, "right")) - 1)
        _walk(hashes[at[a] : at[b]], np.repeat(np.arange(b - a), size[a:b]), out[a:b], m)
        a = b
    return out


def _walk(hashes: np.ndarray, owner: np.ndarray, out: np.ndarray, m: int) -> None:
    slots = out.reshape(-1)
    rank, k = _drawn(hashes, 0, m)
    np.minimum.at(slots, owner * m + k, rank)
    walks = None
    for j in range(1, m):
        # early stop: no step from here on offers less than j
        open_ = (out >> np.uint64(56)).max(axis=1) >= j
        live = open_[owner]
        if not live.any():
            return
        if walks is None:
            hashes, owner, k = hashes[live], owner[live], k[live]
            walks = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(hashes), 1))
            walks[np.arange(len(k)), k] = 0
        elif live.sum() * 2 < len(live):
            hashes, owner, walks = hashes[live], owner[live], walks[live]
        rank, k = _drawn(hashes, j, m - j)
        rows, k = np.arange(len(k)), k + j
        slot = walks[rows, k].astype(np.int64)
        walks[rows, k] = walks[:, j]
        np.minimum.at(slots, owner * m + slot, rank)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    n, m = signature.shape
    cut = signature.reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, m // rows)).copy()
    for i in range(rows):
        out = spans.mix((out ^ cut[:, :, i]) + np.uint64(i + 1))
    return out


class _Texts(Sets):
    """The sets of a block of texts, one after the other."""

    def __init__(self, column: pa.Array, words: int):
        super().__init__(column, words)
        order = np.argsort(self.owner, kind="stable")
        self.hashes, self.owner = self.hashes[order], self.owner[order]
        self.at = np.concatenate(([0], np.cumsum(self.size)))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums of each set, which tell sets apart."""
        both = []
        for salt in (0x243F6A8885A308D3, 0x5851F42D4C957F2D):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spans.mix(self.hashes ^ np.uint64(salt)))))
            both.append((sums[self.at[1:]] - sums[self.at[:-1]]).view(np.int64))
        return both[0], both[1]


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, m: int = M, rows: int | None = None) -> DataFrame:
    """Rows (key, t, n, a, b, signature) of all documents: a hash of the text, the size of the set, two sums that name it, and m ranks of
    eight bytes, or, if `rows` is given, the keys of bands of so many slots in their place. Null, empty and blank texts have n = 0
    and a null signature. All rows are kept, whatever their key."""
    base = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")).withColumn("_t", F.xxhash64("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _Texts(batch.column("_text"), words)
        a, b = own.sums()
        made = signatures(own.hashes, own.at, m)
        made = bands(made, rows) if rows else made
        signature = pa.array([x.tobytes() if n else None for x, n in zip(made, own.size.tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_t"), pa.array(own.size), pa.array(a), pa.array(b), signature], names=["key", "t", "n", "a", "b", "signature"])

    return map_texts(base, "_text", run, f"key {base.schema['_key'].dataType.simpleString()}, t long, n long, a long, b long, signature binary")


def similarity(a: Column, b: Column, m: int = M) -> Column:
    """The estimated Jaccard similarity of two signatures' sets: the share of equal slots. Null where a set is empty."""
    slot = lambda s, i: F.substring(s, i * 8 + 1, F.lit(8))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), F.lit(0), lambda n, i: n + (slot(a, i) == slot(b, i)).cast("int")) / m)


class _Group:
    """Sets that one task compares, by shingle."""

    def __init__(self, tokens: list[np.ndarray]):
        self.n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.n) - self.n
        _, self.token = np.unique(np.concatenate(tokens), return_inverse=True)
        self.owners = np.repeat(np.arange(len(tokens)), self.n)[np.argsort(self.token, kind="stable")]
        self.size = np.bincount(self.token)
        self.at = np.cumsum(self.size) - self.size

    def shared(self, x: int) -> np.ndarray:
        """How many of x's shingles each set has."""
        own = self.token[self.start[x] : self.start[x] + self.n[x]]
        return np.bincount(self.owners[spans.ragged(self.at[own], self.size[own])], minlength=len(self.n))


def joined(tokens: list[np.ndarray], keys: np.ndarray, root: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each set, the smallest number of a set that it is joined with. `keys` are the bands' keys, `root` what is joined already:
    numbers of sets that come first in their part. Sets of one side have been compared before."""
    group, root, m = _Group(tokens), root.copy(), len(tokens)
    order = np.argsort(keys, axis=0, kind="stable")  # by band
    ranked = np.take_along_axis(keys, order, axis=0)
    fresh = np.ones(ranked.shape, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(m)[:, None], 0), axis=0)
    last = np.minimum.accumulate(np.where(np.concatenate((fresh[1:], np.ones((1, keys.shape[1]), bool))), np.arange(m)[:, None], m)[::-1], axis=0)[::-1]
    place = np.empty(order.shape, np.int64)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(m)[:, None], order.shape), axis=0)
    lows, highs = (np.take_along_axis(x, place, axis=0) for x in (first, last))
    flat = np.ascontiguousarray(order.T).reshape(-1)
    base = np.arange(keys.shape[1]) * m
    for x in range(m):
        near = flat[spans.ragged(base + lows[x], highs[x] - lows[x] + 1)]
        near = near[(near > x) & (root[near] != root[x]) & (side[near] != side[x])]  # what is joined isn't compared
        if not len(near):
            continue
        both = group.shared(x)
        near = np.unique(near)
        near = near[(100 + percent) * both[near] >= percent * (group.n[x] + group.n[near])]
        if len(near):
            parts = np.unique(np.concatenate((root[near], [root[x]])))
            root[np.isin(root, parts)] = parts[0]
    return root


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Rows (doc, root): the least doc that each is joined with here. `part` is what it is joined with before."""
        table = table.sort_by("doc")
        doc, part = np.asarray(table.column("doc")), np.asarray(table.column("part"))
        tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        keys = np.stack([np.frombuffer(s, np.uint64) for s in table.column("bands").to_pylist()])
        _, first, inverse = np.unique(part, return_index=True, return_inverse=True)
        root = joined(tokens, keys, first[inverse], np.asarray(table.column("side")), percent)
        return pa.Table.from_arrays([pa.array(doc), pa.array(doc[root])], names=["doc", "root"])

    return run


def _tokens(words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The sets of texts that stand for their classes; a text of another set with the same key and hash gets none."""
        own = _Texts(batch.column("text"), words)
        right = own.size == np.asarray(batch.column("n"))
        for name, sums in zip("ab", own.sums(), strict=True):
            right &= sums == np.asarray(batch.column(name))
        made = [own.hashes[x:y].tobytes() if r else None for x, y, r in zip(own.at.tolist(), own.at[1:].tolist(), right.tolist(), strict=False)]
        others = ["doc", "cluster", "parts", "nth", "bands"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(made, pa.binary())], names=[*others, "tokens"])

    return run


def _verified(texts: DataFrame, clusters: DataFrame, words: int, percent: int, task_sets: int) -> DataFrame:
    """(doc, root) of all classes of the clusters: the least class that each is joined with by links. texts: (doc, n, a, b, bands, text)."""
    half, columns = task_sets // 2, ["place", "doc", "part", "side", "bands", "tokens"]
    size = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    tasks = max(16, clusters.count() // task_sets + 1)
    placed = clusters.join(size, "cluster").withColumn("parts", F.when(F.col("m") > task_sets, F.ceil(F.col("m") / half)).otherwise(1).cast("int"))
    placed = scratch.keep(placed.select("doc", "cluster", "parts", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("nth")), "placed")
    joined_texts = placed.join(texts, "doc").select("doc", "cluster", "parts", "nth", "bands", "n", "a", "b", "text")
    sets = scratch.keep(map_texts(joined_texts, "text", _tokens(words), "doc long, cluster long, parts int, nth int, bands binary, tokens binary").where("tokens IS NOT NULL"), "sets")

    def solve(rows: DataFrame, name: str) -> DataFrame:
        return scratch.keep(rows.select(*columns).groupBy("place").applyInArrow(_compare(percent), "doc long, root long"), name)

    alone = [F.col("doc").alias("part"), F.col("doc").alias("side")]
    place = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("cluster"), F.lit(tasks))).otherwise(F.xxhash64("cluster", "nth"))
    found = solve(sets.select("*", place.alias("place"), *alone), "links")
    large = placed.where("parts > 1")
    if not large.limit(1).count():
        return found
    # large clusters: one set for each joined part meets the others' in tasks of bounded size
    parts = found.join(large.select("doc", "cluster"), "doc")
    leaders = parts.where("doc = root").select("doc", "cluster")
    many = leaders.groupBy("cluster").agg(F.ceil(F.count("*") / task_sets).alias("k"))
    leaders = leaders.join(many, "cluster").select("doc", F.xxhash64("cluster", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("k"))).alias("place"))
    second = solve(leaders.join(sets.select("doc", "bands", "tokens"), "doc").select("*", *alone), "leaders")
    parts = parts.join(second.select(F.col("doc").alias("root"), F.col("root").alias("top")), "root").select("doc", "cluster", F.col("top").alias("part"))
    parts = scratch.keep(parts, "parts")
    # clusters that are in more than one part: all pairs of their small parts, but for what is joined
    torn = parts.groupBy("cluster").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("cluster")
    links = parts.select(F.col("part").alias("u"), F.col("doc").alias("v"))
    if torn.limit(1).count():
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("nth", j).alias("i"), F.greatest("nth", j).alias("j")))
        open_ = large.join(torn, "cluster", "left_semi").select("doc", "cluster", F.col("nth").cast("long").alias("side"), F.explode(pairs).alias("p")).where("p.i < p.j")
        rows = open_.select("doc", "side", F.xxhash64("cluster", "p").alias("place")).join(parts.select("doc", "part"), "doc").join(sets.select("doc", "bands", "tokens"), "doc")
        links = links.unionByName(solve(rows, "pairs").select(F.col("root").alias("u"), F.col("doc").alias("v")))
    whole = graph.components(links).select(F.col("node").alias("doc"), F.col("component").alias("root"))
    return found.join(large.select("doc"), "doc", "left_anti").unionByName(whole)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, task_sets: int = TASK_SETS, m: int = M, rows: int = ROWS) -> DataFrame:
    """Rows (key, n_shingles, component_id, kept) of all documents. The key is a whole number.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both; component_id is the smallest key reachable
    by links, and the document that has it is kept. Documents without words (null, empty or blank text) are linked with nothing.
    Repeated rows are copies: where a key is the component's, all its rows are kept. Null keys stay null and are a component only
    where no other key is reachable; an empty table gives no rows; other columns are passed over, whatever their names.
    """
    base = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    found = scratch.keep(signed(base, "key", "text", words, m, rows).withColumnRenamed("signature", "bands"), "signatures")
    on = ["n", "a", "b"]
    classes = found.where("n > 0").groupBy(*on).agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.min(F.struct("key", "t", "bands")).alias("one"))
    classes = scratch.keep(classes.select(*on, "least", "copies", "one.*", F.monotonically_increasing_id().alias("doc")), "classes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = spans.buffer(batch.column("bands"))
            flat, doc = keys.view(np.int64), np.repeat(np.asarray(batch.column("doc")), np.diff(at) // 8)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(flat)], names=["doc", "band"])

    cuts = classes.select("doc", "bands").mapInArrow(cut, "doc long, band long")
    shared = cuts.groupBy("band").agg(F.min("doc").alias("u"), F.max("doc").alias("top")).where("u < top").select("band", "u")
    # of the classes that come first in its bands, as many as there are bands at most, a class keeps the least; the others hang on that one, and
    # classes of one group mostly name the same ones, so a group's links are about as many as its classes, not as its bands
    firsts = cuts.join(shared, "band").where("doc > u").groupBy("doc").agg(F.collect_set("u").alias("us")).select("doc", F.array_min("us").alias("u"), "us")
    hung = firsts.select("u", F.explode("us").alias("v")).where("u < v").distinct()
    clusters = graph.components(firsts.select("u", F.col("doc").alias("v")).unionByName(hung))
    clusters = clusters.withColumnRenamed("node", "doc").withColumnRenamed("component", "cluster")
    # texts are read again for the classes in clusters only, one for each: rows of the same key and text are many only where they are repeated
    wanted = classes.join(clusters.select("doc"), "doc", "left_semi").select("doc", F.col("key").alias("_k"), F.col("t").alias("_t"), *on, "bands")
    again = base.join(wanted, F.col("key").eqNullSafe(F.col("_k")) & (F.xxhash64("text") == F.col("_t"))).select("doc", *on, "bands", "text", F.col("_t"))
    texts = again.withColumn("_r", F.row_number().over(W.partitionBy("doc").orderBy("_t"))).where("_r = 1").drop("_r", "_t")
    roots = _verified(texts, clusters, words, percent, task_sets)
    named = classes.select("doc", *on, "copies", "least").join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    # null keys are passed over, so a component's is null only where it has no other
    named = scratch.keep(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(*on, "copies", "component_id"), "components")
    return _spread(found.select("key", *on), named).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _spread(found: DataFrame, named: DataFrame) -> DataFrame:
    """Each document with its class's component. Documents of the largest classes, of which there are HOT_CLASSES at most, stay where
    they are and get a broadcast row; all others are shuffled."""
    on = ["n", "a", "b"]
    least = -(-found.count() // HOT_CLASSES) + 1
    hot, cold = F.broadcast(named.where(F.col("copies") >= least).drop("copies")), named.where(F.col("copies") < least).drop("copies")
    some = found.where("n > 0")
    out = some.join(hot, on).unionByName(some.join(hot.select(*on), on, "left_anti").join(cold, on))
    return out.unionByName(found.where("n = 0").withColumn("component_id", F.col("key")))


def op11_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir).select("doc_id", "text"))


#: The same by comparing all pairs that share a shingle.
OP11_SQL = (
    jaccard.linked_sql(PERCENT)
    + "SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id, min(r.other) = s.doc_id AS kept FROM sizes s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.n"
)
