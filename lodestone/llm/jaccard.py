"""Documents linked by the Jaccard similarity of their word shingles, exactly.

1. All shingles are counted over the corpus (exchange.py). In the order of rising count, two sets of similarity t or
   more share one of the first n - ceil(t n) + 1 shingles of either. A shingle that only one document has can't be
   shared, so a document with that many of them has no link, and most documents are done here.
2. Equal sets are one class; only classes go on.
3. Classes that may be linked meet in index lists, one for each shingle of their prefixes. Members of a list are
   ordered by size and cut into blocks by the shingle's position; a block whose positions leave too few shingles is
   skipped as a whole (index-level skipping).
4. A set that follows a very similar one starts from that one's answers: only the lists of the shingles that one of the two
   lacks are read, and added to or taken from its shared counts (answer-level skipping).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import exchange, graph, scratch, spans
from lodestone.llm.columns import documents

#: Words of a shingle, and the similarity of linked sets in percent.
WORDS, PERCENT = 5, 80


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, one text's after the other's, and where each text's start. ASCII capitals count as
    small letters; a text of fewer words is one shingle, one without words has none."""
    raw, starts = spans.buffer(column)
    w_start, w_end = spans.words(raw, starts)
    first = spans.owners(w_start, starts)
    n = np.diff(first)
    h = spans.Hashes(spans.LOWER[raw]).of(w_start, w_end)
    made = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    at = spans.ragged(first[:-1], made)
    size = np.repeat(np.where(n >= words, words, n), made)
    out = np.full(len(at), 0x243F6A8885A308D3, np.uint64)
    if len(h):
        for i in range(words):
            step = spans.mix((out ^ h[np.minimum(at + i, len(h) - 1)]) + np.uint64(i + 1))
            out = np.where(i < size, step, out)
    return out, np.concatenate(([0], np.cumsum(made)))


class Sets:
    """The shingle sets of a block of texts."""

    def __init__(self, column: pa.Array, words: int):
        flat, at = shingles(column, words)
        owner = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(at))
        order = np.argsort(flat, kind="stable")  # equal shingles of one text are next to each other
        h, d = flat[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        #: Each text's distinct shingles, all ascending.
        self.hashes, self.owner = h[fresh], d[fresh]
        self.size = np.bincount(self.owner, minlength=len(column)).astype(np.int64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The block's 48-bit keys and in how many of its texts they are."""
        keys = self.hashes >> np.uint64(16) << np.uint64(16)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.concatenate((first, [len(keys)])))

    def spread(self, counts: np.ndarray) -> np.ndarray:
        """Counts of the block's keys as counts of `hashes`."""
        keys = self.hashes >> np.uint64(16)
        return counts[np.cumsum(np.concatenate(([0], (keys[1:] != keys[:-1]).astype(np.int64))))] if len(keys) else counts


def _chunked(table: pa.Table) -> pa.Array:
    return table.column("_text").combine_chunks() if table.column("_text").num_chunks != 1 else table.column("_text").chunk(0)


def sets(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Rows (doc, n, a, b, rare, open, tokens) of all documents: the set's size and a 128-bit sum of it, and for those that may
    have a link (open), the shingles in the common order and how many of them no other document has."""
    base, n_blocks = exchange.blocks(docs, key, text)

    def find(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return Sets(_chunked(table), words).counts()

    def settle(table: pa.Table, replies: pa.Table) -> pa.Table:
        own = Sets(_chunked(table), words)
        counts = own.spread(exchange.read_counts(replies)) if len(own.hashes) else np.zeros(0, np.uint8)
        n = own.size
        rare = np.bincount(own.owner[counts == 1], minlength=len(n)).astype(np.int64)
        need = n - -(-percent * n // 100) + 1
        a = np.zeros(len(n), np.uint64)
        b = np.zeros(len(n), np.uint64)
        np.add.at(a, own.owner, spans.mix(own.hashes))
        np.add.at(b, own.owner, spans.mix(own.hashes ^ np.uint64(0x5851F42D4C957F2D)))
        order = np.argsort(own.owner.astype(np.int64) << 8 | counts, kind="stable")  # by text, count, hash
        h, ends = own.hashes[order], np.cumsum(n)
        tokens = [h[e - m : e].tobytes() if m and r < p else None for e, m, r, p in zip(ends.tolist(), n.tolist(), rare.tolist(), need.tolist(), strict=True)]
        return pa.Table.from_arrays(
            [table.column("_key"), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(rare), pa.array([t is not None for t in tokens]), pa.array(tokens, pa.binary())],
            names=["doc", "n", "a", "b", "rare", "open", "tokens"],
        )

    replies = exchange.counted(base, n_blocks, find, bucket_blocks=BUCKET_BLOCKS)
    return base.groupBy("_blk").cogroup(replies.groupBy("_blk")).applyInArrow(settle, f"doc {base.schema['_key'].dataType.simpleString()}, n long, a long, b long, rare long, open boolean, tokens binary")


#: Sets that one task compares, about. A cluster of more is compared in pairs of parts of half as many.
TASK_SETS = 4000
#: Blocks whose shingles' share one bucket counts.
BUCKET_BLOCKS = 6
#: Classes of copies whose documents aren't shuffled to meet their class, at most.
HOT_CLASSES = 5000
#: Answers of so many latest sets are kept to derive later ones from.
RECENT = 256


class _Index:
    """All shingles of some sets, by shingle, and the prefixes' lists in blocks of equal positions."""

    def __init__(self, tokens: list[np.ndarray], rare: np.ndarray, percent: int):
        self.n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.n) - self.n
        _, self.token = np.unique(np.concatenate(tokens), return_inverse=True)
        owner = np.repeat(np.arange(len(tokens)), self.n)
        self.owners = owner[np.argsort(self.token, kind="stable")]
        self.size = np.bincount(self.token)
        self.at = np.cumsum(self.size) - self.size
        self.percent = percent
        self.prefix_end = self.n - -(-percent * self.n // 100) + 1
        place = np.arange(len(owner)) - self.start[owner]
        kept = (place >= rare[owner]) & (place < self.prefix_end[owner]) & (self.size[self.token] > 1)
        order = np.lexsort((self.n[owner[kept]], place[kept], self.token[kept]))  # by shingle, then blocks of one position
        self.entry_token, self.entry_place, self.entry_owner = (x[kept][order] for x in (self.token, place, owner))
        block = np.concatenate(([True], (np.diff(self.entry_token) != 0) | (np.diff(self.entry_place) != 0))) if len(order) else np.zeros(0, bool)
        self.block_start = np.concatenate((np.flatnonzero(block), [len(order)]))
        self.block_token, self.block_place = self.entry_token[self.block_start[:-1]], self.entry_place[self.block_start[:-1]]
        # the largest set of a block bounds what any of it can share behind the position
        self.block_most = np.maximum.reduceat(self.n[self.entry_owner], self.block_start[:-1]) if len(order) else np.zeros(0, np.int64)
        self.rare = rare

    def tokens_of(self, x: int) -> np.ndarray:
        return self.token[self.start[x] : self.start[x] + self.n[x]]

    def candidates(self, x: int) -> np.ndarray:
        """Earlier or later sets that share a prefix shingle with x and may be large enough, once for each such shingle."""
        own = self.tokens_of(x)[self.rare[x] : self.prefix_end[x]]
        lo, hi = np.searchsorted(self.block_token, own), np.searchsorted(self.block_token, own, "right")
        blocks = spans.ragged(lo, hi - lo)
        if not len(blocks):
            return blocks
        place = np.repeat(np.arange(self.rare[x], self.rare[x] + len(own)), hi - lo)
        # shared: what stands from this shingle on in both, and at most all that stands before it in one of them
        most = np.minimum(self.n[x] - place, self.block_most[blocks] - self.block_place[blocks]) + np.minimum(place, self.block_place[blocks])
        least = -(-self.percent * self.n[x] // 100)  # any linked set shares at least so many
        blocks = blocks[most >= least]  # whole blocks are skipped
        y = self.entry_owner[spans.ragged(self.block_start[blocks], self.block_start[blocks + 1] - self.block_start[blocks])]
        ny, nx = self.n[y], self.n[x]
        return y[(y != x) & (100 * np.minimum(ny, nx) >= self.percent * np.maximum(ny, nx))]

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the given shingles each set has."""
        return np.bincount(self.owners[spans.ragged(self.at[tokens], self.size[tokens])], minlength=len(self.n))


def link(tokens: list[np.ndarray], rare: np.ndarray, weight: np.ndarray, parts: np.ndarray | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """For each set, the number of the first set (in the given order) of its component, and the weight of the sets that it is
    linked with. With `parts`, only links between different parts count."""
    index = _Index(tokens, rare, percent)
    m = len(tokens)
    parent = np.arange(m)
    linked = np.zeros(m, np.int64)
    answers: dict[int, np.ndarray] = {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    for x in np.argsort(index.n, kind="stable").tolist():
        near = index.candidates(x)
        if parts is not None:
            near = near[parts[near] != parts[x]]
        if not len(near):
            continue
        own = index.tokens_of(x)
        # the known set that shares most prefix shingles with x; x's shared counts differ from its only by what the two don't share
        votes = np.bincount(near, minlength=m)
        known = max(answers, key=votes.__getitem__, default=None)
        if known is not None and votes[known]:
            other = index.tokens_of(known)
            gone, new = np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)
        if known is not None and votes[known] and len(gone) + len(new) < len(own):
            both = answers[known] - index.shared(gone) + index.shared(new)
        else:
            both = index.shared(own)
        answers[x] = both
        if len(answers) > RECENT:
            del answers[next(iter(answers))]
        y = np.flatnonzero(votes)
        y = y[(100 + percent) * both[y] >= percent * (index.n[x] + index.n[y])]
        linked[x] += weight[y].sum()
        for r in {find(i) for i in y.tolist()} - {find(x)} if len(y) < 64 else {find(i) for i in np.unique(parent[y]).tolist()} - {find(x)}:
            a, b = sorted((find(x), r))
            parent[b] = a
    return np.fromiter(map(find, range(m)), np.int64, m), linked


def _clusters(reps: DataFrame, percent: int) -> DataFrame:
    """(rep, cluster) of the sets that meet in index lists, directly or by others, with sets of a like size between."""

    def entries(batches):
        for batch in batches:
            rep, n, rare = (np.asarray(batch.column(c)) for c in ("doc", "n", "rare"))
            need = n - -(-percent * n // 100) + 1
            raw, at = spans.buffer(batch.column("tokens"))
            token = raw.view(np.uint64)
            flat = token[spans.ragged(at[:-1] // 8 + rare, need - rare)]
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(rep, need - rare)), pa.array(np.repeat(n, need - rare))], names=["token", "rep", "n"])

    lists = reps.select("doc", "n", "rare", "tokens").mapInArrow(entries, "token long, rep long, n long")
    order = W.partitionBy("token").orderBy("n", "rep")
    chain = lists.withColumn("u", F.lag("rep").over(order)).withColumn("m", F.lag("n").over(order))
    return graph.components(chain.where((100 * F.col("m") >= percent * F.col("n"))).select("u", F.col("rep").alias("v"))).withColumnRenamed("node", "doc").withColumnRenamed("component", "cluster")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, task_sets: int = TASK_SETS) -> DataFrame:
    """Rows (key, n_shingles, component_id, n_links) of all documents. The key is a whole number.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both. component_id is the smallest
    key that is reachable by links, of all 64-bit keys; documents without words (null or empty text) are linked with nothing. Repeated rows
    are linked like copies. Null keys stay null, and are a component only where no other key is reachable. No pair of documents is ever a row: classes of equal sets stand for their documents, and
    tasks return one row for each set they compare. An empty table gives no rows; other columns are passed over, whatever their names.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col(key).cast("long").alias(key), text)
    # rows are told apart by numbers, so any key may be null, repeated or as large as can be
    found = sets(wanted, key, text, words, percent).withColumnRenamed("doc", "key").withColumn("doc", F.monotonically_increasing_id())
    found = scratch.keep(found, "sets")
    open_ = found.where("open")
    classes = open_.groupBy("n", "a", "b").agg(F.min("doc").alias("rep"), F.min("key").alias("least"), F.count("*").alias("copies"))
    # one document's shingles for each class; ranking before the shuffle keeps a class of many copies small
    first = open_.withColumn("_r", F.row_number().over(W.partitionBy("n", "a", "b").orderBy("doc"))).where("_r = 1").drop("_r")
    reps = scratch.keep(first.join(classes, ["n", "a", "b"]).select("doc", "n", "rare", "copies", "tokens"), "classes")
    clusters = scratch.keep(_clusters(reps, percent), "clusters")
    size = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    # small clusters share tasks; large ones are cut into parts, and each pair of parts is a task
    half = task_sets // 2
    tasks = max(16, reps.count() // task_sets + 1)
    placed = clusters.join(size, "cluster").withColumn("parts", F.when(F.col("m") > task_sets, F.ceil(F.col("m") / half)).otherwise(1).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    placed = placed.select("doc", "cluster", "part", "parts", F.explode(pairs).alias("p"))
    place = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("cluster"), F.lit(tasks))).otherwise(F.xxhash64("cluster", "p"))
    placed = placed.select("doc", "part", (F.col("parts") > 1).alias("split"), (F.col("p.i") < F.col("p.j")).alias("across"), place.alias("place"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc")
        doc = np.asarray(table.column("doc"))
        tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        root, links = link(tokens, np.asarray(table.column("rare")), np.asarray(table.column("copies")), np.asarray(table.column("part")) if table.column("across")[0].as_py() else None, percent)
        return pa.Table.from_arrays([pa.array(doc), pa.array(doc[root]), pa.array(links), table.column("split")], names=["doc", "root", "links", "split"])

    schema = "doc long, root long, links long, split boolean"
    solved = scratch.keep(placed.join(reps, "doc").select("place", "doc", "rare", "copies", "tokens", "part", "split", "across").groupBy("place").applyInArrow(compare, schema), "links")
    whole = solved.where("NOT split").select("doc", "root", "links")
    if solved.where("split").limit(1).count():
        joined = graph.components(solved.where("split").select(F.col("doc").alias("u"), F.col("root").alias("v")))
        sums = solved.where("split").groupBy("doc").agg(F.sum("links").alias("links"))
        whole = whole.unionByName(sums.join(joined.select(F.col("node").alias("doc"), F.col("component").alias("root")), "doc"))
    by_class = classes.join(whole, F.col("rep") == F.col("doc"), "left").select("n", "a", "b", "copies", "least", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # null keys are passed over, so a component's is null only where it has no other
    by_class = by_class.join(by_class.groupBy("root").agg(F.min("least").alias("component")), "root").drop("root", "least")
    done = found.select("key", "n", "a", "b", "open")
    # classes of so many copies that there are at most HOT_CLASSES: their documents stay where they are, all others are shuffled
    least = -(-found.count() // HOT_CLASSES) + 1
    hot = F.broadcast(by_class.where(F.col("copies") >= least).drop("copies"))
    cold = by_class.where(F.col("copies") < least).drop("copies")
    on = ["n", "a", "b"]
    classed = done.where("open").join(hot, on).unionByName(done.where("open").join(hot.select(*on), on, "left_anti").join(cold, on))
    classed = classed.select("key", "n", "component", "n_links")
    alone = done.where("NOT open").select("key", "n", F.col("key").alias("component"), F.lit(0).cast("long").alias("n_links"))
    return classed.unionByName(alone).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir).select("doc_id", "text"))


def linked_sql(percent: int, words: int = WORDS) -> str:
    """SQL for `sizes` (doc_id, n), `edges` (x, y), both ways, and `reach` (doc_id, other), by comparing all pairs that share a shingle."""
    return f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' ')) END) AS g FROM cut
), sizes AS (
  SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN shingles s USING (doc_id) GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= {percent} * (p.n + q.n - common)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
)
"""


OP9_SQL = (
    linked_sql(PERCENT)
    + """, own AS (SELECT x AS doc_id, count(*) AS n_links FROM edges GROUP BY 1)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id, coalesce(any_value(o.n_links), 0) AS n_links FROM sizes s JOIN reach r USING (doc_id) LEFT JOIN own o USING (doc_id) GROUP BY s.doc_id, s.n"""
)
