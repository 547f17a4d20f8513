"""The prefix trie of conversations, as intervals of a preorder.

A turn is named by a hash of its role and text, with the text's length behind it; a conversation is the string of its turns'
names, its path. No text is moved further than to its name, and no two conversations are ever paired.

1. Distinct paths are sorted over all tasks. What a path has in common with the one before it are nodes that stand already; the
   rest of its nodes are new, in this order, which is the preorder. A running sum of new nodes, within tasks and then over
   the tasks' totals, gives each node its place.
2. Each path names its nodes. What is summed up for a node over all paths through it, in each task first, gives its members, its
   least member and the end of its subtree: the place behind the last node of its last path.
3. The nodes' places are cut into runs of RUN. Prefix sums of leaves and of saved tokens over runs, and over the runs' totals, are
   looked up at a node's place and at its end; the differences are its subtree's.
4. The members that end at a node are sorted over all tasks and packed into blobs, and the blobs of a node are hashed one after the
   other, so that a node with most of the members takes memory for some blobs only.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import scratch

#: Bytes of a turn in a path: 16 of its hash, 8 of its text's length.
STEP = 24
#: Places in a run of prefix sums, members in a blob, and parents whose rows are broadcast rather than shuffled, at most.
RUN, BLOB, HOT_PARENTS = 1 << 16, 1 << 16, 5000
#: The contract's rebuilding of conversations: the head comes from a conversation of a multiple of GROUP and has fewer turns than HEADS.
GROUP, HEADS = 5, 9


def turn_name(role: Column, text: Column) -> Column:
    """48 hexadecimal digits for a turn; null is empty. The role's length keeps role and text apart."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.sha2(F.concat_ws("\n", F.octet_length(role).cast("string"), role, text).cast("binary"), 256)
    return F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))


def paths(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, names) of all conversations: the names of their turns in the order of `turn`, null first; turns of equal numbers
    are ordered by their names. Rows without a conversation's id belong to none."""
    rows = turns.select(F.col(conversation).cast("long").alias("conv"), F.col(turn).alias("turn"), turn_name(F.col(role), F.col(text)).alias("name")).where("conv IS NOT NULL")
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "name"))).alias("turns")).select("conv", F.col("turns.name").alias("names"))


def rebuilt(named: DataFrame) -> DataFrame:
    """Rows (conv, names): the first h names of conversation conv - conv % GROUP, if there is one, then the conversation's own behind
    its first h, where h is the conversation id's crc32 modulo HEADS."""
    heads = named.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.slice("names", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    joined = named.withColumn("base", F.col("conv") - F.col("conv") % GROUP).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    own = F.slice("names", F.col("h") + 1, F.greatest(F.size("names") - F.col("h"), F.lit(0)))
    return joined.withColumn("h", h).select("conv", F.concat(head, own).alias("names"))


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common at their start."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:  # equal up to low turns, unlike within high + 1
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * STEP] == b[: middle * STEP] else (low, middle - 1)
    return low


def _key(digest: bytes) -> tuple[int, int]:
    return struct.unpack(">qq", digest[:16])


ROOT = _key(hashlib.sha256(b"").digest())
_SORTED = "part int, place long, before long, path binary, n long, conv long"


def _placed(paths: DataFrame) -> DataFrame:
    """Distinct paths (path, n, conv) with `common`, the number of turns that the path before has too, and `at`, the place of the first new
    node. The root has the place 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before, last = TaskContext.get().partitionId(), 0, 0, b""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                common = _shared(last, row["path"])
                out.append({"part": part, "place": place, "before": before, **row, "common": common})
                place, before, last = place + 1, before + len(row["path"]) // STEP - common, row["path"]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("place", pa.int64()), ("before", pa.int64()), ("path", pa.binary()), ("n", pa.int64()), ("conv", pa.int64()), ("common", pa.int64())]))

    parts = paths.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = paths.repartitionByRange(int(parts), "path").sortWithinPartitions("path")
    rows = scratch.keep(ordered.select("path", "n", "conv").mapInArrow(run, _SORTED + ", common long"), "paths")
    # a row for each task: its first path has some turns in common with the last one of the task before it
    ends = rows.groupBy("part").agg(F.max(F.struct("place", "path", (F.col("before") + F.octet_length("path") / STEP - F.col("common")).cast("long").alias("total"))).alias("last"))
    firsts = rows.where("place = 0").select("part", F.col("path").alias("first"))
    tasks = ends.join(firsts, "part").select("part", "first", "last.path", "last.total").withColumn("_one", F.lit(0))
    order = W.partitionBy("_one").orderBy("part")
    same = F.udf(lambda a, b: _shared(bytes(a), bytes(b)) if a is not None else 0, "long")
    tasks = tasks.withColumn("earlier", same(F.lag("path").over(order), "first")).withColumn("own", F.col("total") - F.col("earlier"))
    tasks = tasks.select("part", "earlier", (F.sum("own").over(order) - F.col("own") + 1).alias("base"))
    rows = rows.join(F.broadcast(tasks), "part")  # as many rows as tasks
    first = F.col("place") == 0
    at = F.col("base") + F.when(first, 0).otherwise(F.col("before") - F.col("earlier"))
    return rows.select("path", "n", "conv", F.when(first, F.col("earlier")).otherwise(F.col("common")).alias("common"), at.alias("at"))


_NODE = "k1 long, k2 long, p1 long, p2 long, depth long, start long, stop long, n long, conv long, bytes long"


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node on each path: its name, its parent's, its place where this path is its first, and where the path ends."""
    names = [c.split()[0] for c in _NODE.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for row in batch.to_pylist():
            path, common, at = row["path"], row["common"], row["at"]
            length = len(path) // STEP
            stop, h = at + length - common, hashlib.sha256()
            key, parent, size = ROOT, (None, None), 0
            for d in range(length + 1):
                if d:
                    turn = path[(d - 1) * STEP : d * STEP]
                    h.update(turn)
                    key, parent, size = _key(h.copy().digest()), key, int.from_bytes(turn[16:])
                start = 0 if not d else at + d - common - 1 if d > common else None
                for c, v in zip(out, (*key, *parent, d, start, stop, row["n"], row["conv"], size), strict=True):
                    c.append(v)
            if len(out[0]) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)


def _summed(nodes: DataFrame) -> DataFrame:
    """The nodes with n_leaves and saved_tokens of their subtrees, by differences of prefix sums at a subtree's two ends."""
    run = F.expr(f"start div {RUN}")
    # the place behind the last node is the end of many subtrees, and so a mark that adds nothing
    end = nodes.where("p1 IS NULL").select(F.col("stop").alias("start"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"), F.expr(f"stop div {RUN}").alias("run"))
    marked = nodes.select("start", (F.col("stop") == F.col("start") + 1).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"), run.alias("run"))
    marked = scratch.keep(marked.unionByName(end), "marks")
    totals = marked.groupBy("run").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).withColumn("_one", F.lit(0))
    order = W.partitionBy("_one").orderBy("run")  # a row for RUN nodes
    before = totals.select("run", (F.sum("leaf").over(order) - F.col("leaf")).alias("leaf0"), (F.sum("saved").over(order) - F.col("saved")).alias("saved0"))
    inner = W.partitionBy("run").orderBy("start")
    sums = marked.join(before, "run").select("start", *((F.col(f"{c}0") + F.sum(c).over(inner) - F.col(c)).alias(c) for c in ("leaf", "saved")))
    here = nodes.join(sums.select("start", F.col("leaf").alias("leaf_from"), F.col("saved").alias("saved_from")), "start")
    out = here.join(sums.select(F.col("start").alias("stop"), F.col("leaf").alias("leaf_to"), F.col("saved").alias("saved_to")), "stop")
    return out.select("*", (F.col("leaf_to") - F.col("leaf_from")).alias("n_leaves"), (F.col("saved_to") - F.col("saved_from")).alias("saved_tokens"))


def _ends(members: DataFrame) -> DataFrame:
    """Rows (k1, k2, ends_sha256) of nodes (k1, k2) at which members (conv) end."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, conv = (np.asarray(batch.column(c)) for c in ("k1", "k2", "conv"))
            cuts = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))) if len(conv) else np.zeros(0, np.int64)
            cuts = np.unique(np.concatenate((cuts, np.arange(0, len(conv), BLOB), [len(conv)])))
            rows = [{"k1": int(k1[a]), "k2": int(k2[a]), "first": int(conv[a]), "blob": zstandard.compress(np.diff(conv[a:b], prepend=0).astype("<i8").tobytes(), 1)} for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("blob", pa.binary())]))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
        key, h = None, hashlib.sha256()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["k1"], row["k2"]) != key:
                    if key:
                        out.append({"k1": key[0], "k2": key[1], "ends_sha256": h.hexdigest()})
                    key, h = (row["k1"], row["k2"]), hashlib.sha256()
                else:
                    h.update(b",")
                h.update(",".join(map(str, np.cumsum(np.frombuffer(zstandard.decompress(row["blob"]), "<i8")).tolist())).encode())
            yield pa.RecordBatch.from_pylist(out, kind)
        if key:
            yield pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "ends_sha256": h.hexdigest()}], kind)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["k1", "k2"]
    blobs = members.repartitionByRange(n, *by, "conv").sortWithinPartitions(*by, "conv").mapInArrow(pack, "k1 long, k2 long, first long, blob binary")
    return blobs.repartition(n, *by).sortWithinPartitions(*by, "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def trie(named: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations (conv, names), each conv once: conv_id, the smallest member; depth; parent_conv_id, the
    parent's smallest member (null for the root); n_convs, n_children, n_leaves and saved_tokens (over the subtree, each node's
    members but one times the bytes of its last text); ends_sha256 of the ids of the conversations that end there. first and last are
    the node's place in the preorder and the place behind its subtree. A conversation without turns ends at the root; an empty table gives no rows.
    """
    members = scratch.keep(named.select("conv", F.unhex(F.array_join("names", "")).alias("path")), "members")
    distinct = members.groupBy("path").agg(F.count("*").alias("n"), F.min("conv").alias("conv"))
    on, up = ["k1", "k2"], ["p1", "p2"]
    spelt = _placed(distinct).mapInArrow(_spelt, _NODE)
    nodes = spelt.groupBy(*on).agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), *(F.max(c).alias(c) for c in ("depth", "start", "stop", "bytes", *up)))
    nodes = scratch.keep(nodes, "nodes")
    children = nodes.where("p1 IS NOT NULL").groupBy(*up).agg(F.count("*").alias("n_children"))
    counted = scratch.keep(nodes.join(children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children"), on, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # parents of so many children that there are HOT_PARENTS at most are broadcast; the root, without one, stays as it is
    least = counted.count() // HOT_PARENTS + 1
    parents = counted.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"), "n_children")
    hot, cold = F.broadcast(parents.where(F.col("n_children") >= least).drop("n_children")), parents.where(F.col("n_children") < least).drop("n_children")
    below = counted.where("p1 IS NOT NULL")
    owned = below.join(hot, up).unionByName(below.join(hot.select(*up), up, "left_anti").join(cold, up)).select(*counted.columns, "parent_conv_id")
    owned = owned.unionByName(counted.where("p1 IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    half = lambda at: F.conv(F.substring(F.col("_sha"), at, 16), 16, -10).cast("long")
    ended = members.select("conv", F.sha2("path", 256).alias("_sha")).select("conv", half(1).alias("k1"), half(17).alias("k2"))
    none = hashlib.sha256(b"").hexdigest()
    out = _summed(scratch.keep(owned, "nodes")).join(_ends(ended), on, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), F.col("start").alias("first"), F.col("stop").alias("last"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(paths(spark.read.parquet(f"{sf_dir}/conversations.parquet")))).drop("first", "last")


#: The same with whole lists of turns as names of nodes. The crc32 is worked out bit by bit; both numbers are fixed values of that checksum.
OP13_SQL = """
WITH ids AS (
  SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT c, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: list_concat([CAST(ascii(ch) AS BIGINT)], [CAST(-1 AS BIGINT), -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END), CAST(4294967295 AS BIGINT)) % 9 AS INTEGER) AS h FROM ids
), named AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), built AS (
  SELECT n.c, list_concat(coalesce(b.turns[1:h], []), n.turns[h + 1:]) AS p FROM named n JOIN crc USING (c) LEFT JOIN named b ON b.c = n.c - n.c % 5
), prefixes AS (
  SELECT c, d, p[1:d] AS k, len(p) = d AS ends FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM built)
), nodes AS (
  SELECT k, CAST(d AS BIGINT) AS d, min(c) AS conv, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ids,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(k[d].t)) END AS saved FROM prefixes GROUP BY k, d
), kids AS (
  SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), every_node AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (k)
), below AS (
  SELECT k[1:e] AS k, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT k, saved, n_children, unnest(range(0, d + 1)) AS e FROM every_node) GROUP BY 1
)
SELECT n.conv AS conv_id, n.d AS depth, u.conv AS parent_conv_id, n.n AS n_convs, n.n_children, b.n_leaves, b.saved_tokens, sha256(n.ids) AS ends_sha256
FROM every_node n JOIN below b USING (k) LEFT JOIN nodes u ON n.d > 0 AND u.k = n.k[1:n.d - 1]
"""
