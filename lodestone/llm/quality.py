"""Quality rules by cross-document line frequency.

Each text is cut into lines, lines are normalised and hashed, and for each host the distinct documents that hold a
line are counted. Lines above the limit are boilerplate and are taken off; a document of which little is left is
depleted and rejected, as is one that fails the base rules.

Copies of one page repeat each of its lines without making them boilerplate, so documents with the same set of lines
count as one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import scratch
from lodestone.llm.columns import documents, map_texts, text_of

#: Base rules.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: A host's line is boilerplate in more documents than this.
MAX_DOCUMENTS = 10
#: A document is depleted if boilerplate lines hold more than this share of its words.
MAX_REMOVED_PERCENT = 70

_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_LINES = "lines array<struct<line: long, words: int>>"


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words in 3-word windows found twice or more."""
    words = text.encode().split()  # bytes split at the six ASCII white spaces only
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        once, again = set(), set()
        for t in triples:
            (again if t in once else once).add(t)
        end = 0  # first word not counted yet
        for i, t in enumerate(triples):
            if t in again:
                repeated += i + 3 - max(i, end)
                end = i + 3
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in _SPACE),
        sum(text.count(c) for c in _SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
    )


def _normal(line: bytes) -> list[bytes]:
    """A line's words, ASCII capitals small."""
    return line.lower().split()


def line_hashes(text: str) -> list[dict]:
    """One entry for each distinct normalised line (ASCII lower case, single spaces) that has a word: its hash, and its words over
    all places where it stands."""
    found: dict[int, dict] = {}
    for line in text.encode().split(b"\n"):
        if words := _normal(line):
            h = _hash(b" ".join(words))
            if h in found:
                found[h]["words"] += len(words)
            else:
                found[h] = {"line": h, "words": len(words)}
    return list(found.values())


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines of the given hashes."""
    return "\n".join(x for x in text.split("\n") if not (w := _normal(x.encode())) or _hash(b" ".join(w)) not in gone)


def page_hash(lines: list[dict]) -> int:
    """A hash of the set of a document's lines."""
    return _hash(np.sort(np.array([x["line"] for x in lines], np.int64)).tobytes())


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("_text").to_pylist()
    stats = list(zip(*map(text_stats, texts), strict=True)) or [[]] * 5
    lines = [line_hashes(t) for t in texts]
    kind = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [batch.column("_row"), batch.column("_host"), *(pa.array(x, pa.int64()) for x in stats), pa.array([page_hash(x) for x in lines], pa.int64()), pa.array(lines, kind)],
        names=["_row", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "page", "lines"],
    )


def boilerplate(lines: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """The (_host, line) pairs above the limit, of rows (_host, line, page), one for each document and line."""
    pages = lines.groupBy("_host", "line", "page").agg(F.lit(1).alias("n"))  # a very common line is dealt by its pages
    return pages.groupBy("_host", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_documents).select("_host", "line")


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def quality(docs: DataFrame, text: str = "text", host: str = "source", max_documents: int = MAX_DOCUMENTS, max_removed_percent: int = MAX_REMOVED_PERCENT, with_text: bool = False) -> DataFrame:
    """The rows of `docs` with the figures of text_stats(), n_removed_words, base_failed and kept; the text only if asked for, and then
    without the lines above the limit.

    A null text counts as empty and fails the base rules. A null host is a host of its own. Repeated rows are judged
    one by one, each alike, and count as one document. An empty table gives no rows. Columns of `docs` with the names of
    the figures are replaced; all others stay, whatever their names, as they travel in a column of their own.
    """
    light = [c for c in docs.columns if c != text and c not in _FIGURES]
    own = F.struct(*[F.col(c) for c in light]) if light else F.struct(F.lit(0).alias("none"))
    base = docs.select(F.struct(own.alias("own"), F.monotonically_increasing_id().alias("_i")).alias("_row"), F.when(F.col(host).isNull(), "").otherwise(F.concat(F.lit("."), F.col(host).cast("string"))).alias("_host"), text_of(text).alias("_text"))
    kind = base.schema["_row"].dataType.simpleString()
    if with_text:  # the texts are read twice, under the same numbers
        base = scratch.keep(base, "numbered")
    # the figures and the other columns are written once; texts are read again only where the caller wants them
    found = scratch.keep(map_texts(base, "_text", _measure, f"_row {kind}, _host string, {_STATS}, page long, {_LINES}"), "quality")
    lines = found.select(F.col("_row._i").alias("_i"), "_host", "page", F.inline("lines"))
    above = lines.join(boilerplate(lines, max_documents), ["_host", "line"])
    removed = above.groupBy("_i").agg(F.sum("words").alias("n_removed_words"), *[F.collect_list("line").alias("_gone")] * with_text)
    out = found.select(F.col("_row._i").alias("_i"), *([] if with_text else ["_row"]), *_FIGURES[:5]).join(removed, "_i", "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_removed_words") <= max_removed_percent * F.col("n_words")))
    columns = [F.col("_row.own")[c].alias(c) for c in light]
    if not with_text:
        return out.select(*columns, *_FIGURES)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [without_lines(t, set(g)) if g else t for t, g in zip(batch.column("_text").to_pylist(), batch.column("_gone").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_of"), pa.array(texts, pa.string())], names=["_row", "_of", "_text"])

    numbered = base.select(F.col("_row._i").alias("_i"), "_row", "_text")
    both = numbered.join(out, "_i").select("_row", F.struct(*_FIGURES).alias("_of"), "_text", "_gone")
    of = both.schema["_of"].dataType.simpleString()
    return map_texts(both, "_text", clean, f"_row {kind}, _of {of}, _text string").select(*columns, F.col("_text").alias(text), "_of.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", *_FIGURES)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('.' || source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM words),
t AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM twice GROUP BY 1),
raw AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS l FROM d),
ln AS (SELECT doc_id, host, l, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM raw),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln WHERE len(ws) > 0 GROUP BY 1),
own AS (SELECT doc_id, host, array_to_string(ws, ' ') AS line, sum(len(ws)) AS words FROM ln WHERE len(ws) > 0 GROUP BY ALL),
page AS (SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY line)) AS page FROM own GROUP BY 1),
common AS (SELECT host, line FROM own JOIN page USING (doc_id) GROUP BY 1, 2 HAVING count(DISTINCT page) > 10),
removed AS (SELECT doc_id, sum(words)::BIGINT AS n_removed_words FROM own JOIN common USING (host, line) GROUP BY 1),
o AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
      FROM d JOIN words USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND 100 * n_removed_words <= 70 * n_words AS kept FROM f
"""
