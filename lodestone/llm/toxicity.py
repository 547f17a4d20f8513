"""A toxicity classifier that is trained not to react to mentions of a group.

A logistic model over the presence of words and word beginnings, with an L1 penalty. For each labelled text that names
an identity, a counterfactual text names another one of the same kind; the squared change of the score is part of the
loss, so a neutral mention of a group can't carry the score.

The model is fitted on a bounded sample of the labelled rows (MAX_POSITIVE and MAX_NEGATIVE, the smallest hashes of
their ids), weighted to the label counts of all rows; every text is scored. What the sample says of each feature is counted by
Spark, and only features that speak for label 1 reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import scratch
from lodestone.llm.columns import documents, map_texts, text_of

#: Labelled rows to fit on, at most.
MAX_POSITIVE, MAX_NEGATIVE = 4000, 8000
#: A text is predicted toxic from this score.
THRESHOLD = 0.7
#: Features are hashed to so many places; in the sample a feature has to occur in MIN_TEXTS texts.
PLACES, MIN_TEXTS = 1 << 20, 5
#: Weights of the L1 penalty, of the score changes under swapped identities, and rounds of the fit.
L1, SWAP, ROUNDS = 0.0008, 4.0, 500
#: Lengths of word beginnings.
BEGINNINGS = (3, 4, 5, 6)

#: Identity terms by kind; a term is swapped for the next of its kind.
IDENTITIES = (
    ("men", "women"),
    ("man", "woman"),
    ("male", "female"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SWAP = {term: kind[(i + 1) % len(kind)] for kind in IDENTITIES for i, term in enumerate(kind)}


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def places(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    return [xxhash.xxh3_64_intdigest(f"{n}:{word[:n]}") % PLACES for n in BEGINNINGS if len(word) >= n] + [xxhash.xxh3_64_intdigest(f"w:{word}") % PLACES]


def _features(found: set[str]) -> np.ndarray:
    return np.array(sorted({p for w in found for p in places(w)}), np.int32)


@dataclass(frozen=True)
class Model:
    """Weights of the places that have one, and the constant."""

    weights: dict[int, float]
    constant: float

    def scorer(self):
        """A function from a text to its score. Words seen before are remembered, up to a bound."""
        weights, seen = self.weights, {}

        def score(text: str) -> float:
            hit: set[int] = set()
            for w in words(text):
                got = seen.get(w)
                if got is None:
                    if len(seen) > 500_000:
                        seen.clear()
                    got = seen[w] = tuple(p for p in places(w) if p in weights)
                if got:
                    hit.update(got)
            z = self.constant + sum(weights[p] for p in sorted(hit))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def _compact(rows: list[np.ndarray], lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and column numbers of the features kept; `lookup` has each feature's column, or -1."""
    parts = [(c := lookup[r])[c >= 0] for r in rows]
    return np.repeat(np.arange(len(rows)), [len(p) for p in parts]), np.concatenate(parts or [lookup[:0]])


def train(rows: list[np.ndarray], labels: list[int], swaps: list[tuple[np.ndarray, np.ndarray]], share: tuple[float, float]) -> Model:
    """Fits by accelerated proximal gradient steps. `swaps`: features of a text and of its counterfactual.
    `share`: how many labelled rows each sampled one stands for, for label 0 and 1."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, -40.0 if not len(y) or y.max() == 0 else 40.0)
    n, weight = len(y), np.where(y == 1, share[1], share[0])
    weight /= weight.sum()
    count, mass, toxic_mass = np.zeros(PLACES, np.int32), np.zeros(PLACES), np.zeros(PLACES)
    for r, own, label in zip(rows, weight, y, strict=True):
        count[r] += 1
        mass[r] += own
        toxic_mass[r] += own * label
    # features that speak for label 1 only: what is absent from a text must not count for it
    columns = np.flatnonzero((count >= MIN_TEXTS) & (toxic_mass > 2 * np.dot(weight, y) * mass))
    m = len(columns)
    lookup = np.full(PLACES, -1, np.int32)
    lookup[columns] = np.arange(m)
    owner, where = _compact(rows, lookup)
    a_owner, a_where = _compact([a for a, _ in swaps], lookup)
    b_owner, b_where = _compact([b for _, b in swaps], lookup)
    k = max(1, len(swaps))
    scale = 1 / np.sqrt(np.bincount(where, weight[owner], m) + 1e-4)  # rare features move as fast as frequent ones

    def forward(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = v * scale
        return np.bincount(owner, u[where], n), np.bincount(a_owner, u[a_where], k) - np.bincount(b_owner, u[b_where], k)

    def backward(r: np.ndarray, d: np.ndarray) -> np.ndarray:
        return scale * (np.bincount(where, r[owner], m) + np.bincount(a_where, d[a_owner], m) - np.bincount(b_where, d[b_owner], m))

    v, largest = np.ones(m) / max(1, m) ** 0.5, 1.0
    for _ in range(15 if m else 0):  # the largest curvature, by power iteration
        z, d = forward(v)
        u = backward(0.25 * weight * z, SWAP / k * d)
        largest = max(np.linalg.norm(u), 1e-9)
        v = u / largest
    step = 0.9 / (1.2 * largest + 0.25)
    w, b = np.zeros(m), float(np.log(np.dot(weight, y) / np.dot(weight, 1 - y)))
    v, vb, t = w, b, 1.0
    for _ in range(ROUNDS):
        z, d = forward(v)
        r = weight * (1 / (1 + np.exp(-np.clip(z + vb, -40, 40))) - y)
        new = v - step * backward(r, SWAP / k * d)
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_b = vb - step * r.sum()
        if np.dot(v - new, new - w) > 0:  # overshot: start the acceleration again
            t = 1.0
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, vb = new + (last - 1) / t * (new - w), new_b + (last - 1) / t * (new_b - b)
        w, b = new, new_b
    return Model({int(columns[i]): float(w[i] * scale[i]) for i in np.flatnonzero(w)}, float(b))


def _prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Features of each text and, if it names identities, of its counterfactual."""
    own, other = [], []
    for text in batch.column("_text").to_pylist():
        found = words(text)
        own.append(_features(found))
        named = found & _SWAP.keys()
        other.append(_features((found - named) | {_SWAP[x] for x in named}) if named else None)
    return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], names=["toxic", "own", "other"])


def _speaking(features: DataFrame, n: list[int], share: tuple[float, float]) -> np.ndarray:
    """Features that may have a weight, counted where they lie: in MIN_TEXTS texts, and twice as often with label 1 as a feature
    that says nothing. There are PLACES at most. train() draws the line itself, so the margin of rounding here decides nothing."""
    seen = features.select("toxic", F.explode("own").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    toxic, clean = F.col("toxic") * share[1], (F.col("n") - F.col("toxic")) * share[0]
    prior = share[1] * n[1] / max(share[0] * n[0] + share[1] * n[1], 1e-300)
    found = seen.where((F.col("n") >= MIN_TEXTS) & (toxic > 2 * prior * (1 - 1e-9) * (toxic + clean))).select("place").toArrow()
    return np.sort(found.column("place").to_numpy())


def held_out(key: str = "doc_id"):
    """Rows that are never learnt from; a null id counts as learnt from, though labels never reach it."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Model:
    """Learns labels.toxic of doc_id from the texts. Held-out ids, null ids and null labels are left out; an id that is labelled
    both ways counts as toxic; documents that repeat an id are each learnt from. Without labelled rows all scores are 0; with
    one label only, all scores are that label."""
    spark = docs.sparkSession
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    all_n = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    parts = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c, most in ((1, max_positive), (0, max_negative))]
    # at most max_positive + max_negative rows of two numbers, whatever the size of the tables
    sample = F.broadcast(spark.createDataFrame([r for p in parts for r in p.collect()] or [], usable.schema))
    texts = docs.select("doc_id", text_of(text).alias("_text")).join(sample, "doc_id").select("toxic", "_text")
    schema = "toxic int, own array<int>, other array<int>"
    features = scratch.keep(map_texts(texts, "_text", _prepare, schema), "features")
    counted = {r["toxic"]: r["count"] for r in features.groupBy("toxic").count().collect()}
    n = [counted.get(c, 0) for c in (0, 1)]
    share = tuple(all_n.get(c, 0) / max(1, n[c]) for c in (0, 1))
    speaking = spark.sparkContext.broadcast(_speaking(features, n, share))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([x if x is None else np.intersect1d(np.asarray(x, np.int32), speaking.value) for x in batch.column(c).to_pylist()], pa.list_(pa.int32())) for c in ("own", "other")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], names=["toxic", "own", "other"])

    got = features.mapInArrow(narrow, schema).toArrow()
    labels, own, other = (got.column(c).to_pylist() for c in ("toxic", "own", "other"))
    read = lambda x: np.asarray(x, np.int32)
    swaps = [(read(a), read(b)) for a, b in zip(own, other, strict=True) if b is not None]
    swaps += [(_features({a}), _features({b})) for a, b in _SWAP.items()]
    return train([read(x) for x in own], labels, swaps, share)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with score and predicted; columns of these names are replaced, all others stay. A null text is scored as
    an empty one and stays null; repeated rows are scored one by one; an empty table gives no rows."""
    others = [c for c in docs.columns if c not in ("score", "predicted", text)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not scorers:
            scorers.append(shared.value.scorer())
        got = [scorers[0](t or "") for t in batch.column("_text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text"), pa.array(got, pa.float64())], names=["_row", "_text", "score"])

    base = docs.select(F.struct(*others).alias("_row"), F.col(text).cast("string").alias("_text"))
    out = map_texts(base, "_text", run, f"_row {base.schema['_row'].dataType.simpleString()}, _text string, score double")
    columns = [F.col("_text").alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("score", "predicted")]
    return out.select(*columns, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
