"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled part is a sample of all documents of the
labels' table, whose labels it doesn't use, so that the prior, their share of toxic ones, is the sample's own. A linear model over words and character runs is trained with numpy on the
risk  pi * R+(P) + max(0, R-(U) - pi * R-(P))  (class prior pi), whose inner term is kept from
going below zero: where it does, the step goes up that term's gradient instead.

Both samples are of labelled rows, bounded by parameters, and taken by the hash of the id. Their features
are counted in Spark, and only those that the model keeps come to the driver. Scoring reads every
whole text; words of any length give their character runs. Labels are read from documents outside the held-out fold alone.

Defined results: null and empty texts get the score of a text without features; without any
positive label every score is 0; repeated rows give repeated results; null ids are
scored, never held out and never learned from; an id with several texts gives one of them, by hash, to
learn from; an id with several labels is toxic if one says so; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadproof.llm.common import filter_texts, fold, small_batches, stored, table

#: Bounds of the two samples that the classifier is fitted on.
POSITIVES, UNLABELLED = 4_000, 12_000
#: Features kept, those most typical of the positives first; buckets that feature names hash to.
FEATURES, BUCKETS = 4_096, 1 << 22
LOCAL_WORDS = 150_000
#: Longer words are scored like all others, but not remembered.
CACHED_CHARS = 60
HELD_OUT = 5

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """The word and its runs of five characters, ends marked, as hash buckets."""
    marked = f"^{word}$"
    names = {marked, *(marked[i : i + 5] for i in range(len(marked) - 4))}
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names]


def features(text: str | None) -> set[int]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def scores(self, texts: list[str | None], seen: dict[str, tuple[int, ...]]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            found: set[int] = set()
            for word in set(_WORD.findall((text or "").lower())):
                if (kept := seen.get(word)) is None:
                    kept = tuple(f for f in word_features(word) if f in self.weights)
                    if len(word) <= CACHED_CHARS:
                        if len(seen) >= LOCAL_WORDS:
                            seen.clear()
                        seen[word] = kept
                if kept:
                    found.update(kept)
            if found:
                out[i] += sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def chosen_features(names: np.ndarray, n_pos: np.ndarray, n_un: np.ndarray, positives: int, unlabelled: int) -> np.ndarray:
    """The features most typical of the positives, ascending, from how many documents of either sample have each."""
    # log-likelihood gain of the positives' own rate, to beat what the best of so many would reach by chance
    expected = np.maximum(n_un / unlabelled, 1 / unlabelled) * positives
    lift = np.where(n_pos > expected, n_pos * np.log(n_pos / expected) - n_pos + expected, 0)
    return np.sort(names[np.lexsort((names, -lift))[:FEATURES]][: int((lift > np.log(max(len(names), 1))).sum())])


Sample = tuple[np.ndarray, np.ndarray, int]


def risk(w: np.ndarray, p: Sample, u: Sample, prior: float) -> tuple[float, np.ndarray, float, np.ndarray]:
    """pi * R+(P) and R-(U) - pi * R-(P) under the logistic loss, each with its gradient; the last weight is the bias.

    A sample is its features' columns, the rows that these are in, and the number of rows.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    soft = lambda z: np.logaddexp(0, z)
    z = lambda s: np.bincount(s[1], w[s[0]], s[2]) + w[-1]
    slope = lambda s, d: np.append(np.bincount(s[0], d[s[1]], len(w) - 1), d.sum())
    z_p, z_u = z(p), z(u)
    inner = soft(z_u).mean() - prior * soft(z_p).mean()
    g_inner = slope(u, sigmoid(z_u) / u[2]) - slope(p, prior * sigmoid(z_p) / p[2])
    return prior * soft(-z_p).mean(), slope(p, -prior * sigmoid(-z_p) / p[2]), inner, g_inner


def minimise(kept: np.ndarray, p: Sample, u: Sample, prior: float, epochs: int = 300, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0, gamma: float = 1.0) -> Model:
    """Adam on the non-negative risk."""
    if not len(kept):
        return Model(float(np.log(prior / (1 - prior))), {})
    w = np.zeros(len(kept) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        _, g_pos, inner, g_inner = risk(w, p, u, prior)
        g = g_pos + g_inner if inner >= -beta else -gamma * g_inner
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(float(w[-1]), dict(zip(kept.tolist(), w[:-1].tolist(), strict=True)))


def columns(kept: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents' features, laid end to end, those kept, as column numbers, and how many each document has."""
    at = np.minimum(np.searchsorted(kept, flat), max(len(kept) - 1, 0))
    hit = kept[at] == flat if len(kept) else np.zeros(len(flat), bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return at[hit].astype(np.int32), np.bincount(owner[hit], minlength=len(sizes))


def _sample(cols: np.ndarray, sizes: np.ndarray) -> Sample:
    return cols, np.repeat(np.arange(len(sizes)), sizes), len(sizes)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """The model of two lists of documents, each an array of its distinct feature buckets."""
    if not positive or not unlabelled:
        return Model(-40.0, {})
    lay = lambda rows: (np.concatenate([np.empty(0, np.int32), *rows]), np.array([len(r) for r in rows]))
    p, u = lay(positive), lay(unlabelled)
    count = lambda flat: np.bincount(flat, minlength=BUCKETS)
    n_pos, n_un = count(p[0]), count(u[0])
    names = np.flatnonzero(n_pos).astype(np.int32)
    kept = chosen_features(names, n_pos[names], n_un[names], len(positive), len(unlabelled))
    return minimise(kept, _sample(*columns(kept, *p)), _sample(*columns(kept, *u)), prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """The model learned from labelled documents outside the held-out fold; prior: by default the labels' own share, which is that of both samples' source."""
    spark = docs.sparkSession
    small_batches(spark)
    key = F.col(f"`{id_col}`").cast("long")
    every = docs.select(key.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where((fold("id", HELD_OUT) != 0) & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    known = known.join(every.select("id").distinct(), "id", "left_semi")
    if prior is None:
        prior = known.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0] or 0.0
    prior = float(np.clip(prior, 1e-4, 0.9))
    some = lambda df, n, p: df.select("id").orderBy(F.xxhash64("id"), "id").limit(n).withColumn("p", F.lit(p))
    chosen = some(known.where("y = 1"), positives, 1).unionByName(some(known, unlabelled, 0))
    # at most positives + unlabelled ids, so this side may be sent to all; an id that repeats gives one text
    picked = every.join(F.broadcast(chosen), "id").groupBy("id", "p").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted(features(t)), np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "p", "f"])

    rows = stored(picked.mapInArrow(run, "id long, p int, f array<int>"))
    n_p, n_u = (rows.where(f"p = {p}").count() for p in (1, 0))
    if not n_p or not n_u:
        return Model(-40.0, {})
    n = lambda p: F.count(F.when(F.col("p") == p, 1))
    # at most BUCKETS rows
    got = rows.select("p", F.explode("f").alias("f")).groupBy("f").agg(n(1).alias("n_pos"), n(0).alias("n_un")).where("n_pos > 0").toArrow()
    kept = chosen_features(*(got.column(c).to_numpy() for c in range(3)), n_p, n_u)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(2)
            cols, sizes = columns(kept, f.flatten().to_numpy(), np.diff(f.offsets.to_numpy()))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(cols, pa.int32()))], names=["id", "p", "f"])

    own = rows.mapInArrow(cut, "id long, p int, f array<int>").toArrow().sort_by("id").combine_chunks()  # the same sums in any order of rows
    both = [own.filter(pa.compute.equal(own.column("p"), p)).column("f") for p in (1, 0)]
    return minimise(kept, *(_sample(f.combine_chunks().flatten().to_numpy(), pa.compute.list_value_length(f).to_numpy()) for f in both), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            s = held.value.scores(batch.column(1).to_pylist(), seen)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text isn't predicted toxic, all columns kept; scored in the row, without a join."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def start():
        seen: dict[str, tuple[int, ...]] = {}
        return lambda texts: (held.value.scores(texts, seen) < 0.5).tolist()

    return filter_texts(docs, text_col, start)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", HELD_OUT) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
