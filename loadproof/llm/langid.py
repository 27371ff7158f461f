"""Language identification of words by a linear-chain conditional random field.

Each word's score for a language adds up weights of its features: the word itself (lexicon),
prefixes and suffixes of one to three characters, and character runs of two and three. Learned
transitions tie neighbours together, and forward-backward gives each word of a text, code-switched
or not, its probability for each language. A document's prediction is the language with the
largest share of its words' probability.

Trained with numpy on a bounded sample of documents for each language. Sequences for training are
cut from the sample and spliced, half of them from several languages, so that switches are learned.
Scoring runs over whole texts: words are laid in blocks, the blocks' transfer matrices are chained
within each document, and all blocks are then filled in at once, which is exact.

Defined results: null texts and texts without letters (numerals of any kind are none) give `und` with score 0; without a single
document to learn from every text gives `und`; ties go to the first language in order; repeated
rows give repeated results; null ids are scored and never learned from; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadproof.llm.common import fold, small_batches, table

HELD_OUT, OF = 2, 4
#: Bounds of the sample: documents a language, segments a document, words a segment, segments a sequence.
DOCS, SEGMENTS, WORDS, SPLICED = 300, 8, 12, 3
BUCKETS, LOCAL_WORDS, STEP, SALTS = 1 << 17, 200_000, 64, 64

#: Characters that Python counts to words, but that are numbers: fractions, powers, Roman numerals.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl"))
_WORD = re.compile(r"[^\W\d_]+")


def _lowered(text: str | None) -> str:
    """The text in lower case, with a space for each numeral, so that places stay."""
    low = (text or "").lower()
    if not low.isascii():
        # in the pattern, each of so many characters would be tried for each character of the text
        for c in _NUMBERS.intersection(set(low)):
            low = low.replace(c, " ")
    return low


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(_lowered(text))


def features(word: str) -> list[int]:
    """Buckets of the word's lexicon, affix and n-gram features."""
    marked = f"^{word}$"
    names = ["w" + word, *("p" + word[:n] for n in (1, 2, 3)), *("s" + word[-n:] for n in (1, 2, 3)), *(marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1))]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names]


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows = [features(w) for w in words]
    return np.array([f for r in rows for f in r], np.int64), np.cumsum([0, *map(len, rows)])


class Crf:
    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.labels, self.weights, self.moves, self.start = labels, weights, moves, start

    def scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        flat, ends = _flat(words)
        return np.add.reduceat(self.weights[flat], ends[:-1], axis=0)

    def marginals(self, docs: list[np.ndarray], emit: np.ndarray) -> list[np.ndarray]:
        """Each word's label probabilities; docs hold rows of emit, none is empty."""
        k, sizes = len(self.labels), np.array([len(d) for d in docs])
        blocks = -(-sizes // STEP)
        first = np.concatenate([[0], np.cumsum(blocks)])
        n, at = int(first[-1]), np.full((int(first[-1]), STEP), -1)
        flat = np.concatenate(docs)
        doc = np.repeat(np.arange(len(docs)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at[first[doc] + place // STEP, place % STEP] = flat
        e = np.exp(emit - emit.max(1, keepdims=True))
        move, start = np.exp(self.moves - self.moves.max()), np.exp(self.start - self.start.max())
        opens = np.zeros(n, bool)
        opens[first[:-1]] = True
        # transfer matrices of the blocks
        whole = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        for t in range(STEP):
            live = at[:, t] >= 0
            if t == 0:
                whole = move[None] * e[at[:, 0]][:, None, :]
                whole[opens] = np.broadcast_to((start * e[at[opens, 0]])[:, None, :], (int(opens.sum()), k, k))
            else:
                rows = np.flatnonzero(live)
                whole[rows] = (whole[rows].reshape(-1, k) @ move).reshape(-1, k, k) * e[at[rows, t]][:, None, :]
            if t % 8 == 7:
                whole /= whole.sum((1, 2), keepdims=True)
        whole /= whole.sum((1, 2), keepdims=True)
        # states at the blocks' edges, chained within each document
        before, after = np.full((n, k), 1 / k), np.ones((n, k))
        for step in range(1, int(blocks.max())):
            b = first[:-1][blocks > step] + step
            v = np.einsum("bi,bij->bj", before[b - 1], whole[b - 1])
            before[b] = v / v.sum(1, keepdims=True)
            b = first[1:][blocks > step] - 1 - step
            v = np.einsum("bij,bj->bi", whole[b + 1], after[b + 1])
            after[b] = v / v.sum(1, keepdims=True)
        # all blocks at once
        ahead, out = np.zeros((STEP, n, k)), np.zeros((STEP, n, k))
        a = before
        for t in range(STEP):
            live = at[:, t] >= 0
            new = (a @ move) * e[at[:, t]]
            if t == 0:
                new[opens] = start * e[at[opens, 0]]
            new /= new.sum(1, keepdims=True)
            a = np.where(live[:, None], new, a)
            ahead[t] = a
        b = after
        for t in range(STEP - 1, -1, -1):
            live = at[:, t] >= 0
            g = ahead[t] * b
            out[t] = g / g.sum(1, keepdims=True)
            new = (e[at[:, t]] * b) @ move.T
            b = np.where(live[:, None], new / new.sum(1, keepdims=True), b)
        got = out.transpose(1, 0, 2)[first[doc] + place // STEP, place % STEP]
        return np.split(got, np.cumsum(sizes)[:-1])

    def label(self, texts: list[str | None], cache: dict[str, int], rows: list[np.ndarray]) -> list[np.ndarray]:
        """Each text's words' probabilities, one array a text; cache and rows keep words' scores between calls."""
        split = [words_of(t) for t in texts]
        if len(cache) > LOCAL_WORDS:
            cache.clear()
            rows.clear()
        new = list(dict.fromkeys(w for s in split for w in s if w not in cache))
        base = len(cache)
        cache.update((w, base + i) for i, w in enumerate(new))
        if new:
            rows.append(self.scores(new))
        emit = np.concatenate(rows) if rows else np.zeros((0, len(self.labels)))
        rows[:] = [emit]
        some = [i for i, s in enumerate(split) if s]
        out = [np.zeros((0, len(self.labels)))] * len(texts)
        if some:
            for i, m in zip(some, self.marginals([np.fromiter(map(cache.__getitem__, split[i]), np.int64, len(split[i])) for i in some], emit), strict=True):
                out[i] = m
        return out


def spliced(segments: list[tuple[str, list[str]]]) -> list[list[tuple[str, str]]]:
    """Training sequences of (word, label): in turn from one language and from whatever comes next."""
    rng = np.random.Generator(np.random.PCG64(11))
    mixed = [segments[i] for i in rng.permutation(len(segments))]
    half = len(mixed) // 2
    order = mixed[:half] + sorted(mixed[half:], key=lambda s: s[0])
    runs = [order[i : i + SPLICED] for i in range(0, len(order), SPLICED)]
    return [[(w, lang) for lang, ws in run for w in ws] for run in runs]


def train(sequences: list[list[tuple[str, str]]], epochs: int = 40, rate: float = 0.1, decay: float = 1e-3) -> Crf | None:
    """Maximum likelihood with a Gaussian prior, by Adam over all sequences at once."""
    sequences = [s for s in sequences if s]
    if not sequences:
        return None
    labels = sorted({y for s in sequences for _, y in s})
    vocabulary = sorted({w for s in sequences for w, _ in s})
    number, code, k = {w: i for i, w in enumerate(vocabulary)}, {y: i for i, y in enumerate(labels)}, len(labels)
    flat, ends = _flat(vocabulary)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(ends))
    n, size = len(sequences), max(map(len, sequences))
    x, y = np.zeros((size, n), np.int64), np.full((size, n), -1)
    for j, s in enumerate(sequences):
        for t, (w, lang) in enumerate(s):
            x[t, j], y[t, j] = number[w], code[lang]
    live = y >= 0
    total = int(live.sum())
    w, moves, start = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
    used, back = np.unique(flat, return_inverse=True)
    params = [np.zeros((len(used), k)), moves, start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    truth = np.zeros((len(vocabulary), k))
    np.add.at(truth, (x[live], y[live]), 1)
    true_moves, pair = np.zeros((k, k)), live[1:] & live[:-1]
    np.add.at(true_moves, (y[:-1][pair], y[1:][pair]), 1)
    true_start = np.bincount(y[0], minlength=k).astype(float)
    for epoch in range(1, epochs + 1):
        v, moves, start = params
        emit = np.add.reduceat(v[back], ends[:-1], axis=0)
        e, move = np.exp(emit - emit.max(1, keepdims=True)), np.exp(moves - moves.max())
        ahead = np.zeros((size, n, k))
        for t in range(size):
            a = np.exp(start - start.max()) * e[x[0]] if t == 0 else (ahead[t - 1] @ move) * e[x[t]]
            a = a / a.sum(1, keepdims=True)
            ahead[t] = a if t == 0 else np.where(live[t][:, None], a, ahead[t - 1])
        want, want_moves = np.zeros((len(vocabulary), k)), np.zeros((k, k))
        b = np.ones((n, k))
        for t in range(size - 1, -1, -1):
            g = ahead[t] * b
            g /= g.sum(1, keepdims=True)
            rows = live[t]
            np.add.at(want, x[t][rows], g[rows])
            back_ = e[x[t]] * b
            if t:
                joint = ahead[t - 1][:, :, None] * move[None] * back_[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                want_moves += joint[rows].sum(0)
                new = back_ @ move.T
                b = np.where(rows[:, None], new / new.sum(1, keepdims=True), b)
            else:
                want_start = g.sum(0)
        word = want - truth
        grads = [np.zeros((len(used), k)), (want_moves - true_moves) / total, (want_start - true_start) / total]
        for c in range(k):
            grads[0][:, c] = np.bincount(back, word[owner, c], len(used)) / total
        for i, g in enumerate(grads):
            g = g + decay / total * params[i] * n
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**epoch)) / (np.sqrt(second[i] / (1 - 0.99**epoch)) + 1e-9)
    w[used] = params[0]
    return Crf(labels, w.astype(np.float32), params[1], params[2])


def segments_of(lang: str, text: str | None) -> list[tuple[str, list[str]]]:
    """Segments at even distances over the whole text."""
    words = words_of(text)
    starts = sorted({int(x) for x in np.linspace(0, max(0, len(words) - WORDS), SEGMENTS)})
    return [(lang, words[s : s + WORDS]) for s in starts if words]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS) -> Crf | None:
    """The model learned from documents outside the held-out fold, at most so many for each language."""
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).withColumn("h", F.xxhash64("text"))
    learn = every.select("id", "lang", "h").where((fold("id", OF) != HELD_OUT) & F.col("lang").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)))
    # the first by hash of each salted part, then the first of those: a language that most documents have is no single group
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("id"), "id", "h"))
    part = learn.withColumn("r", place("lang", "salt")).where(F.col("r") <= per_language)
    chosen = part.withColumn("r", place("lang")).where(F.col("r") <= per_language).select("id", "lang", "h").distinct()
    # at most per_language rows for each language, so the side may be sent to all; repeated rows count once
    rows = every.join(F.broadcast(chosen), ["id", "lang", "h"]).groupBy("id", "lang", "h").agg(F.min("text").alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, s) for i, lang, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) for s in segments_of(lang, text)]
            yield pa.RecordBatch.from_arrays([pa.array([f[1][0] for f in found], pa.string()), pa.array([f[1][1] for f in found], pa.list_(pa.string()))], names=["lang", "words"])

    got = rows.select("id", "lang", "text").mapInArrow(run, "lang string, words array<string>").toArrow()
    segments = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    return train(spliced(segments))


def predict(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache, rows = held.value, {}, []
        for batch in batches:
            texts, langs, scores = batch.column(1).to_pylist(), [], []
            for i in range(0, len(texts), 250):
                for p in m.label(texts[i : i + 250], cache, rows) if m else [np.zeros((0, 1))] * len(texts[i : i + 250]):
                    share = p.mean(0) if len(p) else None
                    langs.append("und" if share is None else m.labels[int(share.argmax())])
                    scores.append(0.0 if share is None else float(min(share.max(), 1.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def label_words(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and its words in order, each with start, label and probability."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache, rows = held.value, {}, []
        for batch in batches:
            texts = list(map(_lowered, batch.column(1).to_pylist()))
            found = [
                [{"start": w.start(), "word": w[0], "lang": m.labels[int(q.argmax())], "p": float(q.max())} for w, q in zip(_WORD.finditer(t), p, strict=True)]
                for t, p in zip(texts, m.label(texts, cache, rows), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "words"])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, words array<struct<start:int,word:string,lang:string,p:double>>").withColumnRenamed("id", id_col)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", OF) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
