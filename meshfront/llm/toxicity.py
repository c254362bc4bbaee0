"""Toxicity by non-negative positive-unlabelled learning.

A linear model in numpy learns from confirmed toxic texts and from unlabelled ones, which are documents drawn by hash whatever their label, or without any. Its
risk is that of Kiryo et al.: with class prior p, the positive part ``p * R+`` plus the negative part ``max(0, Ru- - p * Rp-)``; where the negative part falls below
zero its gradient is turned, which keeps the model from memorizing the positives. Features are the set of lower-case words and of their stems (first
STEMS letters), hashed; a document's score is the logistic function of the sum of the weights of its features, so one pass with a per-word cache scores whole texts.

Documents that are held out teach nothing. Up to MAX_POSITIVE toxic documents and MAX_UNLABELLED documents of the table, the first by hash, are drawn; one row stands for an
id. The class prior is the toxic share among the labels; no other use is made of a label 0. If every label is toxic there is no share, and ``prior`` (PRIOR by default) is taken. The bias is set so that
a score of 0.7 is the cut of the best F1, which positives and unlabelled texts give without negatives: ``2 p r / (p + q)``, where r is the part of the positives and q that of the unlabelled texts
above the cut. Margins for it come from FOLDS models, each of which hasn't seen the documents it scores.

Defined cases: null and empty texts, and those without a letter, score as the empty set of features. Very long texts are read whole. Repeated rows and ties score alike. Without any toxic label every score
is 0. An empty table gives no rows. Null ids are scored and never held out nor learned from. Only id and text are read; other columns are dropped or, in reject_toxic(), kept whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshfront.llm.common import crc_of_id

MAX_POSITIVE, MAX_UNLABELLED, PRIOR, FOLDS = 3000, 12_000, 0.1, 3
SIZE = 1 << 18
STEMS = (3, 4, 5, 6)
CUT = 0.7
CACHED = 400_000
_WORDS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashed features of one word: itself and its stems."""
    return [zlib.crc32(("=" + word).encode()) % SIZE, *(zlib.crc32((f"{n}" + word[:n]).encode()) % SIZE for n in STEMS if len(word) >= n)]


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def document_features(text: str | None) -> np.ndarray:
    out: set[int] = set()
    for w in words_of(text):
        out.update(features(w))
    return np.fromiter(sorted(out), np.int64, len(out))


class Model:
    """weights and bias; ``score`` of a text's features."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def margin(self, active: np.ndarray) -> float:
        return float(self.weights[active].sum() + self.bias)


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of margins of positive and unlabelled texts, and the step direction for each margin: the risk's gradient, or the turned one of its negative part where that is below zero."""
    loss = lambda z: np.logaddexp(0, -z)
    slope = lambda z: -1 / (1 + np.exp(np.clip(z, -50, 50)))
    n_p, n_u = max(len(z_p), 1), max(len(z_u), 1)
    positive, negative = prior * loss(z_p).sum() / n_p, loss(-z_u).sum() / n_u - prior * loss(-z_p).sum() / n_p
    of_p, of_u = prior * slope(-z_p) / n_p, -slope(-z_u) / n_u
    if negative < 0:
        return float(positive), -of_p, -of_u
    return float(positive + negative), prior * slope(z_p) / n_p + of_p, of_u


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 30, batch: int = 256, rate: float = 0.1, decay: float = 2e-3, seed: int = 7) -> Model:
    """Minimize the non-negative risk with the logistic loss by AdaGrad over mixed batches."""
    if not positive:
        return Model(np.zeros(SIZE), -50.0)
    # Only features that occur in several positives and more often there than chance and the mix at large explain can speak for the class.
    freq_p, freq_u = np.zeros(SIZE), np.zeros(SIZE)
    for freq, part in ((freq_p, positive), (freq_u, unlabelled)):
        for x in part:
            freq[x] += 1  # a text has each of its features once
    lift = ((freq_p + 0.5) / (len(positive) + 1)) / ((freq_u + 0.5) / (len(unlabelled) + 1))
    chance = (freq_u + 0.5) / (len(unlabelled) + 1) * len(positive)
    useful = np.flatnonzero((freq_p >= 3) & (lift > 2) & (freq_p - chance > 4 * np.sqrt(chance)))
    place = np.full(SIZE, -1)
    place[useful] = np.arange(len(useful))
    rows = [[own[own >= 0] for own in (place[x] for x in part)] for part in (positive, unlabelled)]
    weights, bias, size = np.zeros(len(useful)), 0.0, len(useful)
    rng, squares, square_b = np.random.default_rng(seed), np.full(size, 1e-6), 1e-6
    steps = max(1, -(-max(map(len, rows)) // batch))

    def flat(part: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        picked = [part[i] for i in at]
        return np.repeat(np.arange(len(at)), [len(x) for x in picked]), np.concatenate([*picked, np.zeros(0, np.int64)])

    for _ in range(epochs):
        orders = [np.resize(rng.permutation(len(part)), steps * batch).reshape(steps, batch) if part else np.zeros((steps, 0), np.int64) for part in rows]
        for at_p, at_u in zip(*orders, strict=True):
            (own_p, f_p), (own_u, f_u) = flat(rows[0], at_p), flat(rows[1], at_u)
            z_p, z_u = (np.bincount(own, weights[f], n) + bias for own, f, n in ((own_p, f_p, len(at_p)), (own_u, f_u, len(at_u))))
            _, g_p, g_u = risk(z_p, z_u, prior)
            grad = np.bincount(f_p, g_p[own_p], size) + np.bincount(f_u, g_u[own_u], size) + decay * weights
            squares += grad**2
            weights -= rate * grad / np.sqrt(squares)
            g_b = g_p.sum() + g_u.sum()
            square_b += g_b**2
            bias -= rate * g_b / np.sqrt(square_b)
    out = np.zeros(SIZE)
    out[useful] = weights
    return Model(out, bias)


def best_cut(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> float:
    """The margin that parts texts with the highest F1 as positives and unlabelled texts show it, in the middle of the gap between positives there."""
    ranked = np.unique(z_p)[::-1]
    recall = 1 - np.searchsorted(np.sort(z_p), ranked) / len(z_p)
    taken = 1 - np.searchsorted(np.sort(z_u), ranked) / max(len(z_u), 1) if len(z_u) else recall * prior
    f1 = 2 * prior * recall / (prior + np.maximum(taken, prior * recall))  # no more than what is taken can be toxic
    k = int(np.argmax(f1))
    below = np.concatenate([z_p[z_p < ranked[k]], z_u[z_u < ranked[k]]])
    return float((ranked[k] + (below.max() if len(below) else ranked[k] - 1)) / 2)


def fitted(positive: dict, unlabelled: dict, prior: float, cut: float = CUT) -> Model:
    """A model of texts' features by document id, whose bias makes ``cut`` the best cut of margins that models of other documents give."""
    fold = lambda k: zlib.crc32(str(k).encode()) // 3 % FOLDS
    z = ([], [])
    for i in range(FOLDS):
        part = train(*([x for k, x in own.items() if fold(k) != i] for own in (positive, unlabelled)), prior)
        for own, out in zip((positive, unlabelled), z, strict=True):
            out += [part.margin(x) for k, x in own.items() if fold(k) == i]
    whole = train(list(positive.values()), list(unlabelled.values()), prior)
    if not positive:
        return whole
    return Model(whole.weights, whole.bias - best_cut(*map(np.array, z), prior) + float(np.log(cut / (1 - cut))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(False))


def _features_frame(rows: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([document_features(t.as_py()).astype(np.int32).tobytes() for t in batch.column(3)], pa.binary())], ["id", "toxic", "drawn", "features"])

    return rows.select("id", "toxic", "drawn", "text").mapInArrow(run, f"id {kind}, toxic boolean, drawn boolean, features binary")


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model:
    """Train on documents that ``labels`` confirms as toxic and on a draw of all documents, none of them held out."""
    learnt = lambda c: F.col(c).isNotNull() & ~held_out(F.col(c))
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).where(learnt("id") & F.col("label").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    share = known.agg(F.avg("label").alias("p"), F.count("*").alias("n")).first()
    if not share.n or not share.p:
        return train([], [], 0.0)
    prior = prior if prior is not None else share.p if share.p < 1 else PRIOR
    order = F.xxhash64("id", F.lit("toxicity"))
    ids = docs.select(F.col("doc_id").alias("id")).where(learnt("id"))
    toxic = known.where("label = 1").orderBy(order, "id").limit(max_positive).select("id", F.lit(True).alias("toxic"), F.lit(False).alias("drawn"))
    drawn = ids.distinct().orderBy(order, "id").limit(max_unlabelled).select("id", F.lit(False).alias("toxic"), F.lit(True).alias("drawn"))
    picked = toxic.unionAll(drawn).groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("drawn").alias("drawn"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), "id")  # as many ids as the two bounds allow
    # One row an id, so that repeated ids don't exceed the bounds.
    found = _features_frame(texts, docs.schema["doc_id"].dataType.simpleString()).groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("drawn").alias("drawn"), F.min("features").alias("features")).orderBy("id").toArrow()
    parts = {"toxic": {}, "drawn": {}}
    for k, f, *of in zip(*(found.column(c) for c in ("id", "features", "toxic", "drawn")), strict=True):
        for part, own in zip(parts, of, strict=True):
            if own.as_py():
                parts[part][k.as_py()] = np.frombuffer(f.as_py(), np.int32)
    del found
    return fitted(parts["toxic"], parts["drawn"], prior)


def _scored(model: Model):
    nonzero = np.flatnonzero(model.weights)
    table = dict(zip(nonzero.tolist(), model.weights[nonzero].tolist(), strict=True))
    bias = model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}

        def active(word: str) -> tuple:
            if (hit := known.get(word)) is None:
                if len(known) >= CACHED:
                    known.clear()
                hit = known[word] = tuple(f for f in features(word) if f in table)
            return hit

        for batch in batches:
            scores = []
            for t in batch.column(1):
                own: set[int] = set()
                for w in words_of(t.as_py()):
                    if a := active(w):
                        own.update(a)
                z = sum(table[f] for f in sorted(own)) + bias
                scores.append(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't predict to be toxic, with all their columns."""
    run = _scored(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["doc_id", "text"])
            scores = next(run(iter([texts]))).column(1).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(scores < CUT))

    at = docs.columns.index("text")
    return docs.mapInArrow(keep, docs.schema)
