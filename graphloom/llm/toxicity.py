"""Toxicity by multiple-instance learning: a text is a bag of sentences, and only texts have labels.

A sentence's score is a logistic function of the weights of its words and of their first bytes; a text is toxic unless
none of its sentences is, so its score is the noisy-or of theirs. The weights are trained through that combination from
document labels, by full-batch gradient steps on a bounded sample, and then locate the sentences that give offence.
Scoring is a pass over whole texts in arrays; nothing is shuffled.

Defined results: null and empty texts have no sentence and score 0; with no labels, or labels of one class only, every
score is 0 or 1 accordingly; a document with several labels counts as toxic if one says so; null labels are no labels;
of several rows with a labelled id one is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .sampling import sampled
from .tables import bare

#: The most labelled documents that are learned from, by label; weights; lengths in bytes of the word beginnings.
DOCUMENTS, WEIGHTS, BEGINNINGS = {0: 4500, 1: 1500}, 1 << 18, (4, 5, 6, 7)
#: Fewest toxic documents in which a feature must occur to get a weight.
SUPPORT = 4
STEPS, RATE, DECAY = 80, 0.2, 2e-4

_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    constant: float | None


class Bags(NamedTuple):
    """Features of each word, sentence of each word, text of each sentence, and the words' and texts' places."""

    features: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bags(t: K.Texts) -> Bags:
    data = K.LOWER[t.data]
    start, end, doc = K.spans(K.Texts(data, t.offsets), K.LETTERED)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Bags(np.zeros((1 + len(BEGINNINGS), 0), np.int64), none, none, none, none)
    rows = [K.hashed(data, start, end)]
    for k in BEGINNINGS:
        rows.append(K.mixed(K.sums(data, start, np.minimum(end, start + k)) + K.U64(k)))
    features = np.stack(rows) >> K.U64(46)
    turn = np.searchsorted(np.flatnonzero(_ENDS[data]), start)
    new = np.concatenate([[True], (turn[1:] != turn[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    return Bags(features.astype(np.int64), np.cumsum(new) - 1, doc[at], start[at], np.append(end[at[1:] - 1], end[-1]))


def _sliced(texts: list[str | None], slice_: int = 200) -> Iterator[tuple[int, Bags]]:
    """The bags of some texts at a time, with the place of the first; slices without words are left out."""
    for first in range(0, len(texts), slice_):
        t = K.texts(pa.array(texts[first : first + slice_], pa.string()))
        b = bags(t) if len(t.data) else None
        if b is not None and len(b.doc):
            yield first, b


def trained(texts: list[str | None], labels: list[int]) -> Model:
    """Weights that maximise the likelihood of the labels under the noisy-or of sentence scores, with weight decay."""
    y = np.asarray(labels, float)
    weights = np.zeros(WEIGHTS, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(weights, 0.0, float(y[0]) if len(y) else 0.0)
    # a slice of the texts at a time: first which features are of use, then only their occurrences
    seen, every = np.zeros(WEIGHTS), np.zeros(WEIGHTS)
    for first, b in _sliced(texts):
        doc, n = b.doc[b.sentence], len(texts) - first
        key = np.unique(np.concatenate([f * n + doc for f in b.features]))
        seen += np.bincount(key // n, weights=y[first + key % n], minlength=WEIGHTS)
        every += np.bincount(key // n, minlength=WEIGHTS)
    plain = every - seen
    useful = (seen >= min(SUPPORT, y.sum())) & (seen / y.sum() > 1.5 * plain / (len(y) - y.sum()))
    place = np.cumsum(useful) - 1
    columns, sentences, docs, before = [], [], [], 0
    for first, b in _sliced(texts):
        for feature in b.features:
            keep = useful[feature]
            columns.append(place[feature[keep]].astype(np.int32))
            sentences.append((before + b.sentence[keep]).astype(np.int32))
        docs.append(first + b.doc)
        before += len(b.doc)
    if not before:
        return Model(weights, 0.0, 0.0)
    column, sentence, doc = np.concatenate(columns), np.concatenate(sentences), np.concatenate(docs)
    del columns, sentences, docs
    w, bias = np.zeros(max(int(useful.sum()), 1)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    # documents without words, as those that are empty, say nothing
    alive = np.bincount(doc, minlength=len(y)) > 0
    # toxic documents are few: they weigh up to three times as much
    worth = np.where(y > 0, np.clip(np.sqrt((len(y) - y.sum()) / y.sum()), 1, 3), 1.0) * alive / len(y)
    for step in range(1, STEPS + 1):
        z = np.clip(bias + np.bincount(sentence, weights=w[column], minlength=len(doc)), -30, 30)
        total = np.maximum(np.bincount(doc, weights=np.log1p(np.exp(z)), minlength=len(y)), 1e-9)
        pull = np.where(y > 0, -1 / np.expm1(total), 1.0) * worth
        by_sentence = pull[doc] / (1 + np.exp(-z))
        g = np.bincount(column, weights=by_sentence[sentence], minlength=len(w)) + DECAY * w
        gb = by_sentence.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w -= RATE * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        bias -= RATE * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    weights[useful] = w[: int(useful.sum())]
    return Model(weights, float(bias), None)


def scores(model: Model, t: K.Texts) -> tuple[np.ndarray, Bags | None, np.ndarray]:
    """Each text's score; its sentences, and their scores."""
    n = len(t.offsets) - 1
    if model.constant is not None or not len(t.data):
        return np.full(n, model.constant or 0.0), None, np.zeros(0)
    b = bags(t)
    if not len(b.doc):
        return np.zeros(n), None, np.zeros(0)
    by_word = model.weights[b.features].sum(axis=0, dtype=np.float64)
    z = np.clip(model.bias + np.bincount(b.sentence, weights=by_word, minlength=len(b.doc)), -30, 30)
    return -np.expm1(-np.bincount(b.doc, weights=np.log1p(np.exp(z)), minlength=n)), b, 1 / (1 + np.exp(-z))


_SCORED = "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>"


def _scorer(model: Model, offence: float):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in K.chunks(batches, "text"):
            score, b, by_sentence = scores(model, t)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if b is not None:
                bad = np.flatnonzero(by_sentence >= offence)
                if len(bad):
                    points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80, dtype=np.int32)])
                    base = points[t.offsets[b.doc[bad]]]
                    for d, s, e, p in zip(b.doc[bad].tolist(), (points[b.start[bad]] - base).tolist(), (points[b.end[bad]] - base).tolist(), by_sentence[bad].tolist(), strict=True):
                        found[d].append({"start": s, "end": e, "score": p})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score), pa.array(found, kind)], names=["doc_id", "score", "sentences"])

    return of


def _learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: one row, the model of the rows (toxic, text) that come."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("toxic").to_pylist()
    model = trained(texts, labels)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64()), pa.array([model.constant], pa.float64())], names=["weights", "bias", "constant"])


def learned(docs: DataFrame, labels: DataFrame, documents: dict[int, int] = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most `documents` labelled documents of each label; the labels' ids say which to learn from.

    A task learns it: the driver sees ids and weights, but no text.
    """
    known = bare(labels, doc_id=id_col, toxic=label_col).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = sampled(known, "toxic", documents, 2)
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "id long, toxic int"))
    # of rows that share an id one is learned from, the one whose text has the least hash
    rows = bare(docs, doc_id=id_col, text=text_col).join(ids, F.col("doc_id") == F.col("id"))
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.coalesce(1).sortWithinPartitions("doc_id").select("toxic", "text")
    model = rows.mapInArrow(_learner, "weights binary, bias double, constant double").first()
    return Model(np.frombuffer(model["weights"], np.float32), model["bias"], model["constant"]) if model else trained([], [])


def scored(docs: DataFrame, model: Model, offence: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, sentences) for every row; sentences: the code points of those that score `offence` or more."""
    return bare(docs, doc_id=id_col, text=text_col).mapInArrow(_scorer(model, offence), _SCORED)


def keeper(model: Model, below: float = 0.5, text_col: str = "text"):
    """For mapInArrow: the rows whose text scores under `below`, with all their columns."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in K.chunks(batches, text_col):
            yield batch.filter(pa.array(scores(model, t)[0] < below))

    return of
