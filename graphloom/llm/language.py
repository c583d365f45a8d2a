"""Language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: for each length n of byte n-grams, the number of
n-grams that occur in both, divided by the root of the product of how many each has; lengths count alike. Kernel ridge
regression, one language against the rest, is solved on the Nyström features of a few landmark texts. A batch of texts
becomes one 0/1 matrix of n-grams; its kernel against the landmarks, and the scores, are matrix products.

n-grams are those that the sample of training texts has most often; a text's other n-grams take no part. Whole texts
are read. Fitting takes a bounded sample, `documents` for each language.

Defined results: a null text, and one without any letter, is `und` with score 0; so is every text if nothing can be
learned; rows without a language or a text aren't learned from. The score is a softmax of the languages' outputs.
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

#: Documents of each language that are learned from, landmarks of each, the most languages.
DOCUMENTS, LANDMARKS, LANGUAGES = 400, 32, 200
#: Lengths of n-grams and how many of each are kept.
GRAMS = {1: 256, 2: 2048, 3: 4096}
RIDGE, SHARPNESS, SLOTS = 0.1, 6.0, 1 << 22
#: Texts of a matrix.
ROWS = 256
UNKNOWN = "und"


class Model(NamedTuple):
    """columns[n]: the column of each slot of n-grams (the last column collects what isn't kept)."""

    languages: list[str]
    columns: dict[int, np.ndarray]
    landmarks: np.ndarray
    weights: np.ndarray


def _slots(data: np.ndarray, offsets: np.ndarray, n: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slot and text of every n-gram that lies inside one text, `most` places of the data at a time."""
    for a in range(0, len(data) - n + 1, most):
        b = min(a + most, len(data) - n + 1)
        code = np.zeros(b - a, np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | data[a + k : b + k]
        if n > 2:
            code = (code * np.uint32(2654435761)) >> np.uint32(10)
        low, high = np.searchsorted(offsets, [a, b - 1], "right") - 1
        row = np.repeat(np.arange(low, high + 1), np.diff(np.clip(offsets[low : high + 2], a, b)))
        inside = np.arange(a + n, b + n) <= offsets[row + 1]
        yield code[inside].astype(np.int64), row[inside]


def _presence(t: K.Texts, columns: dict[int, np.ndarray]) -> np.ndarray:
    """A row for each text: for each n, its kept n-grams as ones, divided by the root of their number."""
    data, parts = K.LOWER[t.data], []
    for n, column in columns.items():
        part = np.zeros((len(t.offsets) - 1, GRAMS[n] + 1), np.float32)
        for slot, row in _slots(data, t.offsets, n):
            part.ravel()[row * (GRAMS[n] + 1) + column[slot]] = 1
        part = part[:, :-1]
        parts.append(part / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1)))
    return np.concatenate(parts, axis=1) / np.sqrt(len(columns))


def _seen(t: K.Texts, n: int) -> np.ndarray:
    """In how many texts each slot of n-grams occurs, a few texts at a time."""
    out, rows = np.zeros(256**n if n < 3 else SLOTS, np.int64), len(t.offsets) - 1
    for a in range(0, rows, 32):
        part = _cut(t, a, min(a + 32, rows))
        keys = [np.unique(slot * 32 + row) for slot, row in _slots(K.LOWER[part.data], part.offsets, n)]
        if keys:
            out += np.bincount(np.unique(np.concatenate(keys)) // 32, minlength=len(out))
    return out


def _cut(t: K.Texts, first: int, last: int) -> K.Texts:
    at = t.offsets[first : last + 1]
    return K.Texts(t.data[at[0] : at[-1]], at - at[0])


def fitted(texts: list[str], languages: list[str], landmarks: int = LANDMARKS) -> Model | None:
    """The model of these texts; None if there are none."""
    pairs = [(x, y) for x, y in zip(texts, languages, strict=True) if x and y is not None]
    if not pairs:
        return None
    names = sorted({y for _, y in pairs})
    t = K.texts(pa.array([x for x, _ in pairs], pa.string()))
    columns = {}
    for n, most in GRAMS.items():
        seen = _seen(t, n)
        best = np.argsort(-seen, kind="stable")[:most]
        best = best[seen[best] > 0]
        columns[n] = np.full(len(seen), most, np.int32)
        columns[n][best] = np.arange(len(best))
    x = np.concatenate([_presence(_cut(t, a, min(a + ROWS, len(pairs))), columns) for a in range(0, len(pairs), ROWS)])
    y = np.array([names.index(lang) for _, lang in pairs])
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(names))])
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = (x @ marks.T).astype(float) @ root
    # languages weigh alike, however many texts of each there are
    weigh = 1 / np.bincount(y)[y]
    goal = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = (features * weigh[:, None]).T @ features + RIDGE * 1e-2 * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, (features * weigh[:, None]).T @ goal)
    return Model(names, columns, marks, (root @ solved).astype(np.float32))


def predicted(model: Model, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The place of each text's language, and its score."""
    best, score = [], []
    for a in range(0, len(t.offsets) - 1, ROWS):
        out = _presence(_cut(t, a, min(a + ROWS, len(t.offsets) - 1)), model.columns) @ model.landmarks.T @ model.weights
        e = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)).astype(float))
        best.append(out.argmax(axis=1))
        score.append(1 / e.sum(axis=1))
    return np.concatenate(best), np.concatenate(score)


_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True


def has_letter(t: K.Texts) -> np.ndarray:
    """Whether each text has a letter of any script."""
    n = len(t.offsets) - 1
    out = np.zeros(n, bool)
    at = np.flatnonzero(_ALPHA[t.data])
    out[np.searchsorted(t.offsets, at, "right") - 1] = True
    for i in np.flatnonzero(~out & (np.diff(t.offsets) > 0)).tolist():
        raw = t.data[t.offsets[i] : t.offsets[i + 1]]
        if (raw >= 0x80).any():
            out[i] = any(c.isalpha() for c in raw.tobytes().decode(errors="replace"))
    return out


def _predictor(model: Model | None):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in K.chunks(batches, "text"):
            names, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if model is not None and len(t.data):
                best, sure = predicted(model, t)
                some = has_letter(t)
                names[some] = np.array(model.languages, object)[best[some]]
                score[some] = sure[some]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return of


def learned(rows: DataFrame, documents: int = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from at most `documents` rows of each language; the rows say which may be learned from."""
    known = bare(rows, doc_id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null and text <> ''")
    chosen = sampled(known, "lang", documents, LANGUAGES)
    return fitted([r["text"] for r in chosen], [r["lang"] for r in chosen])


def identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    return bare(docs, doc_id=id_col, text=text_col).mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double")
