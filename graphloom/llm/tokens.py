"""Words of whole texts as numpy arrays, without a Python object per word.

An Arrow string column is one byte buffer with offsets. Every function here works on such a buffer: a table of 256
flags says which bytes are word bytes (bytes of 0x80 and above belong to multi-byte characters, so a class of ASCII
characters never splits one), and a word gets a 64-bit hash that depends on each byte and its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 21

U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers without visible pattern."""
    return mixed((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


#: A number for each place in a stretch of 64 bytes and byte; each further stretch of a word has a factor of its own.
PLACES = stream(64 * 256, 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_all = np.ones(256, bool)
#: `[^\x20\x09-\x0D]+`
SPACED = _all.copy()
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
LETTERED = _all.copy()
LETTERED[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


class Texts(NamedTuple):
    """Texts as one buffer: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """One entry for each word in reading order; `doc` is the text's place in the chunk."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    per_doc: np.ndarray


def texts(column: pa.Array) -> Texts:
    """The column's buffer; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with about `limit` bytes of text each, whole texts only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = texts(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(whole.offsets, whole.offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            at = whole.offsets[first : last + 1]
            yield batch.slice(first, last - first), Texts(whole.data[at[0] : at[-1]], at - at[0])
            first = last


def spans(t: Texts, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each maximal run of member bytes; a run ends with its text."""
    inside = members[t.data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = t.offsets[(t.offsets > 0) & (t.offsets < len(t.data))]
    begins[edge] |= inside[edge]
    closes[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(t.offsets, start, "right") - 1


def _sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    value = PLACES[((place & 63) << 8) | data[place + np.repeat(start, size)]]
    if size.max() > 64:
        value *= _stretches(int(size.max() - 1 >> 6) + 1)[place >> 6]
    return np.add.reduceat(value, first)


def _stretches(n: int, first: int = 0) -> np.ndarray:
    """An odd number for each stretch of 64 bytes, without pattern, 1 for a word's first."""
    out = mixed((np.arange(first, first + n, dtype=U64) + U64(7 << 32)) * U64(0x9E3779B97F4A7C15)) | U64(1)
    if not first:
        out[:1] = 1
    return out


def sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Over the bytes of each span a sum of numbers that depend on byte and place; no span is empty. CHUNK bytes are
    worked on at a time, however long a span is."""
    size = end - start
    out = np.zeros(len(start), U64)
    upto = np.cumsum(size)
    a = 0
    while a < len(start):
        b = int(np.searchsorted(upto, (upto[a] - size[a]) + CHUNK, "right"))
        if b > a:
            out[a:b] = _sums(data, start[a:b], end[a:b])
            a = b
        else:
            for at in range(int(start[a]), int(end[a]), CHUNK):
                part = data[at : min(at + CHUNK, int(end[a]))]
                place = np.arange(len(part), dtype=np.int64)
                value = PLACES[((place & 63) << 8) | part] * _stretches((len(part) + 63) >> 6, (at - int(start[a])) >> 6)[place >> 6]
                out[a : a + 1] += value.sum(dtype=U64)
            a += 1
    return out


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, none of which is empty."""
    return mixed(sums(data, start, end)) if len(start) else np.zeros(0, U64)


def words(t: Texts, members: np.ndarray, lower: bool = True) -> Words:
    """The words of each text: maximal runs of member bytes, A-Z lower-cased first if asked."""
    data = LOWER[t.data] if lower else t.data
    start, end, doc = spans(Texts(data, t.offsets), members)
    return Words(doc, start, end, hashed(data, start, end), np.bincount(doc, minlength=len(t.offsets) - 1))


def hash_of(word: str) -> int:
    """The hash that `words` gives this word, which must be in lower case already."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hashed(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])
