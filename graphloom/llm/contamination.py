"""Benchmark decontamination by a positional inverted index of the training documents.

`indexed` stores the postings of all words of all documents, and `found_in` looks test items up in that table, for any
number of item tables and window lengths. The index is cut by documents into segments, as search engines do: a segment
has the postings of a few megabytes of text, for each term the sorted positions of its occurrences. A search reads the
positions with a gap between documents, so no match crosses from one into the next.

A test window is looked up from its rarest term, by the terms' counts over all documents: its positions, moved by the
term's place in the window, are the possible starts; they are intersected with the moved list of the next rarer term,
and so on through all terms. Windows that miss a term in a segment stop at once. The windows of a segment are searched
together, in arrays, so many at a time that their rarest terms occur OCCURRENCES times.

Windows are made and told apart in tables. They travel to the executors WINDOWS at a time; more of them are searched in
parts, each a pass over the index alone, and the parts' hits are united by row. Terms are 64-bit hashes of words.

Defined results: null and empty texts have no words, and a row; items without words have no window, shorter items than
a window are one; an item_id of null is left out of the listed items, though its windows hit; rows that share a doc_id
are judged each alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K
from .tables import bare, saved, scratch

#: Words of a window.
LENGTH = 10
#: The most windows that are searched at once, 80 bytes each, and the most occurrences of rarest terms, some 50 bytes each.
WINDOWS, OCCURRENCES = 500_000, 1 << 20

# postings are bytes: as arrays they would go through the executors' memory number by number, several times their size
_SEGMENT = "rows array<long>, doc_ids array<long>, n_words array<int>, terms binary, counts binary, gaps binary"
_FOUND = "row long, hits array<long>, windows array<long>"


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _listed(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values, pa.int64()))


def _packed(values: np.ndarray) -> pa.Array:
    """One row of bytes, all values' first bytes before all second ones, which compresses well."""
    return pa.array([values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()], pa.binary())


def _unpacked(column: pa.Array, i: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(column[i].as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, t in K.chunks(batches, "text"):
        n_words, terms, counts, gaps = np.zeros(batch.num_rows, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(t.data):
            w = K.words(t, K.LETTERED)
            n_words = w.per_doc
            if len(w.hash):
                # a word's place in the segment is its position
                at = np.argsort(w.hash, kind="stable")
                term = w.hash[at]
                first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                gaps = np.diff(at, prepend=0)
                gaps[first] = at[first]
                terms, counts = term[first], np.diff(np.append(first, len(term)))
        yield pa.RecordBatch.from_arrays(
            [_one(batch.column("row")), _one(batch.column("doc_id").cast(pa.int64())), _one(pa.array(n_words, pa.int32())), *map(_packed, (terms, counts.astype(np.int32), gaps.astype(np.int32)))],
            names=["rows", "doc_ids", "n_words", "terms", "counts", "gaps"],
        )


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The written index of all documents, a row for each segment. `row_col` names a unique, written key of the rows;
    else each row gets a number, which is kept with the index."""
    source = bare(docs, doc_id=id_col, text=text_col, **({"row": row_col} if row_col else {}))
    if row_col is None:
        source = source.withColumn("row", F.monotonically_increasing_id())
    # a page of the file ends with the row that fills it, however large rows are
    return saved(source.mapInArrow(_segments, _SEGMENT), "postings", **{"parquet.page.size.row.check.min": "1"})


class Windows(NamedTuple):
    """Distinct windows: terms as places in `vocabulary` (-1 past a shorter window's end)."""

    vocabulary: np.ndarray
    terms: np.ndarray
    size: np.ndarray
    ids: np.ndarray


def _windowed(length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in K.chunks(batches, "text"):
            if not len(t.data):
                continue
            w = K.words(t, K.LETTERED)
            first = np.cumsum(w.per_doc) - w.per_doc
            for item, a, n in zip(batch.column("item").to_pylist(), first.tolist(), w.per_doc.tolist(), strict=True):
                if not n:
                    continue
                rows = np.lib.stride_tricks.sliding_window_view(w.hash[a : a + n], min(n, length)).view(np.int64)
                for k in range(0, len(rows), 50_000):
                    part = np.ascontiguousarray(rows[k : k + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), _listed(part.ravel(), np.full(len(part), part.shape[1]))], names=["item", "terms"])

    return of


def _windows(rows: pa.Table, length: int) -> Windows:
    column = rows.column("terms").combine_chunks()
    flat, size = column.flatten().to_numpy().view(np.uint64), column.value_lengths().to_numpy().astype(np.int64)
    vocabulary, place = np.unique(flat, return_inverse=True)
    terms = np.full((len(size), length), -1, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    terms[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = place
    return Windows(vocabulary, terms, size, rows.column("window").to_numpy())


class Segment(NamedTuple):
    """Postings as one sorted array of term << 32 | position; the list of term t is keys[lists[t]:lists[t + 1]]."""

    rows: np.ndarray
    n_words: np.ndarray
    base: np.ndarray
    keys: np.ndarray
    lists: np.ndarray

    def has(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each term stands at its position."""
        wanted = (terms << 32) | at
        found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[found] == wanted) & (at >= 0)


def _opened(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, gap: int) -> Iterator[Segment]:
    """The segments that have a term of the vocabulary, with these terms' postings."""
    for batch in batches:
        for i in range(batch.num_rows):
            terms = _unpacked(batch.column("terms"), i, np.uint64)
            place = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
            ours = vocabulary[place] == terms
            if not ours.any():
                continue
            counts, gaps = (_unpacked(batch.column(c), i, np.int32).astype(np.int64) for c in ("counts", "gaps"))
            n_words = batch.column("n_words")[i].values.to_numpy().astype(np.int64)
            at, first = np.cumsum(gaps), np.cumsum(counts) - counts
            at = (at - np.repeat(at[first] - gaps[first], counts))[np.repeat(ours, counts)]
            place, counts = place[ours], counts[ours]
            # words without gaps between the documents until here
            at += (np.searchsorted(np.cumsum(n_words), at, "right") + 1) * gap
            lists = np.zeros(len(vocabulary) + 1, np.int64)
            lists[place + 1] = counts
            base = np.cumsum(n_words) - n_words + (np.arange(len(n_words)) + 1) * gap
            yield Segment(batch.column("rows")[i].values.to_numpy(), n_words, base, (np.repeat(place, counts) << 32) | at, np.cumsum(lists))


def _rarest(s: Segment, w: Windows, order: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, position of its rarest term) for all windows whose terms the segment has, about `most` at a time."""
    here = np.diff(s.lists)
    window = np.flatnonzero(np.where(w.terms >= 0, here[w.terms], 1).min(axis=1, initial=1) > 0)
    anchor = w.terms[window, order[window, 0]]
    size = here[anchor]
    upto, a = np.cumsum(size), 0
    while a < len(window):
        b = max(int(np.searchsorted(upto, (upto[a] - size[a]) + most, "right")), a + 1)
        n = size[a:b]
        at = np.repeat(s.lists[anchor[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield np.repeat(window[a:b], n), s.keys[at] & 0xFFFFFFFF
        a = b


def _phrases(s: Segment, w: Windows, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of every occurrence; order: each window's offsets from the rarest term on."""
    for window, start in _rarest(s, w, order, OCCURRENCES):
        start = start - order[window, 0]
        for k in range(1, w.terms.shape[1]):
            if not len(window):
                break
            offset = order[window, k]
            term = w.terms[window, offset]
            ok = (term < 0) | s.has(np.maximum(term, 0), start + offset)
            window, start = window[ok], start[ok]
        yield window, start


def _nearby(s: Segment, w: Windows, order: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of every stretch of `span` words, beginning at one of them, that has all the window's terms."""
    for window, rare in _rarest(s, w, order, max(1, OCCURRENCES // span)):
        start = (rare[:, None] - np.arange(span)).ravel()
        window = np.repeat(window, span)
        begins = np.zeros(len(start), bool)
        for k in range(w.terms.shape[1]):
            if not len(window):
                break
            term = w.terms[window, order[window, k]]
            next_at = np.searchsorted(s.keys, (np.maximum(term, 0) << 32) | np.maximum(start, 0))
            found = s.keys[np.minimum(next_at, len(s.keys) - 1)]
            ok = (term < 0) | ((found >> 32 == term) & ((found & 0xFFFFFFFF) < start + span) & (next_at < len(s.keys)))
            begins |= (term >= 0) & ok & ((found & 0xFFFFFFFF) == start)
            window, start, begins = window[ok], start[ok], begins[ok]
        yield window[begins], start[begins]


def _search(w: Windows, gap: int, frequency: np.ndarray, span: int | None):
    rarity = np.where(w.terms >= 0, frequency[w.terms], np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _opened(batches, w.vocabulary, gap):
            parts = list(_phrases(s, w, order) if span is None else _nearby(s, w, order, span))
            window, start = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
            if not len(window):
                continue
            doc = np.searchsorted(s.base, start, "right") - 1
            long = w.size[window] if span is None else np.full(len(window), span)
            edge = np.zeros(int(s.base[-1] + s.n_words[-1]) + gap + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, np.minimum(start + long, (s.base + s.n_words)[doc]), -1)
            place = np.flatnonzero(np.cumsum(edge) > 0)
            owner = np.searchsorted(s.base, place, "right") - 1
            pairs = np.unique(np.stack([doc, window], 1), axis=0)
            docs, n_windows = np.unique(pairs[:, 0], return_counts=True)
            n_hits = np.bincount(owner, minlength=len(s.base))[docs]
            yield pa.RecordBatch.from_arrays([pa.array(s.rows[docs], pa.int64()), _listed(place - s.base[owner], n_hits), _listed(w.ids[pairs[:, 1]], n_windows)], names=["row", "hits", "windows"])

    return of


def _totals(vocabulary: np.ndarray):
    """Each task's number of postings by term of the vocabulary."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, counts = _unpacked(batch.column("terms"), i, np.uint64), _unpacked(batch.column("counts"), i, np.int32)
                place = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
                ours = vocabulary[place] == terms
                total[place[ours]] += counts[ours]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    return of


def found_in(index: DataFrame, items: DataFrame, length: int = LENGTH, span: int | None = None, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, hits, items), written, for every document of the index: the places of words inside an
    occurrence, and the items whose windows occur, as sorted strings.

    A window occurs where its words stand as a phrase or, with `span`, where some `span` words have all of them in any
    order (proximity; the hits are then the words of that stretch).
    """
    if span is not None and span < length:
        raise ValueError("span must be at least the window's length")
    with scratch(index.sparkSession):
        return saved(_looked_up(index, bare(items, item=item_col, text=item_text_col), length, span), "matches", keep=True)


def _looked_up(index: DataFrame, asked: DataFrame, length: int, span: int | None) -> DataFrame:
    gap = max(length, span or 0) + 1
    asked = asked.select(F.col("item").cast("string").alias("item"), "text")
    made = saved(asked.mapInArrow(_windowed(length), "item string, terms array<long>"), "item-windows")
    distinct = saved(made.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    owners = saved(made.where("item is not null").join(distinct, "terms").select("window", "item").distinct(), "owners")
    n = distinct.count()
    parts = -(-n // WINDOWS)
    found = []
    for k in range(parts):
        w = _windows(distinct.where(F.pmod("window", F.lit(parts)) == k).toArrow(), length)
        if not len(w.size):
            continue
        counted = index.select("terms", "counts").mapInArrow(_totals(w.vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        frequency = np.zeros(len(w.vocabulary), np.int64)
        frequency[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
        found.append(saved(index.mapInArrow(_search(w, gap, frequency, span), _FOUND), "found"))
    docs = index.select(F.explode(F.arrays_zip("rows", "doc_ids", "n_words")).alias("d")).select(F.col("d.rows").alias("row"), F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))
    nothing = F.array().cast("array<long>"), F.array().cast("array<string>")
    if not found:
        return docs.select("*", nothing[0].alias("hits"), nothing[1].alias("items"))
    every = reduce(DataFrame.unionByName, found)
    hits = every.select("row", "hits") if parts == 1 else every.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    named = every.select("row", F.explode("windows").alias("window")).join(owners, "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = docs.join(hits, "row", "left").join(named, "row", "left")
    return out.select("row", "doc_id", "n_words", F.coalesce("hits", nothing[0]).alias("hits"), F.coalesce("items", nothing[1]).alias("items"))


def matches(docs: DataFrame, items: DataFrame, length: int = LENGTH, span: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """found_in for documents that are indexed for this search alone."""
    with scratch(docs.sparkSession):
        found = found_in(indexed(docs, id_col, text_col, row_col), items, length, span, item_col, item_text_col)
        return saved(found, "matches", keep=True)


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits, items) for every document; row is the key
    that `row_col` names, or a number."""
    return matches(docs, items, **options).select(
        "row",
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "hits",
        "items",
    )
