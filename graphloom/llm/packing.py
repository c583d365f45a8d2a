"""Packing token ids into rows of one length, best fit decreasing, with what a trainer needs to tell documents apart.

Every document is encoded whole. One that is longer than a row is split without loss: into full rows and a rest. Rows of
full pieces are done; the rests are packed, longest first, each into the open row with the least room that still takes
it. Rows by their room stand in a segment tree: the search for the best room is a walk of its height, whatever the
number of rows. Each document is packed within its group, a bounded number of tokens that one task holds at a time.

A row has its ids, padded to the row's length, the cumulative lengths of its segments (from 0 to what is filled) and
position ids that begin at 0 in every segment. Of each segment it keeps the document, and the offset in its tokens.

Defined results: null and empty texts have no tokens and take no place; rows that share a doc_id are packed each alone;
ids of equal lengths are packed in the order in which they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encoding import VOCABULARY, digest, encoder, vocabulary_of
from .tables import bare

#: Tokens of a row; tokens that are packed together; the id that fills up a row stands after the vocabulary's.
ROW, GROUP = 2048, 1 << 21


class Rooms:
    """A segment tree over the rooms 0 to `most`: how many open rows have each, and which is the least that fits."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, n: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The room and row of the open row with the least room of at least `least`; the row is open no more."""
        node, count = self.size + least, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not count[2 * node])
        room = node - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def packed(sizes: np.ndarray, row: int = ROW) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, offset, length) for documents of these sizes."""
    rows: list[list[tuple[int, int, int]]] = []
    rests = []
    for d, n in enumerate(sizes.tolist()):
        rows += [[(d, a, row)] for a in range(0, n - row + 1, row)]
        if n % row:
            rests.append((d, n - n % row, n % row))
    rests.sort(key=lambda x: -x[2])
    rooms = Rooms(row)
    for piece in rests:
        found = rooms.take(piece[2])
        if found is None:
            rows.append([piece])
            rooms.put(row - piece[2], len(rows) - 1)
        else:
            room, k = found
            rows[k].append(piece)
            if room > piece[2]:
                rooms.put(room - piece[2], k)
    return rows


_PACKED = "pack_sha256 string, n_tokens int, doc_ids array<long>, offsets array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"


def _packer(row: int, group: int, vocabulary: bytes):
    def flush(docs: list, ids: list[np.ndarray], pad: int) -> pa.RecordBatch:
        rows = packed(np.array([len(x) for x in ids], np.int64), row)
        matrix, places = np.full((len(rows), row), pad, "<i4"), np.zeros((len(rows), row), "<u2")
        count = np.arange(row, dtype="<u2")
        filled, owners, offsets, ends = [], [], [], []
        for k, pieces in enumerate(rows):
            at = 0
            for d, a, n in pieces:
                matrix[k, at : at + n] = ids[d][a : a + n]
                places[k, at : at + n] = count[:n]
                at += n
            filled.append(at)
            owners.append([docs[d] for d, _, _ in pieces])
            offsets.append([a for _, a, _ in pieces])
            ends.append(np.cumsum([0, *(n for _, _, n in pieces)]).tolist())
        columns = [
            pa.array([digest(matrix[k, : filled[k]]) for k in range(len(rows))], pa.string()),
            pa.array(filled, pa.int32()),
            pa.array(owners, pa.list_(pa.int64())),
            pa.array(offsets, pa.list_(pa.int32())),
            pa.array(ends, pa.list_(pa.int32())),
            pa.array([matrix[k].tobytes() for k in range(len(rows))], pa.binary()),
            pa.array([places[k].tobytes() for k in range(len(rows))], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["pack_sha256", "n_tokens", "doc_ids", "offsets", "cu_seqlens", "input_ids", "position_ids"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        docs, ids, total = [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    got = bpe.encode(text)
                    if len(got):
                        docs.append(doc)
                        ids.append(got)
                        total += len(got)
                    if total >= group:
                        yield flush(docs, ids, bpe.end)
                        docs, ids, total = [], [], 0
        if ids:
            yield flush(docs, ids, bpe.end)

    return of


def packs(docs: DataFrame, row: int = ROW, group: int = GROUP, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pack_sha256, n_tokens, doc_ids, offsets, cu_seqlens, input_ids, position_ids) for every packed row.

    input_ids are little-endian 32-bit ids, `row` of them, position_ids as many little-endian 16-bit numbers that begin
    at 0 anew in every segment; what is past n_tokens is padding, with positions of 0.
    """
    if not 1 < row <= 1 << 16:
        raise ValueError("a row has 2 to 65,536 tokens")
    return bare(docs, doc_id=id_col, text=text_col).mapInArrow(_packer(row, group, vocabulary_of(vocabulary)), _PACKED)


def written(rows: DataFrame, path: str) -> None:
    """The packed rows as Parquet: one binary row of the id matrix and of its positions each, beside its segments."""
    rows.write.mode("overwrite").parquet(path)
