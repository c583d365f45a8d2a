"""Token counts of fields and sections by attributing the tokens of documents that are encoded once, as a whole.

A document is its fields, joined by a separator. Encoding fields or sections alone would give other tokens at their
edges, and other sums. Here the whole is encoded once; each token's character span follows from its length, and the
sorted spans are merged with the sorted sections of the document: an interval join. A token that crosses an edge is
allocated by an explicit rule:

- "first": to the section that has its first byte;
- "most": to the section that has most of its bytes, the earlier one if two have as many;
- "share": to all that it touches, in proportion to its bytes there.

In each case a document's counts sum to its number of tokens, whichever rule is taken. A section ends with the line
break that follows it, unless other edges are given; a separator belongs to the field before it.

Defined results: a null field is empty and keeps its place; a document without text has no token, and a section (field)
of 0 tokens for each empty field; an edge inside a character can't be, as sections begin at line breaks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import VOCABULARY, digest, encoder, vocabulary_of
from .tables import bare

RULES = ("first", "most", "share")
SEPARATOR = "\n\n"

_ATTRIBUTED = "doc_id long, n_tokens long, n_crossing long, ids_sha256 string, sections array<struct<field:string,start:int,end:int,tokens:double>>"


def allocated(edges: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross an edge. Section i is edges[i] to edges[i + 1], tokens are
    [begin, end); all in bytes and sorted, the sections without gaps. Empty sections get nothing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    out = np.zeros(len(edges) - 1)
    if not len(begin):
        return out, 0
    first = np.searchsorted(edges, begin, "right") - 1
    last = np.searchsorted(edges, end - 1, "right") - 1
    inside = first == last
    out += np.bincount(first[inside], minlength=len(out))
    for k in np.flatnonzero(~inside).tolist():
        parts = np.arange(first[k], last[k] + 1)
        size = np.minimum(edges[parts + 1], end[k]) - np.maximum(edges[parts], begin[k])
        if rule == "first":
            out[first[k]] += 1
        elif rule == "most":
            out[parts[size.argmax()]] += 1
        else:
            out[parts] += size / size.sum()
    return out, int((~inside).sum())


def _attributor(fields: Sequence[str], rule: str, lines: bool, vocabulary: bytes):
    kind = pa.list_(pa.struct([("field", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                columns = [part.column(f"field_{k}").to_pylist() for k in range(len(fields))]
                rows = []
                for values in zip(*columns, strict=True):
                    raw = [((v or "") + (SEPARATOR if k < len(fields) - 1 else "")).encode() for k, v in enumerate(values)]
                    whole = b"".join(raw)
                    ids = bpe.encode(whole.decode())
                    end = np.cumsum(bpe.bytes_of[ids])
                    edges, names, at = [0], [], 0
                    for name, piece in zip(fields, raw, strict=True):
                        cut = np.flatnonzero(np.frombuffer(piece, np.uint8) == 10) + 1 if lines else np.zeros(0, np.int64)
                        stops = [at + c for c in cut.tolist() if c < len(piece)] + [at + len(piece)]
                        edges += stops
                        names += [name] * len(stops)
                        at += len(piece)
                    edges = np.array(edges, np.int64)
                    tokens, crossing = allocated(edges, end - bpe.bytes_of[ids], end, rule)
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80, dtype=np.int32)])[edges]
                    rows.append((len(ids), crossing, digest(ids), [{"field": f, "start": s, "end": e, "tokens": n} for f, s, e, n in zip(names, points[:-1].tolist(), points[1:].tolist(), tokens.tolist(), strict=True)]))
                n, crossing, sha, sections = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(crossing, pa.int64()), pa.array(sha, pa.string()), pa.array(sections, kind)], names=["doc_id", "n_tokens", "n_crossing", "ids_sha256", "sections"])

    return of


def token_counts(docs: DataFrame, fields: Sequence[str] = ("text",), rule: str = "first", lines: bool = True, vocabulary: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_crossing, ids_sha256, sections) for every row; a section is (field, start, end, tokens).

    lines: a field's lines are its sections; else each field is one. start and end are code points of the joined fields.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    rows = bare(docs, doc_id=id_col, **{f"field_{k}": c for k, c in enumerate(fields)})
    return rows.mapInArrow(_attributor(list(fields), rule, lines, vocabulary_of(vocabulary)), _ATTRIBUTED)


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_empty, n_crossing, largest_section, section_tokens, ids_sha256): section_tokens
    lists the counts in order."""
    counts = F.transform("sections", lambda s: s["tokens"])
    return found.select(
        "doc_id",
        "n_tokens",
        F.size("sections").cast("long").alias("n_sections"),
        F.size(F.filter("sections", lambda s: s["tokens"] == 0)).cast("long").alias("n_empty"),
        "n_crossing",
        F.array_max(counts).cast("long").alias("largest_section"),
        F.transform(counts, lambda n: n.cast("long")).alias("section_tokens"),
        "ids_sha256",
    )
