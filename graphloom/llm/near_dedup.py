"""Near-duplicate documents: MinHash bands propose, odd sketches check, full shingle sets confirm.

A document's set holds its distinct 5-word shingles. Two documents are linked when
100 * |intersection| >= percent * |union|; a group is what links connect.

1. One pass over the texts gives each document its set's size, a 128-bit print of the set, 32 band keys of 5 MinHash
   samples each, and an odd sketch: a bitmap in which every one of the 160 samples flips one bit. The XOR of two
   sketches has a population count from which a high similarity follows more precisely than from as many bits of
   MinHash values.
2. Documents with equal sets are one class; only its least id goes on. So copies are never paired.
3. Every member of a bucket (equal band key) is paired with the bucket's least id. Sketches drop pairs that aren't
   alike, full sets confirm the rest. What these links connect is contracted: a large group of near copies is settled
   here at a cost in proportion to its size.
4. Buckets that still hold several components are compared exhaustively by sketch, in blocks of bounded size, leaving
   out pairs within the bucket's largest component. A block gives a spanning forest, not its pairs; the forests connect
   clusters, and inside a cluster the full sets of all pairs from different components are intersected, again in blocks.
5. Where a bucket or cluster is wide, as that of pages made from one template is, its documents are instead compared if
   they share one of their rarest shingles, so few of them that linked sets can't do without. This is exact, too.

A pair at a threshold of 85 % meets in no band with a probability of 7e-9 (at 80 %, of 3e-6), and its sketches fail (an
estimate 0.17 under the threshold, five standard deviations below) with one of 6e-7. Nothing else is left to chance, and nothing is capped.

Defined results: a null or empty text, or one of separators only, has an empty set and is linked with nothing; a text
of one to four words has one shingle; rows that share a doc_id are judged each by its own text, and equal ones agree; a
null doc_id takes part in no link and keeps a null component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketches as S
from . import tokens as K
from .components import components
from .tables import bare, joined_by, saved, scratch

#: How far under the threshold an estimated similarity may lie if a pair's full sets are to be compared.
MARGIN = 0.17
#: Documents in a block where sketches, or full sets, of all pairs are compared; documents beyond the largest part up to
#: which all pairs of a bucket or cluster are.
SKETCHES, SETS, WIDE = 1024, 256, 4096

_FEATURES = "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>, sketch binary"


def _listed(values: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values, kind))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, t in K.chunks(batches, "text"):
        values, size = S.shingle_sets(K.words(t, K.SPACED)) if len(t.data) else (np.zeros(0, K.U64), np.zeros(batch.num_rows, np.int64))
        full = size > 0
        prints = np.zeros((2, len(size)), K.U64)
        bands, sketch = np.zeros((0, S.BANDS), K.U64), np.zeros((0, S.BITS // 8), np.uint8)
        if full.any():
            first = (np.cumsum(size) - size)[full]
            prints[0, full] = _print_a(values, first)
            prints[1, full] = np.add.reduceat(K.mixed(values ^ K.U64(0x5555555555555555)), first)
            minima = S.minhashes(values, size[full])
            bands, sketch = S.band_keys(minima), S.odd_sketches(minima)
        maps = iter(sketch)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(size, pa.int64()),
                pa.array(prints[0].view(np.int64)),
                pa.array(prints[1].view(np.int64)),
                _listed(bands.ravel().view(np.int64), np.where(full, S.BANDS, 0), pa.int64()),
                pa.array([next(maps).tobytes() if f else b"" for f in full], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "print_a", "print_b", "bands", "sketch"],
        )


def _print_a(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(K.mixed(values + K.U64(7)), first)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets of the texts that have the print asked for."""
    for batch, t in K.chunks(batches, "text"):
        if len(t.data):
            values, size = S.shingle_sets(K.words(t, K.SPACED))
            full = size > 0
            got = np.zeros(len(size), K.U64)
            got[full] = _print_a(values, (np.cumsum(size) - size)[full])
            asked = pa.array(full & (got.view(np.int64) == batch.column("print_a").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), _listed(values.view(np.int64), size, pa.int64())], names=["id", "members"]).filter(asked)


def _close(size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be linked at all."""
    return 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)


def _forest(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (left, right) of rows that connect what all the pairs connect, given each row's component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(int(nodes[i])), root(int(nodes[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _by_group(rows: DataFrame, keys: tuple[str, ...], work: Callable[[pa.RecordBatch], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) pairs that `work` finds in each group of rows; groups are dealt by their keys and come sorted, so that a
    task walks through many small ones without a call for each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        parts: list[pa.RecordBatch] = []
        now: tuple[int, ...] | None = None

        def closed() -> list[tuple[int, int]]:
            return work(parts[0] if len(parts) == 1 else pa.concat_batches(parts)) if parts else []

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], 1)
            turns = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for first, last in zip(turns, turns[1:], strict=False):
                if (this := tuple(key[first].tolist())) != now:
                    found += closed()
                    parts, now = [], this
                parts.append(batch.slice(first, last - first))
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        yield _pairs(found + closed())

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(of, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _sides(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's part, and the rows of the two sides; a block that meets itself is both."""
    side = group.column("side").to_numpy()
    return group.column("part").to_numpy(), np.flatnonzero(side == 0), np.flatnonzero(side == 1) if (side == 1).any() else np.arange(len(side))


def _tied(part: np.ndarray, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    kept = _forest(part, *np.array(edges, np.int64).reshape(-1, 2).T) if edges else []
    return [(int(part[i]), int(part[j])) for i, j in kept]


def _alike(percent: int):
    def of(group: pa.RecordBatch) -> list[tuple[int, int]]:
        """A spanning forest of the pairs of the two sides that sketches find likely."""
        part, rows, columns = _sides(group)
        n = group.column("n").to_numpy()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(n), -1)
        edges: list[tuple[int, int]] = []
        for i in rows.tolist():
            fits = columns[(part[columns] != part[i]) & _close(n[columns], n[i], percent)]
            if len(fits):
                bits = np.bitwise_count(sketch[fits] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                near = fits[S.estimated(bits) >= percent / 100 - MARGIN]
                edges += _forest(part, np.full(len(near), i), near)
        return _tied(part, edges)

    return of


def _confirmed(percent: int):
    def of(group: pa.RecordBatch) -> list[tuple[int, int]]:
        """A spanning forest of the pairs of the two sides whose full sets confirm a link."""
        part, rows, columns = _sides(group)
        members = group.column("members")
        flat, n = members.flatten().to_numpy(), members.value_lengths().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.argsort(flat, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]]))
        # the rows that hold each shingle, one after another; ends[k] to ends[k + 1] are those of shingle k
        holders, ends = owner[order], np.append(begins, len(flat))
        shingle = np.empty(len(flat), np.int64)
        shingle[order] = np.repeat(np.arange(len(begins)), np.diff(ends))
        first, edges = np.cumsum(n) - n, []
        for i in rows.tolist():
            mine = shingle[first[i] : first[i] + n[i]]
            size = ends[mine + 1] - ends[mine]
            at = np.repeat(ends[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            shared = np.bincount(holders[at], minlength=len(n))[columns]
            near = columns[(part[columns] != part[i]) & (100 * shared >= percent * (n[columns] + n[i] - shared))]
            edges += _forest(part, np.full(len(near), i), near)
        return _tied(part, edges)

    return of


def _dealt(rows: DataFrame, group: str, most: int) -> DataFrame:
    """The rows (group, id, part) of groups with several parts, written, each with the block it is in.

    The group's largest part is its core. Pairs within it aren't wanted, so core blocks meet only blocks of the rest: a
    group with one part makes no task, and one with a dominant part makes as many as the part has blocks. `wide` says
    that the rest is too large to be compared pair by pair.
    """
    parts = rows.groupBy(group, "part").agg(F.count("*").alias("k"))
    sums = parts.groupBy(group).agg(F.max(F.struct("k", "part")).alias("top"), F.sum("k").alias("all")).where("all > top.k")
    dims = sums.select(
        group,
        "all",
        F.col("top.part").alias("core"),
        F.ceil(F.col("top.k") / most).cast("int").alias("cores"),
        F.ceil((F.col("all") - F.col("top.k")) / most).cast("int").alias("rests"),
        (F.col("all") - F.col("top.k") > WIDE).alias("wide"),
    )
    dealt = joined_by(rows, saved(dims, "dims"), [group], "all").withColumn("is_core", F.col("part") == F.col("core"))
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("is_core"), F.col("cores")).otherwise(F.col("rests"))).cast("int")
    return saved(dealt.select(group, "id", "part", "cores", "rests", "wide", "is_core", mine.alias("mine")), "dealt")


def _blocks(dealt: DataFrame, group: str) -> DataFrame:
    """The rows dealt to tasks of two blocks at most, so that every pair of rows of different parts of a group meets."""
    # (x, y, side): rest block x against core block y (as -1 - y) or rest block y >= x
    tasks = F.when(F.col("is_core"), F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda x: F.struct(x.alias("x"), (-1 - F.col("mine")).alias("y"), F.lit(1).alias("side")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("cores") - 1), lambda y: F.struct(F.col("mine").alias("x"), (-1 - y).alias("y"), F.lit(0).alias("side"))),
            F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda y: F.struct(F.least(F.col("mine"), y).alias("x"), F.greatest(F.col("mine"), y).alias("y"), F.when(F.col("mine") <= y, 0).otherwise(1).alias("side"))),
        )
    )
    return dealt.withColumn("task", F.explode(tasks)).select(group, "task.x", "task.y", "task.side", "id", "part")


def _by_prefix(wide: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links among the documents (id, part) of wide groups, without meeting all of them: shingles are ordered from the
    rarest on, and two linked sets share one that is among the first of both, as many as either may lack and one more."""
    sets = saved(wide.join(members, "id"), "sets")
    counts = saved(sets.select(F.explode("members").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")), "counts")
    listed = joined_by(sets.select("id", "part", F.explode("members").alias("shingle")), counts, ["shingle"], "n")
    ordered = listed.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    first = F.slice("s", 1, F.size("s") - F.floor((percent * F.size("s") + 99) / 100).cast("int") + 1)
    prefix = saved(ordered.select("id", "part", F.explode(first).alias("s")).where("s.n > 1").select(F.col("s.shingle").alias("shingle"), "id", "part"), "prefix")
    return _by_group(_blocks(_dealt(prefix, "shingle", SETS), "shingle").join(members, "id"), ("shingle", "x", "y"), _confirmed(percent))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row, written; see the module's text for how and for odd cases."""
    with scratch(docs.sparkSession):
        return saved(_grouped(docs, percent, id_col, text_col), "near-duplicates", keep=True)


def _grouped(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    source = bare(docs, doc_id=id_col, text=text_col)
    features = saved(source.mapInArrow(_features, _FEATURES), "features")
    full = features.where("n_shingles > 0 and doc_id is not null")
    prints = ["print_a", "print_b"]
    classes = saved(full.groupBy(*prints).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    leaders = joined_by(full, classes, prints, "copies").where("doc_id = id").select("id", F.col("n_shingles").alias("n"), *prints, "sketch", "bands").dropDuplicates(["id", *prints])
    leaders = saved(leaders, "leaders")
    keyed = leaders.select("id", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("id").alias("hub")).where("k > 1").select("key", "hub")
    buckets = saved(keyed.join(saved(hubs, "hubs"), "key"), "buckets")

    # sets of all that share a bucket
    asked = leaders.select("id", "print_a").join(buckets.select("id").distinct(), "id")
    members = source.join(asked, F.col("doc_id") == F.col("id")).select("id", "print_a", "text")
    members = saved(members.mapInArrow(_sets, "id long, members array<long>"), "members")

    # pairs with the least of the bucket
    slim = leaders.select("id", "n", "sketch")
    stars = buckets.where("id <> hub").select("id", "hub").distinct().join(slim, "id").join(slim.select(F.col("id").alias("hub"), F.col("n").alias("m"), F.col("sketch").alias("other")), "hub")
    stars = stars.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).mapInArrow(_likely(percent), "id long, hub long")
    shared = F.size(F.array_intersect("members", "theirs"))
    tied = stars.join(members, "id").join(members.select(F.col("id").alias("hub"), F.col("members").alias("theirs")), "hub").where(100 * shared >= percent * (F.size("members") + F.size("theirs") - shared)).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    tied = saved(tied, "tied")
    first = components(tied)

    # what is left: buckets with several components
    def parts(rows: DataFrame) -> DataFrame:
        return rows.join(first, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")

    parted = saved(parts(buckets.select("key", "id")), "parted")
    dealt = _dealt(parted, "key", SKETCHES)
    likely = _by_group(_blocks(dealt.where("not wide"), "key").join(slim, "id"), ("key", "x", "y"), _alike(percent))
    clusters = components(likely).select(F.col("id").alias("part"), F.col("component").alias("cluster"))
    inside = saved(parts(leaders.select("id").distinct()).join(clusters, "part"), "inside")
    within = _dealt(inside.select("cluster", "id", "part"), "cluster", SETS)
    links = _by_group(_blocks(within.where("not wide"), "cluster").join(members, "id"), ("cluster", "x", "y"), _confirmed(percent))
    every = tied.unionByName(saved(links, "links"))
    wide = saved(dealt.where("wide").select("id", "part").unionByName(within.where("wide").select("id", "part")).distinct(), "wide")
    if not wide.isEmpty():
        every = every.unionByName(saved(_by_prefix(wide, members, percent), "more"))
    final = components(every)

    known = saved(classes.join(final, "id", "left").select(*prints, "copies", F.coalesce("component", "id").alias("component_id")), "known")
    grouped = joined_by(full.select("doc_id", "n_shingles", *prints), known, prints, "copies").select("doc_id", "n_shingles", "component_id")
    alone = features.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _likely(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch", "other"))
                keep = S.estimated(S.popcounts(a, b)) >= percent / 100 - MARGIN
                yield batch.select(["id", "hub"]).filter(pa.array(keep))

    return of
