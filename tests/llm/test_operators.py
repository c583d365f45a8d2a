"""The corpus operators against brute force, and their defined results for odd input."""

import collections
import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import contamination as C
from graphloom.llm import encoding, language, mixing, packing, personal, sharding, toxicity
from graphloom.llm import token_counts as TC
from graphloom.llm import tokens as K
from graphloom.llm.components import components
from graphloom.llm.exact_dedup import exact_duplicates
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.tables import joined_by, saved

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, part int, hash string, kept string, slot string, shard string, label string, row string, key string"
SPACED, LETTERED = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def made_texts(seed=1, n=60):
    r = random.Random(seed)
    words = ["The", "cat", "élan", "dog's", "x1", "naïve", "Straße", "ran", "on", "и", "ok.", "a-b"] + [f"w{k}" for k in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 5, 30, 80, 200]))) for _ in range(n)]
    for k in range(0, n, 3):
        copy = base[k].split(" ")
        for _ in range(r.choice([0, 1, 1, 2])):
            if len(copy) > 20:
                copy[r.randrange(len(copy))] = f"new{r.randrange(999)}"
        base.append(r.choice([str.upper, str, lambda s: s.replace(" ", "\n ")])(" ".join(copy)))
    return [*base, None, "", " \t\n", "ÀÉ", "one two three four", "one two three four", "very " * 30000 + "long", "no" * 40000]


def odd_rows(seed=1):
    texts = made_texts(seed)
    rows = [(k * 7 % 997, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, k, "x", 1, "h", "k", "s", "s", "l", "r", "y") for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[4], *rows[4][2:]), (None, None, *[None] * 13)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# words


@pytest.mark.parametrize(("table", "pattern"), [(K.SPACED, SPACED), (K.LETTERED, LETTERED)])
def test_words_are_those_of_the_pattern(table, pattern):
    texts = made_texts(5) + ["\x00a\x7fb\x0b", "é ü\x1fz", "A_B[c]`d{e}"]
    w = K.words(K.texts(pa.array(texts)), table)
    wanted = [re.findall(pattern, lower(t)) for t in texts]
    assert w.per_doc.tolist() == [len(x) for x in wanted]
    known = {}
    for word, h in zip([x for y in wanted for x in y], w.hash.tolist(), strict=True):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_chunks_keep_texts_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c"]})
    parts = [(b.num_rows, t.data.tobytes()) for b, t in K.chunks(iter([batch]), "text", 12)]
    assert sum(n for n, _ in parts) == 5 and b"".join(x for _, x in parts) == b"a" * 10 + b"b" * 50 + b"c"


# 1 mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [Fraction(375, 2), 75, Fraction(75, 2)]
    got = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and sum(got) == 2010 and got[1] == 2 * got[2]
    assert mixing.targets([0, 0], [1, 1]) == [0, 0] and mixing.targets([], []) == [] and mixing.targets([7], [5]) == [7]


def test_quotas_are_exact():
    shard, source, draws = mixing.split_quotas([1000, 10, 0, 333], 7, 3)
    assert np.bincount(source, draws, 4).tolist() == [1000, 10, 0, 333] and draws.min() > 0 and np.ptp(np.bincount(shard, draws)) <= 3
    assert sorted(zip(source, shard, strict=True)) == list(zip(source, shard, strict=True))
    assert all((a == b).all() for a, b in zip((shard, source, draws), mixing.split_quotas([1000, 10, 0, 333], 7, 3), strict=True))
    assert mixing.split_quotas([], 1, 3)[2].tolist() == []
    many = mixing.split_quotas([1] * 50_000, 800, 3)
    assert len(many[0]) == 50_000 and np.ptp(np.bincount(many[0])) <= 1


def test_mix(docs):
    mix = mixing.mixed(docs, block_docs=4, shard_blocks=2)
    got = mixing.words_taken(mix).collect()
    sizes = collections.Counter(len(re.findall(SPACED, r["text"] or "")) for r in docs.collect())
    assert collections.Counter(r["size"] for r in got) == sizes
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    wanted = mixing.targets([sum(r["size"] for r in by[s]) for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
    for s, target in zip(names, wanted, strict=True):
        assert abs(by[s][0]["target"] - target) < 1e-6 and abs(sum(r["taken"] for r in by[s]) - target) <= 1
    draws = mix.draws.collect()
    assert sum(r["words"] for r in draws) == sum(r["taken"] for r in got)
    for shard in {r["shard"] for r in draws}:
        assert sorted(r["position"] for r in draws if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in draws)))
    again = mixing.words_taken(mixing.mixed(docs, block_docs=4, shard_blocks=2))
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in again.collect()) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got)
    whole = mixing.mixed(docs, whole=True, block_docs=4)
    size = {r["row"]: r["size"] for r in whole.documents.collect()}
    assert all(r["words"] == size[r["row"]] for r in whole.draws.collect())


def test_mix_of_nothing(empty):
    assert mixing.words_taken(mixing.mixed(empty)).count() == 0


# 2 decontamination


def items_of(texts):
    r = random.Random(2)
    out = [(10, "the cat"), (11, None), (12, "..."), (None, "a b c d e f g h i j k"), (9, "nothing like this ever occurs in any of the texts here")]
    for k in range(20):
        words = re.findall(LETTERED, lower(r.choice(texts)))
        if words:
            a = r.randrange(len(words))
            out.append((100 + k, "; ".join(words[a : a + r.choice([1, 4, 10, 14])]).upper()))
    return out


def brute_hits(text, items):
    words = re.findall(LETTERED, lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(LETTERED, lower(t))
        for a in range(max(1, len(w) - 9) if w else 0):
            window = w[a : a + 10]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    found.discard("None")
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [500_000, 30])
def test_contamination(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(C, "WINDOWS", limit)
    texts = [r["text"] for r in docs.collect() if r["text"] and len(r["text"]) < 9999]
    items = items_of(texts)
    got = C.contamination(docs.where("length(text) < 9999 or text is null"), spark.createDataFrame(items, "item_id long, text string"))
    wanted = [(r["doc_id"], *brute_hits(r["text"], items)) for r in docs.collect() if len(r["text"] or "") < 9999]
    assert rows_of(got.drop("row", "hits", "items")) == sorted(wanted, key=repr)


@pytest.mark.parametrize("limit", [500_000, 2])
def test_rows_with_one_id_and_length_are_judged_alone(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "WINDOWS", limit)
    texts = ["x one two three y", "a b c d e", "x four five six y", None, "one two three four five"]
    rows = [(i, t) for i in (None, 7) for t in texts]
    items = [(1, "one two three"), (2, "four five six"), (3, "never said here"), (4, "nor this one either"), (5, "nor that other one")]
    made = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = [(i, *brute_hits(t, items)) for i, t in rows]
    assert rows_of(C.contamination(docs, made).drop("row", "hits", "items")) == sorted(wanted, key=repr)
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    got = C.contamination(keyed, made, row_col="key").where("contaminated").select("row")
    assert rows_of(got) == rows_of(keyed.where("text like '%one two three%' or text like '%four five six%'").select("key"))


def test_contamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert C.contamination(empty, none).count() == 0
    assert {r["contaminated"] for r in C.contamination(docs, none).collect()} == {False}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "b x a c"), (2, "a y y y y c b"), (3, "a b"), (4, "c b a c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    got = {r["doc_id"]: r["hits"] for r in C.matches(docs, items, length=3, span=4).collect()}
    assert got == {1: [0, 1, 2, 3], 2: [], 3: [], 4: [0, 1, 2, 3, 4, 5]}


# 3 language


def test_language(spark):
    r = random.Random(1)
    parts = {"aa": ["the", "thing", "oughly"], "bb": ["lich", "keit", "ung"], "cc": ["ción", "ñue", "dad"]}
    rows = [(k, " ".join(r.choice(parts[lang]) + r.choice(parts[lang]) for _ in range(r.randint(2, 30))), lang) for k, lang in enumerate(sorted(parts) * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", None), (902, "12 + 3 = 15!", "bb"), (903, "ñ", None), (904, "lich" * 50000, "bb")], "doc_id long, text string, lang string")
    model = language.learned(docs.where("doc_id % 5 <> 0"), documents=20)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.identified(docs, model).collect()}
    assert all(got[k][0] == lang for k, _, lang in rows) and got[904][0] == "bb"
    assert [got[k] for k in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903][0] == "cc"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.learned(docs.where("false")) is None
    assert {x["lang_pred"] for x in language.identified(docs, None).collect()} == {"und"}


# 4 toxicity


def test_toxicity(spark):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(300):
        sentences = [" ".join(r.choice(["a", "good", "calm", "day", "tree", "sea"]) for _ in range(6)) for _ in range(8)]
        bad = k % 3 == 0
        if bad:
            sentences[5] = f"you {r.choice(['rotten', 'rottenest'])} sea"
        rows.append((k, ". ".join(sentences)))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "?!"), (903, "good day " * 20000)], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.learned(docs, known.where("doc_id % 5 <> 0"))
    got = {x["doc_id"]: x for x in toxicity.scored(docs, model).collect()}
    assert all((got[k]["score"] >= 0.5) == (k % 3 == 0) for k in range(300))
    text = rows[0][1]
    assert [text[s["start"] : s["end"]].split(" ")[0] for s in got[0]["sentences"]] == ["you"]
    assert got[900]["score"] == got[901]["score"] == got[902]["score"] == 0 and got[903]["score"] < 0.5
    constant = toxicity.learned(docs, known.where("toxic = 1"))
    assert {x["score"] for x in toxicity.scored(docs, constant).collect()} == {1.0}
    assert {x["score"] for x in toxicity.scored(docs, toxicity.learned(docs, known.where("false"))).collect()} == {0.0}


def test_toxicity_is_learned_by_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"good day {'rotten' if k % 2 else 'calm'} sea") for k in range(40)], "doc_id long, text string")
    known = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    there = toxicity.trained([r["text"] for r in docs.collect()], [k % 2 for k in range(40)])
    monkeypatch.setattr(toxicity, "trained", None)
    model = toxicity.learned(docs, known)
    assert np.array_equal(model.weights, there.weights) and model[1:] == there[1:]


# 5 token counts


def brute_counts(text, rule):
    bpe = encoding.encoder(encoding.vocabulary_of())
    ids = bpe.encode(text)
    lines = re.findall(rb"[^\n]*\n|[^\n]+", text.encode()) or [b""]
    edges = np.cumsum([0, *map(len, lines)])
    out, at = [Fraction(0)] * len(lines), 0
    for i in ids.tolist():
        n = int(bpe.bytes_of[i])
        overlap = [max(0, min(at + n, int(edges[k + 1])) - max(at, int(edges[k]))) for k in range(len(lines))]
        if rule == "first":
            out[next(k for k, o in enumerate(overlap) if o)] += 1
        elif rule == "most":
            out[max(range(len(lines)), key=lambda k: (overlap[k], -k))] += 1
        else:
            for k, o in enumerate(overlap):
                out[k] += Fraction(o, n)
        at += n
    return [float(x) for x in out]


@pytest.mark.parametrize("rule", TC.RULES)
def test_token_counts(spark, rule):
    texts = ["a b\nc\n\n\nd é", "\n\n\n", "", None, "x", "Ünïcode\r\n\r\n text\n", "  \n  \n   z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in TC.token_counts(docs, rule=rule).collect():
        text = texts[r["doc_id"]] or ""
        assert np.allclose([s["tokens"] for s in r["sections"]], brute_counts(text, rule)) and sum(s["tokens"] for s in r["sections"]) == pytest.approx(r["n_tokens"])
        assert "".join(text[s["start"] : s["end"]] for s in r["sections"]) == text
        assert r["ids_sha256"] == encoding.digest(encoding.encoder(encoding.vocabulary_of()).encode(text))


def test_token_counts_of_fields(docs, empty):
    got = TC.token_counts(docs, fields=("source", "lang", "text"), lines=False).collect()
    assert len(got) == docs.count() and all([s["field"] for s in r["sections"]] == ["source", "lang", "text"] for r in got)
    assert TC.summary(TC.token_counts(empty)).count() == 0
    with pytest.raises(ValueError):
        TC.token_counts(docs, rule="last")


# 6 exact duplicates


def brute_exact(rows, pick):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r["text"])].append(r["doc_id"])
    best = {t: pick([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted(((r["doc_id"], best[t], len(groups[t]), r["doc_id"] == best[t], hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [lower(r["text"])]), key=repr)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(docs, empty, keep):
    pick = min if keep == "smallest" else max
    assert rows_of(exact_duplicates(docs, keep)) == brute_exact(docs.collect(), pick)
    assert exact_duplicates(empty, keep).count() == 0


@pytest.mark.parametrize("weak", [lambda t: (F.lit(b"x"), F.sha2(t, 256)), lambda t: (F.lit(b"x"), F.lit("y"))])
def test_colliding_hashes(docs, weak):
    assert rows_of(exact_duplicates(docs, "largest", digests=weak)) == brute_exact(docs.collect(), max)


# 7 near duplicates


def brute_near(rows, percent):
    sets = []
    for r in rows:
        w = re.findall(SPACED, lower(r["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [k for k, r in enumerate(rows) if sets[k] and r["doc_id"] is not None]
    for n, a in enumerate(live):
        for b in live[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    out = []
    for k, r in enumerate(rows):
        c = min(rows[j]["doc_id"] for j in live if root(j) == root(k)) if k in live else r["doc_id"]
        out.append((r["doc_id"], len(sets[k]), c, r["doc_id"] == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("percent", "wide"), [(85, 4096), (80, 4096), (85, 0), (80, 2)])
def test_near_duplicates(docs, monkeypatch, percent, wide):
    monkeypatch.setattr("graphloom.llm.near_dedup.WIDE", wide)
    assert rows_of(near_duplicates(docs, percent)) == brute_near(docs.collect(), percent)


@pytest.mark.parametrize("wide", [4096, 0])
def test_chains_and_large_groups(spark, monkeypatch, wide):
    """A chain in which only neighbours are alike, many copies of one text with a few words changed, and pages of one
    template, of which few are alike."""
    monkeypatch.setattr("graphloom.llm.near_dedup.WIDE", wide)
    r = random.Random(9)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(25):
        rows.append((1000 + k, " ".join(base)))
        base[(k * 7) % 100] = f"c{k}"
    base = [f"d{k}" for k in range(120)]
    for k in range(60):
        t = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            t[r.randrange(120)] = f"e{r.randrange(10**6)}"
        rows.append((2000 + k, " ".join(t)))
    base = [f"f{k}" for k in range(150)]
    for k in range(50):
        own = [f"g{k // 2}-{j}" for j in range(25)]
        own[k % 25] = f"h{k}"
        rows.append((3000 + k, " ".join(base + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_duplicates(docs)) == brute_near(docs.collect(), 85)


def test_near_duplicates_of_nothing(empty):
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 200), (200, 300), (7, 7), (None, 3), (500, 400), (400, 500)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100, 400: 400, 500: 400}


def test_components_in_chunks_and_rounds(spark, monkeypatch):
    r = random.Random(8)
    pairs = [(r.randrange(150), r.randrange(150)) for _ in range(110)] + [(k, k + 1) for k in range(1000, 1030)]
    known = {k: k for p in pairs if p[0] != p[1] for k in p}
    for _ in known:
        for a, b in pairs:
            if a != b:
                known[a] = known[b] = min(known[a], known[b])
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    for chunk in (1, 7, 1 << 19):
        monkeypatch.setattr("graphloom.llm.components.CHUNK", chunk)
        assert {x["id"]: x["component"] for x in components(edges).collect()} == known


def test_few_edges_are_tied_without_rounds(spark, monkeypatch):
    """Each round has a dozen exchanges, and for each the driver keeps a thread and a plan."""
    monkeypatch.setattr("graphloom.llm.components._stars", None)
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)], "a long, b long").repartition(3)
    assert {r["component"] for r in components(edges).collect()} == {0}


def test_joins_without_hot_keys_are_plain(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1000, F.col("id")).alias("key"), "id")
    dims = saved(spark.range(1000).select(F.col("id").alias("key"), F.lit(1).alias("n")), "dims")
    joined = joined_by(rows, dims, ["key"], "n")
    assert "_hot" not in joined._jdf.queryExecution().toString() and joined.count() == 1000
    hot = saved(rows.select(F.coalesce("key", F.lit(0)).alias("key")).groupBy("key").agg(F.count("*").alias("n")), "dims")
    joined = joined_by(rows.select(F.coalesce("key", F.lit(0)).alias("key"), "id"), hot, ["key"], "n")
    assert "_hot" in joined._jdf.queryExecution().toString() and joined.count() == 2000


# 8 sharding


def brute_filled(names, slots):
    orders = []
    for s in names:
        at, step = sharding._number(f"start {s}") % slots, sharding._number(f"step {s}") % (slots - 1) + 1
        orders.append([(at + k * step) % slots for k in range(slots)])
    table, taken = [None] * slots, 0
    while taken < slots:
        for k, order in enumerate(orders):
            slot = next((x for x in order if table[x] is None), None)
            if slot is not None:
                table[slot] = k
                taken += 1
    return table


def test_table_is_filled_in_turns():
    names = ["a", "b", "c", "d"]
    assert sharding.filled(names, 101) == brute_filled(names, 101)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.filled(bad, 101)
    with pytest.raises(ValueError):
        sharding.filled(names, 100)


def test_few_slots_move():
    names = [f"n{k}" for k in range(10)]
    before, after = sharding.filled(names, 5003), sharding.filled(names[:-1], 5003)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 9)
    assert moved < 0.1 * 5003 and max(collections.Counter(before).values()) - min(collections.Counter(before).values()) <= 1


def test_sharding(docs, empty):
    got = sharding.sharded(docs, 5, 101).collect()
    table = sharding.filled([f"shard-{k}" for k in range(5)], 101)
    assert len(got) == docs.count()
    for r in got:
        name = "null" if r["doc_id"] is None else f"k{r['doc_id']}"
        slot = int(hashlib.md5(name.encode()).hexdigest()[:12], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert sharding.sharded(empty).count() == 0


# 9 packing


def test_best_fit():
    r = random.Random(5)
    for _ in range(40):
        sizes = np.array([r.randint(0, 70) for _ in range(r.randint(0, 60))])
        rows = packing.packed(sizes, 32)
        pieces = sorted(p for row in rows for p in row)
        whole = collections.defaultdict(list)
        for d, a, n in pieces:
            whole[d].append((a, n))
        for d, n in enumerate(sizes.tolist()):
            at = 0
            for a, k in whole[d]:
                assert a == at
                at += k
            assert at == n
        assert all(0 < sum(n for _, _, n in row) <= 32 for row in rows)
        # each rest, longest first, into the row with the least room that takes it
        rooms, opened = [], 0
        for n in sorted((n % 32 for n in sizes.tolist() if n % 32), reverse=True):
            fit = min((x for x in rooms if x >= n), default=None)
            if fit is None:
                opened += 1
                fit = 32
            else:
                rooms.remove(fit)
            rooms.append(fit - n)
        assert len(rows) == opened + sum(n // 32 for n in sizes.tolist())


def test_packs_are_lossless(spark, docs, empty, tmp_path):
    bpe = encoding.encoder(encoding.vocabulary_of())
    path = str(tmp_path / "packs")
    packing.written(packing.packs(docs, row=64, group=5000), path)
    got = spark.read.parquet(path).collect()
    back = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["input_ids"], "<i4")
        assert len(ids) == 64 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        positions = np.frombuffer(r["position_ids"], "<u2").tolist()
        assert len(positions) == 64 and not any(positions[r["n_tokens"] :])
        assert (ids[r["n_tokens"] :] == bpe.end).all() and r["pack_sha256"] == encoding.digest(ids[: r["n_tokens"]])
        for d, a, s, e in zip(r["doc_ids"], r["offsets"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            back[d].append((a, ids[s:e]))
            assert positions[s:e] == list(range(e - s))
    plain = collections.Counter(r["doc_id"] for r in docs.collect())
    for r in docs.collect():
        if r["doc_id"] is not None and plain[r["doc_id"]] == 1:
            assert bpe.decode(np.concatenate([x for _, x in sorted(back[r["doc_id"]], key=lambda p: p[0])] or [np.zeros(0, int)])) == (r["text"] or "")
    assert packing.packs(empty).count() == 0


# 10 personal data

PATTERNS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= sum(c.isdigit() for c in s) <= 19 and personal.luhn([int(c) for c in s if c.isdigit()])),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= sum(c.isdigit() for c in s) <= 15),
]


def brute_spans(text):
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m[0])]
    return [(personal.BASE[k], b, e) for b, k, e in sorted(found)]


def test_patterns():
    r = random.Random(6)
    parts = ["a@b.c", "@", ".", "1", "255", "256", "0", "+1 (555) 123-4567", "4111111111111111", "4111 1111-1111 1111", " ", "-", "x", "é", "a.b@c-d.e.f", "1.2.3.4", "+", "(", "00", "@@a.b"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert personal.base_spans(text) == brute_spans(text), text


def test_decoding_is_exact():
    """The cut into stretches gives the best path of the whole line."""
    model = personal.trained()
    texts = ['the token = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f0a" and password: hunter2x9 SSN 123-45-6789', "Version 2.0, a token of thanks = x", "call (555)123-4567 or secret = abc123def456", "write to bob(at)site(dot)com", "call 555-987-6543"]
    w = personal._tokens(K.texts(pa.array(texts)))
    score = sum(model.emit[row] for row in w.features)
    got = personal.tags(model, w)
    assert all(got[w.doc == d][-1] for d in (3, 4))
    for d in range(len(texts)):
        e = score[w.doc == d].astype(float)
        best, back = model.move[0] + e[0], []
        for x in e[1:]:
            through = best[:, None] + model.move
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + x
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got[w.doc == d].tolist() == path[::-1]
    assert got[w.doc == 0].any()


def test_personal_data(spark, docs, empty):
    texts = ["mail a@b.co", 'é token = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f0a" x', None, ""]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = personal.trained()
    got = {r["doc_id"]: r for r in personal.digest(personal.personal_data(some, model)).collect()}
    assert got[0]["n_email"] == 1 and got[0]["spans"] == "email:5:11" and got[0]["base_sha256"] == hashlib.sha256(b"email:5:11").hexdigest()
    assert got[1]["spans"] == "secret:11:51" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() == got[2]["base_sha256"] and got[3]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in personal.masked(some, model).collect()}
    assert masked == {0: "mail <email>", 1: 'é token = "<secret>" x', 2: None, 3: ""}
    assert personal.digest(personal.personal_data(docs, model)).count() == docs.count()
    assert personal.digest(personal.personal_data(empty, model)).count() == 0
