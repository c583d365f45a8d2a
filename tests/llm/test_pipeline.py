"""The stages one after another, each against what it says it does."""

import corpus_pipeline as P
from graphloom.llm.contamination import contamination
from graphloom.llm.mixing import mixed
from graphloom.llm.near_dedup import near_duplicates

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = P.table(spark, FOLDER, "documents")
    seen = {}
    for name, stage in P.STAGES:
        before, docs = docs, P.saved(stage(spark, docs, FOLDER), "stage")
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == list(P.COLUMNS)
    before, after = seen["toxicity"]
    assert 0 < after.count() < before.count()
    before, after = seen["near duplicates"]
    groups = {r["component_id"] for r in near_duplicates(before, 80).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(groups)
    before, after = seen["decontamination"]
    clean = contamination(before, P.table(spark, FOLDER, "benchmark")).where("not contaminated")
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in clean.collect())
    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    before, after = seen["sharding"]
    assert after.count() == before.count() and {"slot", "shard"} <= set(after.columns)


def test_stages_take_nothing(spark):
    docs = P.table(spark, FOLDER, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = P.saved(stage(spark, docs, FOLDER), "stage")
    assert docs.count() == 0


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def prose(start, n=60):
    return " ".join(f"w{k}" for k in range(start, start + n))


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark, tmp_path):
    spark.createDataFrame([(1, prose(0, 10))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, prose(100)), (5, prose(200)), (None, None), (6, prose(300)), (6, prose(300))]
    rows = [*clean, (None, prose(0)), (5, prose(0, 20))]
    assert left(P.drop_benchmark(spark, made(spark, rows), str(tmp_path))) == sorted(clean, key=repr)


def test_one_row_stays_of_each_group_of_near_copies(spark):
    a, near_a, b, c, d, e = prose(0), prose(0) + " end", prose(200), prose(400), prose(600), prose(800)
    kept = [(3, a), (5, b), (None, c), (8, d), (2, e), (None, None), (None, "")]
    gone = [(5, near_a), (None, c), (None, c + " end"), (8, d), (None, e), (9, e + " end")]
    assert left(P.drop_near_copies(spark, made(spark, kept + gone), "")) == sorted(kept, key=repr)


def test_each_row_is_mixed_by_its_own_draws(spark):
    rows = [(None, prose(k * 100, 20 + k)) for k in range(20)] + [(k % 4, prose(k * 100, 50)) for k in range(40, 80)]
    docs = [(i, t, "en", f"s{k % 3}", 1) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    mix = mixed(docs, whole=True)
    words = {r["source"]: 0 for r in mix.draws.collect()}
    for r in mix.draws.collect():
        words[r["source"]] += r["words"]
    got = {s: 0 for s in words}
    for r in P.mix_sources(spark, docs, "").collect():
        got[r["source"]] += len(r["text"].split())
    assert got == words
