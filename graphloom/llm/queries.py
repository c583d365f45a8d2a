"""The query of each operator over the whole tables of a folder, and DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, personal, toxicity
from .contamination import contamination
from .exact_dedup import exact_duplicates
from .mixing import mixed, words_taken
from .near_dedup import near_duplicates
from .packing import packs, written
from .session import table
from .sharding import filled, sharded
from .tables import shared_folder
from .token_counts import summary, token_counts

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many of its words the mix takes."""
    return words_taken(mixed(table(spark, sf_dir, "documents")))


def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words inside benchmark windows, and a digest of the items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row", "hits", "items")


def _remainder(parts: int) -> Column:
    """What is held out of learning goes by a document's id alone; a null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts, F.lit(-1))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its language, by a model that has seen none of the documents held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.learned(docs.where(_remainder(4).isin(0, 1, 3)))
    found = language.identified(docs, model)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its toxicity, by a model that has seen no label of the documents held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learned(docs, table(spark, sf_dir, "labels").where(_remainder(5) > 0))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its tokens, and those of each of its lines."""
    return summary(token_counts(table(spark, sf_dir, "documents")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: of equal texts the largest doc_id stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its slot and shard."""
    return sharded(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packed row of ids: its segments, their documents, and digests of its ids and of its position ids, which
    are taken from the written rows."""
    path = f"{shared_folder(spark)}/packs-{uuid.uuid4().hex}"
    written(packs(table(spark, sf_dir, "documents")), path)
    rows = spark.read.parquet(path)
    ids, places = F.expr("substring(input_ids, 1, 4 * n_tokens)"), F.expr("substring(position_ids, 1, 2 * n_tokens)")
    return rows.select(
        F.sha2(ids, 256).alias("pack_sha256"),
        "n_tokens",
        "doc_ids",
        "offsets",
        "cu_seqlens",
        (F.length("input_ids") / 4).cast("int").alias("n_ids"),
        F.sha2(places, 256).alias("positions_sha256"),
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many spans of each pattern, their digest, and all spans."""
    return personal.digest(personal.personal_data(table(spark, sf_dir, "documents")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its set's size, its group's least doc_id, and whether it is that document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_contamination": op2_contamination,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_exact_dedup": op6_exact_dedup,
    "op9_packing": op9_packing,
    "op8_sharding": op8_sharding,
    "op7_near_dedup": op7_near_dedup,
    "op10_personal_data": op10_personal_data,
}

#: The table of shards, as the query has it, one after another.
_SHARDS = ",".join(map(str, filled([f"shard-{k}" for k in range(64)])))
_LETTERED = r"regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("{_AZ}", _AZ)

SQL: dict[str, str] = {
    "op2_contamination": rf"""
WITH i AS MATERIALIZED (SELECT item_id, {_LETTERED} AS w FROM benchmark WHERE text IS NOT NULL),
q AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)
), d AS MATERIALIZED (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_LETTERED} END AS w FROM documents),
p AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT d.*, s.n, unnest(range(1, len(w) - s.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM q) s WHERE len(w) >= s.n)
), m AS MATERIALIZED (SELECT doc_id, k, p.n, item_id FROM p JOIN q USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_exact_dedup": f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op8_sharding": f"""
WITH t AS MATERIALIZED (SELECT string_split('{_SHARDS}', ',') AS shards),
d AS (SELECT doc_id, (('0x' || substr(md5(coalesce('k' || doc_id, 'null')), 1, 12))::BIGINT % 65537)::INT AS slot FROM documents)
SELECT doc_id, slot, shards[slot + 1]::INT AS shard FROM d, t""",
    "op7_near_dedup": rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a WHERE r.c < e.b),
m AS (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)""",
}
