"""Samples of a bounded size for fitting a model: the same rows in every run, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F


#: The most rows of one id, or of ids with one hash.
SAME = 4


def sampled(rows: DataFrame, by: str, limit: int | dict, most_values: int, order_by: str = "doc_id") -> list[Row]:
    """At most `limit` rows (a number, or one for each value) of each value of column `by`: those whose hashed id is
    least, and of those of one id SAME at most. Raises if `by` has more than `most_values` values.

    Each value's rows are thinned by a hash to little over the limit where they are read, and only those are gathered.
    """
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().limit(most_values + 1).collect()}
    if len(counts) > most_values:
        raise ValueError(f"{by} has more than {most_values} values")
    if not counts:
        return []
    most = {v: limit[v] if isinstance(limit, dict) else limit for v in counts}
    share = F.coalesce(*(F.when(F.col(by).eqNullSafe(F.lit(v)), F.lit(min(1.0, (1.5 * most[v] + 50) / n))) for v, n in counts.items()), F.lit(1.0))
    spot = F.pmod(F.xxhash64(F.lit(29), order_by), F.lit(1 << 30))
    thin = rows.withColumn("_spot", spot).where(F.col("_spot") < share * (1 << 30))
    # an id that very many rows share would come with all of them
    content = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))
    ranked = Window.partitionBy(by, "_spot").orderBy(content)
    thin = thin.withColumn("_content", content).withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= SAME).collect()
    thin.sort(key=lambda r: (r["_spot"], r["_content"]))
    taken: dict = {}
    out = []
    for r in thin:
        taken[r[by]] = taken.get(r[by], 0) + 1
        if taken[r[by]] <= most[r[by]]:
            out.append(r)
    return out
