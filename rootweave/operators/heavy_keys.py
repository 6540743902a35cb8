"""Per-key results when a few keys hold most rows.

Every aggregate here is algebraic (count, sum, min, max), so Spark's partial hash aggregation keeps one
bounded, spillable table of mergeable states per task and only those states shuffle: a key that holds a
third of all rows sends one state per task, not a third of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_end_states(rows: DataFrame, ends: list[Column], score: Column | None = None) -> DataFrame:
    """One row per key that stands at any of ``ends``: ``key, n_rows, n_scored, score_sum, score_min, score_max``.

    A row whose ends carry the same key counts once for it. Null ends are no keys. Null scores count in
    ``n_rows`` only. An empty table gives no rows. Extra columns are ignored.
    """
    keys = F.array_distinct(F.array_compact(F.array(*ends)))
    score = F.lit(None).cast("int") if score is None else score
    return (
        rows.select(keys.alias("keys"), score.alias("score"))
        .select(F.explode("keys").alias("key"), "score")
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("score").alias("n_scored"),
            F.sum("score").alias("score_sum"),
            F.min("score").alias("score_min"),
            F.max("score").alias("score_max"),
        )
    )


def keys_over_share(rows: DataFrame, ends: list[Column], parts: int, of: int) -> DataFrame:
    """Keys that take part in at least ``parts/of`` of all rows (``key, n_rows``).

    The total counts every row, also those without a key; it is a scalar subquery answered from a count,
    no join. Integer arithmetic keeps the bound exact.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    keys = F.array_distinct(F.array_compact(F.array(*ends)))
    counts = rows.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where(F.col("n_rows") * of >= total.scalar() * parts)
