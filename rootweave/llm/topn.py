"""The N best items of every group, also where one group holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.session import cut

#: A group is hot with at least HOT_ITEMS items (what one window task may sort), or with at least HOT_ROWS items
#: and 1/HOT_PARTS of all (what would keep one task busy after the others).
HOT_ITEMS, HOT_ROWS, HOT_PARTS = 1_000_000, 10_000, 1000


def top_n(rows: DataFrame, n: int, hot_rows: int = HOT_ROWS, hot_parts: int = HOT_PARTS, hot_items: int = HOT_ITEMS) -> DataFrame:
    """``rows``: ``grp, item, score`` -> ``grp, item, score, place`` with place 1..n.

    An item's score is its highest; order is score descending, then item ascending, so ties always fall the
    same way. Rows with a null in any of the three are left out; repeated rows change nothing; an empty table
    gives none. Groups with fewer than n items keep all.

    Rows are combined on (group, item) before they shuffle, which also spreads a group over all tasks. Exact
    counts of the items split the groups. Cold groups go to an ordinary window, so none of its groups has
    ``hot_items``. Hot ones are range-partitioned on (group, score, item): the ranges are the salts, equal scores
    included, and each keeps only its first n rows of a group before the last shuffle (Catalyst's window group
    limit), so a hot group meets in one task as n rows per range. The list of hot groups is broadcast only if
    Spark finds it small.
    """
    rows = rows.select("grp", "item", "score").where("grp is not null and item is not null and score is not null")
    best = cut(rows.groupBy("grp", "item").agg(F.max("score").alias("score")), "best-scores")
    counts = best.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    share = (F.col("n") >= hot_rows) & (F.col("n") * hot_parts >= best.agg(F.count(F.lit(1)).alias("n")).scalar())
    hot = cut(counts.where((F.col("n") >= hot_items) | share).select("grp"), "hot-groups")
    order = [F.col("score").desc(), F.col("item")]
    place = F.row_number().over(Window.partitionBy("grp").orderBy(*order))
    ranked = lambda df: df.withColumn("place", place).where(F.col("place") <= n)
    cold = ranked(best.join(hot, "grp", "left_anti"))
    warm = ranked(best.join(hot, "grp", "left_semi").repartitionByRange("grp", *order))
    return cold.unionByName(warm)
