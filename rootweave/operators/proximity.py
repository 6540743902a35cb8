"""Network proximity of node sets with a degree-matched permutation z-score, for many pairs in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.operators import graph as g
from rootweave.operators import pairs
from rootweave.operators.sampling import degree_matched
from rootweave.session import cut


def members_in(graph: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` (``pair, side, node``) without nodes the graph doesn't have; repeats removed."""
    return sets.select("pair", "side", "node").distinct().join(g.nodes(graph), "node", "left_semi")


def samples(graph: DataFrame, sets: DataFrame, n_random: int, seed: int) -> DataFrame:
    """``pair, side, it, node``: it = 0 are the sets themselves, 1..n_random degree-matched draws."""
    inside = members_in(graph, sets)
    buckets = cut(g.degree_buckets(g.degrees(graph)), "buckets")
    drawn = degree_matched(inside, buckets, n_random, seed)
    return inside.withColumn("it", F.lit(0)).select("pair", "side", "it", "node").unionByName(drawn)


def closest_directed(graph: DataFrame, sampled: DataFrame) -> DataFrame:
    """``pair, it, d``: mean over side A of the distance to the nearest node of side B; infinity if none is reached.

    The distance of a to the set B is a's level in one search that starts from all of B, so the state is
    samples x nodes and not sources x nodes; the search of a sample ends with its last node of side A. Repeated
    draws in A count each; repeats in B don't matter.
    """
    key = F.concat_ws("#", "pair", F.col("it").cast("string"))
    sampled = cut(sampled.withColumn("key", key), "samples")
    side = lambda s: sampled.where(F.col("side") == s)
    level = g.bfs(g.neighbours(graph), side("B").select("key", "node"), side("A").select("key", "node"))
    a = side("A").join(level, ["key", "node"], "left")
    return a.groupBy("pair", "it").agg(F.coalesce(F.avg("d"), F.lit(float("inf"))).alias("d"))


def mean_all_pairs(graph: DataFrame, sampled: DataFrame) -> DataFrame:
    """``pair, it, d``: mean over all pairs of a node of side A and one of side B, repeats counted, unreachable
    pairs left out; infinity if none is reached.

    Pairs are never listed (see ``pairs.sums``).
    """
    sampled = cut(sampled.groupBy("pair", "it", "side", "node").agg(F.count(F.lit(1)).alias("times")), "samples")
    side = lambda s: sampled.where(F.col("side") == s)
    mean = pairs.sums(graph, sampled).select("pair", "it", (F.col("total") / F.nullif("n", F.lit(0))).alias("d"))
    all_ = side("A").join(side("B").select("pair", "it").distinct(), ["pair", "it"], "left_semi").select("pair", "it").distinct()
    return all_.join(mean, ["pair", "it"], "left").withColumn("d", F.coalesce("d", F.lit(float("inf"))))


def summary(values: DataFrame) -> DataFrame:
    """``pair, d, z, mean, std, p, n`` from ``pair, it, d``. Only finite samples count; the standard deviation is
    that of a population, z is 0 without spread, p the share of samples at or below the observed value."""
    inf = F.lit(float("inf"))
    seen = values.where("it = 0").select("pair", F.col("d").alias("observed"))
    null = values.where("it > 0").join(seen, "pair").where(F.col("d") < inf)
    s = null.groupBy("pair").agg(
        F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.avg((F.col("d") <= F.col("observed")).cast("double")).alias("p"), F.count(F.lit(1)).alias("n")
    )
    z = F.when(F.col("std") < 1e-12, 0.0).otherwise((F.col("observed") - F.col("mean")) / F.col("std"))
    return seen.join(s, "pair").select("pair", F.col("observed").alias("d"), z.alias("z"), "mean", "std", "p", "n")


#: Distance of two sets by name.
METRICS = {"closest_directed": closest_directed, "mean_all_pairs": mean_all_pairs}


def proximity(graph: DataFrame, sets: DataFrame, n_random: int = 100, seed: int = 42, metric: str = "closest_directed") -> DataFrame:
    """Proximity of every pair of sets (``pair, side`` 'A' or 'B', ``node``) by one of METRICS. A pair with an empty side has no row."""
    return summary(METRICS[metric](graph, samples(graph, sets, n_random, seed)))
